"""Hard negatives of anchor vectors, scored with tables of subset sums.

Four-Russians scoring: components become integers, and of every eight
dimensions of an anchor all 256 subset sums are tabled. A candidate is kept as
bit planes, one byte per plane and group of eight dimensions; each byte picks
a subset sum, and the sums of the planes, shifted to their weight, add up to
the exact inner product.

Anchors and candidates meet in blocks: candidates are dealt to blocks by a
hash of the whole row, anchors to blocks of their own, and each pair of blocks
is one group of bounded size, whatever the ids and labels are. A first round
finds the positives, a second one the negatives below each positive.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from valuescout.session import cut_lineage

BLOCK = 4096  # rows of one side that meet in a group
_ANCHORS, _CANDIDATES = 256, 512  # scored at a time, so that tables stay in the cache
_LIMIT = float(1 << 31)


def planes(values, bits):
    """Two's complement bit planes of integer rows: (rows, planes, bytes)."""
    weights = np.arange(bits, dtype=values.dtype)
    bit = (values[:, None, :] >> weights[None, :, None]) & 1
    return np.packbits(bit.astype(np.uint8), axis=2, bitorder="little")


def integers(packed):
    """The integer rows that `planes` was made from."""
    bit = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = np.left_shift(np.int64(1), np.arange(packed.shape[1], dtype=np.int64))
    weights[-1] = -weights[-1]
    return np.einsum("rpd,p->rd", bit, weights)


def subset_sums(anchors, kind):
    """Sums of all subsets of each eight dimensions: (groups, 256, anchors)."""
    groups = anchors.shape[1] // 8
    parts = anchors.T.reshape(groups, 8, len(anchors)).astype(kind)
    sums = np.zeros((groups, 256, len(anchors)), kind)
    for i in range(8):
        sums[:, 1 << i : 2 << i] = sums[:, : 1 << i] + parts[:, i : i + 1]
    return sums


def scores(anchors, packed):
    """Exact inner products of integer anchors and packed candidates.

    Sums that leave 64 bits wrap around, as long arithmetic does.
    """
    bits, groups = packed.shape[1:]
    bound = 8 * groups << 2 * (bits - 1)
    kind = np.int32 if bound < 1 << 30 else np.int64
    out = np.zeros((len(anchors), len(packed)), np.int64)
    for a in range(0, len(anchors), _ANCHORS):
        tables = subset_sums(anchors[a : a + _ANCHORS], kind)
        for c in range(0, len(packed), _CANDIDATES):
            some = packed[c : c + _CANDIDATES]
            total = np.zeros((len(some), tables.shape[2]), kind)
            for plane in range(bits - 1, -1, -1):
                here = tables[0].take(some[:, plane, 0], axis=0) if groups else np.zeros_like(total)
                for g in range(1, groups):
                    here += tables[g].take(some[:, plane, g], axis=0)
                # the highest plane has negative weight
                total = -here if plane == bits - 1 else 2 * total + here
            out[a : a + _ANCHORS, c : c + _CANDIDATES] = total.T
    return out


def _packed(batches, bits, groups):
    for batch in batches:
        values = np.zeros((batch.num_rows, 8 * groups), np.int64)
        column = batch["q"]
        length = np.asarray(column.value_lengths())
        row = np.repeat(np.arange(batch.num_rows), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        values[row, place] = column.flatten().to_numpy(zero_copy_only=False)
        flat = planes(values, bits).reshape(batch.num_rows, -1)
        edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * flat.shape[1])
        data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, edges.buffers()[1], pa.py_buffer(flat.tobytes())])
        names = ["vec_id", "label", "asks", "hash"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), data], [*names, "planes"])


def _unpacked(column, bits, groups):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), bits, groups)


def _block(candidates, anchors, bits, groups):
    """One group's rows: candidates in the order of ids, anchors as integers."""
    candidates = candidates.sort_by("vec_id")
    found = pa.chunked_array([*candidates["label"].chunks, *anchors["own"].chunks], pa.string())
    codes = found.combine_chunks().dictionary_encode().indices.to_numpy()
    ids = candidates["vec_id"].to_numpy()
    packed = _unpacked(candidates["planes"], bits, groups)
    return ids, codes[: len(ids)], packed, codes[len(ids) :], integers(_unpacked(anchors["own_planes"], bits, groups))


def _first(values, count):
    """Places of the largest values, ties in the order they stand."""
    return np.argsort(~values, kind="stable")[:count]


_POSITIVES = "anchor_id long, own_hash long, positive_id long, positive_score long"


def _positives(candidates, anchors, bits, groups, count):
    out = [[], [], [], []]
    if candidates.num_rows and anchors.num_rows:
        ids, labels, packed, wanted, values = _block(candidates, anchors, bits, groups)
        who, which = anchors["anchor_id"].to_numpy(), anchors["own_hash"].to_numpy()
        for label in np.unique(wanted):
            mine, same = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
            found = scores(values[mine], packed[same])
            for a, row in zip(mine, found):
                other = ids[same] != who[a]
                best = _first(row[other], count)
                for column, new in zip(out, (np.full(len(best), who[a]), np.full(len(best), which[a]), ids[same][other][best], row[other][best])):
                    column.append(new)
    return _table(out, _POSITIVES)


def _table(columns, schema):
    names = [part.split()[0] for part in schema.split(", ")]
    kept = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, kept)})


_NEGATIVES = "anchor_id long, own_hash long, positive_id long, positive_score long, negative_id long, negative_score long"


def _negatives(candidates, anchors, bits, groups, count, low, high):
    out = [[], [], [], [], [], []]
    if candidates.num_rows and anchors.num_rows:
        ids, labels, packed, own, values = _block(candidates, anchors, bits, groups)
        who, which = anchors["anchor_id"].to_numpy(), anchors["own_hash"].to_numpy()
        found = scores(values, packed)
        for a, (row, positives) in enumerate(zip(found, anchors["positives"].to_pylist())):
            # exact bounds of whole numbers; a negative score has no range below it
            ranges = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
            least, most = min(r[0] for r in ranges), max(r[1] for r in ranges)
            may = np.flatnonzero((labels != own[a]) & (row >= least) & (row <= most))
            may = may[_first(row[may], None)]
            falling = row[may]
            for p, (lo, hi) in zip(positives, ranges):
                start = len(falling) - np.searchsorted(falling[::-1], hi, side="right")
                stop = len(falling) - np.searchsorted(falling[::-1], lo, side="left")
                best = may[start : min(stop, start + count)] if start < stop else may[:0]
                same = (who[a], which[a], p["id"], p["score"])
                for column, new in zip(out, (*(np.full(len(best), x) for x in same), ids[best], row[best])):
                    column.append(new)
    return _table(out, _NEGATIVES)


def hard_negatives(
    vectors: DataFrame,
    anchors,
    id_col="vec_id",
    vector_col="embedding",
    label_col="label",
    scale=256,
    positives=5,
    negatives=10,
    low=30,
    high=90,
) -> DataFrame:
    """Rows of other labels that score from `low` to `high` % of a positive.

    `anchors` is a boolean Column. Components are floor(scale * x), scores are
    inner products of whole numbers. An anchor's positives are the first
    `positives` other rows of its label; for each, the first `negatives` rows
    of another label inside the range are returned. Higher scores come first,
    ties go to the smaller id.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    Defined cases: rows without id, label or vector, with a null or non-finite
    component, or with one of 2**31 or more after scaling, take no part;
    missing components of a shorter vector count as zero; an empty vector
    scores zero; equal rows (id, label and scaled vector) count once; other
    rows that share an id are rows of their own, but never positives of an
    anchor with that id; a positive of negative score has no negatives; an
    empty table gives an empty result; columns not named are ignored, whatever
    they are called.
    """
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * float(scale)))
    given = F.col(vector_col).cast("array<double>")
    usable = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < _LIMIT))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & given.isNotNull() & usable)
    rows = rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
        scaled.alias("q"),
    )
    shape = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("asks").alias("asking"),
        F.max(F.size("q")).alias("size"),
        F.max(F.array_max("q")).alias("most"),
        F.min(F.array_min("q")).alias("least"),
    ).first()
    groups = -(-(shape["size"] or 0) // 8)
    bits = 1 + max((shape["most"] or 0).bit_length(), (~(shape["least"] or 0)).bit_length())
    blocks, parts = max(1, -(-shape["rows"] // BLOCK)), max(1, -(-shape["asking"] // BLOCK))

    distinct = rows.dropDuplicates(["vec_id", "label", "q"]).withColumn("hash", F.xxhash64("vec_id", "label", "q"))
    packed = "vec_id long, label string, asks boolean, hash long, planes binary"
    rows = cut_lineage(distinct.mapInArrow(lambda b: _packed(b, bits, groups), packed))

    def number(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    block = F.pmod("hash", F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int")
    by = ("block", "part")
    dealt = rows.select("vec_id", "label", "planes", block.alias("block"), number(parts).alias("part"))
    asking = rows.filter("asks").select(
        F.col("vec_id").alias("anchor_id"), F.col("hash").alias("own_hash"), F.col("label").alias("own"), F.col("planes").alias("own_planes"), part.alias("part")
    )
    asked = asking.withColumn("block", number(blocks))
    near = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(
        lambda c, a: _positives(c, a, bits, groups, positives), _POSITIVES
    )
    first = Window.partitionBy("anchor_id", "own_hash").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    pairs = F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))
    wanted = near.groupBy("anchor_id", "own_hash").agg(pairs.alias("positives"))
    asked = asking.join(wanted, ["anchor_id", "own_hash"]).withColumn("block", number(blocks))
    hard = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(
        lambda c, a: _negatives(c, a, bits, groups, negatives, low, high), _NEGATIVES
    )
    best = Window.partitionBy("anchor_id", "own_hash", "positive_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM given a JOIN given b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def brute_force(rows, anchors, scale=256, positives=5, negatives=10, low=30, high=90):
    """The same by plain sums, for small tables in tests.

    `rows` are (id, vector, label); `anchors` tells of an id whether it asks.
    """
    import math

    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, str(label), tuple(math.floor(scale * x) for x in v)))
    out = []
    for i, label, q in kept:
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, other)), j, lab) for j, lab, other in kept]
        near = sorted((s, j) for s, j, lab in scored if lab == label and j != i)[:positives]
        for p, j in near:
            fits = sorted((s, n) for s, n, lab in scored if lab != label and low * -p <= 100 * -s <= high * -p)
            out += [(i, j, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(fits[:negatives])]
    return out
