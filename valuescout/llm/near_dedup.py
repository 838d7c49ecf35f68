"""Near-duplicate documents: one-permutation MinHash, bands, star edges.

Documents with the same set of shingles are one class; one of its documents
stands for all. Signatures (`minhash`) are cut into bands; documents that
agree in a band share a bucket. Each bucket has one hub, the member that meets
most others in all its buckets, and every other member is compared with it
only, so a bucket of m documents makes m - 1 pairs. All pairs are confirmed on
the full sets.

A star can miss a link between two members that are not like the hub. So
buckets whose members are still in different components are gone through
again, in blocks of bounded size: signatures rule out pairs that are far from
alike, the others are confirmed on the full sets in the task, each pair in the
first bucket it shares. Only links that join components leave the task.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from valuescout.llm.components import components
from valuescout.llm.minhash import SHINGLE, band_keys, set_keys, shingle_sets, signatures
from valuescout.llm.names import blocks, lazily, tidily
from valuescout.session import cut_lineage

BINS, ROWS = 250, 5
SKETCH = 128
# five standard deviations below a similarity of 0.75, by sketch and signature
_FAR, _FAR_WHOLE = 0.55, 0.61
BLOCK = 512

_SIGNED = "doc_id long, n long, ka long, kb long, bands array<long>, sketch binary"


@tidily
def _signed(batches):
    for batch in batches:
        rows = zip(batch["doc_id"].to_pylist())
        for some, raw in blocks(rows, lazily(batch["text"])):
            text, name, _ = shingle_sets(raw)
            (ka, kb), n = set_keys(text, name, len(raw))
            signature = signatures(text, name, len(raw), BINS)
            bands = band_keys(signature, ROWS)
            edges = np.arange(len(raw) + 1, dtype=np.int32) * bands.shape[1]
            sketch = (signature[:, :SKETCH] & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for (x,) in some], pa.int64()),
                    pa.array(n.astype(np.int64)),
                    pa.array(ka.view(np.int64)),
                    pa.array(kb.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(bands.ravel().view(np.int64))),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                ],
                ["doc_id", "n", "ka", "kb", "bands", "sketch"],
            )


def _sketches(column):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


@tidily
def _likely(batches):
    """Pairs whose sketches do not rule out that they are alike."""
    for batch in batches:
        if batch.num_rows:
            near = (_sketches(batch["sketch"]) == _sketches(batch["hub_sketch"])).mean(axis=1) >= _FAR
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _grouped(batches, keys):
    """Whole groups of rows that are sorted by their keys, batch by batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        values = np.stack([table[k].to_numpy() for k in keys], axis=1)
        edge = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *edge], edge):
            yield table.slice(start, stop - start)
        rest = table.slice(edge[-1] if len(edge) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _links_in(group, percent, unpack):
    """Links between different components within one block or two."""
    component, own = group["component"].to_numpy(), group["block"].to_numpy()
    if (component == component[0]).all():
        return
    doc, band = group["doc_id"].to_numpy(), group["band"][0].as_py()
    two = group["low"][0].as_py() != group["high"][0].as_py()
    text, name, _ = shingle_sets([unpack(t) for t in group["text"].to_pylist()])
    signature = signatures(text, name, len(doc), BINS)
    earlier = band_keys(signature, ROWS)[:, :band]
    edge = np.searchsorted(text, np.arange(len(doc) + 1))
    n = np.diff(edge)
    for i in range(len(doc)):
        other = i + 1 + np.flatnonzero((component != component[i])[i + 1 :])
        other = other[own[other] != own[i]] if two else other
        other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
        other = other[(signature[other] == signature[i]).mean(axis=1) >= _FAR_WHOLE]
        other = other[~(earlier[other] == earlier[i]).any(axis=1)]
        for j in other:
            common = len(np.intersect1d(name[edge[i] : edge[i + 1]], name[edge[j] : edge[j + 1]], assume_unique=True))
            if component[i] != component[j] and 100 * common >= percent * (n[i] + n[j] - common):
                component = np.where(component == component[j], component[i], component)
                yield min(doc[i], doc[j]), max(doc[i], doc[j])


@tidily
def _across(batches, percent):
    unpack = zstandard.ZstdDecompressor().decompress
    for group in _grouped(batches, ("bucket", "low", "high")):
        links = list(_links_in(group, percent, unpack)) if group.num_rows > 1 else ()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])


@tidily
def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = pa.array([pack(t.as_buffer()) for t in batch["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], texts], ["doc_id", "text"])


@tidily
def _confirmed(batches, percent):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        if not batch.num_rows:
            continue
        both = [batch[c].to_pylist() for c in ("text_a", "text_b")]
        number = {t: i for i, t in enumerate(dict.fromkeys(both[0] + both[1]))}
        sets = []
        for _, raw in blocks(range(len(number)), [unpack(t) for t in number]):
            text, name, _ = shingle_sets(raw)
            edge = np.searchsorted(text, np.arange(len(raw) + 1))
            sets += [name[a:b] for a, b in zip(edge, edge[1:])]
        alike = []
        for x, y in zip(*both):
            x, y = sets[number[x]], sets[number[y]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            alike.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(alike))


def confirmed_links(pairs: DataFrame, docs: DataFrame, percent) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike.

    Only here do texts move: compressed, once by id, and the smaller ids'
    texts a second time to meet their partners.
    """
    texts = docs.mapInArrow(_packed, "doc_id long, text binary")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = both.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: _confirmed(b, percent), "a long, b long")
    return cut_lineage(links.distinct())


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", percent=75) -> DataFrame:
    """Component of near-duplicates for every row: doc_id, n_shingles,
    component_id (least id that can be reached) and kept.

    Two documents are linked if the distinct 5-word shingles of their texts,
    A to Z lower-cased, have an intersection of at least `percent` % of the
    union. Bands find a pair at 75 % but for one time in a million.

    Defined cases: a text with fewer than five words is one shingle; a null
    or blank text has none and is linked with nothing; a row without an id
    can't be named as the end of a link, so it has no component and is kept;
    rows with the same id are one document with the links of all of them;
    an empty table gives an empty result; columns not named are ignored,
    whatever they are called.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    signed = cut_lineage(rows.mapInArrow(_signed, _SIGNED))
    named = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    texts = rows.filter(F.col("doc_id").isNotNull())

    classes = cut_lineage(named.groupBy("ka", "kb").agg(F.min("doc_id").alias("rep")))
    reps = named.join(classes, ["ka", "kb"]).filter(F.col("doc_id") == F.col("rep"))
    reps = cut_lineage(reps.select("doc_id", "n", "ka", "bands", "sketch").dropDuplicates(["doc_id", "ka"]))

    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    full = cut_lineage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    met = banded.join(full, "bucket")
    degree = met.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    members = cut_lineage(met.join(degree, "doc_id").select("band", "bucket", "size", "doc_id", "degree"))

    draw = F.struct(-F.col("degree"), "doc_id")
    hubs = cut_lineage(members.groupBy("bucket").agg(F.min(draw).alias("hub")))
    star = members.join(hubs, "bucket").select(
        F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")
    )
    star = cut_lineage(star.filter(F.col("a") < F.col("b")).distinct())
    facts = reps.select("doc_id", "n", "sketch")
    for end, n, sketch in (("a", "n", "sketch"), ("b", "hub_n", "hub_sketch")):
        star = star.join(facts.select(F.col("doc_id").alias(end), F.col("n").alias(n), F.col("sketch").alias(sketch)), end)
    star = star.filter(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
    star = star.select("a", "b", "sketch", "hub_sketch").mapInArrow(_likely, "a long, b long")
    star = cut_lineage(star.distinct())
    links = confirmed_links(star, texts, percent)
    found = cut_lineage(components(links))

    # what the stars may have missed: pairs across components of one bucket
    placed = members.select("band", "bucket", "size", "doc_id").join(found, F.col("doc_id") == F.col("node"), "left")
    placed = cut_lineage(placed.withColumn("component", F.coalesce("component", "doc_id")).drop("node"))
    whose = [F.sum(F.xxhash64("doc_id", F.lit(i)).cast("decimal(38,0)")).alias(f"whose{i}") for i in (0, 1)]
    torn = placed.groupBy("band", "bucket", "size").agg(F.min("component").alias("least"), F.max("component").alias("most"), *whose)
    torn = torn.filter(F.col("least") != F.col("most"))
    # of buckets with the same members the first will do
    torn = torn.groupBy("size", "whose0", "whose1").agg(F.min(F.struct("band", "bucket")).alias("first"))
    torn = cut_lineage(torn.select("first.bucket"))
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = placed.join(torn, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), count).cast("int"))
    spread = spread.join(texts.mapInArrow(_packed, "doc_id long, text binary"), "doc_id")
    spread = spread.withColumn("partner", F.explode(F.sequence(F.lit(0), count - 1)))
    spread = spread.withColumn("low", F.least("block", "partner")).withColumn("high", F.greatest("block", "partner"))
    keys = ["bucket", "low", "high"]
    spread = spread.select(*keys, "band", "block", "component", "doc_id", "text")
    spread = spread.repartition(*keys).sortWithinPartitions(*keys)
    across = spread.mapInArrow(lambda b: _across(b, percent), "a long, b long")
    links = cut_lineage(links.union(across).distinct())
    found = cut_lineage(components(links))

    of_class = signed.drop("bands", "sketch").join(classes, ["ka", "kb"], "left")
    out = of_class.join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id"))
    component = component.otherwise(F.coalesce("component", "rep", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def op8_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows, percent=75):
    """The same by comparing all pairs, for small tables in tests."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        words = ("" if text is None else text).translate(lower).encode().split()
        grams = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    component = {i: i for i, _ in rows}
    again = True
    linked = []
    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                linked.append((rows[x][0], rows[y][0]))
    while again:
        again = False
        for a, b in linked:
            least = min(component[a], component[b])
            again |= component[a] != component[b]
            component[a] = component[b] = least
    return [(i, len(s), component[i], component[i] == i) for (i, _), s in zip(rows, sets)]
