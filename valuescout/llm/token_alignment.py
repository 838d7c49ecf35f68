"""Tokens of two tokenizers over the same bytes, aligned across a corpus.

Both token sequences of a text end at sorted byte offsets; merging the two
lists tells which tokens overlap and where both end. The merge is cut by
merge-path partitioning: a binary search along each of many equally spaced
diagonals finds how many ends of either list lie before it, so that pieces have
equal work whether a task holds one huge text or thousands of small ones. Each
piece is merged alone and emits its overlaps; an end that both lists have, but
that a diagonal splits between two pieces, is stitched afterwards.

Which pairs of ids end together, and how often in all documents, is counted by
Spark; a second pass over the stored pairs of each document looks the counts up.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from valuescout.llm.bpe import _codec, default_vocabulary
from valuescout.llm.names import blocks, lazily, tidily
from valuescout.session import cut_lineage, written_table

PIECE = 8192  # ends of both lists in a piece of the merge
TABLE_PAIRS = 1 << 22  # id pairs that travel to the tasks at once
BLOCK_BYTES = 1 << 20
_FLUSH = 1 << 20


class _Pieces:
    """Encoder of a sentencepiece model and the bytes of its ids."""

    def __init__(self, model):
        import sentencepiece

        self._core = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._raw(self._core.id_to_piece(i)) for i in range(self._core.get_piece_size())]

    @staticmethod
    def _raw(piece):
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts):
        return [np.array(x, np.int64) for x in self._core.encode(texts, num_threads=1)]


class _Kept(dict):
    """A cache that travels to tasks empty."""

    def __reduce__(self):
        return _Kept, ()


_MODELS = _Kept()


def _model(definition):
    if definition not in _MODELS:
        _MODELS[definition] = _Pieces(definition)
    return _MODELS[definition]


def diagonals(a, b, piece):
    """Merge-path split points: how many of a and of b lie before each diagonal.

    Equal ends count a's first. Both lists are strictly increasing.
    """
    at = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        i, j = middle[open_], (at - middle)[open_] - 1
        before = a[i] <= b[j]
        low[open_] = np.where(before, i + 1, low[open_])
        high[open_] = np.where(before, high[open_], i)
    return low, at - low


def _merged_piece(a, b):
    """Overlaps of one piece: how many ends of a and b come before each end,
    and whether both lists end there. Equal ends are one overlap."""
    twin = np.searchsorted(b, a)
    both = np.zeros(len(a), bool)
    inside = twin < len(b)
    both[inside] = b[twin[inside]] == a[inside]
    own = np.ones(len(b), bool)
    own[twin[both]] = False
    rest = np.flatnonzero(own)
    ends = np.concatenate([a, b[rest]])
    order = np.argsort(ends, kind="stable")
    before_a = np.concatenate([np.arange(len(a)), np.searchsorted(a, b[rest])])[order]
    before_b = np.concatenate([twin, rest])[order]
    return ends[order], before_a, before_b, np.concatenate([both, np.zeros(len(rest), bool)])[order]


def overlaps(a, b, piece=PIECE):
    """All overlapping token pairs of two lists of ends, in order.

    Returns token numbers of a, token numbers of b, and whether both end there.
    """
    split_a, split_b = diagonals(a, b, piece)
    ends, of_a, of_b, close = [], [], [], []
    for i, j, to_i, to_j in zip(split_a[:-1], split_b[:-1], split_a[1:], split_b[1:]):
        end, before_a, before_b, both = _merged_piece(a[i:to_i], b[j:to_j])
        for column, new in zip((ends, of_a, of_b, close), (end, before_a + i, before_b + j, both)):
            column.append(new)
    # stitch: an end that stands on both sides of a border is one overlap
    for k in range(1, len(ends)):
        if len(ends[k]) and len(ends[k - 1]) and ends[k][0] == ends[k - 1][-1]:
            close[k - 1][-1] = True
            ends[k], of_a[k], of_b[k], close[k] = ends[k][1:], of_a[k][1:], of_b[k][1:], close[k][1:]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *of_a]), np.concatenate([none, *of_b]), np.concatenate([none.astype(bool), *close])


def _numerals(size, marks):
    """Each id in decimal with each mark behind it, as fixed-width bytes."""
    width = len(str(max(size - 1, 0))) + 1
    return np.array([f"{i}{mark}".encode() for mark in marks for i in range(size)], f"S{width}")


class _Aligner:
    def __init__(self, vocabulary, model, piece):
        self.a, self.b, self.piece = _codec(vocabulary), _model(model), piece
        self.length_a, self.length_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        size = max(len(self.length_a), len(self.length_b))
        self.numerals = _numerals(size, ",|;")
        self.size = size

    def align(self, texts):
        """Per text: numbers of tokens, groups as text, linked id pairs."""
        ids_a = [self.a._core.encode_to_numpy(" " + t).astype(np.int64) if t else np.zeros(0, np.int64) for t in texts]
        ids_b = self.b.encode(texts)
        for d, text in enumerate(texts):
            whole = (" " + text).encode()
            joined = (b"".join(map(codec.bytes.__getitem__, ids[d].tolist())) for codec, ids in ((self.a, ids_a), (self.b, ids_b)))
            if not text or any(x != whole for x in joined):
                ids_a[d] = ids_b[d] = np.zeros(0, np.int64)
        count_a, count_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        of_a, of_b, close = overlaps(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), self.piece)
        n_overlaps = np.bincount(np.repeat(np.arange(len(texts)), count_a)[of_a], minlength=len(texts))
        of_a, of_b = of_a[close], of_b[close]
        doc = np.searchsorted(np.cumsum(count_a), of_a, side="right")
        return {
            "n_a": count_a,
            "n_b": count_b,
            "n_groups": np.bincount(doc, minlength=len(texts)),
            "n_overlaps": n_overlaps,
            "groups": self._groups(a, b, of_a + 1, of_b + 1, count_a + count_b),
            **_pairs(doc, a[of_a], b[of_b], len(texts)),
        }

    def _groups(self, a, b, stop_a, stop_b, length):
        start_a, start_b = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (stop_a, stop_b))
        code = np.zeros(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[stop_a - 1], mark_b[stop_b - 1] = 1, 2
        code[np.arange(len(a)) + np.repeat(start_b, stop_a - start_a)] = a + mark_a * self.size
        code[np.arange(len(b)) + np.repeat(stop_a, stop_b - start_b)] = b + mark_b * self.size
        edge = np.concatenate([[0], np.cumsum(length)])
        out = []
        for i, j in zip(edge[:-1], edge[1:]):
            out.append(self.numerals[code[i:j]].tobytes().translate(None, b"\0")[:-1].decode())
        return out


def _pairs(doc, a, b, docs):
    """Distinct linked pairs of each text and how often it has them, as lists."""
    pair, which = np.unique((a << 32) | b, return_inverse=True)
    key, count = np.unique(doc * max(1, len(pair)) + which, return_counts=True)
    doc, pair = key // max(1, len(pair)), pair[key % max(1, len(pair))] if len(pair) else pair
    edges = pa.array(np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32))

    def lists(values):
        return pa.ListArray.from_arrays(edges, pa.array(values.astype(np.int32)))

    return {"link_a": lists(pair >> 32), "link_b": lists(pair & 0xFFFFFFFF), "link_n": lists(count)}


_ALIGNED = (
    "n_a long, n_b long, n_groups long, n_overlaps long, groups string, "
    "link_a array<int>, link_b array<int>, link_n array<int>"
)


@tidily
def _aligned(batches, vocabulary, model, piece, schema):
    aligner = _Aligner(vocabulary, model, piece)
    for batch in batches:
        for some, raw in blocks(range(batch.num_rows), lazily(batch["text"]), BLOCK_BYTES):
            part = batch.slice(some[0], len(some))
            new = aligner.align([r.decode() for r in raw])
            new = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in new.items()}
            columns = [new[f.name].cast(f.type) if f.name in new else part[f.name] for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def align_tokenizers(docs: DataFrame, vocabulary, model, id_col="doc_id", text_col="text", carry=(), piece=PIECE) -> DataFrame:
    """Align the tokens of a byte-level BPE and of a sentencepiece model.

    `vocabulary` is the path of a tokenizers definition, `model` that of a
    sentencepiece model with byte fallback; both are read on the driver. The
    first one gets a space before the text, as the second one adds it itself.
    Strings of special tokens are plain text.

    Returns id, rest (a struct of the columns named in `carry`), n_a, n_b
    (tokens), n_groups, n_overlaps (overlapping token pairs), groups (text like
    `a1,a2|b1;a3|b2,b3`: ids between two offsets at which both have an end),
    link_a, link_b, link_n (ids of tokens that end together, each pair once
    with the number of its occurrences).

    Defined cases: null and empty texts, and texts that either tokenizer does
    not give back byte by byte, have no tokens; equal texts have equal results,
    each row its own; long texts are encoded whole and merged in pieces; an
    empty table gives an empty result; columns not named are ignored, whatever
    they are called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(vocabulary, "rb") as file:
        first = file.read()
    with open(model, "rb") as file:
        second = file.read()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    result = f"id {rows.schema['id'].dataType.simpleString()}, rest {rows.schema['rest'].dataType.simpleString()}, {_ALIGNED}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    return rows.mapInArrow(lambda batches: _aligned(batches, first, second, piece, schema), result)


def _flat(batch):
    """Linked pairs of a batch as one array: row, pair code, occurrences."""
    a, b, n = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("link_a", "link_b", "link_n"))
    length = np.asarray(batch["link_a"].value_lengths().fill_null(0))
    return np.repeat(np.arange(batch.num_rows), length), (a << 32) | b, n


def _summed(parts):
    code, n = (np.concatenate(x) for x in zip(*parts))
    code, which = np.unique(code, return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, which, n)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(total)], ["pair", "n"])


@tidily
def _counted(batches):
    parts, size = [], 0
    for batch in batches:
        _, code, n = _flat(batch)
        parts.append((code, n))
        size += len(code)
        if size >= _FLUSH:
            yield _summed(parts)
            parts, size = [], 0
    if parts:
        yield _summed(parts)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How often each pair of ids ends together in all documents.

    Returns link_a, link_b, n, best (whether no other link_a is more frequent
    with this link_b). The table is bounded by the two vocabularies.
    """
    sums = aligned.select("link_a", "link_b", "link_n").mapInArrow(_counted, "pair long, n long")
    sums = sums.groupBy("pair").agg(F.sum("n").alias("n"))
    sums = sums.select(
        F.shiftright("pair", 32).cast("int").alias("link_a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("link_b"), "n"
    )
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("link_b")))


@tidily
def _scored(batches, codes, counts, best, schema):
    for batch in batches:
        row, code, n = _flat(batch)
        at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
        known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        row, at, n = row[known], at[known], n[known]
        new = {}
        for name, value in (("n_links", n), ("n_best", n * best[at]), ("count_sum", n * counts[at])):
            total = batch[name].to_numpy(zero_copy_only=False).copy()
            np.add.at(total, row, value)
            new[name] = pa.array(total)
        yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch[f.name] for f in schema], schema=schema)


def score_links(aligned: DataFrame) -> DataFrame:
    """Add n_links, n_best and count_sum to the rows of `align_tokenizers`.

    A link counts as best if its pair's count is the highest of its second id;
    count_sum adds up the counts of all links. The rows are written once, read
    for the counts and read again to look them up. Counts travel to the tasks
    in tables of at most `TABLE_PAIRS` pairs; if there are more pairs, the rows
    are gone through once for each table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = written_table(aligned)
    pairs = cut_lineage(pair_counts(rows))
    tables = max(1, -(-pairs.count() // TABLE_PAIRS))
    number = F.pmod(F.xxhash64("link_a", "link_b"), F.lit(tables))
    zero = F.lit(0).cast("long")
    rows = rows.select("*", zero.alias("n_links"), zero.alias("n_best"), zero.alias("count_sum"))
    schema = to_arrow_schema(rows.schema)
    for t in range(tables):
        some = pairs.filter(number == t).toArrow()
        code = (some["link_a"].to_numpy().astype(np.int64) << 32) | some["link_b"].to_numpy()
        order = np.argsort(code)
        table = code[order], some["n"].to_numpy()[order], some["best"].to_numpy()[order]
        rows = rows.mapInArrow(lambda batches, table=table: _scored(batches, *table, schema), rows.schema)
        if t + 1 < tables:
            rows = written_table(rows)
    return rows.drop("link_a", "link_b", "link_n")


def default_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned = align_tokenizers(docs, default_vocabulary(), default_model())
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    scored = score_links(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return scored.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"
    )


def brute_force(rows, vocabulary, model):
    """The same with the two libraries and dictionaries, for tests.

    `rows` are (id, text); returns the columns of the query, groups unhashed.
    """
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer, decoders

    first = Tokenizer.from_file(vocabulary)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    assert isinstance(first.decoder, decoders.ByteLevel)

    def raw(piece):
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    found = []
    for doc, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = [(i, raw(second.id_to_piece(i))) for i in second.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in x) != whole for x in (a, b)):
            a, b = [], []
        ends = []
        for tokens in (a, b):
            at, here = 0, {}
            for i, t in tokens:
                at += len(t)
                here[at] = i
            ends.append(here)
        groups, links, open_ = [], [], ([], [])
        for end in sorted({*ends[0], *ends[1]}):
            for here, ids in zip(ends, open_):
                ids += [here[end]] if end in here else []
            if end in ends[0] and end in ends[1]:
                links.append((ends[0][end], ends[1][end]))
                groups.append("|".join(",".join(map(str, ids)) for ids in open_))
                open_ = ([], [])
        found.append((doc, len(a), len(b), groups, links, len(set(ends[0]) | set(ends[1]))))
    counts = Counter(link for f in found for link in f[4])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (doc, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups), both)
        for doc, n_a, n_b, groups, links, both in found
    ]
