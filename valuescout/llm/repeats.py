"""Find token windows that repeat anywhere in a corpus, by doubling.

Shared by the operators that remove repeated words and repeated bytes. The
levels, for windows of n tokens and grams of k = ceil(n / 4) tokens:

k   every window is stood for by its anchor, the least k-gram inside. Anchors
    are sorted by (name of the gram, name of the whole span of windows with
    that anchor). A gram that is alone ends here: none of its windows repeats.
    Spans that are equal as a whole are past n already and are settled here.
2k  what is left, the first of each distinct span whose gram also stands in
    another span, is extended to twice the length on either side; halves that
    are alone end here.
n   windows that reach this level are named one by one and sorted by name.

Each level is one sort of (name, place) pairs by Spark; names are made where
the text lies. Text is shuffled once, by document, and that shuffle is read
again at each level. Before each shuffle by name a task settles what its own
documents decide, so that a name sends two rows per task at most, however
many copies it has; no group is gathered anywhere.
"""

from collections import namedtuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from valuescout.llm.names import ByteTokens, Running, WordTokens, anchored, blocks, lazily, mixed, sorted_by, tidily

OPEN, REMOVED, CANDIDATE, BOTH = 0, 1, 2, 3
_FLUSH = 1_000_000
_ROWS = 256
_LISTS = {"name": pa.int64(), "whole": pa.int64(), "did": pa.int64(), "tag": pa.int32(), "start": pa.int32(), "more": pa.int32()}
_PACKED = "bucket int, name array<long>, whole array<long>, did array<long>, tag array<int>, start array<int>, more array<int>"
_U = np.uint64

Method = namedtuple("Method", "tokens n keep_first buckets")


def numbered(docs: DataFrame, id_col, text_col, carry) -> DataFrame:
    """One row per input row: did and sub identify it, whatever the ids are.

    Rows of one id are told apart by a number in the order of their texts; a
    null id is replaced by a number that depends on the text alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    rows = docs.select(
        F.coalesce(ident, F.xxhash64(text)).alias("did"),
        ident.alias("id"),
        text.cast("binary").alias("text"),
        F.xxhash64(text).alias("tie"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"),
    )
    rows = rows.mapInArrow(_compressed, rows.schema)
    order = Window.partitionBy("did").orderBy("tie", "text", F.col("id").asc_nulls_first())
    return rows.repartition("did").withColumn("sub", F.row_number().over(order) - 1).drop("tie")


@tidily
def _compressed(batches):
    """Texts travel compressed: they are most of what the shuffles move."""
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        at = batch.schema.get_field_index("text")
        texts = pa.array([pack(t.as_buffer()) for t in batch["text"]], pa.binary())
        yield batch.set_column(at, batch.schema.field(at), texts)


def _texts(column):
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(t) for t in lazily(column))


def _packed(name, whole, did, tag, place, known, buckets):
    """Places with their names, one row per bucket of names.

    Lists of numbers take about half the room of single rows in a shuffle.
    Places that are settled already need no name and are spread evenly.
    """
    place = np.asarray(place, np.int64)
    name = np.where(known, _U(0), name)
    whole = np.where(known, _U(0), whole)
    spread = np.where(known, mixed(did.astype(_U), place.astype(_U)), mixed(name))
    bucket = (spread % _U(buckets)).astype(np.int32)
    order = np.lexsort((place, did, bucket))
    bucket = bucket[order]
    columns = (name.view(np.int64), whole.view(np.int64), did, tag, place >> 32, place & 0xFFFFFFFF)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    edges = pa.array(np.append(at, len(bucket)).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(edges, pa.array(x[order].astype(kind.to_pandas_dtype()), kind))
        for x, kind in zip(columns, _LISTS.values())
    ]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *lists], ["bucket", *_LISTS])


def _pack(start, count, offset=0):
    return (np.asarray(start, np.int64) << 32) | (np.asarray(count, np.int64) << 16) | np.asarray(offset, np.int64)


def _unpack(place):
    place = np.asarray(place, np.int64)
    return place >> 32, (place >> 16) & 0xFFFF, place & 0xFFFF


def _nth(new):
    """Number of each row within its group; `new` marks the groups' first rows."""
    at = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(at, np.diff(np.append(at, len(new))))


class _Spans:
    """Collects the spans of a task and settles what they decide by themselves."""

    def __init__(self, method):
        self.method, self.parts, self.size = method, [], 0

    def add(self, *columns):
        self.parts.append(columns)
        self.size += len(columns[0])

    def flush(self):
        if not self.size:
            return
        name, whole, did, sub, place = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = sorted_by(name, place, sub, did, whole)
        name, whole, did, sub, place = (x[order] for x in (name, whole, did, sub, place))
        new_name, new_whole = np.ones(len(name), bool), np.ones(len(name), bool)
        new_name[1:] = name[1:] != name[:-1]
        new_whole[1:] = new_name[1:] | (whole[1:] != whole[:-1])
        nth = _nth(new_whole)
        group = np.cumsum(new_whole) - 1
        many = np.bincount(group)[group] > 1
        wholes = np.cumsum(new_whole)
        spare = wholes - wholes[np.flatnonzero(new_name)][np.cumsum(new_name) - 1] >= 2
        kind = np.full(len(name), OPEN)
        if self.method.keep_first:
            kind[nth > 0] = REMOVED
            kind[spare & (nth == 0)] = CANDIDATE
        else:
            kind[(nth > 1) | (spare & (nth > 0))] = REMOVED
            kind[spare & (nth == 0)] = np.where(many, BOTH, CANDIDATE)[spare & (nth == 0)]
        yield _packed(name, whole, did, sub * 4 + kind, place, kind != OPEN, self.method.buckets)


@tidily
def _first_level(batches, method):
    n, k = method.n, -(-method.n // 4)
    out = _Spans(method)
    for batch in batches:
        rows = zip(batch["did"].to_pylist(), batch["sub"].to_pylist())
        for some, raw in blocks(rows, _texts(batch["text"])):
            tokens = method.tokens(raw)
            grams = tokens.grams(k)
            doc, lo, hi, anchor = anchored(grams, tokens.first, n, k)
            ids = np.array(some, np.int64).reshape(-1, 2)
            out.add(
                grams[anchor],
                tokens.running.names(lo, hi + n),
                ids[doc, 0],
                ids[doc, 1],
                _pack(lo - tokens.first[doc], hi - lo + 1, anchor - lo),
            )
            if out.size >= _FLUSH:
                yield from out.flush()
    yield from out.flush()


class _Names:
    """Collects named places and lets two of a kind (or one) through."""

    def __init__(self, method, through):
        self.method, self.through, self.parts, self.size = method, through, [], 0

    def add(self, *columns):
        self.parts.append(columns)
        self.size += len(columns[0])

    def flush(self):
        if not self.size:
            return
        name, check, did, sub, place = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = sorted_by(name, place, sub, did, check)
        name, check, did, sub, place = (x[order] for x in (name, check, did, sub, place))
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
        known = _nth(new) >= self.through
        yield _packed(name, check, did, sub * 4 + known, place, known, self.method.buckets)


class _Listed:
    """A column of lists of (tag, place), read without a Python object each."""

    def __init__(self, column):
        length = np.asarray(column.value_lengths().fill_null(0))
        self.edge = np.concatenate([[0], np.cumsum(length)])
        flat = column.flatten()
        self.tag, self.place = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tag", "place"))

    def of(self, row, sub):
        """Tags' kinds and places of the items in one row that are `sub`'s."""
        here = slice(self.edge[row], self.edge[row + 1])
        tag, place = self.tag[here], self.place[here]
        mine = tag >> 2 == sub
        return tag[mine] & 3, place[mine]


def _candidate_rows(batches, method):
    """Blocks of the documents that have candidates, with their spans."""
    for batch in (b.slice(at, 8 * _ROWS) for b in batches for at in range(0, b.num_rows, 8 * _ROWS)):
        rows, texts = [], []
        unpack = zstandard.ZstdDecompressor().decompress
        spans = _Listed(batch["spans"])
        halves = _Listed(batch["halves"]) if "halves" in batch.schema.names else None
        for row, (did, sub) in enumerate(zip(batch["did"].to_pylist(), batch["sub"].to_pylist())):
            kind, place = spans.of(row, sub)
            place = np.sort(place[kind >= CANDIDATE])
            if len(place):
                rows.append((did, sub, place, halves.of(row, sub)[1] if halves else place[:0]))
                texts.append(unpack(batch["text"][row].as_py()))
        for some, raw in blocks(rows, texts):
            yield some, method.tokens(raw)


@tidily
def _second_level(batches, method):
    n, k = method.n, -(-method.n // 4)
    out = _Names(method, 2)
    for some, tokens in _candidate_rows(batches, method):
        size = [len(x[2]) for x in some]
        doc = np.repeat(np.arange(len(some)), size)
        ids = np.array([x[:2] for x in some], np.int64)[doc]
        start, count, offset = _unpack(np.concatenate([x[2] for x in some]))
        first = tokens.first[doc]
        anchor = start + offset
        for side, begin in ((0, anchor), (1, anchor - k)):
            fits = offset - count + 1 <= n - 2 * k if side == 0 else offset >= k
            begin = (begin + first)[fits]
            name = tokens.running.names(begin, begin + 2 * k)
            # two that are taken for equal here are only looked at again
            out.add(name, np.zeros_like(name), ids[fits, 0], ids[fits, 1], _pack(anchor[fits], side))
        if out.size >= _FLUSH:
            yield from out.flush()
    yield from out.flush()


@tidily
def _last_level(batches, method):
    n, k = method.n, -(-method.n // 4)
    out = _Names(method, 1 if method.keep_first else 2)
    for some, tokens in _candidate_rows(batches, method):
        doc = np.repeat(np.arange(len(some)), [len(x[2]) for x in some])
        start, count, offset = _unpack(np.concatenate([x[2] for x in some]))
        alive = np.concatenate([x[3] for x in some])
        owner = np.repeat(np.arange(len(some)), [len(x[3]) for x in some])
        halves = set(zip(owner.tolist(), (alive >> 16).tolist()))
        anchor = start + offset
        keys = [((anchor << 16) | side).tolist() for side in (0, 1)]
        right, left = (np.array([(d, x) in halves for d, x in zip(doc.tolist(), key)], bool) for key in keys)
        span = np.repeat(np.arange(len(start)), count)
        window = start[span] + _nth(np.append(True, span[1:] != span[:-1]) if len(span) else np.zeros(0, bool))
        before = anchor[span] - window
        may = ((before > n - 2 * k) | right[span]) & ((before < k) | left[span])
        window, doc = window[may], doc[span][may]
        begin = window + tokens.first[doc]
        ids = np.array([x[:2] for x in some], np.int64)[doc]
        grams = tokens.grams(n)
        out.add(grams[begin], tokens.running.names(begin, begin + n), ids[:, 0], ids[:, 1], _pack(window, 1))
        if out.size >= _FLUSH:
            yield from out.flush()
    yield from out.flush()


def _lists(rows, name):
    return rows.groupBy("did").agg(F.collect_list(F.struct("tag", "place")).alias(name))


@tidily
def _removed_rows(batches, method, finish, schema):
    unpack = zstandard.ZstdDecompressor().decompress
    # few rows at a time become Python objects
    for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
        spans, windows = _Listed(batch["spans"]), _Listed(batch["windows"])
        out = []
        for row, (sub, text) in enumerate(zip(batch["sub"].to_pylist(), lazily(batch["text"]))):
            kind, place = spans.of(row, sub)
            gone = np.concatenate([place[(kind == REMOVED) | (kind == BOTH)], windows.of(row, sub)[1]])
            start, count, _ = _unpack(gone)
            out.append(finish(unpack(text).decode(), merged(start, start + count - 1 + method.n)))
        made = [pa.array([x[f.name] for x in out], f.type) if f.name in out[0] else batch[f.name] for f in schema]
        yield pa.RecordBatch.from_arrays(made, schema=schema)


def merged(start, stop):
    """Maximal runs of the union of intervals, as two arrays."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], stop[last]


def without_repeats(docs: DataFrame, method, id_col, text_col, carry, finish, fields) -> DataFrame:
    """Apply `finish(text, (starts, stops))` to each text and its repeated runs.

    `method.keep_first` spares the first copy in the order of ids; without it
    every copy counts. `finish` returns a dict with the columns of `fields`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    method = method._replace(buckets=max(256, 4 * partitions))
    if not method.tokens.least_window <= method.n < 1 << 15:
        raise ValueError(f"a window has {method.tokens.least_window} to 32,767 tokens")
    # all levels read the same columns, so that they share one shuffle of texts
    rows = numbered(docs, id_col, text_col, carry)

    def level(function, df):
        packed = df.mapInArrow(lambda batches: function(batches, method), _PACKED).repartition("bucket")
        rows = packed.select("bucket", F.explode(F.arrays_zip(*_LISTS)).alias("row")).select("bucket", "row.*")
        place = F.shiftleft(F.col("start").cast("long"), 32) + F.col("more")
        return rows.select("bucket", "name", "whole", "did", "tag", place.alias("place"))

    # level k: sort (gram, span) pairs
    alike = Window.partitionBy("bucket", "name", "whole")
    pair = alike.orderBy("did", "tag", "place")
    gram = Window.partitionBy("bucket", "name")
    kind = F.col("tag").bitwiseAND(F.lit(3))
    spans = (
        level(_first_level, rows)
        .withColumn("nth", F.row_number().over(pair))
        .withColumn("many", F.count(F.lit(1)).over(alike) > 1)
        .withColumn("shared", F.min("whole").over(gram) != F.max("whole").over(gram))
    )
    first = F.col("nth") == 1
    gone = ~first if method.keep_first else F.col("many")
    found = gone.cast("long") * REMOVED + (first & F.col("shared")).cast("long") * CANDIDATE
    spans = spans.withColumn("tag", F.when(kind != OPEN, F.col("tag")).otherwise(F.col("tag") + found))
    spans = _lists(spans.filter(F.col("tag").bitwiseAND(F.lit(3)) != OPEN), "spans")

    # level 2k: both extensions of each candidate
    halves = level(_second_level, rows.join(spans, "did", "left"))
    halves = halves.withColumn("many", F.count(F.lit(1)).over(alike) > 1)
    halves = _lists(halves.filter(F.col("many") | (kind != OPEN)), "halves")

    # level n: the windows that are left
    windows = level(_last_level, rows.join(spans, "did", "left").join(halves, "did", "left"))
    again = F.row_number().over(pair) > 1 if method.keep_first else F.count(F.lit(1)).over(alike) > 1
    windows = windows.withColumn("again", again).filter(F.col("again") | (kind != OPEN))
    windows = _lists(windows, "windows")

    result = f"id long, rest {rows.schema['rest'].dataType.simpleString()}, {fields}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    joined = rows.join(spans, "did", "left").join(windows, "did", "left")
    return joined.mapInArrow(lambda batches: _removed_rows(batches, method, finish, schema), result)


__all__ = ["ByteTokens", "Method", "Running", "WordTokens", "merged", "numbered", "without_repeats"]
