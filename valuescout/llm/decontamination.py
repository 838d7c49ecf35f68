"""Benchmark passages inside documents, found by Wu-Manber search.

Documents and benchmark items become lower-case words with one space around
each, so that a window of words is a byte string with a space at either end.
All windows of the benchmark are searched at once: a table tells by the block
of bytes at the end of the search window how far it may jump, blocks on which
a window may end have a bucket of test strings, and those are compared byte by
byte. Test strings are searched in classes of like length, because the
shortest one bounds the jumps.

Documents are not shuffled: the tables travel to them. A set of tables covers
a bounded part of the benchmark; a bigger benchmark is searched part by part,
and only what each part finds is brought together.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valuescout.llm.names import blocks, lazily, tidily
from valuescout.llm.repeats import merged
from valuescout.session import cut_lineage

PART_BYTES = 4 << 20  # benchmark text that one set of tables covers
BLOCK_BYTES = 4 << 20  # document text searched at a time
_LANE = 1024
_PAIRS = 1 << 20
_SPACE, _EDGE = 32, 0
_U = np.uint64
_CLASSES = (3, 8, 16, 32, 1 << 62)  # lengths of test strings in bytes


def _word_bytes():
    """Each byte as it counts in a word, 0 where it separates words."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for first, last, shift in ((0x30, 0x39, 0), (0x61, 0x7A, 0), (0x41, 0x5A, 32)):
        table[first : last + 1] = np.arange(first, last + 1) + shift
    return table


_TABLE = _word_bytes()


class Words:
    """Texts as one byte string: an edge, then each word between spaces."""

    def __init__(self, raw):
        size = np.array([len(r) for r in raw], np.int64)
        edge = 1 + np.concatenate([[0], np.cumsum(size + 3)])  # of each text, and one after the last
        data = _TABLE[np.frombuffer(b"\0\0\0".join([b"", *raw, b""]), np.uint8)]
        word = data != 0
        after = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        data[after] = data[edge + 1] = _SPACE
        word[after] = word[edge] = word[edge + 1] = True
        self.size = int(np.count_nonzero(word))
        self.data = np.concatenate([data[word], np.zeros(8, np.uint8)])
        body = self.data[: self.size]
        self.start = np.flatnonzero((body[1:] > _SPACE) & (body[:-1] == _SPACE)) + 1
        self.stop = np.flatnonzero((body[1:] == _SPACE) & (body[:-1] > _SPACE)) + 1
        self.first = np.searchsorted(self.start, np.flatnonzero(body == _EDGE))

    def eights(self):
        """The eight bytes from each place on as one number; reads no copy."""
        return np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))


class _Class:
    """Jump table and buckets of the test strings from `least` bytes on."""

    def __init__(self, eights, start, length, chosen):
        self.chosen = chosen
        start, length = start[chosen], length[chosen]
        self.window = int(min(length.min(), 255))
        self.block = 8 if self.window >= 16 else min(4, self.window)
        last = self.window - self.block
        self.mask = _U(0xFFFFFFFFFFFFFFFF >> (64 - 8 * self.block))
        blocks = sum(len(np.unique(eights[start + j])) for j in range(0, last + 1, max(1, last // 4))) * max(1, last // 4)
        self.down = _U(64 - min(24, max(12, int(8 * blocks).bit_length())))
        self.jump = np.full(1 << int(64 - self.down), last + 1, np.uint8)
        for j in range(last + 1):  # the later, the shorter the jump
            self.jump[self.hash(eights[start + j])] = last - j
        ends = self.hash(eights[start + last])
        order = np.argsort(ends, kind="stable")
        self.bucket, self.at = np.unique(ends[order], return_index=True)
        self.at = np.append(self.at, len(order))
        self.chosen = chosen[order]

    def hash(self, eight):
        return ((eight & self.mask) * _U(0x9E3779B97F4A7C15)) >> self.down

    def places(self, eights, size):
        """Where the window may lie: many cursors jump through the text at once."""
        end = size - self.window + 1
        cursor = np.arange(0, max(0, end), _LANE)
        stop = np.minimum(cursor + _LANE, end)
        ahead, found = self.window - self.block, []
        while len(cursor):
            jump = self.jump[self.hash(eights[cursor + ahead])]
            found.append(cursor[jump == 0])
            cursor = cursor + np.maximum(jump, 1)
            on = cursor < stop
            cursor, stop = cursor[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def pairs(self, eights, size):
        """Places with each test string of their bucket, in bounded portions."""
        place = self.places(eights, size)
        key = self.hash(eights[place + (self.window - self.block)])
        at = np.minimum(np.searchsorted(self.bucket, key), len(self.bucket) - 1)
        place, at = place[self.bucket[at] == key], at[self.bucket[at] == key]
        count = self.at[at + 1] - self.at[at]
        total = np.cumsum(count)
        begin = 0
        while begin < len(place):
            base = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, base + _PAIRS, side="right")))
            n = count[begin:stop]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(place[begin:stop], n), self.chosen[np.repeat(self.at[at[begin:stop]], n) + nth]
            begin = stop


class Matcher:
    """Search for all word windows of some benchmark items at once.

    `items` are (name, UTF-8 text). An item of fewer than n words is one
    window as a whole, an item without words has none.
    """

    def __init__(self, items, n):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.words = words = Words([text for _, text in items])
        have = np.diff(words.first)
        owners = {}
        for item, first, count in zip(items, words.first.tolist(), have.tolist()):
            for w in range(first, first + max(count - n, 0) + 1) if count else ():
                size = min(n, count)
                text = words.data[words.start[w] - 1 : words.stop[w + size - 1] + 1].tobytes()
                owners.setdefault(text, (words.start[w] - 1, size, set()))[2].add(number[item[0]])
        self.start = np.array([o[0] for o in owners.values()], np.int64)
        self.length = np.array([len(t) for t in owners], np.int64)
        self.count = np.array([o[1] for o in owners.values()], np.int64)
        self.owners = [sorted(o[2]) for o in owners.values()]
        kind = np.searchsorted(_CLASSES, self.length, side="right")
        eights = words.eights()
        self.classes = [_Class(eights, self.start, self.length, np.flatnonzero(kind == k)) for k in np.unique(kind)]

    def _same(self, text, place, which):
        """Which test strings really stand at their places, compared in full."""
        mine, other = self.words.eights(), text.eights()
        length, start = self.length[which], self.start[which]
        kept = np.flatnonzero(place + length <= text.size)
        short = kept[length[kept] < 8]
        mask = _U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * length[short].astype(_U))
        right = (other[place[short]] & mask) == (mine[start[short]] & mask)
        short, kept = short[right], kept[length[kept] >= 8]
        at, done = 0, [short]
        while len(kept):
            last = at + 8 >= length[kept]
            step = np.minimum(at, length[kept] - 8)
            equal = other[place[kept] + step] == mine[start[kept] + step]
            done.append(kept[equal & last])
            kept = kept[equal & ~last]
            at += 8
        return np.concatenate(done)

    def find(self, raw):
        """For each text: words, runs of hit words, numbers of the items found."""
        text = Words(raw)
        eights = text.eights()
        first, size, which = [], [], []
        for kind in self.classes:
            for place, test in kind.pairs(eights, text.size):
                right = self._same(text, place, test)
                first.append(np.searchsorted(text.start, place[right]))
                which.append(test[right])
        count = np.diff(text.first)
        runs, items = [[] for _ in raw], [[] for _ in raw]
        if first:
            first, which = np.concatenate(first), np.concatenate(which)
            doc = np.searchsorted(text.first, first, side="right") - 1
            # one more place between texts keeps their runs apart
            start, stop = merged(first + doc, first + doc + self.count[which])
            owner = np.searchsorted(text.first + np.arange(len(text.first)), start, side="right") - 1
            base = text.first[owner] + owner
            for d, a, b in zip(owner.tolist(), (start - base).tolist(), (stop - base).tolist()):
                runs[d].append({"start": a, "stop": b})
            for d, w in zip(*np.unique(np.stack([doc, which]), axis=1).tolist()):
                items[d].append(self.owners[w])
        return count, runs, [functools.reduce(set().union, x, set()) for x in items]


_FOUND = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


@tidily
def _found(batches, matcher, schema, hits_only):
    for batch in batches:
        for some, raw in blocks(range(batch.num_rows), lazily(batch["text"]), BLOCK_BYTES):
            part = batch.slice(some[0], len(some))
            count, runs, items = matcher.find(raw)
            names = [sorted(matcher.names[i] for i in x) for x in items]
            new = {"n_words": pa.array(count, pa.int64())}
            new |= {k: pa.array(v, schema.field(k).type) for k, v in (("spans", runs), ("items", names))}
            out = pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part[f.name] for f in schema], schema=schema)
            yield out.filter(pa.array([bool(r) for r in runs])) if hits_only else out


def contaminated_words(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", n=10, carry=()
) -> DataFrame:
    """Words of each document that lie in a passage of a benchmark item.

    Words are runs of digits, letters and all characters beyond ASCII, with
    A-Z in lower case. A passage is `n` consecutive words of an item, or all
    words of an item that has fewer.

    Returns id, rest (a struct of the columns named in `carry`), n_words,
    spans (runs of hit words) and items (ids of the items found, as strings in
    order).

    Defined cases: a null, empty or wordless text has no words and no hits; an
    item without words is never found; items that share an id are one item; an
    item without id goes by the empty string; equal documents have equal
    results, each row its own; very long texts are searched whole; an empty
    table on either side is no error; columns not named are ignored, whatever
    they are called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    def raw(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), raw(item_text).alias("text"))
    items = items.filter(F.length("text") > 0).distinct()
    rows = docs.select(
        F.col(id_col).alias("id"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"), raw(text_col).alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))

    def searched(df, number, keys, hits_only):
        chosen = items.filter(part == number).collect() if number is not None else []
        matcher = Matcher([(r["item"], bytes(r["text"])) for r in chosen], n)
        result = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), _FOUND])
        schema = to_arrow_schema(df.sparkSession.createDataFrame([], result).schema)
        return df.mapInArrow(lambda b: _found(b, matcher, schema, hits_only), result)

    if parts == 1:
        return searched(rows, 0, ["id", "rest"], False)
    # what is found depends on the text alone, so equal texts are one key
    rows = rows.withColumn("key", F.sha2("text", 256))
    texts = rows.select("key", "text")
    each = [cut_lineage(searched(texts, p, ["key"], True).dropDuplicates(["key"])) for p in range(parts)]
    hits = functools.reduce(DataFrame.union, each).groupBy("key")
    hits = hits.agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = searched(rows, None, ["id", "rest", "key"], False).select("id", "rest", "key", "n_words")
    joined = counted.join(hits.withColumn("spans", _union("spans")), "key", "left")
    lists = [F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items")]
    return joined.select("id", "rest", "n_words", *lists)


def _union(spans):
    """Overlapping and touching runs as one, over an array of runs."""
    kind = "array<struct<start:bigint,stop:bigint>>"

    def add(done, run):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (run["start"] <= last["stop"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], run["stop"]).alias("stop"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def op11_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated_words(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, run: total + run["stop"] - run["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

SQL = f"""
WITH docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
cut AS (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0
),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS words FROM cut),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n),
found AS (
  SELECT p.doc_id, p.k, p.n, f.item
  FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS words FROM places) p
  JOIN windows f ON f.n = p.n AND f.words = p.words
),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def brute_force(docs, items, n=10):
    """The same by a dictionary of all windows, for small tables in tests.

    `docs` are (id, text), `items` (id, text). Returns id, words, runs, items.
    """
    import regex

    lower = {c: c + 32 for c in range(65, 91)}
    cut = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return tuple(cut.findall((text or "").translate(lower)))

    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - n, 0) + 1) if w else ():
            windows.setdefault(w[k : k + n], set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(w[k : k + size]):
                    hit.update(range(k, k + size))
                    names |= found
        starts = sorted(i for i in hit if i - 1 not in hit)
        stops = sorted(i + 1 for i in hit if i + 1 not in hit)
        out.append((doc, len(w), list(zip(starts, stops)), sorted(names)))
    return out
