"""I-Match fingerprints: hashes of the telling terms of a text.

Terms within a band of inverse document frequency form the lexicon. From it
several random subsets are drawn, each of half of it, so that a term is in none
of them once in 2**32 only; a text has one hash per subset, over its distinct
terms in that subset, sorted. Texts that share a hash agree in all terms of
that subset. All work on texts is done by built-in column functions.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from valuescout.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
IDF_BAND = (2.0, 6.0)
SUBSETS = 32
LEXICON_BITS = 22
SLOTS = 64
_SHARE_BITS = 1
_PER_BYTE = 4


def term_hashes(text: Column) -> Column:
    """Distinct lower-case words of a text as hashes."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col="text", band=IDF_BAND) -> bytes:
    """Terms with ln(documents / document frequency) within `band`, as a bitmap.

    Counts cover all words of all documents. A term is kept by the last bits
    of its hash, LEXICON_BITS (1 MB) or as many as give each term of the band
    SLOTS places of its own, so that a word outside the band is taken for one
    of them once in SLOTS times at most. The band bounds the terms, and so the
    bitmap: no more than the mean number of distinct words times exp(band[1])
    are that frequent.
    """
    terms = docs.select(F.explode(term_hashes(F.col(text_col).cast("string"))).alias("term"))
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    most, least = total * math.exp(-band[0]), total * math.exp(-band[1])
    kept = counted.filter((F.col("n") <= most) & (F.col("n") >= least))
    kept = cut_lineage(kept.select("term"))
    size = max(LEXICON_BITS, (SLOTS * kept.count()).bit_length())
    bit = F.col("term").bitwiseAND(F.lit((1 << size) - 1))
    byte = F.shiftright(bit, 2)
    value = F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(_PER_BYTE - 1)).cast("int"))
    rows = kept.groupBy(byte.alias("byte")).agg(F.bit_or(value).alias("value")).collect()
    bits = bytearray(b"@" * ((1 << size) // _PER_BYTE))
    for r in rows:
        bits[r["byte"]] += r["value"]
    return bytes(bits)


def fingerprint(text: Column, bits: bytes) -> Column:
    """One hash per random subset of the lexicon; null where no term is in it."""
    table = F.lit(bits)

    def known(term):
        place = term.bitwiseAND(F.lit(len(bits) * _PER_BYTE - 1))
        byte = F.substring(table, F.shiftright(place, 2).cast("int") + 1, F.lit(1))
        value = F.ascii(byte.cast("string"))
        at = place.bitwiseAND(F.lit(_PER_BYTE - 1)).cast("int")
        return F.call_function("shiftright", value, at).bitwiseAND(F.lit(1)) == 1

    terms = F.array_sort(F.filter(term_hashes(text), known))
    # two random words per term; a subset is cut out of either by a few bits
    terms = F.transform(terms, lambda t: F.struct(t.alias("own"), F.xxhash64(t, F.lit(1)).alias("other")))
    share = F.lit((1 << _SHARE_BITS) - 1)
    half = SUBSETS // 2
    step = (64 - _SHARE_BITS) // (half - 1)

    def in_subset(number):
        word, shift = "own" if number < half else "other", number % half * step
        return lambda term: F.shiftrightunsigned(term[word], shift).bitwiseAND(share) == 0

    def hashed(terms_of_text, number):
        found = F.filter(terms_of_text, in_subset(number))
        value = F.xxhash64(found, F.lit(number)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(F.size(found) > 0, value)

    # an array of one list lets each subset refer to the list by name
    return F.transform(F.array(terms), lambda t: F.array(*[hashed(t, i) for i in range(SUBSETS)]))[0]


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms in.

    If neither has a term in any subset: 1 if the texts are `equal`, else 0.
    """
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda u: u))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda u: u))
    return F.when(used == 0, equal.cast("double")).otherwise(same / used)


def printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), " ")


def followed(rows: DataFrame, id_col, tie_cols, columns) -> DataFrame:
    """Adds next_<column>: the value in the next row by descending id.

    After the last row comes the first. Null ids are last; ties are ordered by
    `tie_cols`. Ids are dealt to ranges by quantiles, each range is sorted by
    itself, and one row per range links it to the next one.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = min(16, max(6, math.ceil(math.log2(8 * partitions))))
    ranges = 1 << steps
    shares = [i / ranges for i in range(1, ranges)]
    ident = F.col(id_col)
    ends = rows.agg(F.percentile_approx(ident, shares, 20 * ranges)).first()[0] or [0] * (ranges - 1)
    ends = F.lit([int(e) for e in ends])
    # binary search: the number of ends that are not above the id
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    search = F.aggregate(
        halves, F.lit(0), lambda at, half: at + F.when(F.element_at(ends, at + half) <= ident, half).otherwise(F.lit(0))
    )
    part = F.when(ident.isNotNull(), search).otherwise(-1 - F.pmod(F.xxhash64(*tie_cols), F.lit(64)).cast("int"))
    part = F.coalesce(part, F.lit(0))  # never null: a filter would keep the two readers of `dealt` from sharing it
    order = [F.col(c) if c != id_col else ident.desc_nulls_last() for c in [id_col, *tie_cols]]
    inside = Window.partitionBy("part").orderBy(*order)
    value = F.struct(*columns)
    # texts move once, to the range of their id
    dealt = rows.withColumn("part", part).repartition("part")
    linked = dealt.withColumn("next", F.lead(value).over(inside)).withColumn("place", F.row_number().over(inside))
    heads = linked.filter(F.col("place") == 1).select("part", value.alias("head"))
    # only the numbers of the ranges meet in one window, their heads do not
    onward = Window.orderBy(F.col("own").desc())
    everything = onward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = rows.select(part.alias("own")).distinct()
    parts = parts.select(F.col("own").alias("p"), F.coalesce(F.lead("own").over(onward), F.first("own").over(everything)).alias("onward"))
    heads = heads.join(parts, F.col("part") == F.col("onward")).select("p", F.col("head").alias("after"))
    out = linked.join(heads, F.col("part") == F.col("p"))
    following = F.coalesce(F.col("next"), F.col("after"))
    return out.select(*rows.columns, *[following[c].alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", bits=None) -> DataFrame:
    """Each text's fingerprint next to that of the text that follows it.

    Returns id, text, hashes (array of long, null where a subset has no term),
    next_text and next_hashes, in the order of descending ids, the first after
    the last.

    Defined cases: a null text is empty; a text without lexicon terms has only
    nulls; very long texts count with all their words; equal texts have equal
    hashes; rows with the same id follow each
    other by their texts, null ids come last; a single row is followed by
    itself; an empty table gives an empty result; columns not named are
    ignored, whatever they are called.
    """
    bits = lexicon(docs, text_col) if bits is None else bits
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("hashes", fingerprint(F.col("text"), bits))
    return followed(rows, "id", ["text"], ["text", "hashes"])


def op5_imatch(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bits = lexicon(docs)
    rows = fingerprints(docs, bits=bits)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_hashes", fingerprint(F.col("edited"), bits))
    return rows.select(
        F.col("id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("hashes")).alias("fingerprint"),
        printed(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes"), F.col("edited") == F.col("text")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes"), F.col("next_text") == F.col("text")).alias("near_next"),
    )
