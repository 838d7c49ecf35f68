"""Removal of word passages that repeat anywhere in the corpus.

Level-wise doubling: windows that repeat at one length alone are extended to
twice that length, until the wanted length is reached or none survives (see
`repeats`). All copies of a passage go, the first one included.
"""

import hashlib

from pyspark.sql import DataFrame, functions as F

from valuescout.llm.repeats import Method, WordTokens, without_repeats

_FIELDS = "n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"


def _finish(text, runs):
    words = text.encode().split()
    kept, at = [], 0
    for start, stop in zip(*(x.tolist() for x in runs)):
        kept += words[at:start]
        at = stop
    kept += words[at:]
    return {
        "n_words": len(words),
        "n_removed": len(words) - len(kept),
        "spans": [{"start": a, "stop": b} for a, b in zip(*(x.tolist() for x in runs))],
        "kept": b" ".join(kept).decode(),
    }


def remove_repeated_words(docs: DataFrame, id_col="doc_id", text_col="text", n=35, carry=()) -> DataFrame:
    """Drop every word that lies in a window of `n` words found more than once.

    Words are maximal runs without space, tab and line-ending characters; a
    window lies in one text. Returns id, rest (a struct of the columns named
    in `carry`), n_words, n_removed, spans (runs of removed words) and kept
    (the remaining words joined by a space).

    Defined cases: a null or blank text has no words and stays empty; a text
    shorter than `n` words loses nothing; repeated rows count as separate
    documents, so each one's windows repeat in the other; a null id is kept as
    null; an empty table gives an empty result; columns not named are ignored,
    whatever they are called.
    """
    return without_repeats(docs, Method(WordTokens, n, False, None), id_col, text_col, carry, _finish, _FIELDS)


def op1_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_words(docs).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def brute_force(rows, n=35):
    """The same by a dictionary of all windows, for small tables in tests."""
    places = {}
    words = [("" if text is None else text).encode().split() for _, text in rows]
    for d, w in enumerate(words):
        for p in range(len(w) - n + 1):
            places.setdefault(tuple(w[p : p + n]), []).append((d, p))
    gone = [set() for _ in rows]
    for found in places.values():
        for d, p in found if len(found) > 1 else ():
            gone[d].update(range(p, p + n))
    out = []
    for (doc_id, _), w, g in zip(rows, words, gone):
        kept = b" ".join(x for i, x in enumerate(w) if i not in g)
        out.append((doc_id, len(w), len(g), hashlib.sha256(kept).hexdigest()))
    return out
