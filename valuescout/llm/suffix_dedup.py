"""Removal of byte strings that occur earlier in the corpus.

In place of the ranks of prefix doubling, strings of n / 4, n / 2 and n bytes
have hash names, made where the text lies; Spark groups equal names, until a
place is unique or past the threshold (see `repeats`). Only places that a rule
on the content selects are named, so that about one byte in 38 gets a row;
equal strings select equal places.
The first copy in the order (id, start) stays.
"""

import hashlib

from pyspark.sql import DataFrame, functions as F

from valuescout.llm.repeats import ByteTokens, Method, without_repeats

_FIELDS = "n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary, kept_text string"


def _finish(text, runs):
    raw = text.encode()
    kept, at = [], 0
    pairs = list(zip(*(x.tolist() for x in runs)))
    for start, stop in pairs:
        kept.append(raw[at:start])
        at = stop
    kept = b"".join([*kept, raw[at:]])
    return {
        "n_bytes": len(raw),
        "n_removed": len(raw) - len(kept),
        "spans": [{"start": a, "stop": b} for a, b in pairs],
        "kept": kept,
        "kept_text": kept.decode(errors="ignore"),
    }


def remove_earlier_bytes(docs: DataFrame, id_col="doc_id", text_col="text", n=100, carry=()) -> DataFrame:
    """Drop every byte covered by an `n`-byte string that also starts earlier.

    Earlier means a smaller id, or the same document and a smaller start.
    Strings lie in one text. Returns id, rest (a struct of the columns named
    in `carry`), n_bytes, n_removed, spans (maximal removed runs), kept (the
    remaining bytes) and kept_text (the same without cut characters).

    Defined cases: a null or empty text stays empty; a text under `n` bytes
    loses nothing; rows with the same id are separate documents in an order
    that depends on their texts alone, so of equal rows one stays; a null id
    is kept, its row's order depends on the text; an empty table gives an
    empty result; columns not named are ignored, whatever they are called.
    """
    return without_repeats(docs, Method(ByteTokens, n, True, None), id_col, text_col, carry, _finish, _FIELDS)


def op10_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_earlier_bytes(docs).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(rows, n=100):
    """The same by a dictionary of all strings, for small tables in tests."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = ("" if text is None else text).encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            s = raw[p : p + n]
            if s in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [out[k] for k in sorted(out)]
