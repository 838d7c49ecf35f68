
import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_tables import PASSAGE, SCHEMA, as_set, documents, with_clashes, words
from valuescout.llm import repeats, substring_dedup, suffix_dedup
from valuescout.llm.names import ByteTokens, WordTokens, anchored

FOLDER = "/root/testdata/sf0.001"


def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def op1(df, **more):
    out = substring_dedup.remove_repeated_words(df, **more)
    return out.select("id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()


def op10(df, **more):
    out = suffix_dedup.remove_earlier_bytes(df, **more)
    return out.select("id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect()


def test_queries_equal_brute_force(spark):
    rows = given(spark)
    assert as_set(substring_dedup.op1_substring_dedup(spark, FOLDER).collect()) == as_set(substring_dedup.brute_force(rows))
    assert as_set(suffix_dedup.op10_suffix_dedup(spark, FOLDER).collect()) == as_set(suffix_dedup.brute_force(rows))


def test_awkward_texts_and_clashing_names(spark):
    df = with_clashes(spark.createDataFrame(documents(), SCHEMA)).repartition(5)
    rows = [r[:2] for r in documents()]
    assert as_set(op1(df)) == as_set(substring_dedup.brute_force(rows))
    assert as_set(op10(df)) == as_set(suffix_dedup.brute_force(rows))


def test_many_short_repeats(spark):
    """Texts over few letters: hot grams, periods, overlaps, every edge."""
    rng = np.random.default_rng(3)
    blocks = ["".join(rng.choice(list("ab "), p=[0.45, 0.45, 0.1], size=rng.integers(9, 30))) for _ in range(9)]
    rows = [(i, "".join(rng.choice(blocks, size=rng.integers(0, 9)))) for i in range(150)]
    rows += [(200 + i, "ab" * (10 + i)) for i in range(50)] + [(300 + i, "a " * i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for n in (32, 45, 100):
        assert as_set(op10(df, n=n)) == as_set(suffix_dedup.brute_force(rows, n)), n
    assert as_set(op1(df, n=4)) == as_set(substring_dedup.brute_force(rows, 4))
    assert as_set(op1(df, n=35)) == as_set(substring_dedup.brute_force(rows, 35))
    with pytest.raises(ValueError):
        op10(df, n=31)


def test_small_flushes_give_the_same(spark, monkeypatch):
    """What a task settles by itself does not change the result."""
    rows = [(i, PASSAGE + " " + words(i % 7, 30) + " " + PASSAGE) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(repeats, "_FLUSH", 1)
    assert as_set(op10(df)) == as_set(suffix_dedup.brute_force(rows))
    assert as_set(op1(df)) == as_set(substring_dedup.brute_force(rows))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = words(8, 60)
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(op1(df), key=repr)
    assert all(r["n_removed"] == r["n_words"] for r in found if r["n_words"] == 60)
    found = [r for r in op10(df) if r["n_bytes"] == len(text)]
    assert len(found) == 3 and sum(r["n_removed"] == 0 for r in found) == 1
    assert sum(r["id"] is None for r in op10(df)) == 2
    assert op1(df.limit(0)) == [] and op10(df.limit(0)) == []


def test_real_outputs_and_carried_columns(spark):
    once = "".join(chr(0xC0 + i) for i in range(60))
    rows = [(1, once + "x", "p"), (2, "y" + once, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["id"]: r for r in suffix_dedup.remove_earlier_bytes(df, carry=["source"]).collect()}
    assert out[1]["kept_text"] == once + "x" and out[1]["rest"]["source"] == "p"
    assert out[2]["kept"] == b"y" and out[2]["spans"][0].asDict() == {"start": 1, "stop": 121}


def test_one_hot_passage_does_not_fill_one_task(spark):
    """A gram that stands in every document sends a few rows per task."""
    rows = [(i, words(i, 30) + " " + PASSAGE + " " + words(i + 1000, 30)) for i in range(300)]
    method = repeats.Method(ByteTokens, 100, True, 64)
    out = repeats._Spans(method)
    raw = [t.encode() for _, t in rows]
    tokens = ByteTokens(raw)
    grams = tokens.grams(25)
    doc, lo, hi, anchor = anchored(grams, tokens.first, 100, 25)
    out.add(grams[anchor], tokens.running.names(lo, hi + 100), doc, doc * 0, repeats._pack(lo - tokens.first[doc], hi - lo + 1, anchor - lo))
    names = [n for batch in out.flush() for part in batch["name"].to_pylist() for n in part]
    counts = np.unique([n for n in names if n], return_counts=True)[1]
    assert counts.max() <= 2


def test_words_and_windows():
    texts = [b"a  b\tc\x0bd", b"", b" \n", b"e"]
    tokens = WordTokens(texts)
    assert tokens.first.tolist() == [0, 4, 4, 4, 5]
    tokens = WordTokens([" ".join("abcdefgh"[i % 8] for i in range(50)).encode()])
    doc, lo, hi, anchor = anchored(tokens.grams(9), tokens.first, 35, 9)
    assert lo[0] == 0 and hi[-1] == 15 and (lo[1:] == hi[:-1] + 1).all()
    assert ((anchor >= lo) & (anchor <= lo + 26)).all() and (doc == 0).all()


def test_names_that_differ_in_high_bits_only_are_not_equal(spark):
    """Spans are told apart by all 64 bits of their second name."""

    class High(ByteTokens):  # defined here, so that it travels to tasks
        def __init__(self, raw):
            super().__init__(raw)
            names = self.running.names
            self.running.names = lambda start, stop: names(start, stop) << np.uint64(32)

    rows = [(i, words(i, 20) + PASSAGE[:40] + words(i + 1000, 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    method = repeats.Method(High, 100, True, 0)
    out = repeats.without_repeats(df, method, "doc_id", "text", [], lambda text, runs: {"n": len(runs[0])}, "n long")
    assert [r["n"] for r in out.collect()] == [0] * 40
