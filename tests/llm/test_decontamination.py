"""Benchmark passages in documents, against a dictionary of windows and SQL."""

import random

import pytest
from edge_tables import PASSAGE, SCHEMA, as_set, documents, with_clashes, words
from pyspark.sql import functions as F
from side_by_side import connect, differences

from valuescout.llm import decontamination as module
from valuescout.llm.decontamination import SQL, Matcher, Words, brute_force, contaminated_words, op11_decontamination

ITEMS = "item_id long, text string"


def items():
    long = words(2, 9000)
    return [
        (1, None),
        (2, ""),
        (3, " ?! "),
        (4, PASSAGE),
        (4, "Another text of the SAME item, which has more than ten words in it."),
        (5, PASSAGE.upper().replace(" ", " -- ")),
        (5, PASSAGE),
        (None, "jugs of very strong pale ale"),
        (None, "ONE"),
        (6, "one, two!"),
        (7, "it's 12"),
        (8, long[100:40000]),
        (8, long[100:40000]),
        (9, words(1, 80)),
        (10, "中文字" * 9000),
        (11, "é" * 130 + " the quick"),
        (12, "z" * 45000),
        (13, "0123 4567 8"),
    ]


def plain(rows):
    return as_set((r["id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in rows)


def test_normal_words():
    found = Words([b"", b" A-b\0C ", "É9é_x".encode(), b"", b"zz"])
    assert found.data[: found.size].tobytes() == b"\0 \0 a b c \0 \xc3\x899\xc3\xa9 x \0 \0 zz \0 "
    assert found.first.tolist() == [0, 0, 3, 5, 5, 6]


@pytest.mark.parametrize("part", [1 << 22, 30000])
@pytest.mark.parametrize("block", [1 << 22, 500])
def test_awkward_texts(spark, monkeypatch, part, block):
    """Also with the benchmark searched in parts and texts in small blocks."""
    monkeypatch.setattr(module, "PART_BYTES", part)
    monkeypatch.setattr(module, "BLOCK_BYTES", block)
    docs = with_clashes(spark.createDataFrame(documents() + documents()[8:12], SCHEMA))
    benchmark = with_clashes(spark.createDataFrame(items(), ITEMS).withColumnRenamed("text", "body")).withColumnRenamed("body", "text_")
    found = contaminated_words(docs, benchmark, item_text="text_", carry=["lang"])
    expected = brute_force([d[:2] for d in documents() + documents()[8:12]], items())
    assert plain(found.collect()) == plain([{"id": a, "n_words": b, "spans": c, "items": d} for a, b, c, d in expected])
    langs = {d[0]: d[2] for d in documents()}
    assert all(r["rest"]["lang"] == langs[r["id"]] for r in found.collect())


@pytest.mark.parametrize("seed", range(6))
def test_random_matches(seed):
    rng = random.Random(seed)
    letters = "abé1"[: rng.randint(2, 4)]

    def text(n):
        return rng.choice(["", " ", "\n"]).join(["", *(x + rng.choice([" ", ", ", "--"]) for x in ("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(n))), ""])

    n = rng.randint(1, 5)
    some = [(i, text(rng.randint(0, 12))) for i in range(40)]
    texts = [(i, text(rng.choice([0, 1, 30, 700]))) for i in range(60)]
    matcher = Matcher([(str(i), t.encode()) for i, t in some], n)
    count, runs, found = matcher.find([t.encode() for _, t in texts])
    ours = [(i, c, [(r["start"], r["stop"]) for r in s], sorted(matcher.names[x] for x in f)) for (i, _), c, s, f in zip(texts, count, runs, found)]
    assert ours == brute_force(texts, some, n)


def test_many_test_strings_in_one_bucket(monkeypatch):
    """Windows with a long common beginning share a bucket."""
    monkeypatch.setattr(module, "_PAIRS", 50)
    same = "one two three four five six seven eight nine "
    some = [(i, same + f"end{i}") for i in range(300)]
    texts = [(0, same + "end7 " + same + "end301 " + same * 3), (1, " ".join(t for _, t in some))]
    matcher = Matcher([(str(i), t.encode()) for i, t in some], 10)
    _, runs, found = matcher.find([t.encode() for _, t in texts])
    expected = brute_force(texts, some)
    assert [sorted(matcher.names[x] for x in f) for f in found] == [e[3] for e in expected]
    assert [[(r["start"], r["stop"]) for r in s] for s in runs] == [e[2] for e in expected]


def test_empty_tables(spark):
    docs, benchmark = spark.createDataFrame(documents(), SCHEMA), spark.createDataFrame([], ITEMS)
    assert contaminated_words(docs.limit(0), spark.createDataFrame(items(), ITEMS)).count() == 0
    found = contaminated_words(docs, benchmark).collect()
    assert len(found) == len(documents()) and not any(r["items"] or r["spans"] for r in found)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    folder = f"/root/testdata/{folder}"
    assert differences(spark, connect(folder), op11_decontamination, SQL, folder) == ""


def test_query_in_parts(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(module, "PART_BYTES", 2000)
    assert differences(spark, connect(folder), op11_decontamination, SQL, folder) == ""


def test_nothing_is_shuffled(spark):
    df = op11_decontamination(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.filter(F.col("contaminated") != (F.col("n_hit") > 0)).count() == 0
