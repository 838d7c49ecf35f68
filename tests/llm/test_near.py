"""Near-duplicates: against all pairs, and what stars alone would miss."""

import numpy as np
from pyspark.sql import functions as F

from edge_tables import SCHEMA, as_set, documents, with_clashes, words
from valuescout.llm import minhash, near_dedup
from valuescout.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def run(df):
    return near_dedup.near_duplicates(df).collect()


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = near_dedup.op8_near_dedup(spark, FOLDER).collect()
    assert as_set(got) == as_set(near_dedup.brute_force(rows))
    assert any(not r["kept"] for r in got)


def test_awkward_texts(spark):
    df = with_clashes(spark.createDataFrame(documents(), SCHEMA)).repartition(5)
    assert as_set(run(df)) == as_set(near_dedup.brute_force([r[:2] for r in documents()]))


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > share else f"x{rng.integers(1000)}" for w in text.split(" "))


def test_chains_and_large_groups(spark, monkeypatch):
    """Copies of copies, and more members than one block holds."""
    base = words(1, 300)
    rows = [(i, edited(base, i, 0.02)) for i in range(60)]
    chain = words(2, 200)
    for i in range(60, 90):
        rows.append((i, chain))
        chain = edited(chain, i, 0.015)
    shared = words(3, 120)
    rows += [(i, shared + " " + words(i, 100)) for i in range(90, 130)]
    rows += [(i, rows[5][1]) for i in range(130, 160)]
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert as_set(run(df)) == as_set(near_dedup.brute_force(rows))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = words(4, 50)
    rows = [(None, text), (3, text), (2, text), (2, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = run(df)
    assert len(got) == 5 and all(r["component_id"] == 2 for r in got if r["doc_id"])
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True, True]
    assert sorted(r["kept"] for r in got if r["doc_id"]) == [False, True, True]
    assert run(df.limit(0)) == []


def test_components_of_long_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    loose = [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))]
    links = chain + star + loose
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert as_set(got) == as_set((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_signatures_estimate_similarity():
    """Also for small sets, where most bins are filled from others."""
    rng = np.random.default_rng(6)
    for size, common in ((400, 343), (40, 34), (8, 7)):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:size]), np.sort(pool[size - common :])
            text = np.repeat([0, 1], [len(a), len(b)])
            s = minhash.signatures(text, np.concatenate([a, b]), 2, near_dedup.BINS)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - common / (2 * size - common)) < 0.03


def test_star_edges_bound_the_pairs(spark):
    rows = [(i, edited(words(7, 200), i, 0.01)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = df.mapInArrow(near_dedup._signed, near_dedup._SIGNED)
    buckets = signed.select("doc_id", F.explode("bands").alias("bucket")).groupBy("bucket").count().filter("count > 1")
    members = buckets.agg(F.sum("count")).first()[0]
    assert members <= 80 * near_dedup.BINS // near_dedup.ROWS
