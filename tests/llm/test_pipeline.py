"""The corpus pipeline, stage by stage and as a whole."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from edge_tables import SCHEMA, as_set, documents, with_clashes
from valuescout.llm import bpe, near_dedup, suffix_dedup

FOLDER = "/root/testdata/sf0.001"


def written(spark, tmp_path, df, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's result, the documents first."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(spark, folder, stage(spark, out[-1], FOLDER), name))
    return out


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_clean_documents_and_columns(steps):
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mix", "tokens"]
    for df in steps[1:-1]:
        assert df.dtypes == list(pipeline.COLUMNS.items())
    before, after = {r[0] for r in pairs(steps[0])}, {r[0] for r in pairs(steps[1])}
    assert len(after) >= 0.98 * len(before)


def test_near_duplicates_stage(steps):
    wanted = {r[0] for r in near_dedup.brute_force(pairs(steps[1])) if r[3]}
    assert {r[0] for r in pairs(steps[2])} == wanted


def test_repeated_passages_stage(steps):
    rows = sorted(pairs(steps[2]))
    done = {i: size for i, size, *_ in suffix_dedup.brute_force(rows)}
    removed = {r[0]: r[2] for r in suffix_dedup.brute_force(rows)}
    for doc_id, text in pairs(steps[3]):
        size = len((text or "").encode())
        assert 0 <= done[doc_id] - removed[doc_id] - size <= 6 * (removed[doc_id] > 0) * max(1, removed[doc_id] // 100)
    counted = steps[3].filter(F.col("n_chars") != F.length("text")).count()
    assert counted == 0 and sum(removed.values()) > 0


def test_mix_stage_and_tokens(steps, spark):
    assert set(pairs(steps[4])) <= set(pairs(steps[3]))
    with open(bpe.default_vocabulary(), "rb") as file:
        codec = bpe.Codec(file.read())
    texts = dict(pairs(steps[4]))
    rows = steps[5].collect()
    assert len(rows) == steps[4].count() and all(r["exact"] for r in rows)
    assert all(r["ids"] == codec.encode(texts[r["doc_id"]] or "") for r in rows)


def test_run_is_the_stages_in_turn(steps, spark):
    found = pipeline.run(spark, FOLDER)
    assert as_set(found.collect()) == as_set(steps[-1].collect())


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    rows = documents() + [documents()[6], (None, None, None, None, None), (None, "text without an id", "en", None, 3)]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
        out = written(spark, tmp_path, stage(spark, docs, FOLDER), name)
        if name != "tokens":
            assert out.dtypes == list(pipeline.COLUMNS.items())
        if name == "language":
            left = [r["text"] for r in out.collect()]
            assert all(t and re.search(r"[^\W\d_]", t) for t in left) and len(left) >= 18
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in out.collect()]
            assert ids.count(None) == 2 and {4, 13} <= set(ids) and not {5, 6, 14, 15} & set(ids)
        if name == "repeated_passages":
            assert out.count() == docs.count()
