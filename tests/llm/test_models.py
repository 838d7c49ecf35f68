"""Language, neighbours and BPE: held-out accuracy, recall, exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from edge_tables import SCHEMA, as_set, documents, with_clashes
from tokenizers import Tokenizer
from valuescout.llm import bpe, language, neighbours

FOLDER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return bpe.Codec(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


# language


def test_held_out_accuracy(spark):
    found = language.op7_language(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert 150 < len(held) < 350 and len(rows) == 1000
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_and_labels_do_not_matter(spark):
    """Labels of held-out rows never reach the model."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 300").select("doc_id", "text", "lang")
    lied = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language.fit_languages(d.filter(~language.held_out())) for d in (docs, lied))
    assert a.languages == b.languages and (a.weights == b.weights).all() and (a.trust == b.trust).all()


def test_awkward_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 200").select("doc_id", "text", "lang")
    model = language.fit_languages(docs)
    df = with_clashes(spark.createDataFrame(documents(), SCHEMA))
    out = {r["rest"]["doc_id"]: r for r in language.identify_languages(df, model, carry=["doc_id"]).collect()}
    assert len(out) == 22
    for i in (1, 2, 3, 22):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["ambiguous"]) == ("und", 0.0, True)
    assert out[4]["lang_pred"] == out[5]["lang_pred"] and out[4]["score"] == out[5]["score"]
    assert all(out[i]["lang_pred"] in model.languages for i in (7, 8, 9, 17))
    assert language.identify_languages(df.limit(0), model).collect() == []


def test_a_plain_rewriting_gives_the_same(spark):
    """Dictionaries and plain sums; also the same score alone, in blocks and in any partitions."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = rows.union(spark.createDataFrame(documents(), SCHEMA).selectExpr("doc_id + 100000", "text", "lang"))
    learned = rows.filter(~language.held_out())
    model = language.fit_languages(learned)
    again = language.fit_languages(learned.repartition(7))
    assert (model.weights == again.weights).all() and (model.trust == again.trust).all()
    found = {}
    for parts in (1, 7):
        out = language.identify_languages(rows.repartition(parts), model, carry=["doc_id"])
        found[parts] = {r["rest"]["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert found[1] == found[7]
    texts = [tuple(r) for r in rows.select("doc_id", "text").collect()]
    wanted = language.brute_force([tuple(r) for r in learned.select("text", "lang").collect()], [t for _, t in texts])
    for (doc_id, _), (lang, score) in zip(texts, wanted):
        assert found[1][doc_id][0] == lang and abs(found[1][doc_id][1] - score) < 1e-6
    for doc_id, text in texts[:20]:
        if text:
            alone = model.decode(model.margins(language._counts([text.encode()], language.FEATURES)))
            assert found[1][doc_id][1] in (0.0, alone.max())


def test_few_languages(spark):
    rows = [(1, "der die das und", "de"), (2, "the and of", None), (3, None, "en")]
    df = spark.createDataFrame(rows, DOCS)
    one = language.fit_languages(df)
    out = language.identify_languages(df, one).collect()
    assert one.languages == ["de"] and [(r["lang_pred"], r["score"]) for r in out] == [("de", 1.0), ("de", 1.0), ("und", 0.0)]
    none = language.fit_languages(df.limit(0))
    assert {r["lang_pred"] for r in language.identify_languages(df, none).collect()} == {"und"}


def test_codewords_are_distinct():
    for count in (2, 3, 4, 5, 6, 9, 40):
        code = language.codewords(count)
        assert code.shape[0] == count and len({tuple(r) for r in code}) == count
        assert (np.abs(code.sum(axis=0)) < count).all()
    assert language.codewords(4).shape == (4, 7)


def test_a_close_second_is_ambiguous():
    code = language.codewords(2)
    model = language.Model(["a", "b"], code, np.zeros((4, 1)), np.ones(code.shape))
    assert model.decode(np.zeros((1, 1))).tolist() == [[0.5, 0.5]]
    assert model.decode(np.array([[3.0 * code[1, 0]]])).argmax() == 1


# neighbours


def unit(seed, count, size=16):
    x = np.random.default_rng(seed).standard_normal((count, size)).astype(np.float32)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_and_exact_scores(spark):
    got = [tuple(r) for r in neighbours.op3_neighbours(spark, FOLDER).collect()]
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = neighbours.brute_force([r["vec_id"] for r in rows], vectors, lambda i: i % 20 == 0)
    score = {(q, v): s for q, _, v, s in want}
    assert len(got) == len(want) == 20 * len(rows) // 20
    assert sum((q, v) in score for q, _, v, _ in got) / len(want) >= 0.9
    assert all(s == score[q, v] for q, _, v, s in got if (q, v) in score)


def test_one_very_common_vector_and_small_blocks(spark):
    x = unit(1, 400)
    x[100:350] = x[100]
    df = frame(spark, [(i, [float(c) for c in x[i]]) for i in range(400)]).repartition(6)
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=7, target=1.0).collect()
    want = neighbours.brute_force(list(range(400)), x.astype(np.float64), lambda i: i % 50 == 0, 7)
    ties = [r for r in want if 100 <= r[0] < 350]
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert all(found[q, n] == (v, s) for q, n, v, s in ties)
    assert len(got) == 56


@pytest.mark.parametrize("count,copies", [(100, 2), (400, 2), (100, 30)])
def test_repeated_rows_take_no_places(spark, count, copies):
    """Every id several times, by equal vectors and by worse ones."""
    x = unit(6, count)
    rows = [(i, [float(c) for c in x[i]]) for i in range(count)]
    worse = [(i, [c / 2 for c in vec]) for i, vec in rows]
    want = {(q, v) for q, _, v, _ in neighbours.brute_force(list(range(count)), x.astype(np.float64), lambda i: i % 20 == 0)}
    for table in (rows * copies, rows * (copies - 1) + worse):
        got = neighbours.nearest(frame(spark, table).repartition(6), F.col("vec_id") % 20 == 0, target=1.0).collect()
        assert len(got) == len(want) == count // 20 * 20
        assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 1.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 1.0]),
        (140, [None, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (160, [1.0, 2.0, 3.0]),
    ]
    got = neighbours.nearest(with_clashes(frame(spark, rows)), F.col("vec_id") % 20 == 0, k=20).collect()
    found = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert found[0] == [(1, 2.0), (2, 2.0), (20, 1.0), (3, -1.0)]
    assert found[20] == [(1, 2.0), (2, 2.0), (0, 1.0), (3, -1.0)] and len(got) == 8
    assert neighbours.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(frame(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


# BPE


def digests(rows, library):
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        yield doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded))


def test_ids_equal_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert as_set(bpe.op4_bpe(spark, folder).collect()) == as_set(digests(rows, library))


def test_awkward_texts_in_pieces(spark, library):
    rows = [r[:2] for r in documents()] + [documents()[6][:2], (None, "x" * 100)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    for size in (64, 1 << 14):
        out = bpe.encode_texts(df, PATH, size=size)
        got = [
            (r["id"], len(r["ids"]), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, r["ids"])), r["decoded"])))
            for r in out.collect()
        ]
        assert as_set(got) == as_set(digests(rows, library)), size
    assert bpe.encode_texts(df.limit(0), PATH).collect() == []


def test_texts_of_several_pieces(spark, library):
    """At the size that the query uses: runs, special tokens and words across the cuts."""
    rng = random.Random(8)
    words = ["the", " of", "  ", "é", "中文", "'s", "12", "...", "\n", "<|endoftext|>", "antidisestablishmentarianism"]
    size = bpe.PIECE
    rows = [(1, "".join(rng.choices(words, k=size))), (2, "ab" * (2 * size)), (3, "x" * (size + 1)), (4, " " * (3 * size) + "end")]
    rows += [(5, "".join(rng.choices("abcdefgh ", k=5 * size))), (6, rows[0][1]), (7, "y" * size)]
    out = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    got = [
        (r["id"], len(r["ids"]), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, r["ids"])), r["decoded"])))
        for r in out
    ]
    assert as_set(got) == as_set(digests(rows, library)) and all(r["exact"] for r in out)


def test_any_cut_gives_the_same_ids(codec, library):
    rng = random.Random(11)
    parts = ["a", "e", "th", " ", "  ", "'", "'s", "s", "1", "23", "!", "...", "\n", "\t", "é", "中", "😀", " ", "<|endoftext|>", "<|endof", " the", "x" * 9]
    for _ in range(400):
        chosen = rng.sample(parts, rng.randint(1, 6))
        text = "".join(rng.choices(chosen, k=rng.randint(1, 200)))
        wanted = library.encode(text, add_special_tokens=False).ids
        for size in (1, 3, 10, 50):
            ids, stretches = [], {}
            for number, part in bpe.pieces(codec, text, size):
                stretches.setdefault(number, []).append(part)
            for some in stretches.values():
                ids += some if isinstance(some[0], int) else bpe.concatenated(codec, [(p, codec.plain(p)) for p in some])
            assert ids == wanted, (size, text)
        assert codec.decode(wanted) == library.decode(wanted, skip_special_tokens=False)


def test_a_join_encodes_a_small_window_only(codec, monkeypatch):
    text = "".join(random.Random(2).choices("abcdefgh", k=60000))
    left, right = text[:30000], text[30000:]
    parts = codec.plain(left), codec.plain(right)
    lengths = []
    plain = codec.plain
    monkeypatch.setattr(codec, "plain", lambda t: lengths.append(len(t)) or plain(t))
    joined = bpe.join(codec, left, parts[0], right, parts[1])
    assert sum(lengths) < 500 and joined == plain(text)
