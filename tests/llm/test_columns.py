"""Mixing, chat, URLs and fingerprints: against SQL or a plain rewriting."""

import hashlib
import math
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from edge_tables import SCHEMA, as_set, documents, with_clashes, words
from side_by_side import connect, differences
from valuescout.llm import chat, imatch, mixing, url_filter

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize(
    "query,sql",
    [(mixing.op2_mixing, mixing.SQL), (url_filter.op6_url_filter, url_filter.SQL), (chat.op9_chat, chat.SQL)],
    ids=["op2", "op6", "op9"],
)
def test_same_as_sql(spark, con, query, sql):
    assert differences(spark, con, query, sql, FOLDER) == ""


def written(tmp_path, spark, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


# mixing


def test_mix_of_awkward_texts(spark, tmp_path):
    df = with_clashes(spark.createDataFrame(documents(), SCHEMA))
    con = written(tmp_path, spark, "documents", df)
    assert differences(spark, con, mixing.op2_mixing, mixing.SQL, tmp_path) == ""


def test_targets_stop_and_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert found["a"] == 30.0 and found[None] == 0.0 and found["c"] == 300.0
    assert found["b"] == pytest.approx(1110 - 330)


def test_mix_takes_whole_sources_again(spark):
    rows = [(i, words(i, 20), "abc"[min(i // 20, 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 10 and r["most"] <= 3 for r in out)
    again = mixing.mix_sources(df.repartition(9)).select("id", "taken")
    assert as_set(again.collect()) == as_set(mixing.mix_sources(df).select("id", "taken").collect())


def test_mix_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, None, None)], "doc_id long, text string, source string")
    out = mixing.mix_sources(df).collect()
    assert [r["taken"] for r in out if r["id"] == 1] == [2, 2, 2] and len(out) == 4
    assert mixing.mix_sources(df.limit(0)).collect() == []
    blank = mixing.mix_sources(spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string"))
    assert [r["taken"] for r in blank.collect()] == [0]


# URLs


def test_awkward_urls(spark, tmp_path):
    urls = [
        None, "", "://", "http://", "no scheme", "HTTP://EXAMPLE.ORG/es/x", "http://example.org/en/1?q#f", "http://a.example.org/en/12/",
        "http://notexample.org/es/", "http://org", "http://org/", "http://ÄÖ.org/É", "http://x.com/fr", "http://x.com/fr/", "https://x.com/de/a://b/c",
        "ftp://user@h.net:80/login/", "http://adult.net/", "http://my.adultery.net", "http://ads.net/x", "http://a.ads.b/", "http://a?b/c", "http://a#b",
        "http://x.net/" + "a" * 30000 + "/wp-admin/z", "http://x.net/wp-admin", "http://x.net/a\nb/login",
    ]
    df = with_clashes(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls + urls[:3])], "page_id long, url string, html string"))
    con = written(tmp_path, spark, "pages", df)
    assert differences(spark, con, url_filter.op6_url_filter, url_filter.SQL, tmp_path) == ""
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_automaton_equals_regular_expressions():
    import random
    import re

    rng = random.Random(4)
    globs = ["".join(rng.choices(["a", "b", "/", "*", "**", "?", ".", "é"], k=rng.randint(1, 9))) for _ in range(80)]
    globs += ["a?c", "??", "?é", "é?*", "*?é", "?" * 5]
    texts = ["".join(rng.choices("ab/.é中😀", k=rng.randint(0, 12))) for _ in range(300)] + ["aéc", "中😀", "aé", "éé", "é", "a/c"]

    def plain(glob):
        parts = re.findall(r"\*\*+|\*|\?|.", glob)
        one = {"*": "[^/]*", "?": "[^/]"}
        return re.compile("".join(".*" if p.startswith("**") else one.get(p, re.escape(p)) for p in parts), re.S)

    found = url_filter.Automaton(globs).matches([t.encode() for t in texts])
    for i, glob in enumerate(globs):
        wanted = [plain(glob).fullmatch(t) is not None for t in texts]
        assert found[:, i].tolist() == wanted, glob


# chat


def test_awkward_dialogues(spark, tmp_path):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "anna", "hi <|im_end|>"), (1, 2, "bo", None), (1, 3, None, "who?"), (1, 4, "anna", "x" * 50000),
        (1, 64, "bo", "next part"), (1, None, "bo", "no turn"), (2, 0, "system", "alone"), (None, 0, "u", "lost"), (None, 0, "u", "lost"),
        (None, 1, "v", ""), (3, 5, "b", "same"), (3, 5, "b", "same"), (3, 5, "a", "tie"), (4, -1, "line\nbreak", "é中"),
    ]
    # a dialogue of several parts with one who is silent in most of them
    rows += [(5, i, "uv"[i % 2] if i % 100 else "w", f"turn {i}" * (i % 5)) for i in range(400)]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = written(tmp_path, spark, "conversations", df)
    assert differences(spark, con, chat.op9_chat, chat.SQL, tmp_path) == ""
    assert chat.rotate_perspectives(df.limit(0)).collect() == []


def test_each_participant_is_the_assistant_once(spark):
    rows = [(1, i, "abc"[i % 3], f"t{i}") for i in range(7)]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in out:
        own = [r["rendered"][m["start"] : m["stop"]] for m in r["mask"]]
        assert own == [f"t{i}<|im_end|>" for i in range(7) if "abc"[i % 3] == r["speaker"]]
        assert r["rendered"].count("assistant\n") == r["n_own"] == len(own)
    assert {r["speaker"] for r in out} == set("abc")


def test_parts_are_the_whole_dialogue(spark, monkeypatch):
    """Hundreds of turns; one participant is silent in most parts."""
    monkeypatch.setattr(chat, "PARTS_PER_BLOCK", 2)
    schema = "conv_id long, turn long, role string, text string"
    for conv in (1, None):
        said = [(0, "system", "be kind"), (1, "cy", "hello"), *((i, ("anna", "bo")[i % 2], f"é{i}") for i in range(2, 500)), (500, "cy", "bye")]
        said = said if conv else [(0, "bo", "lost")]
        out = chat.rotate_perspectives(spark.createDataFrame([(conv, *s) for s in said], schema).repartition(5)).collect()
        assert len({r["part"] for r in out}) == (8 if conv else 1)
        for speaker in {s[1] for s in said} - {"system"}:
            mine = sorted((r for r in out if r["speaker"] == speaker), key=lambda r: r["part"])
            whole, wanted = "".join(r["rendered"] for r in mine), ""
            for _, name, text in said:
                head = "assistant" if name == speaker else name if name == "system" else f"user name={name}"
                wanted += f"<|im_start|>{head}\n{text}<|im_end|>\n"
            assert whole == wanted and sum(r["n_turns"] for r in mine) == len(said)
            own = [whole[m["start"] : m["stop"]] for r in mine for m in r["mask"]]
            assert own == [f"{t}<|im_end|>" for _, name, t in said if name == speaker]
            assert [whole[r["start"] :].startswith(r["rendered"]) for r in mine] == [True] * len(mine)
            assert [r["start"] for r in mine] == [sum(len(q["rendered"]) for q in mine[:n]) for n in range(len(mine))]


def test_native_plans(spark):
    for df in (chat.op9_chat(spark, FOLDER), imatch.op5_imatch(spark, FOLDER)):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow")), plan[:500]


# fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_terms(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in imatch_words(text)}


def imatch_words(text):
    lower = text.lower()
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def plain_hashes(text, kept):
    mask = (1 << imatch.LEXICON_BITS) - 1
    terms = sorted(t for t in plain_terms(text) if t & mask in kept)
    pairs = [(t, signed(xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<q", t), 42)))) for t in terms]
    out, half = [], imatch.SUBSETS // 2
    step = (64 - imatch._SHARE_BITS) // (half - 1)
    for number in range(imatch.SUBSETS):
        shift = number % half * step
        found = [p for p in pairs if ((p[number >= half] % (1 << 64)) >> shift) & ((1 << imatch._SHARE_BITS) - 1) == 0]
        seed = 42
        for pair in found:
            for x in pair:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
        seed = xxhash.xxh64_intdigest(struct.pack("<i", number), seed)
        out.append(seed & 0xFFFFFFFF if found else None)
    return out


def plain_fingerprints(rows):
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda r: -r[0])]
    counts = {}
    for _, text in rows:
        for t in plain_terms(text):
            counts[t] = counts.get(t, 0) + 1
    low, high = (len(rows) * math.exp(-x) for x in reversed(imatch.IDF_BAND))
    mask = (1 << imatch.LEXICON_BITS) - 1
    kept = {t & mask for t, n in counts.items() if low <= n <= high}

    def like(a, b, equal):
        used = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in used) / len(used) if used else float(equal)

    def shown(h):
        return " ".join("-" if x is None else f"{x:x}" for x in h)

    for n, (doc_id, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (plain_hashes(t, kept) for t in (text, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        yield doc_id, len(text), digest, shown(a), shown(b), like(a, b, edited == text), like(a, c, following == text)


def test_fingerprints_equal_a_plain_rewriting(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert as_set(imatch.op5_imatch(spark, FOLDER).collect()) == as_set(plain_fingerprints(rows))


def test_awkward_fingerprints(spark, tmp_path):
    df = with_clashes(spark.createDataFrame(documents(), SCHEMA))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = imatch.op5_imatch(spark, tmp_path).collect()
    assert as_set(found) == as_set(plain_fingerprints([r[:2] for r in documents()]))


def test_followers_with_nulls_and_ties(spark):
    rows = [(3, "c"), (None, "n"), (1, "a"), (3, "b"), (-5, "m"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = imatch.lexicon(df)
    out = imatch.fingerprints(df, bits=bits).collect()
    follow = {(r["id"], r["text"]): r["next_text"] for r in out}
    assert follow[(3, "b")] == "c" and follow[(3, "c")] == "a" and follow[(1, "a")] == "m"
    assert sorted(follow.values()) == sorted(["a", "b", "c", "m", "n", ""])
    one = imatch.fingerprints(df.filter("doc_id = 1"), bits=bits).collect()
    assert one[0]["next_text"] == "a"
    assert imatch.fingerprints(df.limit(0), bits=bits).collect() == []


def test_subsets_hold_nearly_all_of_the_lexicon(spark):
    """A text of a single lexicon term has a fingerprint, and so has an edit to it."""
    df = spark.createDataFrame([(i, f"term{i}") for i in range(300)], "doc_id long, text string")
    out = imatch.fingerprints(df).collect()
    assert all(any(h is not None for h in r["hashes"]) for r in out)
    assert len({tuple(r["hashes"]) for r in out}) == 300


def test_different_texts_without_terms_are_not_alike(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["the", "the", "of", None, ""])]
    # each word in a third of the rows or more: outside the band
    df = spark.createDataFrame(rows + [(9 + i, "the of") for i in range(3)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in imatch.op5_imatch(spark, tmp_path).collect()}
    assert all(set(r["fingerprint"]) == {"-", " "} for r in out.values())
    assert [out[i]["near_next"] for i in (1, 2, 3, 4, 11)] == [1.0, 0.0, 0.0, 1.0, 1.0]
