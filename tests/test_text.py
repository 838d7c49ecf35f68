from pyspark.sql import functions as F

from valuescout.dictionaries import lemma_dictionary, tag_dictionary
from valuescout.functions import text as tx
from valuescout.operators import phrases as ph
from valuescout.operators.langid import gram_counts, grams, keep_language, langid_fit, langid_model, langid_score


def test_normalize_text(rows):
    cases = {
        "Great<br/>place!\nSee https://x.y/z now": "Great place! See now",
        "see http://a.b<br/>Great host": "see host",
        "www.foo.com": "", None: "", " a  b\t\r\nc ": "a b c", "HTTPS://X.y ok": "ok",
    }
    assert rows(list(cases), "t string", tx.normalize_text("t")) == list(cases.values())


def test_meaningful(rows):
    values = ["Ok", "!!!", "123", "👍👍", "Отлично", "", None]
    assert rows(values, "t string", tx.meaningful("t")) == [True] + [False] * 6


def test_looks_english(rows):
    cases = {
        "Great place": True, "Ottimo": False, "Ok": False, "Très bien": False, "Очень good": False,
        "Molto bella casa vicino stazione": True, "": False, None: False, "a b c d 'e": False,
        "a b c d e": True, "THE": True, "there": False, "it's": False, "good!": True,
        "'a b c d e f": False, "one two three four": False, "1 a, b. c; d - e": True,
    }
    assert rows(list(cases), "t string", tx.looks_english("t")) == list(cases.values())


def _tagged(spark, rows):
    tags = spark.createDataFrame(
        [("great", "ADJ"), ("quiet", "ADJ"), ("good", "ADJ"), ("neighborhoods", "NOUN"),
         ("location", "NOUN"), ("host", "NOUN"), ("better", "ADJ"), ("walks", "NOUN")], "word string, tag string")
    df = spark.createDataFrame(rows, "g string, text string")
    return ph.phrase_counts(df, "g", "text", tags, lemma_dictionary(spark))


def test_phrases(spark):
    got = {(r["g"], r["phrase"]): r["count"] for r in _tagged(spark, [
        ("a", "Great quiet neighborhoods"), ("b", "great location. good"), ("c", "great host"),
        ("d", "Great Location and great location"), ("e", "better walks"), ("f", ""), ("g", "great"),
    ]).collect()}
    assert got == {
        ("a", "quiet neighborhood"): 1, ("a", "great quiet neighborhood"): 1,
        ("b", "great location"): 1, ("d", "great location"): 2, ("e", "good walk"): 1,
    }


def test_tags_and_lemmas(spark):
    df = spark.createDataFrame([(1, "Lovely cities, walked slowly!")], "id int, text string")
    tagged = ph.lemmatize(ph.tag_tokens(df, "id", "text", tag_dictionary(spark)), lemma_dictionary(spark))
    got = [(r["token"], r["tag"], r["lemma"]) for r in tagged.orderBy("pos").collect()]
    assert got == [("Lovely", "ADJ", "lovely"), ("cities", "NOUN", "city"), (",", "OTHER", ","),
                   ("walked", "OTHER", "walked"), ("slowly", "OTHER", "slowly"), ("!", "OTHER", "!")]


def test_noun_lemma(rows):
    cases = {"cities": "city", "boxes": "box", "dishes": "dish", "glass": "glass", "bus": "bus",
             "walks": "walk", "gas": "gas", "classes": "class", "houses": "house", "basis": "basis"}
    assert rows(list(cases), "w string", ph.noun_lemma(F.col("w"))) == list(cases.values())


def test_ratio_theme_weights(spark):
    counts = spark.createDataFrame(
        [("a", "great location", 4), ("a", "hot water", 1), ("b", "great location", 10), ("b", "old bed", 2)],
        "g string, phrase string, count bigint")
    sizes = spark.createDataFrame([("a", 100), ("b", 500)], "g string, n_reviews bigint")
    row = ph.phrase_ratio(counts, sizes, "g", "a", "b").collect()
    assert [(r["phrase"], r["per_k_a"], r["per_k_b"], r["ratio"]) for r in row] == [("great location", 40.0, 20.0, 2.0)]
    share = {r["g"]: r["theme_pct"] for r in ph.theme_share(counts, "g", ("location",)).collect()}
    assert share["a"] == 80.0 and abs(share["b"] - 1000 / 12) < 1e-9
    weights = {(r["g"], r["phrase"]): r["weight"] for r in ph.phrase_weights(counts, "g").collect()}
    assert weights["a", "hot water"] == 0.25 and weights["b", "great location"] == 1.0
    # Ties are broken by the phrase, whatever the partitioning.
    tied = spark.createDataFrame([("a", p, 38) for p in ("short walk", "easy access")], counts.schema)
    top = ph.top_phrases(tied.repartition(5), "g", 1).first()
    assert top["phrase"] == "easy access"


def test_grams(rows):
    assert sorted(rows(["aé b"], "t string", grams("t"))[0]) == sorted(
        ["a", "é", "b", " a", "aé", "é ", " b", "b ", " aé", "aé ", "é b", " b "])


def test_language(spark):
    train = spark.createDataFrame(
        [("en", "the house is very nice and the host was great with us"),
         ("it", "la casa molto bella e il padrone gentile con noi vicino alla stazione"),
         ("de", "das haus ist sehr schön und der gastgeber war nett zu uns")], "lang string, text string")
    profile = langid_fit(train, "text", "lang").persist()
    model = langid_model(profile)
    assert model.languages == ["de", "en", "it"]
    docs = spark.createDataFrame(
        [(1, "the great house"), (2, "casa bella vicino"), (3, "schönes haus"), (4, "123 !!"), (5, None)],
        "id int, text string")
    got = {r["id"]: r["lang_found"] for r in langid_score(docs, "text", model).collect()}
    assert got == {1: "en", 2: "it", 3: "de", 4: None, 5: None}
    kept = keep_language(docs, "text", model, "en").collect()
    assert [r["id"] for r in kept] == [1]


def test_language_is_scored_once_and_after_the_spread(spark):
    """A filter on the language neither repeats the scoring nor moves it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid_model(langid_fit(docs, "text", "lang"))
    kept = keep_language(docs.repartition(5).select("doc_id", "text"), "text", model, "en")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?=(.{3}))") == 1 and plan.count("naive") <= 1
    assert plan.index("(_language") < plan.index("regexp_extract_all") < plan.index("Repartition")


def test_gram_counts_equal_the_grams(spark):
    texts = [("x", t) for t in ("Ab, c", "", None, "é  É", "a", "ab", "straße 12 don't", "#a# b#")]
    df = spark.createDataFrame(texts, "lang string, text string")
    for sizes in ((1, 2, 3), (2,), (1, 4)):
        plain = {}
        for r in df.select(grams("text", sizes).alias("g")).collect():
            for g in r["g"]:
                plain[g] = plain.get(g, 0) + 1
        assert {r["gram"]: r["n"] for r in gram_counts(df, "text", "lang", sizes).collect()} == plain


def test_counted_phrases_equal_the_occurrences(spark):
    rows = [("a", "great location, nice quiet rooms and great location"), ("a", "Great Location nice quiet rooms"), ("b", "quiet rooms. rooms quiet")]
    df = spark.createDataFrame(rows, "g string, text string")
    tags, lemmas = tag_dictionary(spark), lemma_dictionary(spark)
    one = ph.phrases(df, "g", "text", tags, lemmas).groupBy("g", "phrase").count().collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, ph.phrase_counts(df, "g", "text", tags, lemmas).collect()))
    each = ph.lemmatize(ph.tag_tokens(df, "g", "text", tags), lemmas).groupBy("g", "lemma", "tag").count().collect()
    assert sorted(map(tuple, each)) == sorted(map(tuple, ph.tagged_counts(df, "g", "text", tags, lemmas).collect()))


def test_windows_are_counted_before_they_are_looked_up(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = ph.phrase_counts(df, "source", "text", tag_dictionary(spark), lemma_dictionary(spark))
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(lines) if "Join LeftOuter" in line]
    counted = [i for i, line in enumerate(lines) if "Aggregate" in line and "w1" in line]
    assert len(joins) == 3 and counted and max(joins) < max(counted)


def test_language_by_one_sweep_equals_the_weights_of_all_grams(spark, monkeypatch):
    texts = ["Ab, c", "", None, "é  É aé", "a", "straße 12 don't", "\U00010400\U00010401 ab", "ba " * 50, "?!", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    train = spark.createDataFrame([("x", "ab ab é straße"), ("y", "ba don't c \U00010400"), ("z", "a é é ba")], "lang string, text string")
    model = langid_model(langid_fit(train, "text", "lang", size=30))
    slot = {gram: i for i, gram in enumerate(model.vocabulary)}
    for block in (7, 1 << 18):
        monkeypatch.setattr("valuescout.operators.langid._BLOCK", block)
        scored = langid_score(df.select("id", "text", grams("text").alias("g")), "text", model)
        assert scored.drop("g")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
        for r in scored.collect():
            known = [model.weights[:, slot[g]] for g in r["g"] if g in slot]
            if not known:
                assert r["lang_found"] is None
                continue
            sums = sum(known)
            assert sums[model.languages.index(r["lang_found"])] >= sums.max() - 1e-9


def test_phrase_ratio_scores_its_texts_once(spark):
    from valuescout.catalogue.texts import phrase_ratio

    found = phrase_ratio(spark, "/root/testdata/sf0.001")
    assert "(?=(.{3}))" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_scored_without_python(spark):
    """The weights of all n-grams, from the longest known one at each place; no worker needs this library."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter("doc_id % 5 = 0")
    model = langid_model(langid_fit(docs, "text", "lang", size=50))
    slot = {gram: i for i, gram in enumerate(model.vocabulary)}
    scored = langid_score(docs.select("text", grams("text").alias("g")), "text", model)
    assert "Python" not in scored._jdf.queryExecution().toString()
    for r in scored.collect():
        known = [model.weights[:, slot[g]] for g in r["g"] if g in slot]
        sums = sum(known) if known else None
        assert r["lang_found"] is None if not known else sums[model.languages.index(r["lang_found"])] >= sums.max() - 1e-6
