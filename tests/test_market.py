"""Batch, stream and the whole study on small exports."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuescout.plans.listings import clean_listings, listing_report
from valuescout.plans.market import run_market
from valuescout.plans.reviews import clean_reviews, cleaning_audit, listing_facts, score_reviews
from valuescout.dictionaries import sentiment_lexicon
from valuescout.constants import LISTING_COLUMNS
from valuescout.sources.csv import scan_csv_text
from valuescout.sources.schemas import CLEAN_LISTINGS, RAW_LISTING_COLUMNS, RAW_REVIEWS
from valuescout.streaming import cleaning as st

N_LISTINGS = 1500


def _listing(i, rng):
    beds = int(rng.integers(1, 6))
    price = float(np.exp(3.2 + 0.3 * beds + rng.normal(0, 0.4)))
    return dict.fromkeys(RAW_LISTING_COLUMNS, "") | {
        "id": str(10**18 + i), "name": f"Home {i}", "host_id": str(i % 40),
        "latitude": f"{41.8 + rng.random() / 5:.5f}", "longitude": f"{12.4 + rng.random() / 5:.5f}",
        "neighbourhood_cleansed": f"Area {rng.integers(8)}", "property_type": f"Kind {int(rng.integers(20))}",
        "room_type": str(rng.choice(["Entire home/apt", "Private room", "Hotel room"])),
        "accommodates": str(beds * 2), "bedrooms": "" if i % 40 == 0 else str(beds), "beds": str(beds),
        "bathrooms_text": "1.5 baths" if i % 2 else "Half-bath",
        "amenities": json.dumps(["Wifi", "Kitchen", "Washer", "HDTV", "Free parking"][: int(rng.integers(1, 6))]),
        "minimum_nights": "2", "maximum_nights": "30", "instant_bookable": "t" if i % 3 else "f",
        "host_since": "2015-01-01", "host_is_superhost": "t" if i % 5 else "", "last_scraped": "2025-09-15",
        "calculated_host_listings_count": "1", "price": "" if i % 97 == 0 else f"${price:,.2f}",
        "number_of_reviews": str(int(rng.integers(1, 90))), "first_review": "2020-02-30" if i % 2 else "2020-02-28",
    }


def _review(j, i, rng):
    good = ["Great location and very friendly host", "Lovely quiet neighborhood, we loved the stay",
            "Wonderful place with a perfect location!\nThank you"]
    bad = ["The room was dirty and the host was rude", "Terrible noise, not a good place to stay"]
    odd = ["Очень good", "!!!", "Ottimo", ""]
    kind = rng.random()
    text = rng.choice(good if kind < 0.8 else bad if kind < 0.93 else odd)
    return {"listing_id": f"{10**18 + i}.0" if j % 7 == 0 else str(10**18 + i), "id": str(j),
            "date": "2024-12-31" if j % 11 == 0 else f"2025-0{1 + j % 9}-1{j % 10}",
            "reviewer_id": "1", "reviewer_name": "A", "comments": str(text)}


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    rng = np.random.default_rng(1)
    with open(folder / "listings.csv", "w", newline="") as f:
        out = csv.DictWriter(f, RAW_LISTING_COLUMNS)
        out.writeheader()
        for i in range(N_LISTINGS):
            row = _listing(i, rng)
            out.writerow(row)
            if i % 100 == 0:
                out.writerow(row | {"name": "a later copy"})
    (folder / "reviews").mkdir()
    j = 0
    for part in range(3):
        with open(folder / "reviews" / f"part{part}.csv", "w", newline="") as f:
            out = csv.DictWriter(f, RAW_REVIEWS.fieldNames())
            out.writeheader()
            for i in range(N_LISTINGS):
                for _ in range(int(rng.integers(0, 4))):
                    out.writerow(_review(j, i, rng))
                    j += 1
            out.writerow({"listing_id": "corrupt", "id": str(j), "date": "2025-01-01", "comments": "great place"})
            j += 1
    return folder


def test_clean_reviews(spark, exports):
    raw = scan_csv_text(spark, str(exports / "reviews"))
    cleaned = clean_reviews(raw, 2025).cache()
    assert cleaned.columns == [*raw.columns, "comments_clean"]
    assert cleaned.filter(F.year("date") != 2025).count() == 0
    assert cleaned.filter(F.col("comments_clean").contains("\n")).count() == 0
    steps = cleaning_audit(raw, 2025).orderBy("ord").collect()
    assert steps[0]["n_rows"] == raw.count() and steps[-1]["n_rows"] == cleaned.count()
    scored = score_reviews(cleaned, sentiment_lexicon(spark))
    assert scored.columns == [*cleaned.columns, "sentiment_vader"] and scored.count() == cleaned.count()
    facts = listing_facts(scored).collect()
    assert all(r["listing_id"].isdigit() and 0 <= r["positive_rate"] <= 1 for r in facts)


def test_clean_listings(spark, exports):
    raw = scan_csv_text(spark, str(exports / "listings.csv"), RAW_LISTING_COLUMNS)
    reviews = spark.createDataFrame([(str(10**18 + i),) for i in range(0, N_LISTINGS, 2)], "listing_id string")
    raw = raw.withColumn("_order", F.when(F.col("name") == "a later copy", 1).otherwise(0))
    out = clean_listings(raw, reviews, "_order").cache()
    assert tuple(out.columns) == LISTING_COLUMNS
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in CLEAN_LISTINGS.fields]
    priced = [i for i in range(0, N_LISTINGS, 2) if i % 97]
    assert {r["id"] for r in out.select("id").collect()} == {str(10**18 + i) for i in priced}
    assert out.filter("name = 'a later copy'").count() == 0
    row = out.filter(F.col("id") == str(10**18 + 2)).first()
    assert row["bathrooms_num"] == 0.5 and row["has_wifi"] == 1 and row["host_is_superhost_flag"] == 1
    assert row["host_years"] == pytest.approx(3910 / 365.25)
    assert out.filter("first_review IS NULL").count() == 0
    areas, missing = listing_report(out)
    assert areas.first()[0] == 8 and missing.count() == 11


def test_stream_equals_batch(spark, exports, tmp_path):
    folder = str(exports / "reviews")
    out, ids = str(tmp_path / "out"), str(tmp_path / "ids")
    raw = st.review_stream(spark, folder, RAW_REVIEWS, files_per_batch=1)
    # few records are kept: counts are added up while the query runs
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    counts = st.append_available(st.clean_stream(raw, 2025), out, str(tmp_path / "c1"))
    batch = clean_reviews(scan_csv_text(spark, folder), 2025).cache()
    streamed = spark.read.parquet(out).select(*batch.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert counts == {"rows_in": scan_csv_text(spark, folder).count(), "rows_kept": batch.count()}
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    # Nothing new: nothing is added.
    again = st.review_stream(spark, folder, RAW_REVIEWS, files_per_batch=1)
    st.append_available(st.clean_stream(again, 2025), out, str(tmp_path / "c1"))
    assert spark.read.parquet(out).count() == batch.count()
    seen = st.distinct_id_stream(clean_reviews(st.review_stream(spark, folder, RAW_REVIEWS, 1), 2025))
    st.append_available(seen, ids, str(tmp_path / "c2"))
    found = [r["listing_id"] for r in spark.read.parquet(ids).collect()]
    from valuescout.operators.rows import distinct_ids
    assert sorted(found) == sorted(r["listing_id"] for r in distinct_ids(batch, "listing_id").collect())


def test_whole_study(spark, exports, tmp_path):
    out = str(tmp_path / "study")
    run_market(spark, str(exports / "listings.csv"), str(exports / "reviews"), out,
               min_rate=0.5, min_discount=0.05, segment_settings={"restarts": 2, "ks": (1, 2, 3, 4)})
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    counts = [r["n"] for r in read("funnel").orderBy("ord").collect()]
    assert counts == sorted(counts, reverse=True) and counts[-1] == read("gems").count() > 20
    weights = read("phrase_weights").collect()
    assert {r["group"] for r in weights} == {"in", "out"} and max(r["weight"] for r in weights) == 1.0
    assert read("phrase_ratio").filter("ratio > 0").count() > 0
    assert {r["group"] for r in read("theme_share").collect()} == {"in", "out"}
    assert read("gems").join(read("listings_clean").withColumnRenamed("id", "listing_id"), "listing_id", "left_anti").count() == 0
    assigned = read("assignments")
    no_bedrooms = read("gems").join(
        read("listings_clean").filter("bedrooms IS NULL").withColumnRenamed("id", "listing_id"), "listing_id", "left_semi")
    assert assigned.count() == read("gems").count() - no_bedrooms.count()
    assert {r["external_variable"] for r in read("external_validation").collect()} == {
        "price_tertile", "room_type", "discount_tertile"}
    assert read("profile").agg(F.sum("n_listings")).first()[0] == assigned.count()
    assert {r["group"] for r in read("phrases").collect()} == {"in", "out"}
    for k in (1, 2, 3, 4):
        assert read(f"assignments_k{k}").select("cluster").distinct().count() == k == read(f"means_k{k}").count()
        assert read(f"means_k{k}").agg(F.sum("n")).first()[0] == assigned.count()
    z = read("cluster_z").collect()
    assert len(z) == 4 * 5 and all(abs(r["z_clipped"]) <= 1.5 for r in z)
    assert read("listing_areas").first()[0] == 8 and read("listing_missing").count() == 11
    gems_csv = scan_csv_text(spark, f"{out}/gems_csv")
    assert gems_csv.count() == counts[-1]


def test_phrases_of_one_language_only(spark):
    """A text that passes the cleaning step but is found to be in another
    language does not count."""
    from valuescout.dictionaries import lemma_dictionary, tag_dictionary
    from valuescout.operators.langid import langid_fit
    from valuescout.plans.phrases import contrast_phrases

    labelled = [("the great location and a lovely place with friendly people", "en"),
                ("der sehr gute platz und eine schöne wohnung mit netten leuten", "de")]
    profile = langid_fit(spark.createDataFrame(labelled, "text string, lang string"), "text", "lang")
    reviews = spark.createDataFrame(
        [("1", "a", "the great location and friendly people"), ("1", "b", "eine schöne wohnung great location und der gute platz")],
        "listing_id string, id string, comments_clean string",
    )
    ids = spark.createDataFrame([("1",)], "listing_id string")
    dictionaries = tag_dictionary(spark), lemma_dictionary(spark)
    both = contrast_phrases(reviews, ids, *dictionaries).filter("phrase = 'great location'").first()
    one = contrast_phrases(reviews, ids, *dictionaries, profile=profile).filter("phrase = 'great location'").first()
    assert (both["count"], one["count"]) == (2, 1)


def test_duplicate_listings_go_without_an_order_too(spark):
    rows = [dict.fromkeys(RAW_LISTING_COLUMNS, None) | {"id": i, "price": p, "name": n}
            for i, p, n in (("5", "$10.00", "a"), ("5", "$20.00", "b"), ("6", "$30.00", "c"))]
    raw = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in RAW_LISTING_COLUMNS))
    reviews = spark.createDataFrame([("5",), ("6",), ("6",)], "listing_id string")
    cleaned = clean_listings(raw, reviews).collect()
    assert sorted((r["id"], r["price_clean"]) for r in cleaned) == [("5", 10.0), ("6", 30.0)]
