"""The corpus pipeline: each stage applies one operator of `valuescout.llm`.

Stages take (spark, docs, sf_dir) and return a DataFrame; each is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents. Missing columns count as null, further columns are left
out.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from valuescout.llm.bpe import default_vocabulary, encode_texts
from valuescout.llm.language import UNDETERMINED, fit_languages, identify_languages
from valuescout.llm.mixing import mix_sources
from valuescout.llm.near_dedup import near_duplicates
from valuescout.llm.suffix_dedup import remove_earlier_bytes

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
REST = ["doc_id", "lang", "source", "n_chars"]
BATCH_ROWS = 1000  # whole texts that go to a Python worker at once


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; their texts travel in batches of bounded rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    have = set(docs.columns)
    return docs.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()]
    )


def known_language(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Drop texts whose language can't be told: no letter, or two languages
    equally likely. The labels of the documents themselves train the model;
    without any label nothing can be told apart and texts with a letter stay.
    Null and empty texts go; equal texts stay or go together; an empty table
    gives an empty result.
    """
    docs = documents(docs)
    model = fit_languages(docs)
    found = identify_languages(docs, model, carry=REST)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = found.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return documents(found.select("text", "rest.*"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Keep one document of each group of near-duplicates: the least id.

    Rows that share an id are one document; a row without an id stays.
    """
    docs = documents(docs)
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Cut out 100-byte passages that occur earlier; every document stays.

    A character that is cut in half goes too; n_chars is counted again.
    """
    done = remove_earlier_bytes(documents(docs), carry=REST)
    text = F.when(F.col("n_bytes") > 0, F.col("kept_text"))
    out = done.select(text.alias("text"), "rest.*")
    return documents(out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Each document as often as the mix takes it: none, once, up to thrice.

    Null and empty texts count no words and are taken like the others of their
    source; rows that share id and text are taken together; a null source is a
    source of its own; an empty table gives an empty result.
    """
    done = mix_sources(documents(docs), carry=["doc_id", "text", "lang", "n_chars"])
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    out = done.filter(F.col("copies") > 0).withColumn("copy", copies)
    return documents(out.select("source", "rest.*"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Token ids of every text; `exact` tells that decoding gives the text again.

    A null or empty text has no ids and is exact; rows that share an id or a
    text keep a row each; an empty table gives an empty result.
    """
    done = encode_texts(documents(docs), default_vocabulary(), carry=["lang", "source"], decoded=False)
    return done.select(
        F.col("id").alias("doc_id"), "rest.lang", "rest.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact"
    )


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeated_passages),
    ("mix", mixed),
    ("tokens", encoded),
]
# near-duplicate bands, byte passages and BPE are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir) -> DataFrame:
    """All stages over the documents, each written out for the next."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="corpus-pipeline-")
    folder = f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
