"""Chat formatting from every participant's point of view.

Multi-party perspective rotation: a dialogue is rendered once per participant,
with that speaker as the assistant and all others as named users. The mask
marks what the assistant says, its end marker included, as spans of characters
of the rendered text. Built-in column functions only.
"""

from pyspark.sql import DataFrame, Window, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
TURNS_PER_PART = 64
PARTS_PER_BLOCK = 64


def _views(parts: DataFrame) -> DataFrame:
    """at, speaker and begin: a row per part and participant of its dialogue.

    `begin` is the length of all earlier parts as the speaker has them. It is
    added up without texts, inside blocks of parts and then over blocks, so
    that a long dialogue is not added up in one task.
    """

    def length(s):
        name = F.when(s["speaker"] == SYSTEM, len(SYSTEM)).otherwise(len("user name=") + F.length(s["speaker"]))
        return (F.length(s["text"]) + name + len(f"{BEGIN}{END}\n\n")).cast("long")

    # a speaker's own turns are headed by other words than all the others have
    gain = len("assistant") - len("user name=") - F.length("speaker")
    others = F.filter("said", lambda s: s["speaker"] != SYSTEM)
    people = F.array_distinct(F.transform(others, lambda s: s["speaker"]))
    turns_of = lambda name: F.size(F.filter("said", lambda s: s["speaker"] == name))
    own = F.transform(people, lambda name: F.struct(name.alias("speaker"), turns_of(name).cast("long").alias("n_own")))
    light = parts.select(
        "at",
        F.struct("at.conv", "at.alone").alias("whose"),
        F.struct("at.conv", "at.alone", F.floor(F.col("at.part") / PARTS_PER_BLOCK).alias("block")).alias("block"),
        F.aggregate("said", F.lit(0).cast("long"), lambda n, s: n + length(s)).alias("length"),
        own.alias("own"),
    )
    spoken = light.select("at", "block", "whose", F.explode("own").alias("own")).select("at", "block", "whose", "own.*")
    speakers = spoken.select("whose", "speaker").distinct()

    def begins(sized, spoken, key, within, order):
        """Lengths of what stands before each key, as each speaker has it."""
        said = spoken.groupBy(key, "speaker").agg(F.sum("n_own").alias("n_own"))
        seen = sized.join(said, [key, "speaker"], "left")
        length = F.col("length") + F.coalesce("n_own", F.lit(0)) * gain
        before = Window.partitionBy(within, "speaker").orderBy(F.col(order).asc_nulls_first())
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        return seen.withColumn("before", F.coalesce(F.sum(length).over(before), F.lit(0)))

    blocks = light.groupBy("block", "whose").agg(F.sum("length").alias("length")).join(speakers, "whose")
    blocks = begins(blocks, spoken, "block", "whose", "block.block").select("block", "speaker", F.col("before").alias("first"))
    inside = begins(light.select("at", "block", "length").join(blocks, "block"), spoken, "at", "block", "at.part")
    return inside.select("at", "speaker", (F.col("first") + F.col("before")).alias("begin"))


def rotate_perspectives(
    turns: DataFrame, conv_col="conv_id", turn_col="turn", speaker_col="role", text_col="text", per_part=TURNS_PER_PART
) -> DataFrame:
    """One training text per participant of a dialogue, in parts.

    A part holds the turns whose numbers fall in the same `per_part` numbers,
    so that a dialogue of any length is dealt out in bounded pieces. All who
    speak anywhere in the dialogue have every part, whether they speak in it
    or not: the parts of a speaker, put together in the order of their
    numbers, are the rendering of the whole dialogue. The system speaks for
    itself and is no participant. Returns conv (the id), part, speaker,
    n_turns and n_own (turns of the part, and of the speaker in it), start
    (where the part begins in the whole), rendered and mask (array of start
    and stop, counted from the beginning of the whole).

    Defined cases: a null speaker has the empty name; a null text is empty; a
    null turn number belongs to part null and sorts first; rows without a
    conversation are dialogues of their own, equal ones together; equal turn
    numbers are ordered by speaker and text, repeated rows are kept; a
    dialogue of the system alone gives no row; `<|` inside a text or name is
    written `< |`, so that it can't end a turn; an empty table gives an empty
    result; columns not named are ignored, whatever they are called.
    """

    def clean(column):
        return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))

    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.floor(F.col(turn_col) / per_part).alias("part"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.translate(clean(speaker_col), "\n", " ").alias("speaker"),
            clean(text_col).alias("text"),
        ).alias("said"),
    )
    alone = F.when(F.col("conv").isNull(), F.md5(F.to_json("said").cast("binary")))
    # structs are never null, so that equal nulls meet in joins
    at = F.struct("conv", alone.alias("alone"), "part")
    parts = rows.groupBy(at.alias("at")).agg(F.array_sort(F.collect_list("said")).alias("said"))
    views = parts.join(_views(parts), "at").select("at.conv", "at.part", "said", "speaker", "begin")

    def head(said, speaker):
        own = F.when(said["speaker"] == speaker, F.lit(f"{BEGIN}assistant\n"))
        system = own.when(said["speaker"] == SYSTEM, F.lit(f"{BEGIN}{SYSTEM}\n"))
        return system.otherwise(F.concat(F.lit(f"{BEGIN}user name="), said["speaker"], F.lit("\n")))

    lines = F.transform(
        "said",
        lambda s: F.struct(
            head(s, F.col("speaker")).alias("head"),
            F.concat(s["text"], F.lit(END)).alias("body"),
            (s["speaker"] == F.col("speaker")).alias("own"),
        ),
    )
    views = views.select("conv", "part", "speaker", "begin", lines.alias("lines"))
    spans = "array<struct<start:long,stop:long>>"
    empty = F.struct(F.col("begin").alias("at"), F.array().cast(spans).alias("mask"))

    def advance(done, line):
        start = done["at"] + F.length(line["head"])
        stop = start + F.length(line["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        mask = F.when(line["own"], F.concat(done["mask"], span)).otherwise(done["mask"])
        return F.struct((stop + 1).alias("at"), mask.alias("mask"))

    return views.select(
        "conv",
        "part",
        "speaker",
        F.size("lines").cast("long").alias("n_turns"),
        F.size(F.filter("lines", lambda l: l["own"])).cast("long").alias("n_own"),
        F.col("begin").alias("start"),
        F.array_join(F.transform("lines", lambda l: F.concat(l["head"], l["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("lines", empty, advance, lambda done: done["mask"]).alias("mask"),
    )


def op9_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    views = rotate_perspectives(turns)
    span = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string")))
    return views.select(F.col("conv").alias("conv_id"), "part", "speaker", "n_turns", "n_own", "rendered", F.array_join(span, ",").alias("mask"))


SQL = f"""
WITH said AS (
  SELECT conv_id, floor(turn / {TURNS_PER_PART}.0)::BIGINT AS part, turn,
         replace(replace(coalesce(role, ''), '<|', '< |'), chr(10), ' ') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text,
         CASE WHEN conv_id IS NULL THEN md5(concat(turn, '/', role, '/', text)) END AS alone
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, alone, speaker AS view FROM said WHERE speaker <> '{SYSTEM}'
), lines AS (
  SELECT s.*, v.view, s.speaker = v.view AS own,
         CASE WHEN s.speaker = v.view THEN '{BEGIN}assistant' || chr(10)
              WHEN s.speaker = '{SYSTEM}' THEN '{BEGIN}{SYSTEM}' || chr(10)
              ELSE '{BEGIN}user name=' || s.speaker || chr(10) END AS head,
         s.text || '{END}' AS body
  FROM said s JOIN people v ON s.conv_id IS NOT DISTINCT FROM v.conv_id AND s.alone IS NOT DISTINCT FROM v.alone
), placed AS (
  SELECT *, row_number() OVER w AS n,
         sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS start
  FROM lines
  WINDOW w AS (PARTITION BY conv_id, alone, view ORDER BY turn NULLS FIRST, speaker, text
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, part, view AS speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN start || '-' || (start + length(body)) END, ',' ORDER BY n), '') AS mask
FROM placed GROUP BY conv_id, alone, part, view
"""
