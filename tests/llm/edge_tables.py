"""Small tables with the awkward cases, for the tests of the operators."""

import random

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix jugs of very strong pale ale tonight"
CLASHING = (
    "id rest did sub tie name whole tag start more place nth many shared spans halves windows kept n ka kb bands sketch "
    "bucket size hub rep node component block low high s hash copies bound whole_copies key piece ids decoded part next "
    "hashes term byte value host path rule verdict lang_pred score ambiguous text_a text_b a b u v cell vec least asks"
).split()


def words(seed, count):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(count))


def documents():
    """(doc_id, text, lang, source, n_chars) with every kind of text."""
    shared = words(1, 80)
    texts = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "one two"),
        (5, "one two"),
        (6, "One TWO"),
        (7, words(2, 9000)),
        (8, "z" * 45000),
        (9, "é" * 130 + " " + PASSAGE),
        (10, "é" * 130 + "! " + PASSAGE + " " + PASSAGE),
        (11, shared + " " + words(3, 40)),
        (12, words(4, 40) + "\n" + shared),
        (13, words(5, 200)),
        (14, words(5, 200) + " more"),
        (15, words(5, 200).replace("a", "A")),
        (16, "<|endoftext|>it's  12<|endoftext|>" + "!?" * 20000),
        (17, "中文字" * 9000 + " " * 9000 + "  x"),
        (18, words(6, 34)),
        (19, words(6, 34)),
        (20, words(7, 35)),
        (21, words(7, 35)),
        (22, "0123 4567 !!! ..."),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang = (None, "en", "fr")[i % 3]
        source = (None, "b", "a", "")[i % 4]
        out.append((doc_id, text, lang, source, None if text is None else len(text)))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def with_clashes(df):
    """The same table with a further column for each name used inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in df.columns])


def as_set(rows):
    return sorted(map(repr, map(tuple, rows)))
