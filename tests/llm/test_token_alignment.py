"""Aligned tokens against the two libraries and plain dictionaries."""

import hashlib

import numpy as np
import pytest
from edge_tables import SCHEMA, as_set, documents, with_clashes

from valuescout.llm import token_alignment as module
from valuescout.llm.bpe import default_vocabulary
from valuescout.llm.token_alignment import align_tokenizers, brute_force, default_model, diagonals, op13_alignment, overlaps, score_links

COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "n_overlaps"]
MORE = [
    (30, "a  b\n\n\tc  ", None, None, 0),
    (31, "▁ is not a space", None, None, 0),
    (32, "<s> </s> <unk> <0x41> <|endoftext|>", None, None, 0),
    (33, "\x00\x7f​﻿ é é 👩‍👩‍👧 \U0001f600", None, None, 0),
    (34, "straße STRASSE ﬁ ½ ①", None, None, 0),
    (None, "no id", None, None, 0),
]


def plain(rows):
    return as_set(brute_force(rows, default_vocabulary(), default_model()))


def aligned(df, **options):
    return align_tokenizers(df, default_vocabulary(), default_model(), **options)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 8192])
def test_pieces_of_any_size(piece):
    rng = np.random.default_rng(piece)
    for n in (0, 1, 2, 5, 40, 300):
        a, b = (np.unique(rng.integers(1, 2 * n + 2, rng.integers(0, n + 1))) for _ in range(2))
        end = 2 * n + 3
        a, b = (np.append(x, end) for x in (a, b)) if n else (a, b)
        i, j = diagonals(a, b, piece)
        assert (np.diff(i + j)[:-1] == piece).all() and (i[-1], j[-1]) == (len(a), len(b))
        of_a, of_b, close = overlaps(a, b, piece)
        ends = sorted({*a.tolist(), *b.tolist()})
        assert of_a.tolist() == [int((a < e).sum()) for e in ends]
        assert of_b.tolist() == [int((b < e).sum()) for e in ends]
        assert close.tolist() == [e in a and e in b for e in ends]


@pytest.mark.parametrize("piece", [5, 8192])
def test_awkward_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(module, "BLOCK_BYTES", 3000 if piece == 5 else 1 << 20)
    rows = documents() + MORE + documents()[3:12]  # repeated rows are rows of their own
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    found = score_links(aligned(df, carry=["lang"], piece=piece))
    assert as_set(found.select(COLUMNS).collect()) == plain([r[:2] for r in rows])
    langs = {r[0]: r[2] for r in rows}
    assert all(r["rest"]["lang"] == langs[r["id"]] for r in found.select("id", "rest").collect())


def test_counts_in_several_tables(spark, monkeypatch):
    monkeypatch.setattr(module, "TABLE_PAIRS", 40)
    rows = documents()[:6] + documents()[9:13] + MORE
    found = score_links(aligned(spark.createDataFrame(rows, SCHEMA)))
    assert as_set(found.select(COLUMNS).collect()) == plain([r[:2] for r in rows])


def test_empty_table(spark):
    assert score_links(aligned(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, None, None, None, 0), (2, "", None, None, 0)]
    found = score_links(aligned(spark.createDataFrame(rows, SCHEMA))).select(COLUMNS).collect()
    assert as_set(found) == as_set([(1, 0, 0, 0, 0, 0, 0, "", 0), (2, 0, 0, 0, 0, 0, 0, "", 0)])


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "", r[8]) for r in brute_force(rows, default_vocabulary(), default_model())]
    assert as_set(op13_alignment(spark, folder).collect()) == as_set(expected)
