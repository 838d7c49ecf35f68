"""Registered queries of the subpackage and their SQL twins."""

from valuescout.llm import (
    bpe,
    chat,
    decontamination,
    hard_negatives,
    imatch,
    language,
    mixing,
    near_dedup,
    neighbours,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    url_filter,
)

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        mixing.op2_mixing,
        neighbours.op3_neighbours,
        bpe.op4_bpe,
        imatch.op5_imatch,
        url_filter.op6_url_filter,
        language.op7_language,
        near_dedup.op8_near_dedup,
        chat.op9_chat,
        suffix_dedup.op10_suffix_dedup,
        decontamination.op11_decontamination,
        hard_negatives.op12_hard_negatives,
        token_alignment.op13_alignment,
    )
}
ORACLES = {
    "op2_mixing": mixing.SQL,
    "op6_url_filter": url_filter.SQL,
    "op9_chat": chat.SQL,
    "op11_decontamination": decontamination.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
