"""Queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from spindle.llm.bpe import op3_bpe
from spindle.llm.byte_bpe import op11_byte_bpe
from spindle.llm.decontaminate import OP8_SQL, op8_decontamination
from spindle.llm.fixity import OP9_SQL, op9_fixity
from spindle.llm.hamming import OP10_SQL, op10_topk
from spindle.llm.language import op5_language
from spindle.llm.minhash import OP7_SQL, op7_minhash
from spindle.llm.periodic import OP12_SQL, op12_periodic
from spindle.llm.quality import op1_quality
from spindle.llm.repeats import OP2_SQL, op2_suffix_dedup
from spindle.llm.spelling import OP13_SQL, op13_spelling
from spindle.llm.unigram import op4_token_counts
from spindle.llm.urls import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_url_filter": op6_url_filter,
    "op7_minhash": op7_minhash,
    "op8_decontamination": op8_decontamination,
    "op9_fixity": op9_fixity,
    "op10_topk": op10_topk,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic": op12_periodic,
    "op13_spelling": op13_spelling,
}
ORACLE = {
    "op2_suffix_dedup": OP2_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_minhash": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_fixity": OP9_SQL,
    "op10_topk": OP10_SQL,
    "op12_periodic": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
