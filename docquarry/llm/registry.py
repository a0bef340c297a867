"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from docquarry.llm.conversations import op12_conversations
from docquarry.llm.licenses import op2_licenses
from docquarry.llm.lines import OP1_SQL, op1_lines
from docquarry.llm.lm import op7_lm
from docquarry.llm.minhash import op13_minhash
from docquarry.llm.mixing import OP4_SQL, op4_mixing
from docquarry.llm.pieces import op8_pieces
from docquarry.llm.quality import OP6_SQL, op6_quality
from docquarry.llm.runs import op11_runs
from docquarry.llm.simhash import op3_simhash
from docquarry.llm.topk import OP5_SQL, op5_topk
from docquarry.llm.toxicity import op10_toxicity
from docquarry.llm.urls import OP9_SQL, op9_urls

QUERIES = {
    "op1_lines": op1_lines,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_lm": op7_lm,
    "op8_pieces": op8_pieces,
    "op9_urls": op9_urls,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_conversations": op12_conversations,
    "op13_minhash": op13_minhash,
}
ORACLES = {
    "op1_lines": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op5_topk": OP5_SQL,
    "op6_quality": OP6_SQL,
    "op9_urls": OP9_SQL,
}
