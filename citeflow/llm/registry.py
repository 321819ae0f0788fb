"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from citeflow.llm import ann, chat, langid, lm, packing, pii, sentencepiece, simhash, toxicity, winnowing

QUERIES = {
    "op1_winnowing": winnowing.op1,
    "op2_sentencepiece": sentencepiece.op2,
    "op3_pseudonyms": pii.op3,
    "op4_language": langid.op4,
    "op5_toxicity": toxicity.op5,
    "op6_neighbours": ann.op6,
    "op7_chat": chat.op7,
    "op8_simhash": simhash.op8,
    "op9_packing": packing.op9,
    "op10_lm": lm.op10,
}

ORACLES = {"op7_chat": chat.OP7_SQL}
