"""Registered queries of the training-data operators."""

from gridloom.llm import chat, decontaminate, knn, langid, mixing, neardup, ngramlm, pii, suffixdedup, toxicity

QUERIES = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_topk_search": knn.op2_topk_search,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_suffix_dedup": suffixdedup.op4_suffix_dedup,
    "op5_lm_score": ngramlm.op5_lm_score,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": langid.op8_language_id,
    "op9_chat_format": chat.op9_chat_format,
    "op10_pii": pii.op10_pii,
}

ORACLES = {
    "op1_near_dedup": neardup.OP1_SQL,
    "op2_topk_search": knn.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
