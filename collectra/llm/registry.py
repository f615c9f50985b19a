"""The subpackage's queries and their SQL."""

from . import chat, decontaminate, language, mixing, quality, repeats, sharding, simhash, tokens, topk

QUERIES = {
    "op1_chat_format": chat.op1,
    "op2_simhash": simhash.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_top_k": topk.op4,
    "op5_repeats": repeats.op5,
    "op6_mixing": mixing.op6,
    "op7_language": language.op7,
    "op8_tokens": tokens.op8,
    "op9_quality": quality.op9,
    "op10_sharding": sharding.op10,
}
SQL = {"op1_chat_format": chat.OP1_SQL, "op3_decontaminate": decontaminate.OP3_SQL, "op4_top_k": topk.OP4_SQL}
