"""The subpackage's queries and their SQL, by name."""

from . import ann, chat, langid, line_dedup, minhash, packing, pii, quality, sentencepiece, token_counts

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_minhash": minhash.op2_minhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_pii": pii.op10_pii,
    "op3_ann": ann.op3_ann,
    "op8_langid": langid.op8_langid,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op5_chat": chat.op5_chat,
    "op7_token_counts": token_counts.op7_token_counts,
    "op6_packing": packing.op6_packing,
}
SQL = {"op5_chat": chat.OP5_SQL, "op1_quality": quality.OP1_SQL, "op2_minhash": minhash.OP2_SQL, "op9_line_dedup": line_dedup.OP9_SQL}
