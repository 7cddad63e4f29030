"""The thin queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat, decontam, lines, packing, quality, sharding, simhash, substring, suffix, tokenbin

QUERIES = {
    "op1_sharding": sharding.op1_query,
    "op2_packing": packing.op2_query,
    "op3_substring_dedup": substring.op3_query,
    "op4_simhash": simhash.op4_query,
    "op5_decontamination": decontam.op5_query,
    "op6_suffix_dedup": suffix.op6_query,
    "op7_token_files": tokenbin.op7_query,
    "op8_quality": quality.op8_query,
    "op9_line_dedup": lines.op9_query,
    "op10_chat": chat.op10_query,
}
SQL = {"op1_sharding": sharding.OP1_SQL, "op3_substring_dedup": substring.OP3_SQL, "op10_chat": chat.OP10_SQL}
