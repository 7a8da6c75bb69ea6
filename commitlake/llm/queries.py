"""Queries of the subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op6_ann
from .chat import OP4_SQL, op4_chat
from .decontam import OP9_SQL, op9_decontamination
from .mixing import OP8_SQL, op8_mixing
from .quality import op3_quality
from .sharding import op1_sharding
from .simhash import op2_simhash
from .suffix_dedup import op10_suffix_dedup
from .tokenfile import op7_tokens
from .toxicity import op5_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_tokens": op7_tokens,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES = {"op4_chat": OP4_SQL, "op8_mixing": OP8_SQL, "op9_decontamination": OP9_SQL}
