"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op8_chat
from .decontamination import op9_decontamination
from .exact_search import op11_exact_search
from .hard_negatives import op12_hard_negatives
from .language import op7_language
from .language_model import op4_language_model
from .media import op6_media
from .near_dedup import op2_near_dedup
from .oracle import CONVERSATION_REPAIR, DECONTAMINATION, EXACT_SEARCH, HARD_NEGATIVES, NEAR_DEDUP, SUBSTRING_DEDUP
from .packing import op3_packing
from .quality import op5_quality
from .repair import op13_conversation_repair
from .substring_dedup import op1_substring_dedup
from .token_counts import op10_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_packing": op3_packing,
    "op4_language_model": op4_language_model,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_language": op7_language,
    "op8_chat": op8_chat,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_exact_search": op11_exact_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_near_dedup": NEAR_DEDUP,
    "op9_decontamination": DECONTAMINATION,
    "op11_exact_search": EXACT_SEARCH,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
