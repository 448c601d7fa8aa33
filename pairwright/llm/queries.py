"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import CHAT_SQL, op8_chat_format
from .decontamination import op2_template_decontamination
from .dedup import op3_near_duplicates
from .langid import op10_language_profiles
from .mixing import op4_entropy_mixing
from .quality import QUALITY_SQL, op5_adaptive_quality
from .secrets import op6_secret_forest
from .sharding import op1_feistel_sharding
from .tokens import op7_token_counts
from .warc import op9_merkle_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_feistel_sharding, op2_template_decontamination, op3_near_duplicates, op4_entropy_mixing, op5_adaptive_quality, op6_secret_forest, op7_token_counts, op8_chat_format, op9_merkle_fixity, op10_language_profiles)
}

ORACLES: dict[str, str] = {"op5_adaptive_quality": QUALITY_SQL, "op8_chat_format": CHAT_SQL}
