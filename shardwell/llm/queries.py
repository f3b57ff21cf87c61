"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_preferences
from .decontaminate import op8_decontamination
from .exact import OP5_SQL, op5_exact_dedup
from .langid import op9_language_id
from .licenses import op4_licenses
from .mixing import OP6_SQL, op6_mixing
from .secrets import op7_secrets
from .simhash import op10_simhash
from .toxicity import op3_toxicity
from .warc import OP1_SQL, op1_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_preferences": op2_preferences,
        "op3_toxicity": op3_toxicity,
        "op4_licenses": op4_licenses,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_mixing": op6_mixing,
        "op7_secrets": op7_secrets,
        "op8_decontamination": op8_decontamination,
        "op9_language_id": op9_language_id,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_preferences": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_mixing": OP6_SQL}
