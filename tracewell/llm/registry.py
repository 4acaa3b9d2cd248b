"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, flac, langid, lm, mixing, neardup, pii, secrets, sharding, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_langid": langid.op2_langid,
        "op3_secrets": secrets.op3_secrets,
        "op4_mixing": mixing.op4_mixing,
        "op5_sharding": sharding.op5_sharding,
        "op6_lm": lm.op6_lm,
        "op7_minhash": neardup.op7_minhash,
        "op8_substrings": substrings.op8_substrings,
        "op9_flac": flac.op9_flac,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_substrings": substrings.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
