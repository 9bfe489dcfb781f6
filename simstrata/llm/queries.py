"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simstrata.llm import ann, bpe, langid, license, lm, neardup, packing, quality, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_lm": lm.op2_lm,
        "op3_urlfilter": urlfilter.op3_urlfilter,
        "op4_quality": quality.op4_quality,
        "op5_neardup": neardup.op5_neardup,
        "op6_packing": packing.op6_packing,
        "op7_warc": warc.op7_warc,
        "op8_ann": ann.op8_ann,
        "op9_bpe": bpe.op9_bpe,
        "op10_license": license.op10_license,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality": quality.OP4_SQL,
        "op7_warc": warc.OP7_SQL,
        "op10_license": license.op10_sql(),
    }
