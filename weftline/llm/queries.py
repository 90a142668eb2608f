"""Queries p6 to p8 over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.leaks import find_leaks
from weftline.llm.spam import find_spam, score_pages
from weftline.llm.tokens import encode_texts
from weftline.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", prompt="prompt")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("distance = 0").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """With passages of which one word was edited."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_spam(table(spark, d, "documents"), doc_id="doc_id", text="text").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_pages(table(spark, d, "documents"), doc_id="doc_id", text="text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}

ORACLES: dict[str, str] = {}
