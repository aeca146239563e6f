"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import canonical, leaks, names, neighbours, packing, scans, sentences
from quern.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title entry of every job title, 0 where it names none."""
    return canonical.titles_to_entries(table(spark, sf_dir, "experience"), table(spark, sf_dir, "skill_taxonomy"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stored names that mean the same organisation."""
    return names.link_names(names.organisation_names(table(spark, sf_dir, "experience"), table(spark, sf_dir, "education")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture, divided words and misread words of every page line."""
    return scans.line_defects(table(spark, sf_dir, "page_extraction"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired, reflowed text of every résumé."""
    return scans.paragraphs(table(spark, sf_dir, "page_extraction"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among the most similar vectors of both embedding columns."""
    columns = {"resume": "resume_embedding", "jd": "jd_embedding"}
    return neighbours.similar_pairs(table(spark, sf_dir, "cpp_score"), "score_id", columns)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every piece of every document, for each capacity."""
    return packing.fill_containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of room used, for each capacity."""
    return packing.fill_report(p8_containers(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that they leak."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of every sentence unit of every text."""
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p3_found": p3_found, "p6_found": p6_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {}
