"""Queries of the general record problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.intervals import employment_periods
from quern.operators.nested import child_paths, child_rows, merged_schema
from quern.operators.timestamps import normalise_dates
from quern.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of all free-text dates of experience and education."""
    contact = table(spark, sf_dir, "contact")
    jobs = normalise_dates(table(spark, sf_dir, "experience"), contact, "experience", "row_id", ["start_date", "end_date"])
    return jobs.unionByName(normalise_dates(table(spark, sf_dir, "education"), contact, "education", "edu_id", ["end_date"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of employment and the gaps between them."""
    return employment_periods(table(spark, sf_dir, "experience"), table(spark, sf_dir, "contact"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of every child of every readable payload."""
    return child_paths(table(spark, sf_dir, "resume_raw"))


def p7_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all child tables: table, key of the parent, own key, place and text."""
    return child_rows(table(spark, sf_dir, "resume_raw")).withColumnRenamed("at", "child_table")


def p7_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema merged over all readable payloads: every path with the kinds of its values."""
    return merged_schema(table(spark, sf_dir, "resume_raw"), "payload").select(F.array_join("path", ".").alias("path"), "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p7_tables": p7_tables, "p7_schema": p7_schema}
