"""Request and taxonomy sources, report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "resume_text string, jd_text string, resume_embedding array<float>, jd_embedding array<float>"


def requests(raw: DataFrame, json_col: str) -> DataFrame:
    """(resume_text, jd_text, resume_embedding, jd_embedding, error) of JSON requests.

    Missing texts are '', missing vectors empty; an unreadable request or an
    empty text puts a message into error and never fails the job.
    """
    v = F.from_json(F.col(json_col), REQUEST + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.select(v.alias("v"))
    text = lambda c: F.coalesce(F.col(f"v.{c}"), F.lit(""))
    vec = lambda c: F.coalesce(F.col(f"v.{c}"), F.array().cast("array<float>"))
    out = rows.select(F.col("v._bad").alias("_bad"), F.col("v").isNull().alias("_none"), *[text(c).alias(c) for c in ("resume_text", "jd_text")], *[vec(c).alias(c) for c in ("resume_embedding", "jd_embedding")])
    error = F.when(F.col("_none") | F.col("_bad").isNotNull(), "unreadable request").when(F.col("resume_text") == "", "resume_text is empty").when(F.col("jd_text") == "", "jd_text is empty")
    return out.withColumn("error", error).drop("_bad", "_none")


def taxonomy(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """(ord, canonical, category, aliases) of a taxonomy file with a list of skills.

    A file that is absent, unreadable or without skills gives the fallback,
    or an error if there is none.
    """
    schema = "version string, skills array<struct<canonical_name:string,category:string,aliases:array<string>>>"
    try:
        raw = spark.read.option("multiLine", True).schema(schema).json(path)
        skills = raw.select(F.posexplode("skills").alias("ord", "s")).select("ord", F.col("s.canonical_name").alias("canonical"), "s.category", "s.aliases").where(F.col("canonical").isNotNull())
        if fallback is None or not skills.isEmpty():
            return skills
    except AnalysisException:
        if fallback is None:
            raise
    return fallback.select("ord", "canonical", "category", "aliases")


def taxonomy_record(entries: DataFrame, version: str = "1") -> DataFrame:
    """(value): the taxonomy (ord, canonical, category, aliases) as one JSON text, as a file of its own holds it (S6); for lists of a bounded size."""
    rows = entries.agg(F.array_sort(F.collect_list(F.struct("ord", F.col("canonical").alias("canonical_name"), "category", "aliases"))).alias("l"))
    skills = F.transform("l", lambda x: F.struct(x["canonical_name"], x["category"], x["aliases"]))
    return rows.select(F.to_json(F.struct(F.lit(version).alias("version"), skills.alias("skills"))).alias("value"))


def write_stage(df: DataFrame, folder: str, stage: str, form: str = "json") -> None:
    """Write the artefact of a stage."""
    df.write.mode("overwrite").format(form).save(f"{folder}/{stage}")
