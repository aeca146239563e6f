"""Category scores, overall score, explanations and reports from features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import lexicon as L
from quern.functions.text import half_up
from quern.operators.pairs import FEATURES


CATEGORIES = list(L.CATEGORY_WEIGHTS)


def _weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()])


def category_scores(features: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Adds category scores in 0..100 (C1-C7), all six or the ones named; every feature of them must be a column."""
    wanted = {n: L.CATEGORY_WEIGHTS[n] for n in categories or CATEGORIES}
    absent = sorted({k for weights in wanted.values() for k in weights} - set(features.columns))
    if absent:
        raise ValueError(f"missing features: {', '.join(absent)}")
    return features.withColumns({f"{n}_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * _weighted(w))) for n, w in wanted.items()})


def one_decimal(c: Column) -> Column:
    """A score to one decimal; the last bits of a sum, which depend on its order, don't count."""
    return half_up(half_up(c, 6), 1)


def unusable() -> Column:
    """Why a pair can't be scored, '' if it can."""
    return F.when(F.coalesce("text", F.lit("")) == "", "resume_text is empty").when(F.coalesce("query_text", F.lit("")) == "", "jd_text is empty").otherwise("")


def overall_score(scores: DataFrame) -> DataFrame:
    """Adds overall_score to one decimal and the label of the method."""
    total = reduce(lambda a, b: a + b, [F.col(f"{k}_score") * w for k, w in L.OVERALL_WEIGHTS.items()])
    return scores.withColumn("overall_score", one_decimal(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)))).withColumn("ranking_method", F.lit("linear_fallback"))


def ranked(scores: DataFrame, query: str, doc: str, score: str = "overall_score") -> DataFrame:
    """Adds the rank of each document of a query, equal scores sharing one."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(query).orderBy(F.col(score).desc())))


def months_text(share: Column, limit: int = 240) -> Column:
    """A capped share of months as years and months."""
    m = F.floor(share * limit + 1e-9).cast("int")
    y, r = F.floor(m / 12).cast("int"), m % 12
    years = F.when(r == 0, F.format_string("%d yr%s", y, F.when(y > 1, "s").otherwise(""))).otherwise(F.format_string("%d yr %d mo", y, r))
    return F.when(m >= 12, years).otherwise(F.format_string("%d month%s", m, F.when(m != 1, "s").otherwise("")))


def factors(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., feature, side, weight, text): rules whose thresholds a feature passes."""
    rules = [
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("v"), F.lit(p).alias("pos"), F.lit(q).alias("neg"), F.lit(pt).alias("pt"), F.lit(nt).alias("nt"))
        for i, (n, p, q, pt, nt) in enumerate(L.EXPLANATIONS)
    ]
    rows = features.select(*keys, F.explode(F.array(*rules)).alias("r")).select(*keys, "r.*")
    side = F.when(F.col("v") >= F.col("pos"), "positive").when(F.col("v") < F.col("neg"), "negative")
    value = F.when(F.col("feature").isin("relevant_experience_months", "total_experience_months"), months_text(F.col("v"))).otherwise(F.concat(F.bround(F.col("v") * 100, 0).cast("int").cast("string"), F.lit("%")))
    rows = rows.withColumn("side", side).where(F.col("side").isNotNull())
    text = F.replace(F.when(F.col("side") == "positive", F.col("pt")).otherwise(F.col("nt")), F.lit("{value}"), value)
    return rows.select(*keys, "ord", "feature", "side", F.when(F.col("side") == "positive", F.col("v")).otherwise(1 - F.col("v")).alias("weight"), text.alias("text"))


def skill_factors(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Factors that name the first three missing and matched skills (E3); gaps has missing and matched lists."""
    some = lambda c: F.concat(F.array_join(F.slice(c, 1, 3), ", "), F.when(F.size(c) > 3, F.format_string(" +%d more", F.size(c) - 3)).otherwise(""))
    missing = gaps.where(F.size("missing") > 0).select(*keys, F.lit(100).alias("ord"), F.lit("missing").alias("feature"), F.lit("negative").alias("side"), F.lit(0.9).alias("weight"), F.concat(F.lit("Missing required skills: "), some("missing")).alias("text"))
    strong = gaps.where(F.size("matched") > 0).select(*keys, F.lit(101).alias("ord"), F.lit("matched").alias("feature"), F.lit("positive").alias("side"), F.lit(0.85).alias("weight"), F.concat(F.lit("Strong alignment: "), some("matched")).alias("text"))
    return missing.unionByName(strong)


def top_factors(all_factors: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """(keys.., side, rank, text): the k weightiest factors of each side, ties to the earlier rule."""
    w = Window.partitionBy(*keys, "side").orderBy(F.col("weight").desc(), "ord")
    return all_factors.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "side", "rank", "text")


def explained(features: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """(keys.., side, rank, text): the weightiest factors of features and of skill lists together."""
    return top_factors(factors(features, keys).unionByName(skill_factors(features, keys)), keys, k)


# Messages of the flags.
RED_FLAGS = {
    "job_hopper_flag": "Job-Hopping Detected (3+ short tenures)",
    "keyword_stuffing_penalty": "Keyword Stuffing Detected (Extremely high skill density)",
    "overqualified_flag": "Over-Qualification Risk (Seniority exceeds role requirements)",
}
# Factors that stand in where a side has none.
BASELINE_FACTOR = "Candidate shows baseline alignment with the role"
NO_GAP_FACTOR = "No significant gaps identified — review manually for culture fit"


def with_fallbacks(top: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a factor for a side without any (E5): praise only if skills, experience and semantic scores average 40 or more."""
    sides = top.groupBy(*keys).agg(F.bool_or(F.col("side") == "positive").alias("_p"), F.bool_or(F.col("side") == "negative").alias("_n"))
    mean = (F.col("skills_score") + F.col("experience_score") + F.col("semantic_score")) / 3
    rows = scores.select(*keys, mean.alias("_m")).join(sides, keys, "left")
    none = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    praise = F.when(none("_p") & (F.col("_m") >= 40), F.struct(F.lit("positive").alias("side"), F.lit(1).alias("rank"), F.lit(BASELINE_FACTOR).alias("text")))
    blame = F.when(none("_n"), F.struct(F.lit("negative").alias("side"), F.lit(1).alias("rank"), F.lit(NO_GAP_FACTOR).alias("text")))
    added = rows.select(*keys, F.explode(F.array_compact(F.array(praise, blame))).alias("f")).select(*keys, "f.*")
    return top.select(*keys, "side", "rank", "text").unionByName(added)


def red_flags(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., flags): messages of the raised flags."""
    tests = [F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0.5, F.lit(t)) for c, t in RED_FLAGS.items()]
    return features.select(*keys, F.array_compact(F.array(*tests)).alias("flags"))


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def reports(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., report): the response record as JSON.

    scores: features, lists of skills and scores of pairs. Scores have one
    decimal, confidences three, features four. A pair without a text gets the
    record of an error: scores 0, empty lists and the message.
    """
    why = unusable()
    usable = why == ""
    top = with_fallbacks(explained(scores.where(usable), keys), scores.where(usable), keys)
    side = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("rank", "text")))), lambda x: x["text"])
    told = top.groupBy(*keys).agg(side("positive").alias("top_positive_factors"), side("negative").alias("top_negative_factors"))
    rows = scores.join(told, keys, "left").withColumn("_why", why)
    none = F.expr("cast(array() as array<string>)")
    zero = lambda c: F.when(usable, c).otherwise(F.lit(0.0))
    texts = lambda c: F.when(usable, F.coalesce(F.col(c), none)).otherwise(none)
    six = F.struct(*[zero(one_decimal(F.col(f"{c}_score"))).alias("resume_quality" if c == "quality" else c) for c in CATEGORIES])
    near = F.transform("partial", lambda x: F.struct(x["jd_skill"], x["matched_as"], half_up(x["confidence"], 3).alias("confidence")))
    vector = F.when(usable, F.struct(*[half_up(F.col(c), 4).alias(c) for c in FEATURES]))
    record = F.struct(
        zero(F.col("overall_score")).alias("overall_score"), six.alias("scores"), texts("matched").alias("matched_skills"), texts("missing").alias("missing_skills"), F.when(usable, near).alias("partial_skills"),
        *[texts(c).alias(c) for c in ("top_positive_factors", "top_negative_factors")], F.when(usable, F.col("ranking_method")).alias("ranking_method"), vector.alias("feature_vector"), F.nullif("_why", F.lit("")).alias("error"),
    )
    return rows.select(*keys, F.to_json(record, {"ignoreNullFields": "false"}).alias("report"))


# Limits at which the older features are full; the others are in 0..1.
LEGACY_CAPS = {"total_experience_months": 240.0, "num_positions": 10.0, "avg_tenure_months": 60.0, "max_seniority_score": 5.0, "num_degrees": 3.0, "highest_degree_level": 5.0, "num_institutions": 3.0, "total_canonical_skills": 30.0, "category_diversity": 10.0, "num_projects": 10.0, "avg_technologies_per_project": 10.0, "num_certifications": 10.0, "num_unique_issuers": 5.0, "summary_embedding_norm": 1.5, "skills_text_embedding_norm": 1.5}


def legacy_normalised(names: list[str]) -> dict[str, Column]:
    """Older features in 0..1 (L11); the share of unmatched skills is inverted, the consistency goes from -1..1 to 0..1."""
    out = {}
    for n in names:
        v = (F.col(n) + 1) / 2 if n == "summary_skills_semantic_consistency" else F.col(n) / F.lit(LEGACY_CAPS.get(n, 1.0))
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        out[n] = 1 - v if n == "unmatched_skill_ratio" else v
    return out


def heuristic_score(features: DataFrame, keys: list[str], names: list[str], similarity: str) -> DataFrame:
    """(keys.., score, the contributions): .6 of the similarity in 0..1 and .4 shared evenly by the older features, each to 4 decimals."""
    exact = lambda c: half_up(half_up(c, 9), 4)
    near = exact(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(similarity) + 1) / 2)) * 0.6)
    parts = {n: exact(v * (0.4 / max(1, len(names)))) for n, v in legacy_normalised(names).items()}
    return features.select(*keys, near.alias("retrieval_similarity"), *[v.alias(n) for n, v in parts.items()]).withColumn(
        "score", exact(reduce(lambda a, b: a + b, [F.col(n) for n in ("retrieval_similarity", *names)]))
    )
