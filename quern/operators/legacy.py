"""Operators of the older generation: matcher cascade, raw features, narrative, prompt, page clean-up, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ascii_lower, half_up, ladder, squeeze
from quern.operators.retrieval import signed_cosine
from quern.operators.sections import tenure_months
from quern.operators.skills import fuzzy_best

# Seniority of a title, the highest of the words that it holds.
SENIORITY = {"principal": 5.0, "staff": 4.5, "lead": 4.0, "senior": 3.5, "sr.": 3.5, "sr ": 3.5, "mid-level": 2.5, "associate": 2.0, "junior": 1.5, "jr.": 1.5, "intern": 1.0, "trainee": 1.0}
SENIORITY_DEFAULT = 2.0
# Level of a degree by the first of the substrings that it holds.
DEGREES = [
    (["phd", "doctorate", "doctoral"], 5.0), (["master", "m.tech", "mtech", "msc", "m.s.", "mba"], 4.0),
    (["bachelor", "b.tech", "btech", "bsc", "b.s.", "be ", "b.e."], 3.0), (["associate", "diploma"], 2.0), (["high school", "secondary"], 1.0),
]
# Patterns of an editor's surface in copied pages.
SURFACE = ["FileEditViewInsertFormatTools.*?Help", "Normal text", "Calibri", "Arial", "Editing", "Show tabs and outlines", "Turn on screen reader support", r"To enable screen reader support.*?Ctrl\+slash", "Banner hidden"]
# The last line of the prompt.
CLOSING = "Based on this data, provide the 'match_summary' and the specific rewrite 'suggestions'."
# Names that aren't written in title case.
DISPLAY = {"c": "C", "r": "R", "cpp": "C++", "c++": "C++", "c#": "C#", "javascript": "JavaScript", "typescript": "TypeScript", "html": "HTML", "css": "CSS", "php": "PHP", "sql": "SQL", "mysql": "MySQL", "postgresql": "PostgreSQL", "aws": "AWS", "gcp": "GCP", "api": "API", "ui": "UI", "ux": "UX", "react": "React", "node": "Node.js"}


def plain_key(c: Column) -> Column:
    """Letters, digits, white space and + # . (L1)."""
    return squeeze(F.regexp_replace(F.regexp_replace(ascii_lower(c), r"[\t\n\r]", " "), r"[^a-z0-9 +#.]", ""))


def cascade(values: DataFrame, value_col: str, patterns: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(value, canonical, category, confidence, method) of each distinct value: exact, else fuzzy, else unmatched.

    Nulls and blanks are left out; an unmatched value stands for itself in
    the category Uncategorized with confidence .3.
    """
    distinct = values.select(F.col(value_col).alias("value")).where(F.trim(value_col) != "").distinct().withColumn("key", plain_key(F.col("value")))
    names = patterns.withColumn("key", plain_key("pattern")).groupBy("key").agg(F.min_by(F.struct("canonical", "category"), F.struct("ord", "alias_ord")).alias("e"))
    exact = distinct.join(names, "key").select("value", "e.canonical", "e.category", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    rest = distinct.join(names, "key", "left_anti").select("value")
    category = patterns.groupBy("canonical").agg(F.min("category").alias("category"))
    near = fuzzy_best(rest, "value", patterns, threshold).join(category, "canonical")
    near = near.select("value", "canonical", "category", F.col("similarity").alias("confidence"), F.lit("fuzzy").alias("method"))
    none = rest.join(near.select("value"), "value", "left_anti")
    none = none.select("value", F.col("value").alias("canonical"), F.lit("Uncategorized").alias("category"), F.lit(0.3).alias("confidence"), F.lit("unmatched").alias("method"))
    return exact.unionByName(near).unionByName(none)


def grouped_forms(matches: DataFrame) -> DataFrame:
    """(canonical, confidence, forms): raw forms of each canonical name, sorted, and the best confidence."""
    return matches.groupBy("canonical").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("forms"))


# Names of the features of the older generation in the order of its schema.
FEATURES = [
    "total_experience_months", "num_positions", "avg_tenure_months", "is_currently_employed", "max_seniority_score", "has_experience",
    "num_degrees", "highest_degree_level", "gpa_normalized", "has_gpa", "is_currently_studying", "num_institutions",
    "total_canonical_skills", "high_confidence_skill_ratio", "unmatched_skill_ratio", "category_diversity", "primary_domain_confidence", "avg_skill_confidence",
    "num_projects", "avg_technologies_per_project", "project_link_ratio", "has_projects", "num_certifications", "num_unique_issuers", "has_certifications",
    "summary_embedding_norm", "skills_text_embedding_norm", "summary_skills_semantic_consistency",
]


def gpa_ratio(c: Column) -> Column:
    """A mark as a share of its scale to 4 decimals: a/b, else of 4 up to 4, else of 100; null for none and for a scale of 0."""
    pair = r"([0-9]*\.?[0-9]+)[ \t\n\r]*/[ \t\n\r]*([0-9]*\.?[0-9]+)"
    number = lambda rx, k: F.nullif(F.regexp_extract(c, rx, k), F.lit("")).cast("double")
    a, b, one = number(pair, 1), number(pair, 2), number(r"([0-9]*\.?[0-9]+)", 1)
    return half_up(F.when(a.isNotNull(), F.when(b > 0, a / b)).otherwise(F.when(one <= 4, one / 4).otherwise(one / 100)), 4)


def raw_features(ids: DataFrame, jobs: DataFrame, schools: DataFrame, skills: DataFrame, projects: DataFrame, certificates: DataFrame, vectors: DataFrame) -> DataFrame:
    """The 28 unscaled features of the older generation of each id; 0 where a document has no entries (2.8.9).

    skills: (id, canonical, category, confidence, method); vectors: (id,
    summary, skills) as arrays. Each part is one aggregate per document.
    """
    low = ascii_lower(F.coalesce("job_title", F.lit("")))
    held = F.greatest(F.lit(0.0), *[F.when(low.contains(w), v).otherwise(0.0) for w, v in SENIORITY.items()])
    months = tenure_months(F.col("start_date"), F.col("end_date"))
    one, number = F.lit(1.0), F.count("*").cast("double")
    e = jobs.groupBy("id").agg(
        F.sum(months).cast("double").alias("total_experience_months"), number.alias("num_positions"), half_up(F.avg(months), 2).alias("avg_tenure_months"),
        F.max(F.coalesce("is_current", F.lit(False)).cast("double")).alias("is_currently_employed"), F.max(F.when(held == 0, SENIORITY_DEFAULT).otherwise(held)).alias("max_seniority_score"), one.alias("has_experience"),
    )
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    gpa = gpa_ratio(F.col("gpa"))
    d = schools.groupBy("id").agg(
        number.alias("num_degrees"), F.max(ladder(F.col("degree"), DEGREES, 0.0)).alias("highest_degree_level"), half_up(F.coalesce(F.avg(gpa), F.lit(0.0)), 4).alias("gpa_normalized"), F.max(gpa.isNotNull().cast("double")).alias("has_gpa"),
        F.max(F.lower(F.trim(F.coalesce("end_date", F.lit("")))).isin("present", "current", "now", "ongoing").cast("double")).alias("is_currently_studying"), F.count_distinct(blank("institution")).cast("double").alias("num_institutions"),
    )
    share = lambda c: half_up(F.avg(c.cast("double")), 4)
    s = skills.groupBy("id").agg(
        number.alias("total_canonical_skills"), share(F.col("confidence") >= 0.8).alias("high_confidence_skill_ratio"), share(F.col("method") == "unmatched").alias("unmatched_skill_ratio"),
        F.count_distinct("category").cast("double").alias("category_diversity"), half_up(half_up(F.avg("confidence"), 9), 4).alias("avg_skill_confidence"),
    )
    kinds = skills.groupBy("id", "category").agg(F.count("*").alias("n"))
    main = kinds.groupBy("id").agg(half_up(F.max("n") / F.sum("n"), 4).alias("primary_domain_confidence"))
    tech = F.size(F.coalesce("technologies", F.expr("cast(array() as array<string>)")))
    p = projects.groupBy("id").agg(number.alias("num_projects"), half_up(F.avg(tech), 2).alias("avg_technologies_per_project"), share(blank("url").isNotNull()).alias("project_link_ratio"), one.alias("has_projects"))
    c = certificates.groupBy("id").agg(number.alias("num_certifications"), F.count_distinct(blank("issuer")).cast("double").alias("num_unique_issuers"), one.alias("has_certifications"))
    norm = lambda v: half_up(F.sqrt(F.aggregate(F.coalesce(v, F.expr("cast(array() as array<float>)")), F.lit(0.0), lambda t, x: t + F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) ** 2)), 4)
    w = vectors.select("id", norm("summary").alias("summary_embedding_norm"), norm("skills").alias("skills_text_embedding_norm"), (half_up(signed_cosine(F.col("summary"), F.col("skills")) + 1, 4) - 1).alias("summary_skills_semantic_consistency"))
    out = ids.select("id").distinct()
    for part in (e, d, s, main, p, c, w):
        out = out.join(part, "id", "left")
    return out.fillna(0.0).select("id", *FEATURES)


def narrative(rows: DataFrame, contributions: list[str]) -> DataFrame:
    """(id, query_id, narrative) of a score, its contributions and matched, missing and partial lists.

    Names up to three contributions above 0, the largest first, ties to the
    earlier feature.
    """
    parts = F.array(*[F.struct((-F.col(n)).alias("w"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(contributions)])
    drivers = F.transform(F.slice(F.array_sort(F.filter(parts, lambda x: x["w"] < 0)), 1, 3), lambda x: x["name"])
    first = lambda c: F.array_join(F.slice(c, 1, 5), ", ")
    near = F.transform(F.slice("partial", 1, 3), lambda x: F.concat(x["jd_skill"], F.lit("~"), x["matched_as"]))
    texts = [
        F.format_string("ATS match score: %.2f (0-1 scale).", half_up(F.col("score"), 2)),
        F.when(F.size(drivers) > 0, F.format_string("Strongest signals: %s.", F.array_join(drivers, ", "))),
        F.when(F.size("matched") > 0, F.format_string("Matches %d required skill(s), including %s.", F.size("matched"), first("matched"))),
        F.when(F.size("missing") > 0, F.format_string("Missing from the resume: %s.", first("missing"))),
        F.when(F.size("partial") > 0, F.format_string("Related/partial matches: %s.", F.array_join(near, ", "))),
    ]
    return rows.select("id", "query_id", F.concat_ws(" ", *texts).alias("narrative"))


def insight_prompt(query_text: Column, resume_text: Column, matched: Column, missing: Column) -> Column:
    """Prompt of the optional text service: bounded texts and up to ten skills of each list (G1); null for a blank text."""
    ten = lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, 10), ", ")).otherwise("None")
    text = F.concat(
        F.lit("--- JOB DESCRIPTION ---\n"), F.substring(query_text, 1, 1500), F.lit("\n\n--- RESUME TEXT ---\n"), F.substring(resume_text, 1, 2500),
        F.lit("\n\n--- ATS ENGINE FINDINGS ---\nMatched Skills: "), ten(matched), F.lit("\nMissing Skills: "), ten(missing),
        F.lit(f"\n\n{CLOSING}"),
    )
    return F.when((F.trim(query_text) != "") & (F.trim(resume_text) != ""), text)


def model_answer(c: Column) -> tuple[Column, Column, Column]:
    """(summary, up to five suggestions, whether the answer must be asked for again) of a text service's answer.

    A fence around the JSON is taken off; an unreadable answer asks again and
    gives the fixed texts of a failure.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?", ""), r"```$", ""))
    v = F.from_json(bare, "match_summary string, suggestions array<string>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.coalesce(v["_bad"].isNotNull() | v.isNull() | (bare == ""), F.lit(True))
    summary = F.when(bad, "AI summary generation failed or API key was missing.").otherwise(F.coalesce(v["match_summary"], F.lit("Summary unavailable.")))
    return summary, F.when(bad, F.expr("cast(array() as array<string>)")).otherwise(F.slice(F.coalesce(v["suggestions"], F.expr("cast(array() as array<string>)")), 1, 5)), bad


def without_surface(c: Column) -> Column:
    """Text without an editor's surface and lines of figures only."""
    for w in SURFACE:
        c = F.regexp_replace(c, w, "")
    return F.regexp_replace(F.regexp_replace(c, r"(?md)^[ \t\n\r\f0-9]+$", ""), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def display_name(c: Column) -> Column:
    """Known names in their own case, others in title case."""
    known = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    words = F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.coalesce(F.try_element_at(known, F.lower(c)), F.array_join(words, " "))
