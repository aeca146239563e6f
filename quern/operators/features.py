"""Document features over child tables: experience, education, projects, certificates, quality, flags.

All functions aggregate per id; documents without children have no row, and
`complete` fills their features with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import lexicon as L
from quern.functions.text import ascii_lower, cap, contains_any, ladder, length_band, readability, unit, word_count
from quern.operators.sections import tenure_months


def _first_word(c: Column) -> Column:
    return ascii_lower(F.regexp_extract(c, r"^[ \t\n\r]*([^ \t\n\r]+)", 1))


def _bullets(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda b: b.isNotNull())


def query_seniority(text: Column) -> Column:
    return ladder(text, L.QUERY_SENIORITY, L.QUERY_DEFAULT)


def experience_rows(jobs: DataFrame, as_of: int = 2026 * 12 + 7) -> DataFrame:
    """(id, x_..): sums over the jobs (id, pos, job_title, company, start_date, end_date, is_current, bullets) of a document."""
    months = tenure_months(F.col("start_date"), F.col("end_date"), as_of)
    w = Window.partitionBy("id").orderBy("pos")
    low_company = F.lower(F.coalesce("company", F.lit("")))
    rows = jobs.withColumn("m", months).withColumn("sen", ladder(F.col("job_title"), L.TITLE_SENIORITY, L.TITLE_DEFAULT)).withColumn("b", _bullets("bullets"))
    rows = rows.withColumn("co", low_company)
    rows = rows.withColumn("up", ((F.lag("co").over(w) == F.col("co")) & (F.col("sen") - F.lag("sen").over(w) > 0.1)).cast("int"))
    led = contains_any(ascii_lower(F.concat_ws(" ", "job_title", "company", F.array_join("b", " "))), L.LEADERSHIP)
    start = F.greatest(F.lit(0), F.lit(as_of) - F.coalesce(tenure_index(F.col("start_date"), as_of), F.lit(as_of)))
    filled = F.filter("b", lambda x: x != "")
    agg = rows.groupBy("id").agg(
        F.sum("m").alias("total"), F.count("*").alias("n"), F.avg("m").alias("avg_m"), F.max("m").alias("max_m"), F.max_by(start, "pos").alias("since"),
        F.bool_or(F.coalesce("is_current", F.lit(False))).alias("cur"), F.max("sen").alias("max_sen"), F.avg("sen").alias("avg_sen"), F.bool_or(led).alias("led"),
        F.sum(F.coalesce("up", F.lit(0))).alias("ups"), F.sum(F.size(F.filter("b", lambda x: x.rlike(L.QUANTITY)))).alias("quant"),
        F.sum(F.size(filled)).alias("bul"), F.sum(F.size(F.filter(filled, lambda x: _first_word(x).isin(*L.ACTION_VERBS)))).alias("verb"),
        F.min_by("sen", "pos").alias("first_sen"), F.max_by("sen", "pos").alias("last_sen"),
        F.count_if((F.col("m") > 0) & (F.col("m") < 12)).alias("short"),
    )
    return agg.select("id", *[F.col(c).alias(f"x_{c}") for c in agg.columns if c != "id"])


def experience_columns(wanted: Column) -> dict[str, Column]:
    """The fifteen experience features and two flags from `experience_rows`; wanted: seniority that the query asks for."""
    c = lambda n: F.col(f"x_{n}")
    gap = F.greatest(F.lit(0), c("since") - c("total"))
    return {
        "total_experience_months": cap(c("total"), 240), "relevant_experience_months": unit(c("total") * (1 - F.abs(c("max_sen") - wanted)) / 240),
        "num_positions": cap(c("n"), 10), "avg_tenure_months": cap(c("avg_m"), 60), "max_tenure_months": cap(c("max_m"), 120),
        "employment_gap_months": 1 - cap(gap, 24), "num_gaps": 1 - cap(F.when(gap > 0, F.greatest(F.lit(1), F.floor(gap / 12))).otherwise(0), 5),
        "is_currently_employed": c("cur").cast("double"), "max_seniority_score": c("max_sen"), "avg_seniority_score": c("avg_sen"),
        "has_leadership_keywords": c("led").cast("double"), "num_promotions": cap(c("ups"), 3), "quantified_achievement_count": cap(c("quant"), 10),
        "action_verb_density": F.when(c("bul") > 0, c("verb") / c("bul")).otherwise(0.0),
        "career_progression_score": F.when(c("n") < 2, 0.5).otherwise(unit(0.5 + c("last_sen") - c("first_sen"))),
        "job_hopper_flag": (c("short") >= 3).cast("double"), "overqualified_flag": ((c("max_sen") > wanted + 0.3) & (c("total") > 120)).cast("double"),
    }


def experience_features(jobs: DataFrame, query_text: str = "", as_of: int = 2026 * 12 + 7) -> DataFrame:
    """The fifteen experience features and two flags of each document against one query text."""
    named = experience_columns(query_seniority(F.lit(query_text)))
    return experience_rows(jobs, as_of).select("id", *[v.alias(k) for k, v in named.items()])


def tenure_index(c: Column, as_of: int) -> Column:
    from quern.functions.text import year_month

    return year_month(c, as_of)


def gpa_share(c: Column) -> Column:
    """A mark as a share of its scale: a/b, else of 4 up to 4, else of 100; null for none and for a scale of 0."""
    nums = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1)), lambda x: x.cast("double"))
    val, given = F.try_element_at(nums, F.lit(1)), F.try_element_at(nums, F.lit(2))
    scale = F.coalesce(given, F.when(val <= 4, 4.0).otherwise(100.0))
    return F.when(val.isNotNull() & (scale != 0), F.least(F.lit(1.0), val / scale))


def education_rows(schools: DataFrame, year: int = 2026) -> DataFrame:
    """(id, e_..): sums over the schools (id, institution, degree, field_of_study, end_date, gpa) of a document."""
    fields = ascii_lower(F.coalesce("field_of_study", F.lit("")))
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("weight")) for k, v in L.FIELDS.items()])
    inst, end = ascii_lower(F.coalesce("institution", F.lit(""))), F.coalesce("end_date", F.lit(""))
    found = F.regexp_extract(end, r"(?:^|[^A-Za-z0-9_])((?:19|20)[0-9]{2})(?:$|[^A-Za-z0-9_])", 1)
    seen = F.coalesce(F.try_to_number(F.nullif(found, F.lit("")), F.lit("9999")).cast("int"), F.lit(2015))
    recent = F.when(F.lower(end).isin("", "present"), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), year - seen) / 20.0))
    rows = schools.withColumn("lvl", ladder(F.col("degree"), L.DEGREES, 0.0)).withColumn("fl", fields)
    agg = rows.groupBy("id").agg(
        F.count("*").alias("n"), F.max("lvl").alias("lvl"), F.max(gpa_share(F.col("gpa"))).alias("gpa"), F.max(recent).alias("rec"),
        F.bool_or(F.lower(end).isin("present", "current")).alias("cur"), F.bool_or(contains_any(inst, L.PRESTIGE)).alias("top"),
        F.count_distinct(F.when(inst != "", inst)).alias("insts"), F.array_distinct(F.flatten(F.collect_set(F.filter(known, lambda f: F.contains("fl", f["name"]))))).alias("fields"),
    )
    return agg.select("id", *[F.col(c).alias(f"e_{c}") for c in agg.columns if c != "id"])


def education_columns(query: Column) -> dict[str, Column]:
    """The ten education features from `education_rows`; query: the lower-case text of the query."""
    c = lambda n: F.col(f"e_{n}")
    match = F.aggregate(c("fields"), F.lit(0.0), lambda s, f: F.greatest(s, F.when(F.contains(query, f["name"]), f["weight"]).otherwise(f["weight"] * 0.5)))
    met = F.when(~contains_any(query, ["degree required", "bachelor", "b.s."]), 0.5).when(c("lvl") >= 0.6, 1.0).otherwise(0.0)
    return {
        "num_degrees": cap(c("n"), 3), "highest_degree_level": c("lvl"), "degree_field_match": match, "gpa_normalized": F.coalesce(c("gpa"), F.lit(0.0)),
        "has_gpa": c("gpa").isNotNull().cast("double"), "is_currently_studying": c("cur").cast("double"), "education_recency_score": c("rec"),
        "prestigious_institution_flag": c("top").cast("double"), "num_institutions": cap(c("insts"), 3), "degree_requirement_met": F.when(c("n") > 0, met),
    }


def education_features(schools: DataFrame, query_text: str = "", year: int = 2026) -> DataFrame:
    """The ten education features of each document against one query text."""
    named = education_columns(F.lit(query_text.lower()))
    return education_rows(schools, year).select("id", *[v.alias(k) for k, v in named.items()])


def project_rows(projects: DataFrame) -> DataFrame:
    """(id, p_..): sums over the projects (id, name, description, technologies, url) of a document."""
    tech = F.transform(F.coalesce("technologies", F.array().cast("array<string>")), ascii_lower)
    text = ascii_lower(F.concat_ws(" ", "description", "name"))
    link = F.coalesce(F.col("url"), F.lit(""))
    desc = F.nullif(F.coalesce(F.col("description"), F.lit("")), F.lit(""))
    counted = F.regexp_count(F.coalesce(F.col("description"), F.lit("")), F.lit(L.QUANTITY_GLOBAL))
    agg = projects.groupBy("id").agg(
        F.count("*").alias("n"), F.avg(F.size(tech)).alias("tech"), F.avg((link != "").cast("double")).alias("links"), F.sum(counted).alias("figures"),
        F.array_distinct(F.flatten(F.collect_list(tech))).alias("all"), F.collect_list(text).alias("texts"), F.bool_or(F.lower(link).contains("github")).alias("oss"),
        F.avg(F.octet_length(F.encode(desc, "utf-8"))).alias("len"), F.avg(F.coalesce(desc.rlike(L.QUANTITY), F.lit(False)).cast("double")).alias("quant"),
    )
    return agg.select("id", *[F.col(c).alias(f"p_{c}") for c in agg.columns if c != "id"])


def project_columns(need: Column) -> dict[str, Column]:
    """The eight project features from `project_rows`; need: the lower-case skills that the query asks for."""
    c = lambda n: F.col(f"p_{n}")
    named = F.aggregate(c("texts"), F.lit(0), lambda s, t: s + F.size(F.filter(need, lambda x: F.contains(t, x))))
    overlap = F.when(F.size(need) > 0, F.size(F.array_intersect(c("all"), need)) / F.size(need)).otherwise(0.5)
    return {
        "num_projects": cap(c("n"), 10), "avg_technologies_per_project": cap(c("tech"), 8), "project_link_ratio": c("links"), "project_tech_overlap": F.when(c("n") > 0, overlap),
        "project_domain_relevance": F.least(F.lit(1.0), named / F.greatest(F.lit(1), F.size(need))), "has_open_source": c("oss").cast("double"),
        "avg_project_desc_length": F.coalesce(cap(c("len"), 300), F.lit(0.0)), "project_quantification_score": c("quant"),
    }


def project_features(projects: DataFrame, required: list[str]) -> DataFrame:
    """The eight project features of each document; required: skills of one query."""
    need = F.array(*[F.lit(s.lower()) for s in required]).cast("array<string>")
    return project_rows(projects).select("id", *[v.alias(k) for k, v in project_columns(need).items()])


def certificate_rows(certs: DataFrame, year: int = 2026) -> DataFrame:
    """(id, c_..): sums over the certificates (id, name, issuer, issue_date) of a document."""
    name = ascii_lower(F.coalesce("name", F.lit("")))
    words = F.filter(F.split(name, "[ \t]+"), lambda w: F.octet_length(F.encode(w, "utf-8")) > 3)
    found = F.regexp_extract(F.coalesce("issue_date", F.lit("")), r"(20[0-9]{2})", 1)
    recent = F.when(found == "", 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), year - F.try_to_number(F.nullif(found, F.lit("")), F.lit("9999")).cast("int")) / 10.0))
    agg = certs.groupBy("id").agg(
        F.count("*").alias("n"), F.count_distinct(F.nullif(F.lower(F.col("issuer")), F.lit(""))).alias("iss"), F.array_distinct(F.flatten(F.collect_set(words))).alias("words"), F.max(recent).alias("rec"),
        F.bool_or(contains_any(name, ["aws", "azure", "gcp", "google cloud", "cloud"])).alias("cloud"), F.bool_or(contains_any(name, ["security", "cissp", "ceh", "oscp"])).alias("sec"),
    )
    return agg.select("id", *[F.col(c).alias(f"c_{c}") for c in agg.columns if c != "id"])


def certificate_columns(query: Column) -> dict[str, Column]:
    """The seven certificate features from `certificate_rows`; query: the lower-case text of the query."""
    c = lambda n: F.col(f"c_{n}")
    return {
        "num_certifications": cap(c("n"), 8), "num_unique_issuers": cap(c("iss"), 5), "has_certifications": F.when(c("n") > 0, 1.0),
        "jd_cert_match": F.exists(c("words"), lambda w: F.contains(query, w)).cast("double"), "cert_recency_score": c("rec"), "has_cloud_cert": c("cloud").cast("double"), "has_security_cert": c("sec").cast("double"),
    }


def certificate_features(certs: DataFrame, query_text: str = "", year: int = 2026) -> DataFrame:
    """The seven certificate features of each document against one query text."""
    return certificate_rows(certs, year).select("id", *[v.alias(k) for k, v in certificate_columns(F.lit(query_text.lower())).items()])


def bullet_rows(jobs: DataFrame) -> DataFrame:
    """(id, b_..): sums over the bullets of all jobs (id, bullets, start_date) of a document."""
    b = jobs.select("id", "start_date", _bullets("bullets").alias("b"))
    verbs = F.filter("b", lambda x: _first_word(x).isin(*L.ACTION_VERBS_GLOBAL))
    figures = F.aggregate("b", F.lit(0), lambda s, x: s + F.regexp_count(x, F.lit(L.QUANTITY_GLOBAL)))
    size = F.aggregate("b", F.lit(0), lambda s, x: s + F.octet_length(F.encode(x, "utf-8")))
    return b.groupBy("id").agg(
        F.count("*").alias("b_jobs"), F.sum(F.size("b")).alias("b_n"), F.sum(F.size(verbs)).alias("b_verbs"), F.sum(figures).alias("b_figures"), F.sum(size).alias("b_size"),
        F.avg((F.coalesce("start_date", F.lit("")) != "").cast("double")).alias("b_dated"),
    )


def _text_quality(more_figures: Column) -> dict[str, Column]:
    """Quality features of a text and the bullets of its jobs."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = F.coalesce("text", F.lit(""))
    words = word_count(text)
    share = lambda a: F.when(n("b_n") > 0, F.col(a) / F.col("b_n")).otherwise(0.0)
    return {
        "action_verb_density_global": share("b_verbs"), "quantified_achievements_total": cap(n("b_figures") + more_figures, 20), "avg_bullet_length": F.least(F.lit(1.0), share("b_size") / 150),
        "total_word_count": cap(words, 2000), "resume_length_score": length_band(words), "formatting_consistency": F.coalesce("b_dated", F.lit(0.5)), "readability_score": readability(text, n("b_jobs")),
    }


def quality_columns() -> dict[str, Column]:
    """The ten quality features and two flags of a document's row: text, contact, counts of its entries."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    parts = [yes("has_full_name"), yes("has_email"), yes("summarised"), some("x_n"), some("e_n"), some("listed"), some("p_n"), some("c_n")]
    words = word_count(F.coalesce("text", F.lit("")))
    filled = sum((x.cast("int") for x in parts), F.lit(0))
    return {
        "section_completeness_score": filled / 8.0, **_text_quality(F.coalesce("p_figures", F.lit(0))), "has_summary": yes("summarised").cast("double"),
        "has_links": (yes("has_linkedin") | yes("has_github")).cast("double"), "has_contact_info": (yes("has_email") | yes("has_phone")).cast("double"),
        "keyword_stuffing_penalty": (F.coalesce("listed", F.lit(0)) / F.greatest(F.lit(1), words) > 0.25).cast("double"),
    }


def quality_features(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Text and bullet quality of documents: (id, text) with all jobs of (id, bullets, start_date)."""
    rows = docs.select("id", "text").join(bullet_rows(jobs), "id", "left")
    return rows.select("id", *[v.alias(k) for k, v in _text_quality(F.lit(0)).items()])


def complete(ids: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row per id with the features of all parts, 0 where a part has none."""
    out = ids.select("id").distinct()
    for p in parts:
        out = out.join(p, "id", "left")
    return out.fillna(0.0)
