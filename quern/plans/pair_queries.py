"""Queries of the résumé parser and of the score composed from all feature groups, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import pairs as P
from quern.operators import scoring as S
from quern.operators import sections as X
from quern.plans import reference_queries as Q
from quern.session import durable
from quern.sources.tables import balanced, table

#: Ranks and further demands of query texts, by the remainder of the query's id.
RANKS = ["Senior ", "Lead ", "Junior ", ""]
DEMANDS = [
    "A bachelor degree in computer science or finance is asked for.", "Training in nursing or law is welcome.",
    "Python, SQL and Docker are used daily; a certificate of a cloud or of security helps.",
]
SHARES = 13


def contacts_latest(spark: SparkSession, sf: str) -> DataFrame:
    """(id, full_name, email, phone, linkedin, github): of each document the contact received last."""
    c = table(spark, sf, "contact")
    fields = ["full_name", "email", "phone", "linkedin_url", "github_url"]
    kept = c.groupBy("doc_id").agg(F.max_by(F.struct(*fields), F.struct("received_at", *fields)).alias("c"))
    return kept.select(F.col("doc_id").alias("id"), "c.full_name", "c.email", "c.phone", F.col("c.linkedin_url").alias("linkedin"), F.col("c.github_url").alias("github"))


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): the extracted text of every document, else its records written out as a résumé; null where there is neither."""
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "\n\n" if c == "block" else ", " if c == "item" else "\n")
    bullets = F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), b)), "\n")
    jobs = Q.jobs(spark, sf).withColumn("bullets", F.filter(F.coalesce("bullets", F.expr(X.EMPTY)), lambda b: b.isNotNull()))
    block = F.concat_ws("\n", F.concat_ws(" at ", "job_title", "company"), F.concat_ws(" - ", "start_date", "end_date"), bullets)
    work = jobs.select("id", "pos", block.alias("block")).groupBy("id").agg(in_order("block").alias("work"))
    schools = Q.schools(spark, sf).select(
        "id", "pos", F.concat_ws("\n", F.concat_ws(", ", F.concat_ws(" in ", "degree", "field_of_study"), "institution", "end_date"), F.concat(F.lit("GPA: "), F.col("gpa"))).alias("block"),
        F.coalesce("field_of_study", F.lit("")).alias("item"), F.concat_ws(" - ", "degree", F.concat_ws(", ", "institution", "end_date")).alias("line"),
    )
    study = schools.groupBy("id").agg(in_order("block").alias("study"), in_order("item").alias("fields"), in_order("line").alias("lines"))
    c = contacts_latest(spark, sf)
    head = F.concat_ws("\n", "full_name", F.concat_ws(" | ", "email", "phone", "linkedin", "github"))
    written = F.concat_ws(
        "\n\n", head, F.concat(F.lit("EXPERIENCE\n"), F.col("work")), F.concat(F.lit("EDUCATION\n"), F.col("study")), F.concat(F.lit("SKILLS\n"), F.col("fields")), F.concat(F.lit("CERTIFICATIONS\n"), F.col("lines"))
    )
    rows = c.join(work, "id", "full").join(study, "id", "full").select("id", written.alias("written"))
    full = table(spark, sf, "text_extraction").select(F.col("doc_id").alias("id"), "full_text")
    return rows.join(full, "id", "full").select("id", F.coalesce("full_text", F.nullif("written", F.lit(""))).alias("text"))


def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, text): a text for every query that the score table names, from the titles and skills of the taxonomy."""
    t = Q.taxonomy(spark, sf).withColumn("k", F.col("ord") % SHARES)
    asked = t.groupBy("k").agg(
        F.min_by("canonical", F.when(F.col("entry_kind") == "title", F.col("ord"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("entry_kind") == "skill", F.struct("ord", "canonical")))), lambda x: x["canonical"]), ", ").alias("skills"),
    )
    one = lambda texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("query_id") % len(texts) + 1).cast("int"))
    ids = table(spark, sf, "cpp_score").select(F.col("jd_id").alias("query_id")).distinct().withColumn("k", F.col("query_id") % SHARES)
    return ids.join(asked, "k").select("query_id", F.concat(one(RANKS), F.col("title"), F.lit("\nRequirements: "), F.col("skills"), F.lit(" preferred\n"), one(DEMANDS)).alias("text"))


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, query_id, resume_embedding, jd_embedding): of each pair the row scored last."""
    c = table(spark, sf, "cpp_score")
    kept = c.groupBy("doc_id", "jd_id").agg(F.max_by(F.struct("resume_embedding", "jd_embedding"), F.struct("scored_at", "score_id")).alias("v"))
    return kept.select(F.col("doc_id").alias("id"), F.col("jd_id").alias("query_id"), "v.*")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature row of every pair; texts and rows are written once for several readers."""
    asked = table(spark, sf, "cpp_score").select(F.col("doc_id").alias("id")).distinct()
    of = lambda df: df.join(asked, "id", "left_semi")  # noqa: E731 - documents without a pair aren't read further
    docs = durable(balanced(of(document_texts(spark, sf)), "id"))
    parts = X.parsed(docs, "id", "text") | {"experience": of(Q.jobs(spark, sf)), "education": of(Q.schools(spark, sf)), "contact": of(contacts_latest(spark, sf))}
    return P.scored_pairs(scored_pairs(spark, sf), docs, query_texts(spark, sf), parts, Q.taxonomy(spark, sf))


KEYS = ["id", "query_id"]


def x1_x3_contacts(spark, sf):
    docs = document_texts(spark, sf)
    return X.contacts(docs, X.preamble(X.lines(docs, "id", "text")), "id", "text")


def x4_full_name(spark, sf):
    return X.full_name(X.preamble(X.lines(document_texts(spark, sf), "id", "text")))


def x5_summary(spark, sf):
    return X.parsed(document_texts(spark, sf), "id", "text")["summary"].select("id", F.length("summary").alias("n_chars"), F.md5("summary").alias("summary_md5"))


def x6_experience(spark, sf):
    e = X.parsed(document_texts(spark, sf), "id", "text")["experience"]
    return e.select("id", "pos", "job_title", "company", "start_date", "end_date", "is_current", F.size("bullets").alias("n_bullets"), F.md5(F.array_join("bullets", "|")).alias("bullets_md5"))


def x8_education(spark, sf):
    return X.parsed(document_texts(spark, sf), "id", "text")["education"]


def x10_skills(spark, sf):
    return X.parsed(document_texts(spark, sf), "id", "text")["skills"]


def x11_projects(spark, sf):
    p = X.parsed(document_texts(spark, sf), "id", "text")["projects"]
    return p.select("id", "pos", "name", F.md5("description").alias("description_md5"), F.array_join("technologies", "|").alias("technologies"), "url")


def x12_certs(spark, sf):
    return X.parsed(document_texts(spark, sf), "id", "text")["certificates"]


def x13_lists(spark, sf):
    return X.parsed(document_texts(spark, sf), "id", "text")["lists"]


def x15_parse(spark, sf):
    """Number of entries of each kind of every document with a text."""
    docs = document_texts(spark, sf).where(F.col("text") != "")
    parts = X.parsed(docs, "id", "text")
    out = docs.select("id")
    for name in ("experience", "education", "skills", "projects", "certificates", "lists"):
        out = out.join(parts[name].groupBy("id").agg(F.count("*").alias(f"n_{name}")), "id", "left")
    return out.fillna(0)


def c_pair_features(spark, sf):
    """All 85 features and 4 flags of every pair (2.8.1-2.8.8)."""
    return Q.rounded(features(spark, sf).where(S.unusable() == "").select(*KEYS, *P.FEATURES), 4)


def _scores(spark, sf):
    return S.overall_score(S.category_scores(features(spark, sf)))


def c1_c8_scores(spark, sf):
    s = _scores(spark, sf).where(S.unusable() == "")
    return s.select(*KEYS, *[S.one_decimal(F.col(f"{k}_score")).alias(f"{k}_score") for k in S.CATEGORIES], "overall_score", S.score_band(F.col("overall_score")).alias("band"), "ranking_method")


def e1_rules(spark, sf):
    f = S.factors(features(spark, sf).where(S.unusable() == ""), KEYS)
    return f.groupBy("feature", "side").agg(F.count("*").alias("n"))


def e3_skill_factors(spark, sf):
    return S.skill_factors(features(spark, sf).where(S.unusable() == ""), KEYS).select(*KEYS, "side", "text")


def e4_top_factors(spark, sf):
    return S.explained(features(spark, sf).where(S.unusable() == ""), KEYS).select(*KEYS, "side", "rank", "text")


def e5_fallbacks(spark, sf):
    s = _scores(spark, sf).where(S.unusable() == "")
    rows = S.with_fallbacks(S.explained(s, KEYS), s, KEYS)
    return rows.groupBy("side", "rank").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


def u1_red_flags(spark, sf):
    f = S.red_flags(features(spark, sf).where(S.unusable() == ""), KEYS)
    return f.select(*KEYS, F.array_join("flags", "; ").alias("flags"))


def s2_report_json(spark, sf):
    """The response record of every pair as JSON; its members are read back for comparison."""
    r = S.reports(_scores(spark, sf), KEYS)
    get = lambda p: F.get_json_object("report", p)
    return r.select(
        *KEYS, get("$.overall_score").cast("double").alias("overall_score"), get("$.scores.semantic").cast("double").alias("semantic"), F.size(F.from_json(get("$.matched_skills"), "array<string>")).alias("n_matched"),
        F.size(F.from_json(get("$.missing_skills"), "array<string>")).alias("n_missing"), get("$.ranking_method").alias("ranking_method"), get("$.error").alias("error"),
        get("$.feature_vector.bm25_score").cast("double").alias("bm25_score"),
    )


_ALL = [
    x1_x3_contacts, x4_full_name, x5_summary, x6_experience, x8_education, x10_skills, x11_projects, x12_certs, x13_lists, x15_parse,
    c_pair_features, c1_c8_scores, e1_rules, e3_skill_factors, e4_top_factors, e5_fallbacks, u1_red_flags, s2_report_json,
]


def queries():
    return {f.__name__: f for f in _ALL}
