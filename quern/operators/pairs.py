"""Scoring of (document, query) pairs: one wide row of features per pair.

Documents and queries are each brought to one row first, so that a pair is two
equi-joins and column expressions: no table of (pair, term) or (pair, skill)
rows is built. The arrays of a row are bounded by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import lexicon as L
from quern.functions.text import ascii_lower, bigrams, cap, tokens, unit
from quern.operators import features as FE
from quern.operators import retrieval as R
from quern.operators import skills as K
from quern.session import durable


def text_rows(texts: DataFrame) -> DataFrame:
    """(id, n, terms, bi, norm, tech) of (id, text): terms with counts and weights, pairs of tokens, tf-idf norm, technology terms."""
    tokened = texts.select("id", tokens(F.col("text")).alias("t"))
    weight = F.col("tf") / F.col("total") * F.col("idf")
    terms = R.with_idf(R.index(tokened)).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("term", "tf", "idf"))).alias("terms"), F.sqrt(F.sum(weight * weight)).alias("norm"), F.count_if(F.col("term").isin(*L.TECH_TERMS)).alias("tech")
    )
    none = F.expr("cast(array() as array<struct<term:string,tf:bigint,idf:double>>)")
    return tokened.select("id", F.size("t").alias("n"), bigrams(F.col("t")).alias("bi")).join(terms, "id", "left").withColumn("terms", F.coalesce("terms", none)).fillna(0, ["norm", "tech"])


def _sum(rows: str, f) -> Column:
    return F.aggregate(F.col(rows), F.lit(0.0), lambda s, x: s + f(x))


def _retrieval(df: DataFrame) -> DataFrame:
    """Adds the fifteen retrieval features (R2-R15) to pairs with the text rows of both sides and both vectors."""
    counts = F.map_from_entries(F.transform("d_terms", lambda x: F.struct(x["term"], x["tf"])))
    met = F.transform("q_terms", lambda x: F.struct(x["tf"].alias("q"), x["idf"].alias("idf"), F.coalesce(F.try_element_at(F.col("_counts"), x["term"]), F.lit(0)).alias("d")))
    df = df.withColumn("_counts", counts).withColumn("_met", met).drop("_counts")
    dn, qn, nq = F.col("d_n"), F.col("q_n"), F.size("q_terms")
    bm25 = _sum("_met", lambda x: F.when(x["d"] > 0, F.log(1 + dn / (x["d"] + 1)) * x["d"] * (R.K1 + 1) / (x["d"] + R.K1)).otherwise(0.0))
    dot = _sum("_met", lambda x: F.when(x["d"] > 0, (x["d"] / dn * x["idf"]) * (x["q"] / qn * x["idf"])).otherwise(0.0))
    norms = F.col("d_norm") * F.col("q_norm")
    reached = _sum("_met", lambda x: (x["q"] / qn) * F.least(F.lit(1.0), F.when(dn > 0, x["d"] / dn).otherwise(0.0) / (x["q"] / qn + 0.001)))
    shared = F.size(F.filter("_met", lambda x: x["d"] > 0))
    nb = F.size("q_bi")
    return df.withColumns(
        {
            "bm25_score": bm25 / (bm25 + 10), "tfidf_cosine_similarity": F.when(norms > 0, F.least(F.lit(1.0), dot / norms)).otherwise(0.0),
            "keyword_overlap_count": cap(shared, 30), "keyword_overlap_ratio": F.when(nq > 0, shared / nq).otherwise(0.0),
            "cosine_similarity": R.cosine(F.col("resume_embedding"), F.col("jd_embedding")), "jd_term_coverage": F.when(nq > 0, shared / nq).otherwise(1.0),
            "resume_jd_length_ratio": F.when(qn > 0, F.least(F.lit(1.0), dn / qn / 3)).otherwise(0.5),
            "bigram_overlap_ratio": F.when((nb > 0) & (F.size("d_bi") > 0), F.size(F.array_intersect("d_bi", "q_bi")) / nb).otherwise(0.0),
            "title_match_score": F.lit(0.5), "summary_jd_similarity": F.lit(0.5), "jd_unique_term_count": cap(nq, 200), "resume_unique_term_count": cap(F.size("d_terms"), 400),
            "jd_tech_term_count": cap(F.col("q_tech"), 20), "resume_tech_term_count": cap(F.col("d_tech"), 30),
            "tf_weighted_keyword_score": F.when((qn > 0) & (dn > 0), unit(reached / _sum("_met", lambda x: x["q"] / qn))).otherwise(0.0),
        }
    ).drop("_met")


def document_rows(docs: DataFrame, parts: dict[str, DataFrame], taxonomy: DataFrame) -> DataFrame:
    """One row per document (id, text) with all that its features need of it.

    parts: experience, education, projects, certificates, skills, summary,
    contact as of `sections.parsed`. taxonomy as of `skills.patterns`.
    """
    p = K.patterns(taxonomy)
    first = K.first_writer(p)
    hits = K.longest_matches(K.scan(docs, "id", "text", first))
    have = durable(K.extract(hits, parts["skills"].select("id", "skill"), first, p))
    held = have.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "canonical", "category", "confidence", "method"))).alias("have"))
    domain = K.primary_domain(have).select("id", F.col("share").alias("domain_share"))
    listed = parts["skills"].groupBy("id").agg(F.count("*").alias("listed"))
    contact = parts["contact"].select("id", *[(F.coalesce(c, F.lit("")) != "").alias(f"has_{c}") for c in ("full_name", "email", "phone", "linkedin", "github")])
    summary = parts["summary"].groupBy("id").agg(F.bool_or(F.col("summary") != "").alias("summarised"))
    rows = docs.join(text_rows(docs).select("id", *[F.col(c).alias(f"d_{c}") for c in ("n", "terms", "bi", "norm", "tech")]), "id", "left")
    for part in (
        held, domain, listed, contact, summary, FE.experience_rows(parts["experience"]), FE.education_rows(parts["education"]), FE.project_rows(parts["projects"]),
        FE.certificate_rows(parts["certificates"]), FE.bullet_rows(parts["experience"]),
    ):
        rows = rows.join(part, "id", "left")
    return rows


def query_rows(queries: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row per query (query_id, text) with its lower-case text, tokens and the skills that it asks for, sorted by name."""
    p = K.patterns(taxonomy)
    texts = queries.select(F.col("query_id").alias("id"), "text")
    asked = K.longest_matches(K.scan(texts, "id", "text", K.first_writer(p))).select("id", "canonical", "category").distinct()
    need = asked.join(K.self_matches(p), "canonical", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("canonical", "category", "alike", "alikeness"))).alias("need"))
    rows = texts.join(text_rows(texts).select("id", *[F.col(c).alias(f"q_{c}") for c in ("n", "terms", "bi", "norm", "tech")]), "id", "left").join(need, "id", "left")
    none = F.expr("cast(array() as array<struct<canonical:string,category:string,alike:string,alikeness:double>>)")
    return rows.withColumn("need", F.coalesce("need", none)).withColumn("low", ascii_lower(F.coalesce("text", F.lit("")))).withColumnRenamed("id", "query_id").withColumnRenamed("text", "query_text")


# Names of all features in the order of the model's schema, and the flags beside them.
GROUPS = {
    "skills": ["skill_coverage_ratio", "critical_skill_coverage", "optional_skill_coverage", "num_matched_skills", "num_missing_skills", "num_partial_skills", "rare_skill_bonus", "skill_category_diversity", "avg_skill_confidence", "high_confidence_skill_ratio", "total_canonical_skills", "skills_text_length", "unmatched_skill_ratio", "primary_domain_confidence", "jd_skill_count", "jd_critical_skill_count", "skill_exact_match_count", "skill_fuzzy_match_count", "skill_missing_critical_count", "skill_has_all_required"],
    "experience": ["total_experience_months", "relevant_experience_months", "num_positions", "avg_tenure_months", "max_tenure_months", "employment_gap_months", "num_gaps", "is_currently_employed", "max_seniority_score", "avg_seniority_score", "has_leadership_keywords", "num_promotions", "quantified_achievement_count", "action_verb_density", "career_progression_score"],
    "education": ["num_degrees", "highest_degree_level", "degree_field_match", "gpa_normalized", "has_gpa", "is_currently_studying", "education_recency_score", "prestigious_institution_flag", "num_institutions", "degree_requirement_met"],
    "projects": ["num_projects", "avg_technologies_per_project", "project_link_ratio", "project_tech_overlap", "project_domain_relevance", "has_open_source", "avg_project_desc_length", "project_quantification_score"],
    "certificates": ["num_certifications", "num_unique_issuers", "has_certifications", "jd_cert_match", "cert_recency_score", "has_cloud_cert", "has_security_cert"],
    "quality": ["section_completeness_score", "action_verb_density_global", "quantified_achievements_total", "avg_bullet_length", "total_word_count", "resume_length_score", "formatting_consistency", "has_summary", "has_links", "has_contact_info"],
    "retrieval": ["bm25_score", "tfidf_cosine_similarity", "keyword_overlap_count", "keyword_overlap_ratio", "cosine_similarity", "jd_term_coverage", "resume_jd_length_ratio", "bigram_overlap_ratio", "title_match_score", "summary_jd_similarity", "jd_unique_term_count", "resume_unique_term_count", "jd_tech_term_count", "resume_tech_term_count", "tf_weighted_keyword_score"],
    "flags": ["job_hopper_flag", "overqualified_flag", "readability_score", "keyword_stuffing_penalty"],
}
FEATURES = [f for g in GROUPS.values() for f in g]


def pair_features(pairs: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, query_id, text, query_text, 89 features, matched, partial, missing) of (id, query_id, resume_embedding, jd_embedding).

    documents and queries are the rows of `document_rows` and `query_rows`.
    A pair whose document or query has no row keeps a row with null texts; a
    group without children is 0; every feature lies in 0..1.
    """
    df = pairs.join(documents, "id", "left").join(queries, "query_id", "left")
    low = F.coalesce("low", F.lit(""))
    have = F.coalesce("have", F.expr("cast(array() as array<struct<rank:double,canonical:string,category:string,confidence:double,method:string>>)"))
    need = F.coalesce("need", F.expr("cast(array() as array<struct<canonical:string,category:string,alike:string,alikeness:double>>)"))
    for side in "dq":
        df = df.withColumn(f"{side}_terms", F.coalesce(f"{side}_terms", F.expr("cast(array() as array<struct<term:string,tf:bigint,idf:double>>)")))
        df = df.withColumn(f"{side}_bi", F.coalesce(f"{side}_bi", F.expr("cast(array() as array<string>)"))).fillna(0, [f"{side}_n", f"{side}_norm", f"{side}_tech"])
    df = _retrieval(df).withColumn("have", have).withColumn("need", need)
    df = df.withColumn("status", K.statuses(F.col("need"), F.col("have")))
    of = lambda s: F.filter("status", lambda x: x["status"] == s)
    df = df.withColumn("matched", of("matched")["skill"]).withColumn("missing", of("missing")["skill"]).withColumn("partial", F.transform(of("partial"), lambda x: F.struct(x["skill"].alias("jd_skill"), x["matched_as"], x["confidence"])))
    wanted = FE.query_seniority(low)
    needed = F.transform("need", lambda x: ascii_lower(x["canonical"]))
    named: dict[str, Column] = {}
    named |= K.skill_columns(F.col("have"), F.size("need"), F.size("matched"), F.size("partial"), F.size("missing"), F.col("domain_share"))
    some = lambda n, columns: {k: F.when(F.col(n) > 0, v) for k, v in columns.items()}
    named |= some("x_n", FE.experience_columns(wanted)) | some("e_n", FE.education_columns(low)) | some("p_n", FE.project_columns(needed)) | some("c_n", FE.certificate_columns(low)) | FE.quality_columns()
    out = df.withColumns({k: unit(F.coalesce(v, F.lit(0.0))) for k, v in named.items()})
    return out.select("id", "query_id", "text", "query_text", *FEATURES, "matched", "partial", "missing")


def scored_pairs(pairs: DataFrame, docs: DataFrame, queries: DataFrame, parts: dict[str, DataFrame], taxonomy: DataFrame) -> DataFrame:
    """`pair_features` of whole tables, written once into the shared folder for several readers."""
    documents = document_rows(docs.where(F.col("text") != ""), parts, taxonomy)
    return durable(pair_features(pairs, documents, query_rows(queries.where(F.col("text") != ""), taxonomy)))
