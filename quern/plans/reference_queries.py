"""Queries of the matching operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import lexicon as L
from quern import ml
from quern.functions import text as T
from quern.operators import features as FE
from quern.operators import retrieval as R
from quern.operators import scoring as S
from quern.operators import sections as X
from quern.operators import skills as K
from quern.operators import statistics as ST
from quern.session import durable
from quern.sources import records
from quern.sources.tables import table
from quern.streaming import arrivals

#: The query text of the feature queries that take one.
QUERY = "Senior payroll analyst for a data team: bachelor in finance or statistics, SQL and Python, experience with audits. Docker is welcome."
def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of decimals, so that results don't depend on the order of sums."""
    return df.select(*[T.half_up(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, pos, job_title, company, start_date, end_date, is_current, bullets): the row received last of each job."""
    e = table(spark, sf, "experience")
    kept = e.groupBy("doc_id", "pos").agg(
        F.max_by(F.struct("job_title", "company", "start_date", "end_date", "is_current", F.col("responsibilities").alias("bullets")), F.struct("received_at", "row_id")).alias("j")
    )
    return kept.select(F.col("doc_id").alias("id"), "pos", "j.*")


def schools(spark: SparkSession, sf: str) -> DataFrame:
    """(id, institution, degree, field_of_study, end_date, gpa): the row received last of each entry."""
    e = table(spark, sf, "education")
    kept = e.groupBy("doc_id", "pos").agg(F.max_by(F.struct("institution", "degree", "field_of_study", "end_date", "gpa"), F.struct("received_at", "edu_id")).alias("j"))
    return kept.select(F.col("doc_id").alias("id"), "pos", "j.*")


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "text_extraction").select(F.col("doc_id").alias("id"), F.col("full_text").alias("text"))


def corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) of the documents and of the query items."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf, "eval_items").select(F.col("item_id").alias("id"), "text")


def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "skill_taxonomy").select(F.col("entry_id").alias("ord"), F.col("canonical_name").alias("canonical"), "category", "aliases", "entry_kind")


def job_text(spark: SparkSession, sf: str) -> DataFrame:
    return jobs(spark, sf).select("id", F.array_join(FE._bullets("bullets"), " ").alias("text"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Longest matches of the taxonomy in the bullets of each job; id is the document, start counts words of the job."""
    first = K.first_writer(K.patterns(taxonomy(spark, sf)))
    text = jobs(spark, sf).select(F.concat_ws(":", "id", "pos").alias("job"), F.array_join(FE._bullets("bullets"), " ").alias("text"))
    return K.longest_matches(K.scan(text, "job", "text", first))


def _skills(spark: SparkSession, sf: str) -> DataFrame:
    p = K.patterns(taxonomy(spark, sf))
    hits = _hits(spark, sf).withColumn("id", F.split("id", ":")[0].cast("long"))
    raw = jobs(spark, sf).where(F.trim("job_title") != "").select("id", F.col("job_title").alias("skill"))
    return K.extract(hits, raw, K.first_writer(p), p)


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scored (id, query_id) pairs and the skills that each query asks for: every thirteenth of the taxonomy."""
    pairs = table(spark, sf, "cpp_score").select(F.col("doc_id").alias("id"), F.col("jd_id").alias("query_id")).distinct()
    t = taxonomy(spark, sf).where(F.col("entry_kind") == "skill")
    queries = pairs.select("query_id").distinct().withColumn("k", F.col("query_id") % 13)
    required = queries.join(t.select((F.col("ord") % 13).alias("k"), "canonical", "category"), "k").select("query_id", "canonical", "category")
    return pairs, required


def r1_token_counts(spark, sf):
    d = R.tokenised(corpus(spark, sf)[0], "id", "text")
    return d.select(F.col("id").alias("doc_id"), F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_unique"))


def r1_unique_terms(spark, sf):
    return R.index(R.tokenised(corpus(spark, sf)[0], "id", "text")).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


def r2_bm25_topk(spark, sf):
    return R.top_documents(*corpus(spark, sf), "bm25", 5)


def r3_bm25_norm(spark, sf):
    return R.top_documents(*corpus(spark, sf), "bm25", 5, name="bm25_score", normalised=True)


def r4_idf_lookup(spark, sf):
    terms = R.with_idf(R.index(R.tokenised(corpus(spark, sf)[1], "id", "text")).groupBy("term").agg(F.sum("tf").alias("tf")))
    return terms.select("term", "tf", "idf")


def r5_tfidf_cosine(spark, sf):
    return R.top_documents(*corpus(spark, sf), "tfidf", 5)


def r6_vector_cosine_topk(spark, sf):
    return R.vector_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding")


def r6_pair_cosine(spark, sf):
    c = table(spark, sf, "cpp_score")
    return c.select("score_id", T.half_up(R.cosine(F.col("resume_embedding"), F.col("jd_embedding")), 6).alias("cosine_similarity"))


def _top_pairs_features(spark, sf):
    d, q = corpus(spark, sf)
    return rounded(R.overlap_features(R.top_documents(d, q, "bm25", 5), d, q))


def r7_r15_overlap(spark, sf):
    return _top_pairs_features(spark, sf).drop("tf_weighted_keyword_score")


def r13_tf_weighted(spark, sf):
    return _top_pairs_features(spark, sf).select("query_id", "doc_id", F.col("tf_weighted_keyword_score").alias("tf_weighted"))


def k1_k2_k3_normalizers(spark, sf):
    e = table(spark, sf, "experience").select("job_title").where(F.col("job_title").isNotNull()).distinct()
    c = F.col("job_title")
    return e.select("job_title", T.taxonomy_key(c).alias("k1"), T.scan_key(c).alias("k2"), T.fuzzy_key(c).alias("k3"))


def k4_k5_alias_precedence(spark, sf):
    p = K.patterns(taxonomy(spark, sf))
    first, last = K.first_writer(p), K.last_writer(p).select("pattern", F.col("canonical").alias("last_canonical"))
    return first.join(last, "pattern").select("pattern", F.col("canonical").alias("first_canonical"), "last_canonical")


def k9_k10_similarity(spark, sf):
    t = taxonomy(spark, sf).select("ord", T.fuzzy_key(F.col("canonical")).alias("a"), F.explode("aliases").alias("b"))
    t = t.select("ord", "a", T.fuzzy_key(F.col("b")).alias("b"))
    return t.select("ord", "a", "b", F.levenshtein("a", "b").alias("distance"), T.half_up(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def k7_dictionary_scan(spark, sf):
    first = K.first_writer(K.patterns(taxonomy(spark, sf)))
    hits = K.scan(table(spark, sf, "text_extraction"), "doc_id", "full_text", first)
    return hits.groupBy("id", "canonical").agg(F.count("*").alias("n"), F.min("start").alias("first_word"))


def k8_longest_match(spark, sf):
    return _hits(spark, sf).groupBy("canonical", "len").agg(F.count("*").alias("n"), F.count_distinct("id").alias("jobs"))


def k11_fuzzy_best(spark, sf):
    return rounded(K.fuzzy_best(table(spark, sf, "experience"), "job_title", K.patterns(taxonomy(spark, sf))))


def k12_extract_skills(spark, sf):
    return rounded(_skills(spark, sf))


def k13_primary_domain(spark, sf):
    return rounded(K.primary_domain(_skills(spark, sf)))


def k14_gap(spark, sf):
    pairs, required = _pairs(spark, sf)
    g = K.gap_lists(K.gap(pairs, _skills(spark, sf), required, K.patterns(taxonomy(spark, sf))))
    return g.select("id", "query_id", F.array_join("matched", "|").alias("matched"), F.size("missing").alias("n_missing"), T.half_up(F.col("match_ratio"), 6).alias("match_ratio"))


def k15_partial(spark, sf):
    pairs, required = _pairs(spark, sf)
    near = K.gap(pairs, _skills(spark, sf), required, K.patterns(taxonomy(spark, sf)), partial=0.45).select("query_id", F.explode("status").alias("s"))
    return near.groupBy("query_id", F.col("s.status").alias("status")).agg(F.count("*").alias("n"), F.count("s.matched_as").alias("named"))


def k14_gap_tpch(spark, sf):
    """Part types that customers bought against those of each brand, as joins at scale."""
    bought = (
        table(spark, sf, "orders").select("o_orderkey", "o_custkey")
        .join(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select("o_custkey", "p_type").distinct()
    )
    need = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    size = need.groupBy("p_brand").agg(F.count("*").alias("required"))
    met = bought.join(need, "p_type").groupBy("o_custkey", "p_brand").agg(F.count("*").alias("matched"))
    return met.join(size, "p_brand").select("o_custkey", "p_brand", "matched", (F.col("required") - F.col("matched")).alias("missing"))


def f_skills_20(spark, sf):
    pairs, required = _pairs(spark, sf)
    return rounded(K.skill_features(pairs, durable(_skills(spark, sf)), required, K.patterns(taxonomy(spark, sf))))


def l6_corroboration(spark, sf):
    return rounded(K.corroborated(_skills(spark, sf), resumes(spark, sf), "id", "text"))


def l8_domain_distribution(spark, sf):
    return rounded(K.domain_distribution(_skills(spark, sf)), 4)


def sec_lines(spark, sf):
    rows = X.lines(table(spark, sf, "page_extraction").distinct(), "doc_id", "text")
    return rows.groupBy("id").agg(F.count("*").alias("lines"), F.count_if(F.col("line") == "").alias("blank"), F.max("line_no").alias("last_line"))


def sec_headings(spark, sf):
    return X.headings(X.lines(table(spark, sf, "text_extraction"), "doc_id", "full_text"))


def sec_sections(spark, sf):
    s = X.sections(X.lines(table(spark, sf, "text_extraction"), "doc_id", "full_text"))
    return s.select("id", "section", "start_line", "n_lines", F.md5("text").alias("text_md5"))


def sec_preamble(spark, sf):
    return X.preamble(X.lines(table(spark, sf, "text_extraction"), "doc_id", "full_text")).select("id", F.length("text").alias("n_chars"))


def f_experience_15(spark, sf):
    return rounded(FE.experience_features(jobs(spark, sf), QUERY))


def f_education_10(spark, sf):
    return rounded(FE.education_features(schools(spark, sf), QUERY))


def f_quality(spark, sf):
    return rounded(FE.quality_features(resumes(spark, sf), jobs(spark, sf)))


def c8_rank(spark, sf):
    s = table(spark, sf, "cpp_score").where(F.col("overall_score").isNotNull()).groupBy("jd_id", "doc_id").agg(F.max("overall_score").alias("overall_score"))
    return S.ranked(s, "jd_id", "doc_id").where(F.col("rank") <= 10)


def s1_json_decode(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("total_k"))


def s1_requests(spark, sf):
    """Requests written as JSON for every score row, a broken one for every seventh, and decoded."""
    c = table(spark, sf, "cpp_score").join(resumes(spark, sf), F.col("doc_id") == F.col("id"), "left")
    made = F.to_json(F.struct(F.col("text").alias("resume_text"), F.lit(QUERY).alias("jd_text"), "resume_embedding"))
    raw = c.select(F.when(F.col("score_id") % 7 == 0, F.substring(made, 1, 9)).otherwise(made).alias("json"))
    r = records.requests(raw, "json")
    return r.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.sum(F.length("resume_text")).alias("chars"), F.sum(F.size("jd_embedding")).alias("n_jd"))


def s5_taxonomy(spark, sf):
    """A taxonomy file that isn't there, so that the table stands in."""
    t = records.taxonomy(spark, f"{sf}/no_such_taxonomy.json", taxonomy(spark, sf))
    return t.select("ord", "canonical", "category", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("n_aliases"))


def st_percentiles(spark, sf):
    """Median, 95th and 99th percentile of event values by type, by place in order."""
    e = table(spark, sf, "events")
    return rounded(ST.percentiles(e, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"]))


def st_arrivals(spark, sf):
    """Deliveries of each contact by day, as the stream of arrivals counts them."""
    found = arrivals.latest_per_window(table(spark, sf, "contact").where(F.col("received_at").isNotNull()), "doc_id")
    return found.select("doc_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", F.unix_timestamp("last_at").alias("last_second"))


def s4_reject_empty(spark, sf):
    d = table(spark, sf, "documents")
    bad = F.when(F.col("text").isNull(), "missing").when(F.trim("text") == "", "empty").otherwise("ok")
    return d.groupBy(bad.alias("status")).agg(F.count("*").alias("n"))


def s11_limits(spark, sf):
    d = table(spark, sf, "documents")
    over = F.when(F.octet_length(F.encode("text", "utf-8")) > 2 * 1024 * 1024, "file").when(F.length("text") > 15000, "text").otherwise("fits")
    return d.where(F.col("text").isNotNull()).groupBy(over.alias("over")).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


def s8_ocr_routing(spark, sf):
    p = table(spark, sf, "page_extraction").distinct()
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) < 30).alias("needs_ocr"))


def s9_ocr_confidence(spark, sf):
    p = table(spark, sf, "page_extraction").distinct()
    whole = F.floor(F.col("ocr_confidence") * 10_000 + 0.5)  # four decimals as whole numbers, whose mean is exact in any order
    total, n = F.sum(whole), F.count("ocr_confidence")
    return p.groupBy("doc_id").agg(F.coalesce(F.floor((2 * total + n) / F.nullif(2 * n, F.lit(0))) / 10_000, F.lit(1.0)).alias("confidence"))


def s10_clean_text(spark, sf):
    return table(spark, sf, "text_extraction").select("doc_id", F.md5(T.clean_text(F.col("full_text"))).alias("clean_md5"))


def s10_clean_text_nfkc(spark, sf):
    """Cleaning with the compatibility form first, which SQL lacks."""
    return table(spark, sf, "text_extraction").select("doc_id", F.md5(T.clean_text(T.nfkc(F.col("full_text")))).alias("clean_md5"))


def s12_page_text(spark, sf):
    """Texts written out as pages, the text in a container of a known name on two of three, and read back."""
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    held = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<div id='job-details'>"), safe, F.lit("</div>"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('<section class="wide job-description">'), safe, F.lit("</section>"))).otherwise(safe)
    html = F.concat(F.lit("<html><head><style>p{}</style><script>var a='<b>';</script></head><body><!-- x --><p>Menu&nbsp;bar</p>"), held, F.lit("<p>Foot</p></body></html>"))
    return d.select("doc_id", F.md5(T.page_text(html)).alias("text_md5"))


def s14_query_window(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.length(T.query_window(F.col("text"), 1000)).alias("n_chars"), F.md5(T.query_window(F.col("text"), 1000)).alias("text_md5"))


def l9_vocabulary(spark, sf):
    """Taxonomy names that a résumé's bullets hold as substrings, by document."""
    t = taxonomy(spark, sf).where(F.col("entry_kind") == "skill").select(F.lower("canonical").alias("name")).distinct()
    text = jobs(spark, sf).groupBy("id").agg(F.lower(F.array_join(F.array_sort(F.collect_list(F.array_join(FE._bullets("bullets"), " "))), " ")).alias("text"))
    return K.names_within(text, t).groupBy("id").agg(F.count("*").alias("n_skills"))


def l10_set_gap(spark, sf):
    pairs, required = _pairs(spark, sf)
    have = _skills(spark, sf).groupBy("id").agg(F.array_sort(F.collect_set("canonical")).alias("have"))
    need = required.groupBy("query_id").agg(F.array_sort(F.collect_set("canonical")).alias("need"))
    rows = pairs.join(need, "query_id").join(have, "id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    shared = F.array_sort(F.array_intersect("need", "have"))
    return rows.select("id", "query_id", F.array_join(shared, "|").alias("matched"), F.size(F.array_except("need", "have")).alias("n_missing"), T.half_up(F.size(shared) / F.size("need"), 4).alias("ratio"))


def m2_split(spark, sf):
    e = table(spark, sf, "embeddings")
    return ml.stratified_split(e.select("vec_id", "label"), "label", "vec_id").groupBy("label", "part").agg(F.count("*").alias("n"))


def _model(spark, trees=20, depth=5, rows=2000):
    parts = ml.stratified_split(durable(ml.synthetic_rows(spark, rows)), "label", "row")
    return ml.fit_trees(parts.where("part = 'train'"), "label", ml.SCHEMA, trees, depth), parts.where("part = 'test'")


def m1_synthetic(spark, sf):
    rows = ml.synthetic_rows(spark)
    return rows.groupBy("label").agg(F.count("*").alias("n"), *[T.half_up(F.avg(c), 2).alias(c) for c in ("skill_coverage_ratio", "cosine_similarity", "num_promotions")])


def m3_gbt(spark, sf):
    """Area under the curve on held-out rows and the most important features of the boosted trees, with fewer trees than the default."""
    model, test = _model(spark)
    scored = ml.learned_score(test, model)
    area = ml.auc(scored.withColumn("y", F.col("label")), "overall_score", "y").select(F.lit(0).alias("rank"), F.lit("auc").alias("feature"), F.col("auc").alias("importance"))
    return area.unionByName(ml.importances(spark, model, ml.SCHEMA))


def c9_learned(spark, sf):
    """Pairs scored by the boosted trees on their feature rows."""
    from quern.plans import pair_queries as PQ

    model, _ = _model(spark)
    rows = ml.learned_score(PQ.features(spark, sf).where(S.unusable() == ""), model)
    return rows.select("id", "query_id", "overall_score", "ranking_method")


def m4_auc(spark, sf):
    c = table(spark, sf, "cpp_score").where(F.col("overall_score").isNotNull()).select("overall_score", (F.col("jd_id") % 2).alias("label"))
    return rounded(ml.auc(c, "overall_score", "label"))


def tenure_orders(spark, sf):
    """Months between a customer's orders, as positions in time."""
    w = Window.partitionBy("o_custkey").orderBy("m", "o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("m"))
    gaps = o.withColumn("gap", F.col("m") - F.lag("m").over(w))
    return gaps.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.coalesce("gap", F.lit(0))).alias("max_gap"), (F.max("m") - F.min("m")).alias("span"))


_ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    r1_token_counts, r1_unique_terms, r2_bm25_topk, r3_bm25_norm, r4_idf_lookup, r5_tfidf_cosine, r6_vector_cosine_topk, r6_pair_cosine, r7_r15_overlap, r13_tf_weighted,
    k1_k2_k3_normalizers, k4_k5_alias_precedence, k9_k10_similarity, k7_dictionary_scan, k8_longest_match, k11_fuzzy_best, k12_extract_skills, k13_primary_domain, k14_gap, k15_partial,
    k14_gap_tpch, f_skills_20, l6_corroboration, l8_domain_distribution, sec_lines, sec_headings, sec_sections, sec_preamble,
    f_experience_15, f_education_10, f_quality, c8_rank,
    s1_json_decode, s4_reject_empty, s11_limits, s8_ocr_routing, s9_ocr_confidence, s10_clean_text, s10_clean_text_nfkc, s12_page_text, s14_query_window, l9_vocabulary, l10_set_gap, s1_requests, s5_taxonomy, st_percentiles, st_arrivals,
    m1_synthetic, m2_split, m3_gbt, c9_learned, m4_auc, tenure_orders,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
