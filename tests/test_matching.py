import glob
import math
import os

import duckdb
import pytest

from quern import ml
from quern.functions import text as T
from quern.operators import features, legacy, retrieval, scoring, sections, skills, statistics
from quern.plans import pair_queries, pair_sql, reference_queries, reference_sql
from pyspark.sql import functions as F

QUERIES = reference_queries.queries() | pair_queries.queries()
SQL = reference_sql.oracle_sql() | pair_sql.oracle_sql()
NAMES = [
    "r1_token_counts", "r2_bm25_topk", "r5_tfidf_cosine", "r6_vector_cosine_topk", "r7_r15_overlap", "k1_k2_k3_normalizers", "k4_k5_alias_precedence", "k7_dictionary_scan", "k11_fuzzy_best", "k12_extract_skills",
    "sec_headings", "sec_sections", "x1_x3_contacts", "x6_experience", "x8_education", "x10_skills", "x11_projects", "x12_certs", "f_experience_15", "f_education_10", "f_quality", "e4_top_factors", "s12_page_text", "s14_query_window", "m4_auc",
]


def cells(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return v if isinstance(v, str) else str(v) if isinstance(v, bool) else f"{float(v):.6f}"

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    assert cells(QUERIES[name](spark, sf).toPandas()) == cells(con.execute(SQL[name]).df())


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first().x


def test_normalizers(spark):
    c = F.col("c")
    text = "Node.js (k8s) C++ / R&D"
    assert one(spark, T.taxonomy_key(c), c=text) == "node.js ks c++ rd"
    assert one(spark, T.scan_key(c), c=text) == "node.js k8s c++ r&d"
    assert one(spark, T.fuzzy_key(c), c=text) == "node js k8s c++ r d"
    assert one(spark, T.tokens(c), c="Hello, C++ and C# – Größe 3x a") == ["hello", "c++", "c#", "gr", "3x"]
    assert one(spark, T.tokens(c), c=None) == []
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="node js", b="node.js") == pytest.approx(1 - 1 / 7)


def test_length_bands_and_months(spark):
    rows = spark.createDataFrame([(n,) for n in (99, 100, 299, 300, 2000, 2001, 2501)], "n int")
    assert [r[0] for r in rows.select(T.length_band(F.col("n"))).collect()] == [0.2, 0.5, 0.5, 1.0, 1.0, 0.8, 0.6]
    m = spark.createDataFrame([(85 / 240,), (0.05,), (5 / 240,), (122 / 240,)], "v double").select(scoring.months_text(F.col("v"))).collect()
    assert [r[0] for r in m] == ["7 yr 1 mo", "1 yr", "5 months", "10 yr 2 mo"]


def test_bm25_and_cosine(spark):
    d = spark.createDataFrame([(1, "python python kafka"), (2, None), (3, ""), (4, "rust")], "id long, text string")
    q = spark.createDataFrame([(9, "python"), (8, "of the"), (7, None)], "id long, text string")
    best = retrieval.top_documents(d, q, "bm25", 2).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in best] == [(9, 1, 1)] and best[0].bm25 == pytest.approx(math.log(1 + 3 / 3) * 2 * 2.5 / (2 + 1.5), abs=1e-6)
    assert retrieval.top_documents(d.where("id = 0"), q, "bm25", 2).count() == 0 == retrieval.top_documents(d, q.where("id = 0"), "tfidf", 2).count()
    v = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([0.0], [0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in v.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [0.8, 0, 0, 0, 0]


@pytest.mark.parametrize("postings", [2_000_000, 4])
def test_top_documents_equal_brute_force(spark, monkeypatch, postings):
    import random

    from quern import lexicon as L

    monkeypatch.setattr(retrieval, "POSTINGS", postings)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng, words = random.Random(3), ["kafka", "python", "alpha", "beta", "gamma", "delta", "rust"]
    docs = {i: [rng.choice(words) for _ in range(rng.randrange(0, 12))] for i in range(40)} | {99: ["kafka", "rust"], 98: ["kafka", "rust"]}
    asks = {i: [rng.choice(words) for _ in range(rng.randrange(1, 5))] for i in range(6)}
    idf = dict(L.idf_terms())
    vec = lambda t: {x: t.count(x) / len(t) * idf.get(x, L.DEFAULT_IDF) for x in t}
    dot = lambda a, b: sum(v * b.get(x, 0) for x, v in a.items())
    bm25 = lambda d, q: sum(math.log(1 + len(d) / (d.count(x) + 1)) * d.count(x) * 2.5 / (d.count(x) + 1.5) for x in set(q) if x in d)
    tfidf = lambda d, q: dot(vec(d), vec(q)) / math.sqrt(dot(vec(d), vec(d)) * dot(vec(q), vec(q))) if d else 0
    frame = lambda x: spark.createDataFrame([(i, " ".join(t)) for i, t in x.items()], "id long, text string")
    for name, f in (("bm25", bm25), ("tfidf", tfidf)):
        want = {q: [i for s, i in sorted((-round(f(d, a), 6), i) for i, d in docs.items() if f(d, a) > 0)[:3]] for q, a in asks.items()}
        got = retrieval.top_documents(frame(docs), frame(asks), name, 3).orderBy("query_id", "rank").collect()
        assert {q: [r.doc_id for r in got if r.query_id == q] for q in asks} == want


def test_gpa(spark):
    rows = spark.createDataFrame([("3.8/4.0",), ("3.6",), ("85",), ("9/10",), ("n/a",), (None,), ("3/0",)], "g string")
    assert [r[0] and round(r[0], 4) for r in rows.select(features.gpa_share(F.col("g"))).collect()] == [0.95, 0.9, 0.85, 0.9, None, None, None]


def test_longest_match_wins(spark):
    tax = spark.createDataFrame([(1, "Data Structures and Algorithms", "CS", ["algorithms"]), (2, "C++", "PL", None), (3, "C", "PL", [])], "ord int, canonical string, category string, aliases array<string>")
    docs = spark.createDataFrame([(1, "we use data structures and algorithms, C++ and C"), (2, None), (3, "")], "id int, text string")
    hits = skills.longest_matches(skills.scan(docs, "id", "text", skills.first_writer(skills.patterns(tax))))
    assert sorted(r.canonical for r in hits.collect()) == ["C", "C++", "Data Structures and Algorithms"]


def test_headings(spark):
    rows = spark.createDataFrame([(1, 0, "EXPERIENCE:"), (1, 1, "Skills & Tools"), (1, 2, "Skillset"), (1, 3, "")], "id int, line_no int, line string")
    assert sorted((r.line_no, r.section) for r in sections.headings(rows).collect()) == [(0, "EXPERIENCE"), (1, "SKILLS")]


def test_auc_and_split(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert ml.auc(rows, "s", "y").first().auc == pytest.approx(0.75)
    assert ml.auc(rows.where("y = 0"), "s", "y").first().auc is None
    made = ml.stratified_split(ml.synthetic_rows(spark, 2000, block=300), "label", "row")
    n = {(r.label, r.part): r["count"] for r in made.groupBy("label", "part").count().collect()}
    assert all(0.75 < n[y, "train"] / (n[y, "train"] + n[y, "test"]) < 0.85 for y in (0, 1)) and 0.35 < (n[1, "train"] + n[1, "test"]) / 2000 < 0.45


def test_model(spark, tmp_path):
    rows = ml.synthetic_rows(spark, 600).cache()
    model = ml.fit_trees(rows, "label", ml.SCHEMA, trees=4, depth=3)
    scored = ml.learned_score(rows, model).select("overall_score", "label", "ranking_method")
    assert ml.auc(scored, "overall_score", "label").first().auc > 0.9 and scored.first().ranking_method == "xgboost"
    top = ml.importances(spark, model, ml.SCHEMA, 5).collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0].importance >= top[1].importance
    ml.save_model(model, ml.SCHEMA, str(tmp_path))
    again, names = ml.load_model(str(tmp_path))
    assert names == ml.SCHEMA and len(names) == 85
    assert ml.learned_score(rows, again).agg(F.sum("overall_score")).first()[0] == pytest.approx(scored.agg(F.sum("overall_score")).first()[0])


def test_percentiles_equal_sorted_lists(spark):
    import random

    rng = random.Random(2)
    rows = [("a", float(rng.randrange(40))) for _ in range(500)] + [("b", 7.0)] * 3 + [("c", None)]
    got = {r.g: r for r in statistics.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"p50": 0.5, "p99": 0.99}, ["g"]).collect()}
    for g in "ab":
        v = sorted(x for k, x in rows if k == g)
        assert (got[g].n, got[g].p50, got[g].p99) == (len(v), v[int(len(v) * 0.5)], v[int(len(v) * 0.99)])
    assert "c" not in got


def test_clean_text(spark):
    rows = spark.createDataFrame([(0, "ﬁne  ①\n\n\n\n•\tx "), (1, ""), (2, None)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(T.clean_text(T.nfkc(F.col("t")))).collect()] == ["fine 1\n\n-\tx", "", None]


def test_page_text(spark):
    body = "wanted " * 9
    pages = [f"<body><p>menu</p><div class='a job-description b'>{body}<b>x</b></div></body>", "<body><div id='job-details'>short</div> rest</body>", "<script>1</script>plain &amp; simple", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").orderBy("i").select(T.page_text(F.col("h"))).collect()]
    assert got == [f"{body}x", "short rest", "plain & simple", "", None]


def test_model_answers(spark):
    rows = ['```json\n{"match_summary": "fits", "suggestions": ["a", "b", "c", "d", "e", "f"]}\n```', '{"suggestions": []}', "sorry", "", None]
    s, t, again = legacy.model_answer(F.col("a"))
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a string").orderBy("i").select(s.alias("s"), t.alias("t"), again.alias("again")).collect()
    assert [(r.s[:4], len(r.t), r.again) for r in got] == [("fits", 5, False), ("Summ", 0, False), ("AI s", 0, True), ("AI s", 0, True), ("AI s", 0, True)]


@pytest.mark.parametrize("threshold", [0.6, 0.82, 0.9])
def test_fuzzy_best_equals_brute_force(spark, threshold):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 22))) for _ in range(60)})

    def changed(w):
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(0, len(w) + 1)
            w = w[:k] + rng.choice(["", "a", "bd"]) + w[k + rng.randrange(0, 2) :]
        return w or "a"

    values = sorted({changed(rng.choice(names)) for _ in range(300)})
    p = skills.patterns(spark.createDataFrame([(i, n, "x", None) for i, n in enumerate(names)], "ord int, canonical string, category string, aliases array<string>"))
    got = {r.value: (r.canonical, round(r.similarity, 9)) for r in skills.fuzzy_best(spark.createDataFrame([(v,) for v in values], "v string"), "v", p, threshold).collect()}
    want = {}
    for v in values:
        s, _, n = max((1 - distance(v, n) / max(len(v), len(n)), -i, n) for i, n in enumerate(names))
        if s >= threshold:
            want[v] = (n, round(s, 9))
    assert got == want and want


def test_names_within(spark):
    texts = spark.createDataFrame([(1, "reactive c++ and sql"), (2, ""), (3, None), (4, "a")], "id long, text string")
    names = spark.createDataFrame([("react",), ("c",), ("sql",), ("",), (None,), ("go",), ("a",)], "name string")
    assert {(r.id, r.name) for r in skills.names_within(texts, names).collect()} == {(1, "react"), (1, "c"), (1, "sql"), (1, "a"), (4, "a")}


def test_surface_patterns(spark):
    text = "FileEditViewInsertFormatToolsExtensions Help Job Calibri\n1 2\n 3\nTo enable screen reader support, press Ctrl+slash text"
    assert spark.createDataFrame([(text,)], "t string").select(legacy.without_surface(F.col("t"))).first()[0].split() == ["Job", "text"]
