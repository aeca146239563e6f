import json

import pytest
from pyspark.sql import functions as F

from quern.operators import pairs as P
from quern.operators import scoring as S
from quern.operators import sections as X
from quern.operators import skills as K

RESUME = """Marta Quillfeather
Email: marta@quill.example | Phone: 555-010-7788
LinkedIn: linkedin.com/in/marta-q | GitHub: github.com/martaq

SUMMARY
Payroll analyst who likes tidy ledgers.

EXPERIENCE
Senior Payroll Analyst, Harbour Mills, Leeds
Jan 2022 - Present
- Reduced closing time by 40% with SQL reports
- Managed a team of 4 clerks

Payroll Analyst, Copper Lane, York
Jun 2019 - Dec 2021
- Built audits in Python for 900 users
- checked timesheets

EDUCATION
BSc in Statistics, Northgate University, 2015 - 2019
GPA: 3.8/4.0

SKILLS
Python, SQL, Excel, Docker

PROJECTS
Ledgerlight
a small ledger printed without colours
technologies: python, docker
https://github.com/martaq/ledgerlight

CERTIFICATIONS
Certified Cloud Auditor - Audit Board, 2023

LANGUAGES
English, Polish
"""
QUERY = "Senior payroll analyst: bachelor in statistics, SQL and Python, Docker too."
OTHER = "Registered nurse with patient care and triage, night shifts."
TAXONOMY = [(1, "Python", "PL", []), (2, "SQL", "PL", None), (3, "Excel", "Office", []), (4, "Docker", "Ops", ["docker engine"]), (5, "Patient Care", "Care", []), (6, "Triage", "Care", []), (7, "pa-tient care", "Care", [])]


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, None), (3, ""), (4, "x")], "id long, text string")
    return docs, X.parsed(docs, "id", "text")


@pytest.fixture(scope="module")
def scored(spark, parts):
    docs, found = parts
    queries = spark.createDataFrame([(10, QUERY), (11, OTHER), (12, "")], "query_id long, text string")
    ask = spark.createDataFrame([(d, q, [1.0, 2.0], [2.0, 1.0]) for d in (1, 2, 3, 4, 9) for q in (10, 11, 12)], "id long, query_id long, resume_embedding array<float>, jd_embedding array<float>")
    tax = spark.createDataFrame(TAXONOMY, "ord int, canonical string, category string, aliases array<string>")
    return S.overall_score(S.category_scores(P.scored_pairs(ask, docs, queries, found, tax)))


def test_parsed_entries(parts):
    _, found = parts
    one = lambda name: [r.asDict() for r in found[name].where("id = 1").orderBy("pos").collect()]
    c = found["contact"].where("id = 1").first()
    assert (c.full_name, c.email, c.phone, c.linkedin, c.github) == ("Marta Quillfeather", "marta@quill.example", "555-010-7788", "linkedin.com/in/marta-q", "github.com/martaq")
    jobs = one("experience")
    assert [(j["job_title"], j["company"], j["start_date"], j["end_date"], j["is_current"], len(j["bullets"])) for j in jobs] == [
        ("Senior Payroll Analyst, Harbour Mills, Leeds", "", "Jan 2022", "Present", True, 3), ("Payroll Analyst, Copper Lane, York", "", "Jun 2019", "Dec 2021", False, 2),
    ]
    school = one("education")[0]
    assert (school["degree"], school["start_date"], school["end_date"], school["gpa"]) == ("BSc", "2015", "2019", "3.8/4.0")
    assert [s["skill"] for s in one("skills")] == ["Python", "SQL", "Excel", "Docker"]
    project = one("projects")
    assert [(p["name"], p["technologies"], p["url"]) for p in project] == [("Ledgerlight", ["python", "docker"], "https://github.com/martaq/ledgerlight")]
    assert [(r["name"], r["issuer"], r["issue_date"]) for r in one("certificates")] == [("Certified Cloud Auditor", "Audit Board", "2023")]
    assert [r["item"] for r in one("lists")] == ["English", "Polish"]
    assert found["contact"].count() == 4 and found["experience"].where("id <> 1").count() == 0


def test_rules_of_entries(spark):
    e = spark.createDataFrame([(1, "kept the books in order\nab\n- more lines here"), (2, "2015\nNorthgate College\nGPA 3.1\ncurrently there"), (3, "B.S. Computing, Some School, 2010")], "id long, text string")
    loose = X.experience_entries(e.where("id = 1")).first()
    assert loose.job_title == "Unknown" and loose.bullets == ["kept the books in order", "more lines here"]
    school = X.education_entries(e.where("id = 2")).first()
    assert (school.institution, school.end_date, school.gpa, school.degree) == ("Northgate College", "Present", "3.1", "")
    assert X.education_entries(e.where("id = 3")).first().degree == "" and X.education_entries(e.where("id = 3"), X.DEGREE_DOTTED).first().degree == "B.S."
    docs = spark.createDataFrame([(1, "Nothing. Technologies: Rust, Zig\n\nend"), (2, "no such word")], "id long, text string")
    assert [r.text for r in X.skill_fallback(docs, "id", "text").collect()] == ["Rust, Zig"]


def test_features_of_a_pair(scored):
    f = scored.where("id = 1 and query_id = 10").first()
    want = {
        "total_experience_months": 85 / 240, "relevant_experience_months": 85 / 240, "num_positions": 0.2, "employment_gap_months": 1 - 1 / 24, "num_gaps": 0.8, "max_seniority_score": 0.7, "avg_seniority_score": 0.575,
        "has_leadership_keywords": 1, "quantified_achievement_count": 0.2, "action_verb_density": 0.6, "career_progression_score": 0.25, "highest_degree_level": 0.6, "degree_field_match": 0.75, "gpa_normalized": 0.95,
        "education_recency_score": 0.65, "degree_requirement_met": 1, "num_projects": 0.1, "avg_technologies_per_project": 0.25, "project_link_ratio": 1, "project_tech_overlap": 2 / 3, "project_domain_relevance": 0, "has_open_source": 1,
        "has_cloud_cert": 1, "section_completeness_score": 1, "has_summary": 1, "has_links": 1, "has_contact_info": 1, "keyword_stuffing_penalty": 0, "skill_coverage_ratio": 1, "skill_has_all_required": 1, "cosine_similarity": 0.8,
    }
    assert {k: pytest.approx(f[k]) for k in want} == want
    assert f.matched == ["Docker", "Python", "SQL"] and f.missing == []
    assert all(0 <= f[k] <= 1 for k in P.FEATURES) and len(P.FEATURES) == 89
    assert all(f[f"{c}_score"] > 0 for c in S.CATEGORIES)
    assert f.overall_score > scored.where("id = 1 and query_id = 11").first().overall_score


def test_reports_and_errors(scored):
    got = {(r.id, r.query_id): json.loads(r.report) for r in S.reports(scored, ["id", "query_id"]).collect()}
    assert len(got) == 15
    good = got[1, 10]
    assert good["error"] is None and good["matched_skills"] == ["Docker", "Python", "SQL"] and len(good["feature_vector"]) == 89 and good["top_positive_factors"] and good["ranking_method"] == "linear_fallback"
    assert got[2, 10]["error"] == got[3, 10]["error"] == got[9, 10]["error"] == "resume_text is empty" and got[1, 12]["error"] == "jd_text is empty"
    assert got[2, 10]["overall_score"] == 0 and set(got[2, 10]["scores"].values()) == {0} and got[2, 10]["matched_skills"] == [] and got[2, 10]["feature_vector"] is None


def test_partial_skills(spark):
    tax = spark.createDataFrame(TAXONOMY, "ord int, canonical string, category string, aliases array<string>")
    p = K.patterns(tax)
    have = spark.createDataFrame([(1, "Patient Care", "Care", 0.95, "trie"), (1, "Excel", "Office", 1.0, "exact")], "id long, canonical string, category string, confidence double, method string")
    need = spark.createDataFrame([(7, "Triage", "Care"), (7, "pa-tient care", "Care"), (7, "Docker", "Ops"), (7, "Excel", "Office")], "query_id long, canonical string, category string")
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "id long, query_id long")
    rows = {r.id: r for r in K.gap_lists(K.gap(pairs, have, need, p)).collect()}
    assert rows[1].matched == ["Excel"] and rows[1].missing == ["Docker", "Triage", "pa-tient care"] and rows[2].missing == ["Docker", "Excel", "Triage", "pa-tient care"]
    near = K.gap_lists(K.gap(pairs, have, need, p, partial=0.45)).where("id = 1").first().partial
    assert [(x.jd_skill, x.matched_as, round(x.confidence, 2)) for x in near] == [("Triage", "Patient Care", 0.45), ("pa-tient care", "Patient Care", 0.45)]
    needed = F.array(F.struct(F.lit("JavaScript").alias("canonical"), F.lit("PL").alias("category"), F.lit("Java Script").alias("alike"), F.lit(0.9).alias("alikeness")))
    held = F.array(F.struct(F.lit(-1.0).alias("rank"), F.lit("Java Script").alias("canonical"), F.lit("PL").alias("category"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method")))
    s = spark.range(1).select(K.statuses(needed, held)[0].alias("s")).first().s
    assert (s.status, s.matched_as, s.confidence) == ("partial", "Java Script", 0.9)


def test_missing_features_are_an_error(spark):
    with pytest.raises(ValueError, match="gpa_normalized"):
        S.category_scores(spark.createDataFrame([(1, 0.5)], "id long, highest_degree_level double"))
    only = spark.createDataFrame([(1, *[0.5] * 6)], "id long, skill_coverage_ratio double, critical_skill_coverage double, avg_skill_confidence double, skill_category_diversity double, skill_has_all_required double, rare_skill_bonus double")
    assert S.category_scores(only, ["skills"]).first().skills_score == pytest.approx(50)


def test_empty_tables(spark, parts):
    docs, found = parts
    none = docs.where(F.lit(False))
    queries = spark.createDataFrame([], "query_id long, text string")
    ask = spark.createDataFrame([], "id long, query_id long, resume_embedding array<float>, jd_embedding array<float>")
    tax = spark.createDataFrame(TAXONOMY, "ord int, canonical string, category string, aliases array<string>")
    assert P.scored_pairs(ask, none, queries, {k: v.where(F.lit(False)) for k, v in found.items()}, tax).count() == 0
