"""Fixed values of the matching engine and the lookup frames built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that carry no meaning of their own.
STOP_WORDS = """a an the and or but in on at to for of with by is are was were be been being have has had do does did will would
could should may might shall can from as it its this that these those we you he she they i me my our us your their his her also not
no nor so yet both either neither more most other some such only than too very just about""".split()

# Weights of known terms; any other term weighs DEFAULT_IDF.
IDF = {
    "kubernetes": 8.5, "terraform": 8.5, "dvc": 8.5, "langchain": 8.5, "faiss": 8.5, "dbt": 8.5, "graphql": 8.0, "grpc": 8.0, "mlflow": 8.0,
    "rag": 8.0, "databricks": 8.0, "elasticsearch": 7.8, "cassandra": 7.8, "snowflake": 7.8, "kafka": 7.5, "airflow": 7.5, "fastapi": 7.5,
    "xgboost": 7.5, "llm": 7.5, "rust": 7.5, "scala": 7.5, "redshift": 7.5, "spark": 7.2, "pytorch": 7.0, "golang": 7.0, "tensorflow": 6.8,
    "flask": 6.5, "django": 6.5, "typescript": 6.5, "opencv": 6.5, "microservices": 6.5, "postgresql": 6.0, "mongodb": 6.0, "redis": 6.0,
    "scikit": 6.0, "cicd": 6.0, "docker": 5.5, "aws": 5.5, "gcp": 5.5, "azure": 5.5, "mysql": 5.5, "react": 5.5, "nodejs": 5.5, "bash": 5.5,
    "numpy": 5.5, "pandas": 5.5, "restful": 5.5, "fullstack": 5.5, "distributed": 5.5, "scalable": 5.5, "python": 5.0, "java": 5.0,
    "javascript": 5.0, "linux": 5.0, "backend": 5.0, "frontend": 5.0, "sql": 4.5, "git": 4.5, "api": 4.0, "architect": 4.0, "machine": 4.0,
    "learning": 4.0, "deep": 4.0, "engineer": 3.5, "developer": 3.5, "manager": 3.5, "analyst": 3.5, "lead": 3.5, "data": 3.5, "senior": 3.0,
    "junior": 3.0, "software": 3.0, "system": 3.0, "experience": 2.5, "knowledge": 2.5, "team": 2.5, "skills": 2.0, "strong": 2.0, "excellent": 2.0,
    "work": 2.0, "good": 1.5,
}
DEFAULT_IDF = 2.0

# Terms of technology.
TECH_TERMS = """python java javascript typescript golang rust scala cpp csharp react angular vue nodejs flask django fastapi spring aws gcp
azure docker kubernetes terraform ansible sql mysql postgresql mongodb redis elasticsearch cassandra kafka pytorch tensorflow sklearn numpy
pandas spark hadoop git linux bash rest api graphql grpc microservices cicd""".split()

# Section headings, by section, in order of precedence.
SECTION_HEADINGS = {
    "SUMMARY": ["summary", "objective", "profile", "about me", "professional summary", "career objective", "executive summary"],
    "EXPERIENCE": ["experience", "work experience", "employment", "work history", "professional experience", "career history", "employment history", "work & experience", "relevant experience"],
    "EDUCATION": ["education", "academic background", "academic history", "educational background", "qualifications", "academic qualifications"],
    "SKILLS": ["skills", "technical skills", "core competencies", "competencies", "key skills", "skills & expertise", "areas of expertise", "technical expertise", "technologies", "skill set", "tools & technologies", "proficiencies"],
    "PROJECTS": ["projects", "personal projects", "key projects", "project experience", "notable projects", "selected projects", "portfolio", "academic projects"],
    "CERTIFICATIONS": ["certifications", "certificates", "licenses", "professional certifications", "training & certifications", "accreditations"],
    "AWARDS": ["awards", "achievements", "honors", "accomplishments", "recognition", "awards & achievements"],
    "PUBLICATIONS": ["publications", "research", "papers", "conference papers"],
    "LANGUAGES": ["languages", "language proficiency"],
    "VOLUNTEER": ["volunteer", "volunteering", "community"],
    "REFERENCES": ["references", "professional references"],
}

# Seniority of a title and of a query by the first of the substrings that it holds.
TITLE_SENIORITY = [(["principal", "fellow"], 1.0), (["staff"], 0.9), (["lead"], 0.8), (["senior", "sr."], 0.7), (["mid"], 0.5), (["junior", "jr."], 0.3), (["intern", "trainee"], 0.15)]
TITLE_DEFAULT = 0.45
QUERY_SENIORITY = [(["principal", "staff"], 1.0), (["lead"], 0.8), (["senior"], 0.7), (["junior", "entry level"], 0.25)]
QUERY_DEFAULT = 0.5

# Substrings that show leadership.
LEADERSHIP = ["led", "managed", "directed", "supervised", "mentored", "coached", "oversaw", "spearheaded", "headed", "coordinated team", "built team", "hired", "grew team", "team of"]
# Verbs of action of a whole document.
ACTION_VERBS_GLOBAL = [
    "built", "developed", "designed", "implemented", "created", "led", "managed", "improved", "optimized", "reduced", "increased", "launched",
    "deployed", "authored", "architected", "engineered", "refactored", "migrated", "integrated", "automated", "delivered", "shipped",
]
# Verbs of action of a job.
ACTION_VERBS = [
    "built", "developed", "designed", "implemented", "created", "led", "managed", "improved", "optimized", "reduced", "increased", "launched",
    "deployed", "authored", "architected", "engineered", "refactored", "migrated", "integrated", "automated", "delivered", "shipped", "released",
    "established", "collaborated", "drove", "owned", "transformed", "scaled", "revamped", "streamlined", "mentored", "trained", "wrote", "analyzed",
    "researched", "investigated", "resolved", "fixed", "debugged", "maintained", "monitored", "configured", "administered", "supported", "reviewed",
]
# Patterns of a figure with a unit, of a bullet and of a whole document.
QUANTITY = r"[0-9]+[ \t\n\r\f]*(%|x|×|k|\$|million|billion|users|requests|ms|seconds|hours|days|months|years|points|percent)"
QUANTITY_GLOBAL = r"[0-9]+[ \t\n\r\f]*(%|x|×|k|\$|million|billion|users|ms|seconds)"

# Level of a degree by the first of the substrings that it holds.
DEGREES = [
    (["phd", "ph.d", "docto"], 1.0), (["master", "m.tech", "mtech", "mba", "m.s.", "msc"], 0.8),
    (["bachelor", "b.tech", "btech", "bsc", "b.s.", "b.e."], 0.6), (["associate", "diploma"], 0.4), (["high school", "secondary"], 0.2),
]
# Weights of fields of study.
FIELDS = {
    "computer science": 1.0, "software engineering": 1.0, "electrical engineering": 0.85, "data science": 1.0, "machine learning": 1.0,
    "mathematics": 0.75, "statistics": 0.75, "information technology": 0.9, "computer engineering": 0.95, "physics": 0.6,
    "mechanical engineering": 0.5, "finance": 0.7, "business": 0.6, "accounting": 0.65, "biology": 0.4, "chemistry": 0.4,
    "nursing": 0.8, "medicine": 0.8, "law": 0.7, "marketing": 0.65, "psychology": 0.4,
}
# Substrings of well-known institutions.
PRESTIGE = ["iit", "iim", "mit", "stanford", "harvard", "carnegie mellon", "princeton", "caltech", "columbia", "yale", "oxford", "cambridge", "berkeley", "chicago", "nit", "bits", "iisc", "vit", "srm", "manipal", "anna university"]
# Words before which the wanted part of a long query text starts.
QUERY_KEYWORDS = ["requirements", "qualifications", "what you bring", "what you need", "skills", "responsibilities", "what you'll do"]

# Feature, threshold of praise, threshold of blame and their texts.
EXPLANATIONS = [
    ("skill_coverage_ratio", 0.80, 0.40, "Excellent skill match — {value} of required skills aligned", "Skill gap — only {value} of required skills found"),
    ("skill_has_all_required", 0.90, 0.50, "All critical skills present", "Missing critical required skills"),
    ("skill_category_diversity", 0.60, 0.20, "Broad technology expertise across multiple domains", "Limited skill diversity — consider broadening expertise"),
    ("avg_skill_confidence", 0.85, 0.50, "High-confidence skill matches across the profile", "Skill matches have low confidence — verify skill claims"),
    ("relevant_experience_months", 0.50, 0.15, "Strong relevant experience — {value}", "Limited relevant experience — {value}"),
    ("max_seniority_score", 0.70, 0.30, "Seniority level aligns well with position requirements", "Seniority level may not meet position requirements"),
    ("has_leadership_keywords", 0.80, 0.10, "Demonstrated leadership and team management experience", "No leadership indicators found — consider highlighting management experience"),
    ("quantified_achievement_count", 0.60, 0.15, "Well-quantified achievements demonstrate measurable impact", "Few quantified achievements — add metrics to strengthen impact"),
    ("action_verb_density", 0.70, 0.30, "Strong action-oriented language throughout experience", "Weak action verb usage — use stronger action verbs in bullet points"),
    ("career_progression_score", 0.65, 0.35, "Clear career progression demonstrated", "Career progression unclear or inconsistent"),
    ("employment_gap_months", 0.70, 0.30, "Continuous employment history with minimal gaps", "Notable employment gaps in work history"),
    ("highest_degree_level", 0.80, 0.40, "Education level meets or exceeds requirements", "Education level may be below requirements"),
    ("degree_field_match", 0.70, 0.20, "Field of study directly relevant to the role", "Field of study not closely aligned with role requirements"),
    ("project_tech_overlap", 0.70, 0.20, "Project portfolio demonstrates relevant technology experience", "Project work does not show relevant technology alignment"),
    ("project_domain_relevance", 0.65, 0.20, "Projects directly applicable to the job domain", "Project domain diverges from job requirements"),
    ("section_completeness_score", 0.80, 0.40, "Resume is comprehensive and well-structured", "Resume is missing key sections — consider adding summary/projects"),
    ("quantified_achievements_total", 0.50, 0.10, "Resume demonstrates strong impact with measurable results", "Resume lacks quantified results — add numbers to demonstrate impact"),
    ("cosine_similarity", 0.75, 0.40, "Strong semantic alignment with job description", "Resume language does not closely match job description vocabulary"),
    ("bm25_score", 0.65, 0.25, "High keyword alignment with job requirements", "Resume does not contain enough job-relevant keywords"),
    ("keyword_overlap_ratio", 0.60, 0.20, "Good keyword coverage of job description terms", "Low keyword overlap with job description — consider tailoring resume"),
]

# Weights of the category scores and of the overall score.
CATEGORY_WEIGHTS = {
    "skills": {"skill_coverage_ratio": 0.40, "critical_skill_coverage": 0.20, "avg_skill_confidence": 0.15, "skill_category_diversity": 0.10, "skill_has_all_required": 0.10, "rare_skill_bonus": 0.05},
    "experience": {"relevant_experience_months": 0.30, "max_seniority_score": 0.15, "career_progression_score": 0.15, "is_currently_employed": 0.10, "action_verb_density": 0.10, "quantified_achievement_count": 0.10, "has_leadership_keywords": 0.05, "employment_gap_months": 0.05, "job_hopper_flag": -0.10, "overqualified_flag": -0.10},
    "education": {"highest_degree_level": 0.35, "degree_field_match": 0.30, "degree_requirement_met": 0.15, "gpa_normalized": 0.10, "prestigious_institution_flag": 0.05, "education_recency_score": 0.05},
    "projects": {"project_tech_overlap": 0.35, "project_domain_relevance": 0.25, "num_projects": 0.15, "project_link_ratio": 0.10, "avg_technologies_per_project": 0.10, "has_open_source": 0.05},
    "semantic": {"cosine_similarity": 0.40, "tfidf_cosine_similarity": 0.25, "bm25_score": 0.20, "keyword_overlap_ratio": 0.15},
    "quality": {"section_completeness_score": 0.20, "action_verb_density_global": 0.20, "quantified_achievements_total": 0.15, "resume_length_score": 0.15, "readability_score": 0.10, "has_summary": 0.10, "has_links": 0.05, "has_contact_info": 0.05, "keyword_stuffing_penalty": -0.30},
}
OVERALL_WEIGHTS = {"skills": 0.30, "experience": 0.28, "semantic": 0.20, "education": 0.10, "projects": 0.07, "quality": 0.05}


def idf_terms() -> list[tuple[str, float]]:
    return list(IDF.items())


def idf_frame(spark: SparkSession) -> DataFrame:
    """(term, idf) of the known terms; fewer than a hundred rows."""
    return F.broadcast(spark.createDataFrame(idf_terms(), "term string, idf double"))


def headings_frame(spark: SparkSession) -> DataFrame:
    """(heading, section, ord): fewer than a hundred rows."""
    rows = [(h, s, i * 100 + j) for i, (s, hs) in enumerate(SECTION_HEADINGS.items()) for j, h in enumerate(hs)]
    return F.broadcast(spark.createDataFrame(rows, "heading string, section string, ord int"))
