"""Lines, headings, sections and entries of résumé texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import lexicon as L
from quern.functions.text import ascii_lower, year_month
from quern.session import durable

_EDGE = r"^[ \t\r\n]+|[ \t\r\n]+$"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE_RANGE = rf"(?i)((?:(?:{MONTHS})[a-z]*[ \t]+)?[0-9]{{4}})[ \t]*(?:-|–|—|to)+[ \t]*((?:present|current|now|ongoing)|(?:(?:{MONTHS})[a-z]*[ \t]+)?[0-9]{{4}})"
DATE_LINE = rf"(?i)(?:^|[^A-Za-z0-9_])(?:(?:{MONTHS})|january|february|march|april|june|july|august|september|october|november|december|[0-9]{{4}})(?:$|[^A-Za-z0-9_])"
_WORD = "[A-Za-z0-9_]"  # ends of words are those of ASCII
# Names of degrees; the plain form takes a dotted name only where a letter follows it, so not `B.S. `.
_DEGREES = r"ph\.?d|doctorate|doctoral|master|m\.tech|mtech|msc|mba|b\.tech|btech|bsc|bachelor|be|associate|diploma|high school|secondary"
_DOTTED = r"m\.s\.|b\.s\.|b\.e\."
DEGREE = rf"(?i)(?<!{_WORD})(?:(?:{_DEGREES})(?!{_WORD})|(?:{_DOTTED})(?={_WORD}))"
DEGREE_DOTTED = rf"(?i)(?<!{_WORD})(?:(?:{_DEGREES})(?!{_WORD})|(?:{_DOTTED}))"
YEAR = rf"(?<!{_WORD})(?:19|20)[0-9]{{2}}(?!{_WORD})"
BULLET = r"^[\-•*·▪◦][ \t\n\r\f]*"
URL = r"(?i)(?:https?://|github\.com/|gitlab\.com/)[A-Za-z0-9_\-./]+"
TOOLS = r"(?i)(?<![A-Za-z0-9_])(?:using|built with|technologies|technology|technologie|tech stack|tools|tool)[ \t]*:?[ \t]*(.+)"
EMPTY = "cast(array() as array<string>)"


def size_of(c: Column) -> Column:
    """Bytes of a text."""
    return F.octet_length(F.encode(c, "utf-8"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): trimmed lines from 0; null texts have none."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return rows.withColumn("line", strip(F.col("line")))


def headings(rows: DataFrame) -> DataFrame:
    """(id, line_no, section): lines that are a known heading or start with one."""
    key = F.regexp_replace(ascii_lower(F.col("line")), "[ \t]*:$", "")
    short = rows.where((F.octet_length(F.encode("line", "utf-8")) <= 60) & (F.col("line") != "")).withColumn("key", key)
    starts = F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.struct(n.alias("n"), F.substring(F.col("key"), F.lit(1), n).alias("p"), F.substring(F.col("key"), n + 1, F.lit(1)).alias("after")))
    probes = F.filter(starts, lambda s: s["after"].isin("", " ", "/", "&"))
    probed = short.where(F.length("key") > 0).select("id", "line_no", "key", F.explode(probes).alias("s"))
    known = L.headings_frame(rows.sparkSession)
    hit = probed.join(known, F.col("s.p") == F.col("heading")).withColumn("stage", F.when(F.col("key") == F.col("heading"), 0).otherwise(1))
    return hit.groupBy("id", "line_no").agg(F.min_by("section", F.struct("stage", "ord")).alias("section"))


def kept_headings(hits: DataFrame, near: int = 2) -> DataFrame:
    """(id, line_no, section) without repeats of the section of the heading kept before within `near` lines."""
    fold = F.aggregate(
        "h",
        F.array().cast("array<struct<line_no:int,section:string>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["section"] == x["section"]) & (x["line_no"] - F.try_element_at(acc, F.lit(-1))["line_no"] <= near), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    rows = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "section"))).alias("h"))
    return rows.select("id", F.inline(fold))


def labelled(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, line_no, line, section, at): section of each line and the line of its heading; null before the first (P5)."""
    w = Window.partitionBy("id").orderBy("line_no")
    marked = rows.join(kept.withColumn("heading", F.lit(True)), ["id", "line_no"], "left").withColumn("_at", F.when(F.col("heading"), F.col("line_no")))
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    full = marked.withColumn("section", last("section")).withColumn("at", last("_at"))
    return full.where(F.col("heading").isNull()).select("id", "line_no", "line", "section", "at")


def sections(rows: DataFrame) -> DataFrame:
    """(id, section, start_line, n_lines, text): of each name the last section of a document."""
    inside = labelled(rows, kept_headings(headings(rows))).where(F.col("section").isNotNull())
    texts = inside.groupBy("id", "section", "at").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    texts = texts.select("id", "section", "at", F.size("l").alias("n_lines"), F.array_join("l.line", "\n").alias("text"))
    best = texts.groupBy("id", "section").agg(F.max_by(F.struct("at", "n_lines", "text"), "at").alias("s"))
    return best.select("id", "section", F.col("s.at").alias("start_line"), "s.n_lines", "s.text")


def preamble(rows: DataFrame) -> DataFrame:
    """(id, text): the lines before the first heading, all if there is none (P5)."""
    before = labelled(rows, kept_headings(headings(rows))).where(F.col("section").isNull())
    return before.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select("id", F.array_join("l.line", "\n").alias("text"))


def listed_parts(c: Column) -> Column:
    """Parts of a text between commas, bars, semicolons and bullets, without leading dashes, of two bytes or more."""
    parts = F.transform(F.split(c, "[,|;•·●▪◦]"), lambda x: strip(F.regexp_replace(strip(x), r"^(?:-[ \t\r\n]*)+", "")))
    return F.filter(parts, lambda x: size_of(x) > 1)


def contacts(docs: DataFrame, before: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, email, phone, linkedin, github) of the preamble and the first 500 bytes; '' where there is none.

    before: (id, text) of `preamble`. Null texts give '' everywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, 500).cast("string"))
    rows = docs.select(F.col(id_col).alias("id"), start.alias("start")).join(before.select("id", F.col("text").alias("_pre")), "id", "left")
    head = F.concat(F.coalesce("_pre", F.lit("")), F.lit("\n"), F.col("start"))
    phone = F.regexp_extract(head, r"\+?[0-9 \t\n\r\-().]{7,18}[0-9]", 0)
    digits = F.length(F.regexp_replace(phone, "[^0-9]", ""))
    return rows.select(
        "id",
        F.regexp_extract(head, r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+\.[A-Za-z0-9_.]{2,}", 0).alias("email"),
        F.when(digits >= 7, strip(phone)).otherwise("").alias("phone"),
        F.regexp_extract(head, r"(?i)linkedin\.com/in/[A-Za-z0-9_\-]+", 0).alias("linkedin"),
        F.regexp_extract(head, r"(?i)github\.com/[A-Za-z0-9_\-]+", 0).alias("github"),
    )


def full_name(before: DataFrame) -> DataFrame:
    """(id, full_name): the first line of a preamble (id, text) of two to five words that are mostly letters and no link."""
    line = F.col("line")
    words = F.filter(F.split(line, "[ \t]+"), lambda w: w != "")
    letters = lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 0.7 * size_of(w)
    plain = ~(line.contains("@") | line.contains("http") | line.contains("linkedin") | line.contains("github"))
    named = lines(before, "id", "text").where(plain & F.size(words).between(2, 5) & F.forall(words, letters))
    return named.groupBy("id").agg(F.min_by("line", "line_no").alias("full_name"))


def experience_entries(section: DataFrame) -> DataFrame:
    """(id, pos, job_title, company, start_date, end_date, is_current, bullets) of (id, text) of experience sections.

    A section without any entry gives one, `Unknown`, that holds its lines of more than five bytes.
    """
    w = Window.partitionBy("id").orderBy("line_no")
    rows = section.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", strip(F.col("raw")))
    rows = rows.withColumn("prev", F.lag("line").over(w)).where(F.col("line") != "")
    rows = rows.withColumn("head", F.col("line").rlike(DATE_RANGE)).withColumn("pos", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = strip(F.regexp_replace("line", DATE_RANGE, ""))
    at = F.regexp_extract(rest, r"(?i)^(.*?)(?:^|[^A-Za-z0-9_])at(?:$|[^A-Za-z0-9_])(.*)$", 1)
    has_at, comma = rest.rlike(r"(?i)(?:^|[^A-Za-z0-9_])at(?:$|[^A-Za-z0-9_])"), F.instr(rest, ",")
    prev = F.when((F.coalesce("prev", F.lit("")) != "") & ~F.coalesce(F.col("prev").rlike(DATE_LINE), F.lit(False)), F.col("prev")).otherwise("")
    title = F.when(has_at, strip(at)).when(comma > 0, strip(F.substring(rest, F.lit(1), comma - 1))).when(prev != "", prev).otherwise(rest)
    company = (
        F.when(has_at, strip(F.regexp_extract(rest, r"(?i)(?:^|[^A-Za-z0-9_])at(?:$|[^A-Za-z0-9_])(.*)$", 1)))
        .when(comma > 0, strip(F.substring(rest, comma + 1, F.length(rest))))
        .when(prev != "", rest)
        .otherwise("")
    )
    heads = rows.where("head").select(
        "id", "pos", title.alias("job_title"), company.alias("company"),
        F.regexp_extract("line", DATE_RANGE, 1).alias("start_date"), F.regexp_extract("line", DATE_RANGE, 2).alias("end_date"),
    )
    bullets = rows.where(~F.col("head")).withColumn("b", strip(F.regexp_replace("line", BULLET, "")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_no", c))), lambda x: x[c])
    inside = bullets.where((F.col("pos") > 0) & (size_of(F.col("b")) > 5)).groupBy("id", "pos").agg(in_order("b").alias("bullets"))
    jobs = heads.where((F.col("job_title") != "") | (F.col("company") != "")).join(inside, ["id", "pos"], "left")
    current = F.lower("end_date").isin("present", "current", "now", "ongoing")
    found = jobs.select("id", "pos", "job_title", "company", "start_date", "end_date", current.alias("is_current"), F.coalesce("bullets", F.expr(EMPTY)).alias("bullets"))
    loose = rows.where(size_of(F.col("line")) > 5).withColumn("b", F.regexp_replace("line", BULLET, "")).where("b <> ''").groupBy("id").agg(in_order("b").alias("bullets"))
    blank = F.lit("")
    unknown = loose.join(found.select("id").distinct(), "id", "left_anti").select(
        "id", F.lit(1).cast("long").alias("pos"), F.lit("Unknown").alias("job_title"), blank.alias("company"), blank.alias("start_date"), blank.alias("end_date"), F.lit(False).alias("is_current"), "bullets"
    )
    return found.unionByName(unknown)


def education_entries(section: DataFrame, degree: str = DEGREE) -> DataFrame:
    """(id, pos, degree, field_of_study, institution, start_date, end_date, gpa) of (id, text) of education sections."""
    w = Window.partitionBy("id").orderBy("line_no")
    line = F.col("line")
    rows = section.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", strip(F.col("raw"))).where(line != "")
    rows = rows.withColumn("named", line.rlike(degree))
    first = F.min(F.when(F.col("named") | line.rlike(YEAR), F.col("line_no"))).over(Window.partitionBy("id"))
    rows = rows.withColumn("start", F.col("named") | (F.col("line_no") == first)).withColumn("start", F.coalesce("start", F.lit(False)))
    rows = rows.withColumn("pos", F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    years = F.regexp_extract_all("line", F.lit(YEAR), F.lit(0))
    known = F.regexp_extract("line", degree, 0)
    after = F.substring(line, F.instr(line, known) + F.length(known), F.length(line))
    field = strip(F.regexp_replace(F.regexp_replace(strip(after), r"^(?:in|of|,)[ \t]*", ""), YEAR, ""))
    field = F.when(F.col("named") & (size_of(field) > 2) & (size_of(field) < 80), field).otherwise("")
    here = strip(F.regexp_replace(F.regexp_replace("line", degree, ""), YEAR, ""))
    heads = rows.where("start").select(
        "id", "pos", F.when(F.col("named"), strip(known)).otherwise("").alias("degree"), field.alias("field_of_study"), F.when(size_of(here) > 5, here).alias("here"),
        F.when(F.size(years) > 1, F.element_at(years, 1)).otherwise("").alias("start_date"),
        F.coalesce(F.when(F.size(years) > 1, F.element_at(years, 2)).otherwise(F.try_element_at(years, F.lit(1))), F.lit("")).alias("year"),
    )
    number = r"(?i)gpa[ \t]*:?[ \t]*([0-9.]+)[ \t]*/?[ \t]*([0-9.]+)?"
    gpa = F.concat_ws("/", F.regexp_extract("line", number, 1), F.nullif(F.regexp_extract("line", number, 2), F.lit("")))
    later = rows.where(~F.col("start") & (F.col("pos") > 0)).groupBy("id", "pos").agg(
        F.max_by(F.when(line.rlike(number), gpa), F.when(line.rlike(number), F.col("line_no"))).alias("gpa"),
        F.min_by("line", F.when((size_of(line) > 5) & (size_of(line) < 100) & ~line.rlike(DATE_LINE), F.col("line_no"))).alias("below"),
        F.bool_or(F.lower("line").rlike("present|current")).alias("open"),
    )
    both = heads.join(later, ["id", "pos"], "left")
    return both.select(
        "id", "pos", "degree", "field_of_study", F.coalesce("here", "below", F.lit("")).alias("institution"), "start_date",
        F.when(F.coalesce("open", F.lit(False)), "Present").otherwise(F.col("year")).alias("end_date"), F.coalesce("gpa", F.lit("")).alias("gpa"),
    ).where(F.col("institution") != "")


def skill_list(section: DataFrame) -> DataFrame:
    """(id, pos, skill): listed skills without their group's label, each once ignoring case."""
    rows = section.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    body = F.regexp_replace(strip(F.col("raw")), r"^[A-Za-z0-9_ \t&/]+:[ \t]*", "")
    parts = listed_parts(body)
    each = rows.select("id", "line_no", F.posexplode(F.when(F.size(parts) >= 2, parts).otherwise(F.array(strip(F.regexp_replace(body, BULLET, ""))))).alias("k", "skill"))
    each = each.where(size_of(F.col("skill")).between(2, 50))
    w = Window.partitionBy("id", ascii_lower(F.col("skill"))).orderBy("line_no", "k")
    first = each.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.select("id", F.row_number().over(Window.partitionBy("id").orderBy("line_no", "k")).alias("pos"), "skill")


def skill_fallback(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): the text after a word for skills up to a blank line or the end, of (id, text) without a skills section."""
    found = F.regexp_extract(F.col(text_col), r"(?is)(?:skills?|technologies|proficiencies)[: \t\n\r]+(.+?)(?:\n\n|$)", 1)
    return docs.select(F.col(id_col).alias("id"), found.alias("text")).where(F.col("text") != "")


def plain_list(section: DataFrame) -> DataFrame:
    """(id, pos, item) of (id, text) of sections of languages or awards: the listed parts, else the lines without bullets."""
    by_line = F.filter(F.transform(F.split("text", "\n"), lambda x: strip(F.regexp_replace(strip(x), BULLET, ""))), lambda x: x != "")
    parts = listed_parts(F.col("text"))
    return section.select("id", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(by_line)).alias("pos", "item"))


def project_entries(section: DataFrame) -> DataFrame:
    """(id, pos, name, description, technologies, url) of (id, text) of projects sections (X11)."""
    w = Window.partitionBy("id").orderBy("line_no")
    rows = section.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("raw", strip(F.col("raw")))
    rows = rows.withColumn("line", strip(F.regexp_replace("raw", BULLET, "")))
    line = F.col("line")
    is_name = ~F.col("raw").rlike(BULLET) & size_of(line).between(3, 80) & line.rlike("[A-Z]") & ~line.rlike(DATE_LINE)
    rows = rows.withColumn("start", is_name).withColumn("blank", F.col("raw") == "")
    rows = rows.withColumn("grp", F.sum((F.col("start") | F.col("blank")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    link, tools = F.regexp_extract("line", URL, 0), strip(F.regexp_extract("line", TOOLS, 1))
    more = ~F.col("start") & ~F.col("blank")
    has_tools = line.rlike(TOOLS)
    in_order = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line_no", c.alias("v"))))), lambda x: x["v"])
    named = rows.groupBy("id", "grp").agg(
        F.max(F.when(F.col("start"), F.col("line"))).alias("title"),
        F.max_by(F.when(more & (link != ""), link), F.when(more & (link != ""), F.col("line_no"))).alias("url"),
        F.array_join(in_order(line, more & ~has_tools), " ").alias("text"),
        F.flatten(in_order(listed_parts(tools), more & has_tools)).alias("technologies"),
    )
    own = F.regexp_extract("title", URL, 0)
    name = F.when(own != "", strip(F.substring("title", F.lit(1), F.instr("title", own) - 1))).otherwise(F.col("title"))
    kept = named.where(F.col("title").isNotNull()).withColumn("name", name).where(F.col("name") != "")
    return kept.select(
        "id", F.row_number().over(Window.partitionBy("id").orderBy("grp")).alias("pos"), "name", F.when(F.col("text") != "", F.concat("text", F.lit(" "))).otherwise("").alias("description"),
        "technologies", F.coalesce("url", own).alias("url"),
    )


def certificate_entries(section: DataFrame) -> DataFrame:
    """(id, pos, name, issuer, issue_date) of (id, text) of certifications sections."""
    rows = section.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", strip(F.regexp_replace(strip(F.col("raw")), BULLET, "")))
    year = rf"(?<!{_WORD})20[0-9]{{2}}(?!{_WORD})"
    parts = F.filter(F.transform(F.split("line", "[,\\-–—][ \t]*"), lambda x: strip(F.regexp_replace(x, year, ""))), lambda x: x != "")
    return rows.where(size_of(F.col("line")) >= 3).select(
        "id", "pos", F.coalesce(F.try_element_at(parts, F.lit(1)), F.col("line")).alias("name"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("issuer"), F.regexp_extract("line", year, 0).alias("issue_date")
    )


def parsed(docs: DataFrame, id_col: str, text_col: str) -> dict[str, DataFrame]:
    """All entries of résumé texts by name: contact, summary, experience, education, skills, projects, certificates, lists.

    The skills of a text without a skills section come from the words after a
    word for skills (X14). Null texts have no entries.
    """
    rows = lines(docs, id_col, text_col)
    cut = durable(sections(rows))
    of = lambda name: cut.where(F.col("section") == name).select("id", "text")
    before = preamble(rows)
    name, reach = full_name(before), contacts(docs, before, id_col, text_col)
    skills = skill_list(of("SKILLS"))
    loose = skill_fallback(docs.join(skills.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti"), id_col, text_col)
    lists = plain_list(of("LANGUAGES")).withColumn("section", F.lit("LANGUAGES")).unionByName(plain_list(of("AWARDS")).withColumn("section", F.lit("AWARDS")))
    return {
        "contact": reach.join(name, "id", "left"), "summary": of("SUMMARY").select("id", strip(F.col("text")).alias("summary")), "experience": experience_entries(of("EXPERIENCE")),
        "education": education_entries(of("EDUCATION")), "skills": skills.unionByName(skill_list(loose)), "projects": project_entries(of("PROJECTS")),
        "certificates": certificate_entries(of("CERTIFICATIONS")), "lists": lists.select("id", "section", "pos", "item"),
    }


def tenure_months(start: Column, end: Column, as_of: int = 2026 * 12 + 7) -> Column:
    """Whole months from start to end, never below 0; an open or unreadable end is as_of, an unreadable start gives 0."""
    s, e = year_month(start, as_of), F.coalesce(year_month(end, as_of), F.lit(as_of))
    return F.coalesce(F.greatest(F.lit(0), e - s), F.lit(0))
