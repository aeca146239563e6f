"""Dictionary scan, fuzzy lookup and gap analysis over a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import fuzzy_key, scan_key, scan_words, similarity
from quern.sources.tables import balanced

LONGEST = 4
FUZZY = 0.82


def patterns(taxonomy: DataFrame) -> DataFrame:
    """(ord, alias_ord, pattern, canonical, category) of names and aliases; null and blank ones are left out.

    taxonomy: (ord, canonical, category, aliases); ord is the order of entry.
    """
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = taxonomy.select("ord", "canonical", "category", F.posexplode(names).alias("alias_ord", "name"))
    return rows.select("ord", "alias_ord", scan_key("name").alias("pattern"), "canonical", "category").where(F.col("pattern") != "")


def first_writer(p: DataFrame) -> DataFrame:
    """(pattern, canonical, category): the entry that named a pattern first (K5)."""
    return p.groupBy("pattern").agg(F.min_by(F.struct("canonical", "category"), F.struct("ord", "alias_ord")).alias("e")).select("pattern", "e.*")


def last_writer(p: DataFrame) -> DataFrame:
    """(pattern, canonical, category): the entry that named a pattern last (K4)."""
    return p.groupBy("pattern").agg(F.max_by(F.struct("canonical", "category"), F.struct("ord", "alias_ord")).alias("e")).select("pattern", "e.*")


def scan(docs: DataFrame, id_col: str, text_col: str, first: DataFrame) -> DataFrame:
    """(id, start, len, canonical, category): every run of one to four words that is a pattern (K7).

    Word n-grams meet the patterns in an equi-join, so a scan costs four probes
    a word at any number of patterns. Null texts have no hits.
    """
    words = docs.select(F.col(id_col).alias("id"), scan_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("w")),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("w") - i + 1)),
                lambda n: F.struct(i.alias("start"), n.alias("len"), F.array_join(F.slice("w", i, n), " ").alias("pattern")),
            ),
        )
    )
    return words.select("id", F.inline(grams)).join(first, "pattern").select("id", "start", "len", "canonical", "category")


def longest_matches(hits: DataFrame) -> DataFrame:
    """(id, start, len, canonical, category): hits that don't overlap, leftmost first, then the longest (K8)."""
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("len")).alias("neg"), "canonical", "category")))
    kept = F.aggregate(
        "h",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,neg:int,canonical:string,category:string>>").alias("kept")),
        lambda acc, x: F.when(
            x["start"] > acc["end"],
            F.struct((x["start"] - x["neg"] - 1).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    rows = hits.groupBy("id").agg(ordered.alias("h")).select("id", F.explode(kept).alias("m"))
    return rows.select("id", "m.start", (-F.col("m.neg")).alias("len"), "m.canonical", "m.category")


def fuzzy_best(values: DataFrame, value_col: str, p: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(value, canonical, similarity): the most similar pattern of each distinct value at or above the threshold.

    A similarity of t to a name of n letters allows at most k = (1 - t) n / t
    edits. Of k + 1 parts of the name one must stand unchanged in the value,
    near its own place: values and names meet by such parts in an equi-join,
    whatever their number.
    """
    allowed = lambda n: F.floor((1 - threshold) * F.floor(n / threshold + 1e-9) + 1e-9).cast("int")
    size = lambda n, k, i: F.floor(n / (k + 1)).cast("int") + (i >= k + 1 - n % (k + 1)).cast("int")
    start = lambda n, k, i: i * F.floor(n / (k + 1)).cast("int") + F.greatest(F.lit(0), i - (k + 1 - n % (k + 1)))
    v = values.select(F.col(value_col).alias("value"), fuzzy_key(F.col(value_col)).alias("key")).where(F.col("key") != "").distinct().withColumn("m", F.length("key"))
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("m") * threshold - 1e-9).cast("int")), F.floor(F.col("m") / threshold + 1e-9).cast("int"))
    v = balanced(v, "value").withColumn("n", F.explode(lengths)).withColumn("k", allowed(F.col("n")))
    m, n, k = F.col("m"), F.col("n"), F.col("k")

    def places(i: Column) -> Column:
        at, left = start(n, k, i), k - i
        low = F.greatest(F.lit(0), at - i, at + m - n - left)
        high = F.least(m - size(n, k, i), at + i, at + m - n + left)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda j: F.struct(i.alias("i"), F.substring(F.col("key"), j + 1, size(n, k, i)).alias("part"))))

    probes = F.array_distinct(F.flatten(F.filter(F.transform(F.sequence(F.lit(0), k), places), lambda x: x.isNotNull())))
    v = v.select("value", "key", "n", F.inline(probes))
    names = p.select(fuzzy_key("pattern").alias("name"), "canonical", "ord", "alias_ord").where(F.col("name") != "").withColumn("n", F.length("name")).withColumn("k", allowed(n))
    parts = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), F.substring(F.col("name"), start(n, k, i) + 1, size(n, k, i)).alias("part")))
    near = v.join(names.select("name", "canonical", "ord", "alias_ord", "n", F.inline(parts)), ["n", "i", "part"])
    scored = near.withColumn("similarity", similarity(F.col("key"), F.col("name"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("value").agg(F.max_by(F.struct("canonical", "similarity"), F.struct("similarity", -F.col("ord"), -F.col("alias_ord"))).alias("b"))
    return best.select("value", "b.canonical", "b.similarity")


def extract(text_hits: DataFrame, raw: DataFrame, first: DataFrame, p: DataFrame) -> DataFrame:
    """(id, canonical, category, confidence, method): best of scan .95, listed exactly 1, listed nearly similarity * .85.

    raw: (id, skill) as listed.
    """
    scanned = text_hits.select("id", "canonical", "category", F.lit(0.95).alias("confidence"), F.lit("trie").alias("method"))
    listed = raw.select("id", "skill", scan_key("skill").alias("pattern"))
    exact = listed.join(first, "pattern").select("id", "canonical", "category", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    rest = listed.join(first, "pattern", "left_anti")
    category = p.groupBy("canonical").agg(F.min("category").alias("category"))
    near = rest.join(fuzzy_best(rest, "skill", p).withColumnRenamed("value", "skill"), "skill").join(category, "canonical")
    near = near.select("id", "canonical", "category", (F.col("similarity") * 0.85).alias("confidence"), F.lit("fuzzy").alias("method"))
    every = scanned.unionByName(exact).unionByName(near)
    best = every.groupBy("id", "canonical").agg(F.max_by(F.struct("category", "confidence", "method"), F.struct("confidence", "method")).alias("b"))
    return best.select("id", "canonical", "b.category", "b.confidence", "b.method")


def names_within(texts: DataFrame, names: DataFrame, q: int = 3) -> DataFrame:
    """(id, name) of the names (name) that a text (id, text) holds as substrings, inside words too.

    A name lies only in texts that hold its first q characters, so texts and
    names meet by these and are then compared. Null and empty names are in no
    text.
    """
    chars = balanced(texts, "id").where(F.length("text") > 0).select("id", F.split("text", "").alias("c"))
    at = lambda i: F.coalesce(F.try_element_at("c", i), F.lit(""))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: F.concat(*[at(i + k) for k in range(n)]))
    held = chars.select("id", F.explode(F.array_distinct(F.concat(*[grams(n) for n in range(1, q + 1)]))).alias("gram"))
    keyed = names.where(F.length("name") > 0).select("name", F.substring("name", 1, q).alias("gram")).distinct()
    return held.join(keyed, "gram").select("id", "name").join(texts.select("id", "text"), "id").where(F.contains("text", F.col("name"))).select("id", "name")


def primary_domain(skills: DataFrame) -> DataFrame:
    """(id, domain, share): the category with the largest sum of confidences, ties to the smaller name."""
    sums = skills.groupBy("id", "category").agg(F.sum("confidence").alias("s"))
    w = Window.partitionBy("id")
    ranked = sums.withColumn("total", F.sum("s").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("s").desc(), "category")))
    return ranked.where(F.col("rn") == 1).select("id", F.col("category").alias("domain"), (F.col("s") / F.col("total")).alias("share"))


def domain_distribution(skills: DataFrame) -> DataFrame:
    """(id, category, share) of the number of skills in each category."""
    n = skills.groupBy("id", "category").agg(F.count("*").alias("n"))
    return n.select("id", "category", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("share"))


def self_matches(p: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(canonical, alike, alikeness): the entry that the name of each entry is most similar to, mostly itself."""
    best = fuzzy_best(p.select(F.col("canonical").alias("skill")), "skill", p, threshold)
    return best.select(F.col("value").alias("canonical"), F.col("canonical").alias("alike"), F.col("similarity").alias("alikeness"))


def statuses(need: Column, have: Column, partial: float = 0.5) -> Column:
    """array of (skill, status, matched_as, confidence) of the skills needed: matched, partial or missing.

    need: array of (canonical, category, alike, alikeness); have: array of
    (rank, canonical, category, ..), the surest first. A skill that isn't held
    is as near as .45 to the first held one of its category, and as near as
    `alikeness` to the one that its name is most similar to; it is partial
    from `partial` on.
    """

    def status(n: Column) -> Column:
        held = F.exists(have, lambda h: h["canonical"] == n["canonical"])
        kin = F.try_element_at(F.filter(have, lambda h: h["category"] == n["category"]), F.lit(1))["canonical"]
        alike = F.exists(have, lambda h: h["canonical"] == n["alike"]) & (n["alikeness"] > 0.45)
        best = F.when(alike, n["alikeness"]).when(kin.isNotNull(), F.lit(0.45)).otherwise(F.lit(0.0))
        state = F.when(held, "matched").when(best >= partial, "partial").otherwise("missing")
        shown = F.when(~held & (best >= partial), F.when(alike, n["alike"]).otherwise(kin))
        return F.struct(n["canonical"].alias("skill"), state.alias("status"), shown.alias("matched_as"), F.when(shown.isNotNull(), best).alias("confidence"))

    return F.transform(need, status)


def gap(pairs: DataFrame, candidate: DataFrame, required: DataFrame, p: DataFrame, partial: float = 0.5) -> DataFrame:
    """(id, query_id, status) of each pair, status as of `statuses`.

    pairs: (id, query_id); candidate: (id, canonical, category, confidence,
    method); required: (query_id, canonical, category); p: patterns. Skills of
    a document and of a query are gathered before they meet; queries without
    skills have no row.
    """
    have = candidate.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "canonical", "category", "confidence", "method"))).alias("have"))
    named = required.join(self_matches(p), "canonical", "left")
    need = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("canonical", "category", "alike", "alikeness"))).alias("need"))
    rows = pairs.distinct().join(need, "query_id").join(have, "id", "left")
    none = F.expr("cast(array() as array<struct<rank:double,canonical:string,category:string,confidence:double,method:string>>)")
    return rows.withColumn("have", F.coalesce("have", none)).select("id", "query_id", statuses(F.col("need"), F.col("have"), partial).alias("status"))


def gap_lists(gaps: DataFrame) -> DataFrame:
    """(id, query_id, matched, partial, missing, match_ratio): sorted lists and the share matched."""
    pick = lambda s: F.filter("status", lambda x: x["status"] == s)
    near = F.transform(pick("partial"), lambda x: F.struct(x["skill"].alias("jd_skill"), x["matched_as"], x["confidence"]))
    rows = gaps.select("id", "query_id", pick("matched")["skill"].alias("matched"), near.alias("partial"), pick("missing")["skill"].alias("missing"), F.size("status").alias("_n"))
    return rows.withColumn("match_ratio", F.when(F.col("_n") == 0, 1.0).otherwise(F.size("matched") / F.col("_n"))).drop("_n")


def skill_columns(have: Column, j: Column, m: Column, p: Column, x: Column, share: Column) -> dict[str, Column]:
    """The twenty skill features; have: skills of the document, j, m, p, x: numbers needed, matched, partial and missing."""
    from quern.functions.text import cap

    c = F.size(have)
    coverage = F.when(j == 0, 1.0).otherwise(m / F.greatest(j, F.lit(1)))
    either = F.when(j == 0, 1.0).otherwise((m + p) / F.greatest(j, F.lit(1)))
    critical = F.greatest(F.lit(1), F.floor(j / 2))
    of = lambda test: F.size(F.filter(have, test))
    mean = lambda total: F.when(c > 0, total / c).otherwise(0.0)
    fuzzy = of(lambda h: h["method"] == "fuzzy")
    return {
        "skill_coverage_ratio": coverage, "critical_skill_coverage": either, "optional_skill_coverage": either, "num_matched_skills": cap(m, 20), "num_missing_skills": 1 - cap(x, 15),
        "num_partial_skills": cap(p, 10), "rare_skill_bonus": F.when(c > j, F.least(F.lit(0.3), (c - j) / 20)).otherwise(0.0),
        "skill_category_diversity": cap(F.size(F.array_distinct(F.transform(have, lambda h: h["category"]))), 10),
        "avg_skill_confidence": mean(F.aggregate(have, F.lit(0.0), lambda s, h: s + h["confidence"])), "high_confidence_skill_ratio": mean(of(lambda h: h["confidence"] >= 0.85)),
        "total_canonical_skills": cap(c, 30), "skills_text_length": cap(c, 25), "unmatched_skill_ratio": F.when(c > 0, 1.0).otherwise(0.0), "primary_domain_confidence": F.coalesce(share, F.lit(0.0)),
        "jd_skill_count": cap(j, 20), "jd_critical_skill_count": F.when(j == 0, 0.0).otherwise(cap(critical, 10)), "skill_exact_match_count": cap(c - fuzzy, 20), "skill_fuzzy_match_count": cap(fuzzy, 10),
        "skill_missing_critical_count": 1 - F.least(x, critical) / critical, "skill_has_all_required": F.when(x == 0, 1.0).otherwise(coverage),
    }


def skill_features(pairs: DataFrame, candidate: DataFrame, required: DataFrame, p: DataFrame) -> DataFrame:
    """The twenty skill features of (id, query_id) pairs; pairs without required skills count as covered."""
    have = candidate.groupBy("id").agg(F.collect_list(F.struct("category", "confidence", "method")).alias("have"))
    rows = pairs.select("id", "query_id").distinct().join(gap_lists(gap(pairs, candidate, required, p)), ["id", "query_id"], "left").join(have, "id", "left")
    rows = rows.join(primary_domain(candidate).select("id", "share"), "id", "left").withColumn("have", F.coalesce("have", F.expr("cast(array() as array<struct<category:string,confidence:double,method:string>>)")))
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    named = skill_columns(F.col("have"), n("matched") + n("partial") + n("missing"), n("matched"), n("partial"), n("missing"), F.col("share"))
    return rows.select("id", "query_id", *[v.alias(k) for k, v in named.items()])


def corroborated(skills: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonical, boosted): confidence plus .05, at most 1, where the text names the skill more than once."""
    low = F.lower(F.coalesce(F.col("_text"), F.lit("")))
    name: Column = F.lower("canonical")
    times = (F.length(low) - F.length(F.replace(low, name, F.lit("")))) / F.length(name)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    rows = skills.join(text, "id")
    return rows.select("id", "canonical", F.when(times > 1, F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence")).alias("boosted"))
