"""Variant spellings of organisation names.

A name is parted into proper words, line of business (kind of school), legal
form and office. Distinct proper names are joined where their token q-grams
share enough rare ones (prefix filter) or where the anchored q-grams of two
words agree (abbreviated, run-together and reordered names), the pairs are
verified by a soft token similarity in which rare tokens weigh more, and
connected proper names form one organisation per line of business.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.bktree import levenshtein
from quern.llm.components import components
from quern.session import durable

# Legal forms, without dots and spaces.
LEGAL = ("inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "gmbh", "sa", "bv", "kg", "cokg", "co", "company", "ag", "se", "plc", "llp", "lp", "sarl", "srl", "spa", "nv", "ab", "as", "oy", "pty", "pte", "kgaa", "ug", "ev")
# Lines of business with their short forms.
LINES = {
    "logistics": ("logistics", "log", "logist", "logistic", "lgstcs"),
    "manufacturing": ("manufacturing", "mfg", "manuf", "mfr"),
    "systems": ("systems", "sys", "syst", "systs", "system"),
    "laboratories": ("laboratories", "labs", "lab", "laboratory"),
    "analytics": ("analytics", "analyt", "anlytcs", "analytic"),
    "consulting": ("consulting", "cons", "consult", "cnslt", "consltg"),
    "insurance": ("insurance", "ins", "insur", "insce"),
    "engineering": ("engineering", "engrg", "eng", "engr", "engin"),
    "international": ("international", "intl", "int", "internat", "intnl"),
    "technologies": ("technologies", "tech", "techn", "techs", "technol", "technology"),
    "holdings": ("holdings", "hldgs", "hldg", "hold", "holding"),
    "foods": ("foods", "fds", "food"),
    "health": ("health", "hlth", "hth"),
    "energy": ("energy", "enrg", "ener", "engy"),
    "pharma": ("pharma", "pharmaceuticals", "pharmaceutical"),
    "media": ("media",),
    "services": ("services", "svcs", "serv", "service"),
    "software": ("software", "sftw", "softw"),
    "solutions": ("solutions", "solns", "solution"),
    "bank": ("bank", "banking"),
    "finance": ("finance", "financial", "fin"),
    "construction": ("construction", "constr"),
    "retail": ("retail",),
    "motors": ("motors", "automotive"),
}
# Kinds of school with their short forms.
SCHOOLS = {
    "university": ("university", "univ", "u", "uni", "universitat", "universite", "universidad"),
    "college": ("college", "col", "coll"),
    "institute": ("institute", "inst"),
    "technology": ("technology", "tech", "technol", "technological"),
    "school": ("school", "sch"),
    "business": ("business", "bus"),
    "academy": ("academy", "acad"),
    "arts": ("arts", "art"),
    "polytechnic": ("polytechnic", "poly", "polytech"),
    "state": ("state", "st"),
}
# Words that join or place the parts of a name.
JOINING = ("and", "of", "the", "und", "et", "y", "e", "for", "de")
PLACING = ("office", "campus", "branch", "site", "location", "headquarters", "hq")

Q = 4
#: Least Jaccard similarity of the 4-gram sets that the prefix filter guarantees to find.
GRAM_SIMILARITY = 0.5
#: Least soft weighted token similarity of a link.
LINK_SIMILARITY = 0.8


def _plain(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", text).replace("ß", "ss")


def _near(word: str, options: tuple[str, ...]) -> bool:
    """Equal to an option, or one slip from an option of at least six letters."""
    if word in options:
        return True
    return len(word) >= 5 and any(len(o) >= 6 and abs(len(o) - len(word)) <= 1 and (levenshtein(word, o) <= 1 or _swap(word, o)) for o in options)


def _swap(a: str, b: str) -> bool:
    if len(a) != len(b):
        return False
    d = [i for i in range(len(a)) if a[i] != b[i]]
    return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


_LEGAL_RX = re.compile(
    r"(?i)(?<![^\W_])(?:g\.? ?m\.? ?b\.? ?h\.?(?: ?& ?co\.? ?kg)?|l\.? ?l\.? ?c\.?|s\.? ?a\.?(?: ?r\.? ?l\.?)?|b\.? ?v\.?|n\.? ?v\.?)(?![^\W_])\.?"
)


#: Kinds of words that were looked up, by list of kinds.
_KIND_OF: dict[tuple[int, str], str | None] = {}


def parse_name(name: str, kinds: dict[str, tuple[str, ...]]) -> tuple[list[str], str, bool]:
    """(proper words, kind or '', whether the name ends in a place of its organisation).

    A name without a proper word is its own words.
    """
    text = " ".join(_plain(name).split())
    text = re.sub(r"\s*\[[^\]]*\]\s*$", "", text)
    found: set[str] = set()

    def kind_of(word: str) -> str | None:
        key = (id(kinds), word)
        if key not in _KIND_OF:
            if len(_KIND_OF) > 200_000:
                _KIND_OF.clear()
            w = word.lower().strip(".").replace("'", "")
            exact = next((k for k, forms in kinds.items() if w in forms), None)
            _KIND_OF[key] = exact or next((k for k, forms in kinds.items() if _near(w, forms)), None)
        return _KIND_OF[key]

    def stated(part: str) -> bool:
        """True if part consists of kind words, legal forms and joining words."""
        left = [w for w in re.split(r"[\s,&/+.-]+", _LEGAL_RX.sub(" ", part)) if w]
        return all(kind_of(w) or w.lower() in LEGAL or w.lower() in JOINING for w in left)

    while m := re.search(r"\s*\(([^()]*)\)", text):
        inner = m[1]
        text = text[: m.start()] + (f" {inner} " if stated(inner) else " ") + text[m.end() :]
    head, dash, tail = text.rpartition(" - ")
    if dash and head:
        text = f"{head} {tail}" if stated(tail) else head
    head, comma, tail = text.rpartition(",")
    if comma and head and not stated(tail):
        words = [w for w in re.split(r"[\s,&/+-]+", head) if w]
        kinded = any(kind_of(w) for w in words) or _LEGAL_RX.search(head) or any(w.lower().strip(".") in LEGAL for w in words)
        parts = [w for x in words for w in re.findall(r"[A-Z][^\WA-Z_]{2,}|[^\W_]+", x) if w.lower() not in JOINING]
        if (kinded or len(parts) >= 2) and not any(kind_of(w) or w.lower().strip(".") in LEGAL for w in re.split(r"[\s&/+-]+", tail) if w):
            text = head
    text = _LEGAL_RX.sub(lambda m: " " if m.start() > 0 else m[0], text)
    words = [w for w in re.split(r"[\s,&/+]+|(?<=[^\W_.])-(?=[^\W_])|(?<=\.)-(?=[^\W_])", text) if w.strip(".-'")]
    placed = bool(words) and words[-1].lower().strip(".") in PLACING
    if placed:
        words = words[:-1]
    proper: list[str] = []
    last_kind = -1
    flags = []
    for i, w in enumerate(words):
        low = w.lower().strip(".")
        if low in JOINING or (low in LEGAL and i > 0):
            flags.append("legal" if low in LEGAL else "join")
            if low in LEGAL:
                last_kind = i
        elif len(words) > 1 and (k := kind_of(w)) and (i > 0 or len(low) > 2):
            found.add(k)
            flags.append("kind")
            last_kind = i
        else:
            flags.append("proper")
    ended = "proper" in flags[: max(last_kind, 0)]
    if placed and ended:
        words, flags = words[: last_kind + 1], flags[: last_kind + 1]
    for w, flag in zip(words, flags, strict=True):
        if flag == "proper":
            parts = re.findall(r"[A-Z][^\WA-Z_]+\.?|[^\W_]+\.?", w) if re.fullmatch(r"(?:[A-Z][^\WA-Z_]{2,}){2,}\.?", w) else [w]
            proper += [p.lower().strip(".-'") for p in parts]
    own = [p for p in proper if p] or [w for w in re.findall(r"[^\W_]+", _plain(name).lower()) if w]
    return own, " ".join(sorted(found)), placed and not ended and len(own) > 2


def _token_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and len(short) < len(long) and long.startswith(short):
        return 0.95
    if len(short) >= 5:
        d = levenshtein(a, b)
        if d == 1 or _swap(a, b):
            return 0.9
        if len(short) + 1 < len(long) and len(short) >= 4 and levenshtein(short, long[: len(short)]) <= 1 and len(long) - len(short) >= 2:
            return 0.85
    elif len(short) == 4 and len(long) >= 6 and levenshtein(short, long[:4]) <= 1:
        return 0.5
    return 0.0


def _joined_similarity(one: str, two: list[str]) -> float:
    """Similarity of a run-together word to two words: whole words or a prefix of at least three letters of each."""
    best = 0.0
    for x, y in ((two[0], two[1]), (two[1], two[0])):
        if one == x + y:
            return 1.0
        if len(one) >= 10 and abs(len(one) - len(x) - len(y)) <= 1 and (levenshtein(one, x + y) <= 1 or _swap(one, x + y)):
            best = max(best, 0.9)
        for k in range(3, len(one) - 2):
            if x.startswith(one[:k]) and y.startswith(one[k:]):
                best = max(best, 0.9)
    return best


def soft_similarity(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> float:
    """Weighted share of tokens that have a like token on the other side, the smaller of both directions.

    Each token of b answers one token of a; the weights are those of rarity.
    """
    if not a or not b:
        return 0.0
    if len(a) == 1 and len(b) == 1:
        if a[0] != b[0] and min(len(a[0]), len(b[0])) < 8:
            d = levenshtein(a[0], b[0])
            return 0.9 if d <= 1 and min(len(a[0]), len(b[0])) >= 7 else 0.0
        return 1.0 if a[0] == b[0] else 0.9 if levenshtein(a[0], b[0]) <= 1 or _swap(a[0], b[0]) else 0.0
    if len(a) == 1 and len(b) == 2:
        return _joined_similarity(a[0], b)
    if len(b) == 1 and len(a) == 2:
        return _joined_similarity(b[0], a)
    left, used, hit_a, hit_b = [], set(), 0.0, 0.0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if s := _token_similarity(x, y):
                left.append((s, i, j))
    done = set()
    for s, i, j in sorted(left, reverse=True):
        if i not in done and j not in used:
            done.add(i)
            used.add(j)
            hit_a += s * wa[i]
            hit_b += s * wb[j]
    return min(hit_a / sum(wa), hit_b / sum(wb))


def _anchors(tokens: list[str]) -> list[str]:
    """Anchored q-gram pairs: the first letters of any two words, or of both parts of a run-together word."""
    out = set()
    for i in range(len(tokens)):
        for j in range(i + 1, len(tokens)):
            out.add("|".join(sorted((tokens[i][:Q], tokens[j][:Q]))))
    if len(tokens) == 1 and len(tokens[0]) >= 2 * Q:
        t = tokens[0]
        for k in range(Q, len(t) - Q + 1):
            out.add("|".join(sorted((t[:Q], t[k : k + Q]))))
    return sorted(f"^{x}" for x in out)


def _grams(tokens: list[str]) -> list[str]:
    return sorted({t[i : i + Q] for t in tokens for i in range(max(1, len(t) - Q + 1))})


def parsed_names(names: DataFrame) -> DataFrame:
    """(field, name, proper, kind) of (field, name).

    Of a name that ends in a place without saying where its proper words end
    (`Alpha Beta New York office`) the longest beginning that is a whole name
    elsewhere counts; if none is, all but the last word, which belongs to the
    place.
    """

    @F.pandas_udf("proper array<string>, kind string, placed boolean")
    def parse(field: pd.Series, name: pd.Series) -> pd.DataFrame:
        got = [parse_name(n, SCHOOLS if f == "institution" else LINES) for f, n in zip(field, name, strict=True)]
        return pd.DataFrame({"proper": [g[0] for g in got], "kind": [g[1] for g in got], "placed": [g[2] for g in got]})

    parsed = durable(names.select("field", "name", parse("field", "name").alias("p")).select("field", "name", "p.*").where(F.size("proper") > 0))
    plain, placed = parsed.where(~F.col("placed")), parsed.where("placed")
    whole = plain.select("field", F.concat_ws(" ", "proper").alias("words")).distinct()
    heads = placed.select("field", "name", F.explode(F.sequence(F.lit(2), F.size("proper"))).alias("n"), "proper")
    heads = heads.select("field", "name", "n", F.concat_ws(" ", F.slice("proper", 1, F.col("n"))).alias("words"))
    known = heads.join(whole, ["field", "words"]).groupBy("field", "name").agg(F.max("n").alias("n"))
    cut = placed.join(known, ["field", "name"], "left").withColumn("proper", F.slice("proper", F.lit(1), F.coalesce("n", F.size("proper") - 1)))
    return plain.select("field", "name", "proper", "kind").unionByName(cut.select("field", "name", "proper", "kind"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(key_a, key_b) of proper names that share a rare q-gram of their prefixes, or an anchored pair.

    keys: (field, key, proper). For a Jaccard similarity t of two gram sets the
    rarest n - ceil(t n) + 1 grams of each must share one, so no such pair is
    lost; sets whose sizes differ by more than 1/t are dropped in the join.
    """

    @F.pandas_udf("grams array<string>, anchors array<string>")
    def signatures(proper: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"grams": [_grams(list(p)) for p in proper], "anchors": [_anchors(list(p)) for p in proper]})

    signed = keys.select("field", "key", signatures("proper").alias("s")).select("field", "key", "s.*")
    grams = signed.select("field", "key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = grams.groupBy("field", "gram").agg(F.count("*").alias("df"))
    ranked = grams.join(counts, ["field", "gram"]).withColumn("at", F.row_number().over(Window.partitionBy("field", "key").orderBy("df", "gram")))
    prefix = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.lit(GRAM_SIMILARITY) * F.col("n")) + 1).select("field", "gram", "key", "n")
    other = prefix.select("field", "gram", F.col("key").alias("key_b"), F.col("n").alias("n_b"))
    by_gram = (
        prefix.join(other, ["field", "gram"])
        .where((F.col("key") < F.col("key_b")) & (F.col("n_b") >= GRAM_SIMILARITY * F.col("n")) & (F.col("n") >= GRAM_SIMILARITY * F.col("n_b")))
        .select("field", F.col("key").alias("key_a"), "key_b")
    )
    anchors = signed.select("field", "key", F.explode("anchors").alias("anchor"))
    by_anchor = (
        anchors.join(anchors.select("field", "anchor", F.col("key").alias("key_b")), ["field", "anchor"])
        .where(F.col("key") < F.col("key_b"))
        .select("field", F.col("key").alias("key_a"), "key_b")
    )
    return by_gram.unionByName(by_anchor).distinct()


def linked_keys(keys: DataFrame) -> DataFrame:
    """(key_a, key_b) of proper names that mean the same, verified."""
    tokens = keys.select("field", F.explode("proper").alias("token")).groupBy("field", "token").agg(F.count("*").alias("df"))
    total = keys.groupBy("field").agg(F.count("*").alias("total"))
    each = keys.select("field", "key", F.posexplode("proper").alias("i", "token")).join(tokens, ["field", "token"]).join(F.broadcast(total), "field")
    weighed = each.groupBy("field", "key").agg(
        F.array_sort(F.collect_list(F.struct("i", "token", F.log(1 + F.col("total") / F.col("df")).alias("w")))).alias("t")
    ).select("field", "key", F.col("t.token").alias("tokens"), F.col("t.w").alias("weights"))
    side = lambda s: weighed.select("field", F.col("key").alias(f"key_{s}"), F.col("tokens").alias(f"t_{s}"), F.col("weights").alias(f"w_{s}"))

    @F.pandas_udf("double")
    def similarity(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([soft_similarity(list(a), list(x), list(b), list(y)) for a, x, b, y in zip(ta, wa, tb, wb, strict=True)], dtype=float)

    pairs = candidate_pairs(keys).join(side("a"), ["field", "key_a"]).join(side("b"), ["field", "key_b"])
    return pairs.where(similarity("t_a", "w_a", "t_b", "w_b") >= LINK_SIMILARITY).select("key_a", "key_b")


def link_names(names: DataFrame) -> DataFrame:
    """(field, name_a, name_b), name_a < name_b by code point, of names that mean the same organisation.

    names: (field, name), repeated rows allowed; null and blank names and such
    without a proper word have no links. Names of one organisation are those
    of connected proper names of which not both state different lines.
    """
    distinct = names.select("field", "name").where(~F.col("name").rlike(r"^[\s\p{Z}]*$")).distinct()
    parsed = durable(parsed_names(distinct).withColumn("key", F.concat_ws(":", "field", F.concat_ws(" ", "proper"))))
    keys = parsed.groupBy("field", "key").agg(F.first("proper").alias("proper"))
    comp = components(linked_keys(keys), "key_a", "key_b")
    groups = parsed.join(comp, F.col("key") == F.col("node"), "left").select("field", "name", "kind", F.coalesce("component", "key").alias("org"))
    a = groups.select("field", "org", F.col("name").alias("name_a"), F.col("kind").alias("kind_a"))
    b = groups.select("field", "org", F.col("name").alias("name_b"), F.col("kind").alias("kind_b"))
    same = (F.col("kind_a") == F.col("kind_b")) | (F.col("kind_a") == "") | (F.col("kind_b") == "")
    return a.join(b, ["field", "org"]).where((F.col("name_a") < F.col("name_b")) & same).select("field", "name_a", "name_b")


def organisation_names(experience: DataFrame, education: DataFrame) -> DataFrame:
    """(field, name) as stored: companies of experience and institutions of education."""
    jobs = experience.select(F.lit("company").alias("field"), F.col("company").alias("name"))
    return jobs.unionByName(education.select(F.lit("institution").alias("field"), F.col("institution").alias("name")))
