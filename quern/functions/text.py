"""Column functions over text; ASCII rules, nulls stay null unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import lexicon as L


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def taxonomy_key(c: Column) -> Column:
    """Letters, + # . and spaces; _ and - become spaces, all else goes, digits too (K1)."""
    return squeeze(F.regexp_replace(F.regexp_replace(ascii_lower(c), r"[_\-\t\n\r]", " "), r"[^a-z+#. ]", ""))


def scan_key(c: Column) -> Column:
    """Letters, digits and + # . & -, all else becomes a space (K2)."""
    return squeeze(F.regexp_replace(ascii_lower(c), r"[^a-z0-9+#.&\-]+", " "))


def scan_words(c: Column) -> Column:
    """The words of `scan_key`, in order."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(r"[a-z0-9+#.&\-]+"), F.lit(0))


def fuzzy_key(c: Column) -> Column:
    """Letters, digits and + #, all else becomes a space (K3)."""
    return squeeze(F.regexp_replace(ascii_lower(c), r"[^a-z0-9+#]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words of two or more letters, digits, + and #, without stop words, in order; null gives none."""
    parts = F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9+#]{2,}"), F.lit(0))  # far faster than a split by a pattern
    return F.filter(parts, lambda x: ~x.isin(*L.STOP_WORDS))


def bigrams(t: Column) -> Column:
    """Distinct pairs of neighbouring tokens; none for fewer than two."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, i + 1)))
    return F.when(F.size(t) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def cap(c: Column, limit: float) -> Column:
    return F.least(F.lit(1.0), c / F.lit(float(limit)))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def half_up(c: Column, digits: int) -> Column:
    """Round half away from zero for values of zero or more."""
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def contains_any(c: Column, words: list[str]) -> Column:
    """True if c holds any of the substrings; null holds none."""
    return F.coalesce(reduce(lambda x, y: x | y, [c.contains(w) for w in words]), F.lit(False))


def ladder(c: Column, steps: list[tuple[list[str], float]], default: float) -> Column:
    """Value of the first step of which c, in lower case, holds a substring."""
    low = ascii_lower(F.coalesce(c, F.lit("")))
    out = None
    for words, value in steps:
        test = contains_any(low, words)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def nfkc(c: Column) -> Column:
    """Compatibility form of a text, for which there is no built-in function; in Arrow batches. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)

    return run(c)


def clean_text(c: Column) -> Column:
    """Bullets to -, runs of blanks to one space, of line breaks to two, no outer white space (S10 without NFKC)."""
    c = F.regexp_replace(c, "[•●▪◦·]", "-")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def query_window(c: Column, size: int = 15000, lead: int = 50) -> Column:
    """The wanted part of a long text: `size` characters from shortly before the first keyword, cut at a space."""
    low = F.lower(c)
    first = None
    for w in L.QUERY_KEYWORDS:
        at = F.nullif(F.instr(low, w), F.lit(0))
        first = at if first is None else F.least(first, at)  # least skips nulls
    part = F.substring(c, F.greatest(first - lead, F.lit(1)), F.lit(size))
    return F.when(F.length(c) <= size, c).when(first.isNotNull(), F.trim(F.regexp_replace(part, r" [^ ]*$", ""))).otherwise(F.substring(c, 1, size))


def _visible(html: Column) -> Column:
    """Readable text of HTML: scripts, styles, comments and tags go, blanks are squeezed."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


# Attributes of the elements that hold the wanted text of a page, in order.
CONTAINERS = (
    ("id", "job-details"), ("class", "jobs-description__content"), ("class", "jobs-search__job-details--container"), ("class", "job-view-layout"), ("class", "job-description"),
    ("id", "jobDescriptionText"), ("class", "jobDescriptionContent"), ("data-testid", "job-description"),
)


def page_text(html: Column, least: int = 50) -> Column:
    """Readable text of an HTML page (S12): of the first container that holds more than `least` characters, else of the body.

    A container is a section or div of a known name, read up to the next
    element of that tag or its end; null stays null, a page without text gives ''.
    """
    inside = []
    for attribute, name in CONTAINERS:
        word = rf"(?:[^\"'>]*\s)?{name}(?:\s[^\"'>]*)?" if attribute == "class" else name
        found = F.regexp_extract(html, rf"(?is)<(div|section|article|main)\b[^>]*\b{attribute}=[\"']{word}[\"'][^>]*>(.*?)</\1>", 2)
        text = _visible(found)
        inside.append(F.when(F.length(text) > least, text))
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.coalesce(*inside, F.nullif(_visible(body), F.lit("")), _visible(html))


def readability(text: Column, jobs: Column) -> Column:
    """Reading ease in 0..1 from words, vowels and sentence marks; jobs counts as sentences begun."""
    words = word_count(text)
    vowels = F.regexp_count(F.lower(text), F.lit("[aeiouy]"))
    sentences = F.greatest(F.lit(1), jobs) + F.regexp_count(text, F.lit("[.!?]"))
    ease = 206.835 - 1.015 * (words / sentences) - 84.6 * (vowels / F.greatest(F.lit(1), words))
    return unit(ease / 100.0)


def length_band(words: Column) -> Column:
    return F.when(words < 100, 0.2).when(words < 300, 0.5).when(words <= 2000, 1.0).when(words <= 2500, 0.8).otherwise(0.6)


def year_month(c: Column, as_of: int = 2026 * 12 + 7) -> Column:
    """Months since year 0 of a plain date: month name and year, else a bare year as June; words for the present give as_of."""
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    named = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ \t]+((?:19|20)[0-9]{2})"
    month = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(F.regexp_extract(c, named, 1))).cast("int")
    year = F.regexp_extract(c, named, 2)
    bare = F.regexp_extract(c, r"(?:^|[^A-Za-z0-9_])((?:19|20)[0-9]{2})(?:$|[^A-Za-z0-9_])", 1)
    return (
        F.when(F.lower(F.trim(c)).isin("present", "current", "now", "ongoing"), F.lit(as_of))
        .when(year != "", F.try_to_number(year, F.lit("9999")).cast("int") * 12 + month - 1)
        .when(bare != "", F.try_to_number(bare, F.lit("9999")).cast("int") * 12 + 5)
    )
