"""Repair of text from scanned pages: furniture, divided words, misread characters.

Corpus statistics (word counts over all pages, templates of page edges, skip-
gram vectors of the frequent words) are learned first; a second pass over the
pages links rare words to frequent ones through plausible glyph edits, decides
between several by the context's vectors, removes furniture and reflows.
Pages meet their neighbours by (doc_id, page_number), never by whole document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bktree import levenshtein
from quern.session import durable

# Glyphs as read and as printed.
GLYPHS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("l", "i"), ("i", "l"), ("!", "l"), ("!", "i"), ("5", "s"), ("$", "s"), ("8", "b"),
    ("6", "b"), ("9", "g"), ("q", "g"), ("2", "z"), ("+", "t"), ("f", "t"), ("7", "t"), ("c", "e"), ("e", "c"), ("o", "e"), ("e", "o"), ("b", "h"), ("h", "b"),
    ("á", "a"), ("à", "a"), ("é", "e"), ("ó", "o"), ("ú", "u"), ("í", "i"), ("ö", "o"), ("ü", "u"), ("@", "a"), ("4", "a"), ("3", "e"), ("€", "e"),
    ("cl", "d"), ("rn", "m"), ("rri", "m"), ("ni", "m"), ("nn", "m"), ("ii", "u"), ("li", "u"), ("ri", "n"), ("rı", "n"), ("li", "h"), ("lc", "k"), ("vv", "w"), ("m", "rn"), ("d", "cl"),
    ("y", "v"), ("v", "y"), ("u", "n"), ("n", "u"), ("s", "5"), ("o", "a"), ("a", "o"), ("u", "v"), ("v", "u"), ("j", "i"), ("t", "f"), ("ﬁ", "fi"), ("fi", "h"), ("ln", "in"), ("tl", "ti"),
)
# Marks that divide a word at a line's end.
DIVIDERS = "-­‐‑¬"

#: A word is known if it makes up this share of all words, so that at most 1 / SHARE words are known at any size.
SHARE, LEAST = 1e-5, 8
#: A label of figures has at least this share of all of them, so that at most 1 / LABEL_SHARE labels are known.
LABEL_SHARE = 1e-4
#: A known word replaces another one that is at least so many times rarer.
RATIO = 5
#: Pages whose confidence is at least this need twice the ratio.
SURE = 0.97
EDGE = 2

_LABEL = (
    r"(?:[-–—]\s*\w{1,4}\s*[-–—]|\[\s*\w{1,4}\s*\]|(?:page|p[.,]|seite|s[.,]|pg[.,]?|página|pagina)\s*\w{1,4}(?:\s*(?:of|von|/|de|sur|di)\s*\w{1,4})?|[0-9loiIs|]{1,4}\s*/\s*[0-9loiIs|]{1,4})"
)
_LABEL_ALONE = re.compile(rf"\s*{_LABEL}\s*", re.I)
_LABEL_END = re.compile(rf"(?:\s*[|·•]\s*|\s{{2,}}){_LABEL}\s*$", re.I)
_LABEL_START = re.compile(rf"^\s*{_LABEL}(?:\s*[|·•]\s*|\s{{2,}})", re.I)
_WORDISH = re.compile(r"\S+")
_TRIM = "\"'“”„‘’().,;:!?[]{}<>*•·–—…"


def _roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def _core(token: str) -> tuple[int, int]:
    """Start and end of a token without outer punctuation."""
    a, b = 0, len(token)
    while a < b and token[a] in _TRIM:
        a += 1
    while b > a and token[b - 1] in _TRIM:
        b -= 1
    return a, b


def _edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Line numbers (from 0) of the outermost filled lines at the top and at the bottom."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return filled[:EDGE], filled[-EDGE:]


def _without_label(line: str) -> str:
    return _LABEL_START.sub("", _LABEL_END.sub("", line)).strip()


def template(line: str, name: list[str], known=None) -> str:
    """An edge line without its page label, with digits and the words of the document's name masked."""
    text = re.sub(r"\d+", "9", _without_label(line))
    out = []
    for w in text.split():
        a, b = _core(w)
        word = w[a:b].lower()
        like = any(word == n or (len(n) > 3 and abs(len(n) - len(word)) <= 2 and (word[:1] == n[0] or word[-1:] == n[-1]) and levenshtein(word, n) <= 2) for n in name)
        out.append(w[:a] + "<n>" + w[b:] if like and word else w.lower())
    return " ".join(out)


_SLIPS = str.maketrans("0123456789|!$@€", "olzeasbtbgllsae")
_FOLD = str.maketrans("oeagqijtfvynuhz", "cccccllllnnnnbs")


def fold(line: str, name: list[str]) -> str:
    """template() with letters that are misread for each other made one, so that slips don't part equal lines."""

    def letters(m: re.Match) -> str:
        digits = sum(ch.isdigit() for ch in m[0])
        return m[0].translate(_SLIPS) if sum(ch.isalpha() for ch in m[0]) >= 3 * digits else m[0]

    text = re.sub(r"\S+", letters, _without_label(line))
    out = template(text, name)
    for read, printed in (("rn", "m"), ("vv", "w"), ("cl", "d")):
        out = out.replace(read, printed)
    return " ".join(w if "<n>" in w else w.translate(_FOLD) for w in out.split())


def _close(t: str, x: str) -> bool:
    """Whether two templates are equal but for slips."""
    return abs(len(t) - len(x)) <= 3 and levenshtein(t, x) <= (3 if len(x) >= 12 else 2 if len(x) >= 8 else 1)


def name_words(first_lines: str | None) -> list[str]:
    """Words of a document's title line: of its first lines the first of two to four words in capitals."""
    for line in (first_lines or "").split("\n"):
        words = line.split()
        if 2 <= len(words) <= 4 and all(w.isalpha() and w.isupper() for w in words):
            return [w.lower() for w in words]
    return []


@dataclass
class Model:
    """What the corpus taught: counts of known words, furniture templates, labels of figures, vectors."""

    counts: dict[str, int]
    templates: set[str]
    figure_labels: set[str]
    vectors: dict[str, np.ndarray] = field(default_factory=dict)
    masked: set[str] = field(default_factory=set)  # templates with one word, that varies over documents, as <w>
    wild: re.Pattern | None = None
    _seen: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.counts), default=0) + 4  # two edits shorten a word by four letters at most
        named = sorted(t for t in self.templates if "<n>" in t)
        if named:
            self.wild = re.compile("|".join(re.escape(t).replace("<n>", r"[^\W\d_]+") for t in named))
        self._places: dict[int, dict[int, list[str]]] = {}  # masked templates by number of words and place of <w>
        for t in sorted(self.masked):
            words = t.split(" ")
            self._places.setdefault(len(words), {}).setdefault(words.index("<w>"), []).append(t)

    def is_template(self, t: str, anonymous: bool = False) -> bool:
        """Whether t is a furniture template but for slips; anonymous: the document's name is unknown, any word may be it."""
        if t in self.templates:
            return True
        if anonymous and self.wild is not None and self.wild.fullmatch(t):
            return True
        hit = self._seen.get(t)
        if hit is None:
            hit = any(_close(t, x) for x in self.templates)
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[t] = hit
        return hit

    def is_masked(self, t: str) -> bool:
        """Whether t is, but for slips, a furniture template of which one word varies over documents."""
        words = t.split(" ")
        hit = self._seen.get((t, "<w>"))
        if hit is None:
            hit = False
            for at, shapes in self._places.get(len(words), {}).items():
                variant = " ".join([*words[:at], "<w>", *words[at + 1 :]])
                hit = hit or variant in self.masked or any(_close(variant, x) for x in shapes)
            self._seen[t, "<w>"] = hit
        return hit

    def candidates(self, word: str, ratio: float) -> list[tuple[str, int]]:
        """(known word, glyph edits) that word may stand for, the fewest edits only; [] if word is right."""
        low = word.lower()
        own = self.counts.get(low, 0)
        for edits in (1, 2) if own == 0 else (1,):
            found = {v for v in _rewritten(low, word, edits) if self.counts.get(v, 0) >= max(LEAST, ratio * max(own, 1)) and v.replace("-", "").isalpha()}
            if found:
                return [(v, edits) for v in sorted(found)]
        return []

    def correct(self, word: str, context: list[str], ratio: float = RATIO) -> str | None:
        """The known word that word is a misread form of, None if there is none."""
        key = (word, ratio)
        options = self._seen.get(key)
        if options is None:
            bare = not any(ch.isalpha() for ch in word) or len(word) > self.longest or (len(word) <= 2 and word.isascii() and word.isalpha())
            options = [] if bare else self.candidates(word, ratio)
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[key] = options
        if not options:
            return None
        if len(options) == 1:
            return options[0][0]
        around = [self.vectors[c] for c in context if c in self.vectors]
        mean = np.sum(around, axis=0) if around else None
        score = lambda v: (float(mean @ self.vectors[v]) if mean is not None and v in self.vectors else -9.0, self.counts[v], v)
        return max((v for v, _ in options), key=score)


def _rewritten(low: str, word: str, edits: int) -> set[str]:
    """low with one or two glyphs put back; also C for a capital G."""
    level = {low}
    for _ in range(edits):
        fresh = set()
        for w in level:
            for read, printed in GLYPHS:
                at = w.find(read)
                while at >= 0:
                    fresh.add(w[:at] + printed + w[at + len(read) :])
                    at = w.find(read, at + 1)
        level = fresh
    if edits == 1 and word[:1] == "G":
        level.add("c" + low[1:])
    return level - {low}


def _furniture(lines: list[str], page: int, name: list[str], model: Model, own: list[str]) -> set[int]:
    """Line numbers (from 0) of running headers, footers and page numbers; own: templates that recur in the document."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    found: set[int] = set()

    def is_furniture(i: int) -> bool:
        text = lines[i].strip()
        if re.fullmatch(r"[0-9loiIS|]{1,4}", text) and re.search(r"\d", text):
            digits = text.translate(str.maketrans("loiIS|", "101151"))
            k = filled.index(i)
            label = lines[filled[k - 1]].strip().lower() if k else ""
            return int(digits) == page and not (label in model.figure_labels and filled[k - 1] == i - 1)
        if text.lower() == _roman(page):
            return True
        if _LABEL_ALONE.fullmatch(text) and re.search(r"\d|\b[ivxlc]+\b", text, re.I):
            return True
        t = template(text, name)
        if model.is_template(t, not name):
            return True
        title = page == 1 and i in filled[: EDGE + 1] and 2 <= len(text.split()) <= 4 and all(w.isalpha() for w in text.split())
        return not title and (any(_close(t, x) for x in own) or model.is_masked(t))

    for order in (filled, filled[::-1]):
        for i in order:
            if i in found:
                continue
            if not is_furniture(i):
                break
            found.add(i)
    if filled and page == 1 and filled[0] in found and not _LABEL_ALONE.fullmatch(lines[filled[0]].strip()):
        if re.fullmatch(r"(?:<n>\s*)+", template(lines[filled[0]], name)):
            found.discard(filled[0])  # the title line of the first page
    return found


@dataclass
class Page:
    lines: list[str]
    defects: list[set[str]]
    text: str


def first_of_body(text: str, page: int, name: list[str], model: Model, own: list[str]) -> str | None:
    """The first line of a page that is no furniture, where a word divided by the page break goes on."""
    lines = text.split("\n")
    skip = _furniture(lines, page, name, model, own)
    return next((x for k, x in enumerate(lines) if k not in skip and x.strip()), None)


def repair(text: str, page: int, name: list[str], follow: str | None, ocr: bool, confidence: float | None, model: Model, own: list[str]) -> Page:
    """Defects of each line and the reflowed paragraphs of a page; follow is the first line of the next page's body."""
    lines = text.split("\n")
    defects: list[set[str]] = [set() for _ in lines]
    furniture = _furniture(lines, page, name, model, own)
    for i in furniture:
        defects[i].add("furniture")
    body = [i for i in range(len(lines)) if i not in furniture and lines[i].strip()]
    ratio = RATIO * (2 if confidence is not None and confidence >= SURE else 1)
    fixed: dict[int, list[str]] = {}
    joins: dict[int, bool] = {}
    carried = ""  # the head of a word divided on the line before
    for k, i in enumerate(body):
        tokens = lines[i].split()
        nxt = body[k + 1] if k + 1 < len(body) else None
        nxt_line = lines[nxt] if nxt is not None and not any(not lines[j].strip() for j in range(i + 1, nxt) if j not in furniture) else lines[nxt] if nxt is not None else follow
        last = tokens[-1]
        divided = False
        head = last.rstrip(DIVIDERS)
        if last[-1] in DIVIDERS and head and head[-1].isalpha() and nxt_line and nxt_line.split():
            first = nxt_line.split()[0]
            divided = _is_divided(head, first, last[len(head) :], model)
        elif last[-1] in DIVIDERS and head and head[-1].isalpha():
            rest = head[_core(head)[0] :].rpartition("-")[2]
            divided = last[-1] != "-" or not _known(rest, model)
        if divided:
            defects[i].add("hyphen")
        joins[i] = divided
        words = [model_word for model_word in (w.lower() for w in tokens)]
        out = []
        for j, tok in enumerate(tokens):
            a, b = _core(tok)
            whole, lead, tail = tok[a:b], "", ""
            if j == 0 and carried:
                lead = carried
            if j == len(tokens) - 1 and divided and nxt_line:
                fa, fb = _core(nxt_line.split()[0])
                whole = tok[a:].rstrip(DIVIDERS)
                b = a + len(whole)
                tail = nxt_line.split()[0][fa:fb]
            fix = None
            if ocr and whole and not whole.isdigit() and not set(whole.lower()) <= set("ivxlc"):
                context = words[max(0, j - 3) : j] + words[j + 1 : j + 4]
                fix = _fix(lead, whole, tail, context, ratio, model)
            if fix is not None and fix != whole:
                defects[i].add("misread")
                out.append(tok[:a] + fix + tok[b:])
            else:
                out.append(tok)
        fixed[i] = out
        carried = ""
        if divided:
            a, _ = _core(last)
            carried = last[a:].rstrip(DIVIDERS)
    # reflow
    paragraphs: list[str] = []
    current = ""
    previous = None
    for i in body:
        line = " ".join(fixed[i])
        gap = previous is not None and any(not lines[j].strip() for j in range(previous + 1, i))
        bullet = line[:1] in "•*–·" or line.startswith("- ")
        if current and (gap or bullet) and not (previous is not None and joins[previous]):
            paragraphs.append(current)
            current = ""
        if not current:
            current = line
        elif previous is not None and joins[previous]:
            current = current.rstrip(DIVIDERS) + line
        elif current.endswith("-"):
            current += line
        else:
            current += " " + line
        previous = i
    if current:
        if previous is not None and joins[previous]:
            current = current.rstrip(DIVIDERS) + "­"
        paragraphs.append(current)
    return Page(lines, defects, "\n\n".join(paragraphs))


def _known(word: str, model: Model) -> int:
    return model.counts.get(word.lower(), 0)


def _is_divided(head: str, first: str, mark: str, model: Model) -> bool:
    """Whether head and first are one word that only the line break divides."""
    ha, _ = _core(head)
    fa, fb = _core(first)
    a, b = head[ha:], first[fa:fb]
    if not b or not b[0].isalnum():
        return mark.strip("-") != ""
    joined, compound = _known(a + b, model), _known(f"{a}-{b}", model)
    if joined or compound:
        return joined >= compound
    fix_joined, fix_compound = model.correct(a + b, []), model.correct(f"{a}-{b}", [])
    if fix_joined:
        return True
    if fix_compound:
        return False
    if mark.strip("-"):
        return True
    left, right = a.rpartition("-")[2], b.partition("-")[0]
    both = all(_known(x, model) or model.correct(x, []) for x in (left, right))
    return not both and not b[0].isupper()


def _fix(lead: str, whole: str, tail: str, context: list[str], ratio: float, model: Model) -> str | None:
    """The corrected form of the part `whole` of the word lead + whole + tail; None if it is right."""
    word = lead + whole + tail
    own = _known(word, model)
    fix = None
    if own == 0 and not lead and not tail and word.count("-") and not word.startswith("-"):
        parts = word.split("-")
        mended = [(_fix("", p, "", context, ratio, model) or p) if p else p for p in parts]
        got = "-".join(mended)
        whole_fix = model.correct(word, context, ratio)
        return whole_fix if whole_fix else got if got != word and all(_known(p, model) for p in mended) else None
    fix = model.correct(word, context, ratio)
    if fix is None:
        return None
    # the slip lies in this part only if the part itself changes
    start, end = len(lead), len(lead) + len(whole)
    low = word.lower()
    p = 0
    while p < min(len(low), len(fix)) and low[p] == fix[p]:
        p += 1
    s = 0
    while s < min(len(low), len(fix)) - p and low[-1 - s] == fix[-1 - s]:
        s += 1
    a, b = p, len(low) - s  # changed stretch of the word
    if b <= start or a >= end:
        if not (a == b and start <= a <= end):
            return None
    mended = fix[min(start, len(fix)) : len(fix) - (len(word) - end)] if tail else fix[start:]
    if word[:1].isupper() and not lead:
        mended = mended.upper() if whole.isupper() and len(whole) > 1 else mended[:1].upper() + mended[1:]
    return mended


def _pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, used_ocr, ocr_confidence), repeated rows and null or blank texts left out."""
    kept = pages.where(F.length(F.trim("text")) > 0)
    return kept.groupBy("doc_id", "page_number", "text").agg(F.max("used_ocr").alias("used_ocr"), F.min("ocr_confidence").alias("ocr_confidence"))


def _with_titles(pages: DataFrame) -> DataFrame:
    """Adds the first three filled lines of the document's first page, where its title line stands, by an equi-join."""
    filled = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    names = pages.where("page_number = 1").groupBy("doc_id").agg(F.min(F.array_join(F.slice(filled, 1, 3), "\n")).alias("first_lines"))
    return pages.join(names, "doc_id", "left")


def _observed(known: DataFrame) -> DataFrame:
    """(doc_id, page_number, words, edges, labels) of pages with their neighbours: what the model is learned from."""

    @F.pandas_udf("words array<string>, edges array<struct<t:string,key:string,edge:boolean,top:boolean>>, labels array<struct<l:string,odd:boolean>>")
    def observe(text: pd.Series, page: pd.Series, first: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p, f in zip(text, page, first, strict=True):
            lines, name = t.split("\n"), name_words(f)
            top, bottom = _edges(lines)
            outer = {*top, *bottom}
            words, edges, labels = [], [], []
            after_divided = started = False
            previous = None
            for i, x in enumerate(lines):
                tokens = x.split()
                if not tokens:
                    previous = None
                    continue
                edges.append({"t": template(x, name), "key": fold(x, name) if i in outer else None, "edge": i in outer, "top": i in top})
                if re.fullmatch(r"\d{1,4}", x.strip()) and previous:
                    labels.append({"l": previous, "odd": int(x) != p})
                use = tokens[1:] if after_divided or not started else tokens
                started = started or i not in outer
                after_divided = tokens[-1][-1] in DIVIDERS
                if after_divided:
                    use = use[:-1]
                if i not in outer:
                    words += [w for w in (u[slice(*_core(u))].lower() for u in use) if w]
                previous = x.strip().lower()
            rows.append({"words": words, "edges": edges, "labels": labels})
        return pd.DataFrame(rows, columns=["words", "edges", "labels"])

    return durable(known.select("doc_id", "page_number", observe("text", "page_number", "first_lines").alias("o")).select("doc_id", "page_number", "o.*"))


def _lettered(t: str):
    return F.length(F.regexp_replace(t, r"<[nw]>|\W|\d", "")) > 0


def _masked(lines: DataFrame) -> DataFrame:
    """Adds v, the template with one of its words masked, and that word w; a row for each word of templates of two or more words."""
    words = F.split("t", " ")
    at = lines.where(F.size(words) >= 2).select("*", F.posexplode(words).alias("k", "w"))
    return at.where(F.col("w").rlike(r"[^\W\d_]") & ~F.col("w").contains("<n>")).withColumn("v", F.array_join(F.transform(words, lambda x, i: F.when(i == F.col("k"), F.lit("<w>")).otherwise(x)), " ")).where(_lettered("v"))


def _masked_templates(lines: DataFrame, least: float) -> set[str]:
    """Edge templates in which one word varies over at least `least` documents; they seldom stand within a page."""
    outer = _masked(lines.where("edge")).groupBy("v").agg(
        F.count("*").alias("edge"), F.count_if(F.col("page_number") > 1).alias("later"), F.approx_count_distinct("doc_id").alias("docs"), F.approx_count_distinct("w").alias("words")
    )
    likely = outer.where((F.col("docs") >= least) & (F.col("words") >= 4) & (F.col("later") >= 0.3 * F.col("edge"))).select("v", "edge")
    inner = _masked(lines.where("not edge").groupBy("t").agg(F.count("*").alias("n"))).join(F.broadcast(likely.select("v")), "v").groupBy("v").agg(F.sum("n").alias("inner"))  # bounded by least
    kept = likely.join(inner, "v", "left").where(F.col("edge") >= 0.9 * (F.col("edge") + F.coalesce("inner", F.lit(0))))
    return {r.v for r in kept.select("v").collect()}


def _recurring(seen: DataFrame) -> DataFrame:
    """(doc_id, own): edge templates, slips allowed, that stand on the same edge of at least two and at least half of a document's pages.

    At most eight a document. Headings and lines of the body, which also stand
    within pages of the corpus, are none.
    """
    lines = seen.select("doc_id", "page_number", F.explode("edges").alias("e")).select("doc_id", "page_number", "e.*")
    n_pages = seen.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"))
    by_page = lines.where("edge").groupBy("doc_id", "page_number", "key").agg(F.min("t").alias("t"), F.max("top").alias("top"), F.min("top").alias("low"))
    by_doc = by_page.groupBy("doc_id", "key").agg(F.min("t").alias("t"), F.count_if("top").alias("top"), F.count_if(~F.col("low")).alias("bottom"))
    often = by_doc.join(n_pages, "doc_id").where(F.greatest("top", "bottom") >= F.greatest(F.lit(2), F.col("pages") / 2)).where(_lettered("t"))
    shares = lines.groupBy("t").agg(F.count_if("edge").alias("edge"), F.count("*").alias("n"))
    outer = often.join(shares.where(F.col("edge") >= 0.9 * F.col("n")).select("t"), "t", "left_semi")
    return outer.groupBy("doc_id").agg(F.array_sort(F.collect_set("t")).alias("own"))


def learn(known: DataFrame, seen: DataFrame, dim: int = 32) -> Model:
    """The model of a corpus; known is the result of _with_titles, seen of _observed.

    What reaches the driver is bounded: known words by 1 / SHARE, templates
    by their least count of documents, labels by 1 / LABEL_SHARE, vectors by the
    known words.
    """
    counted = seen.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, int(total * SHARE))
    counts = {r.w: r.n for r in counted.where(F.col("n") >= least).collect()}
    shapes = (
        seen.select("doc_id", "page_number", F.explode("edges").alias("e"))
        .groupBy("e.t")
        .agg(
            F.count_if("e.edge").alias("edge"),
            F.count("*").alias("n"),
            F.count_if((F.col("page_number") > 1) & F.col("e.edge")).alias("later"),
            F.approx_count_distinct("doc_id").alias("docs"),
        )
    )
    n_docs = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    frequent = shapes.where((F.col("docs") >= max(4, n_docs * 0.004)) & (F.col("edge") >= 0.9 * F.col("n")) & (F.col("later") >= 0.3 * F.col("edge")) & (F.length(F.regexp_replace("t", r"<n>|\W", "")) > 0))
    templates = {r.t for r in frequent.select("t").collect()}
    figures = seen.select(F.explode("labels").alias("x")).groupBy("x.l").agg(F.count_if("x.odd").alias("odd"), F.count("*").alias("n"))
    masked = _masked_templates(seen.select("doc_id", "page_number", F.explode("edges").alias("e")).select("doc_id", "page_number", "e.*"), max(4, n_docs * 0.004))
    n_labels = figures.agg(F.sum("n")).first()[0] or 0
    labels = {r.l for r in figures.where((F.col("odd") >= max(3, n_labels * LABEL_SHARE)) & (F.col("odd") >= 0.5 * F.col("n"))).collect()}
    vectors = _vectors(seen, least, dim) if counts else {}
    return Model(counts, templates, labels, vectors, masked)


def _vectors(seen: DataFrame, least: int, dim: int) -> dict[str, np.ndarray]:
    """Skip-gram vectors, of unit length, of the words that occur at least `least` times."""
    from pyspark.ml.feature import Word2Vec

    parts = max(1, seen.rdd.getNumPartitions())
    model = Word2Vec(vectorSize=dim, windowSize=3, minCount=least, maxIter=1, numPartitions=parts, seed=7, inputCol="words", outputCol="v", maxSentenceLength=200)
    rows = model.fit(seen.select("words")).getVectors().collect()
    out = {}
    for r in rows:
        v = r.vector.toArray().astype(np.float32)
        norm = float(np.linalg.norm(v))
        out[r.word] = v / norm if norm else v
    return out


def _repaired(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, defects array<struct<line_no,defect>>, text) of every page."""
    known = durable(_with_titles(_pages(pages)))
    seen = _observed(known)
    shared = pages.sparkSession.sparkContext.broadcast(learn(known, seen))
    known = known.join(_recurring(seen), "doc_id", "left")

    def heads(batches):
        model = shared.value
        for batch in batches:
            first = [first_of_body(t, int(p), name_words(fl), model, [] if own is None else list(own)) for p, t, fl, own in zip(batch.page_number, batch.text, batch.first_lines, batch.own, strict=True)]
            yield pd.DataFrame({"doc_id": batch.doc_id, "page_number": batch.page_number - 1, "follow": pd.Series(first, dtype=object, index=batch.index)})

    first = known.where(F.col("page_number") > 1).select("doc_id", "page_number", "text", "first_lines", "own").mapInPandas(heads, "doc_id long, page_number int, follow string")
    known = known.join(first.groupBy("doc_id", "page_number").agg(F.min("follow").alias("follow")), ["doc_id", "page_number"], "left")

    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for d, p, t, o, c, follow, fl, own in zip(batch.doc_id, batch.page_number, batch.text, batch.used_ocr, batch.ocr_confidence, batch.follow, batch.first_lines, batch.own, strict=True):
                conf = None if c is None or c != c else float(c)
                got = repair(t, int(p), name_words(fl), follow, bool(o), conf, model, [] if own is None else list(own))
                out.append((d, p, [{"line_no": i + 1, "defect": x} for i, s in enumerate(got.defects) for x in sorted(s)], got.text))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "defects", "text"])

    return known.mapInPandas(run, "doc_id long, page_number int, defects array<struct<line_no:int,defect:string>>, text string")


def line_defects(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, defect) of page_extraction rows.

    Null and blank pages have no rows, repeated rows count once, an empty
    table gives none; columns besides the five used are ignored.
    """
    rows = _repaired(pages).select("doc_id", "page_number", F.explode("defects").alias("d"))
    return rows.select("doc_id", "page_number", "d.line_no", "d.defect").distinct()


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, text): continuous paragraphs of each document, words divided by a page break put together."""
    rows = _repaired(pages).select("doc_id", F.struct("page_number", "text").alias("p"))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("doc_id", F.array_join(F.col("ps.text"), "\n\n").alias("text"))
    return joined.select("doc_id", F.regexp_replace("text", "­\n\n", "").alias("text"))
