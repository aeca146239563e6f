"""Sentence units across languages and scripts, by a finite transducer.

Boundary rules turn a text into events (marks, brackets, headings, claim and
paragraph numbers). A transducer over six states decides which events end a
unit: inside brackets or a numbered claim a mark ends nothing. Events of many
texts, and of the chunks of long ones, run side by side: each chunk is folded
into a function from entry state to exit state, the functions are composed by
a parallel prefix scan, and a second pass emits the boundaries.

Reading the rules has a state of its own, the number of the last claim, since
a claim's number must go on from it; a paragraph break resets all else. A long
text is cut at paragraph breaks, every piece is read on its own into a
function from entry number to exit number and events, and the functions are
composed by the same prefix scan, so that results don't depend on the cuts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import spread

# Headings of patents that aren't written in capitals.
HEADINGS = (
    "What is claimed is:", "What is claimed:", "We claim:", "I claim:", "The invention claimed is:", "Claims", "Abstract", "Description", "Background", "Summary", "Detailed Description",
    "Patentansprüche", "Ansprüche", "Zusammenfassung", "Beschreibung", "Stand der Technik", "Beschreibung der Ausführungsformen",
    "Revendications", "Abrégé", "Description détaillée", "Reivindicaciones", "Resumen", "Descripción", "Descripción detallada", "Antecedentes",
    "Формула изобретения", "Реферат", "Описание", "Уровень техники", "Осуществление изобретения",
    "权利要求书", "权利要求", "说明书", "说明书摘要", "摘要", "背景技术", "具体实施方式", "发明内容", "技术领域", "附图说明", "权利要求书：",
    "발명의 설명", "청구범위", "특허청구범위", "요약", "요약서", "배경기술", "실시예", "기술분야", "발명의 내용", "도면의 간단한 설명", "발명을 실시하기 위한 구체적인 내용",
    "सारांश", "विवरण", "दावे", "विस्तृत विवरण", "पृष्ठभूमि", "सार",
)
# Abbreviations that never end a sentence.
NEVER = frozenset(
    """fig figs art abs abb abschn sec sect eq eqs ref refs pat pats dr prof mr mrs ms cf vgl ca approx wt vs viz bzw e.g i.e z.b d.h p.ex ex env c.-à-d c.-a-d
    núm pág págs aprox ej sr sra т.е п пп рис напр ок т см стр табл им डॉ सं पृ vol pp st ing dipl gen col rev mt ser ed eds chap ch op cit bd hrsg sog evtl ggf inkl zzgl mme mm.e m.e
    abstr appl pub dept est""".split()
)
# Abbreviations of numbers, which end no sentence before a figure.
NUMBERING = frozenset("no nos nr nrn núm n° item claim".split())
# German words before an ordinal number.
BEFORE_ORDINAL = frozenset("am im vom zum beim der die das dem den des ab bis seit zur jeder jede jedes jeden jedem und oder".split())

_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŴŶŹŻŽА-ЯЁ", "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųŵŷźżžа-яё"
_CJK = "　-〿぀-ヿ㐀-䶿一-鿿豈-﫿＀-￯"
_HEADS = frozenset(HEADINGS)
_CAPITALS = re.compile(rf"[{_UP}][{_UP}'’&/,() \-]{{3,70}}:?")
_BLACK = re.compile(r"【[^】\d０-９]{1,30}】")
#: Places where an event may lie; each branch starts with one character, which the scanner looks for.
_PLACE = re.compile(r"\.(?=[\s.)\]\"'”’“»]|\Z)|!|\?|…|।|。|！|？|．|\(|（|「|『|“|\)|）|」|』|”|\n")
_TERM = re.compile(
    rf"[.!?…।]++(?:\s*»|[)\]\"'”’“])*+(?=\s+(?:\Z|[a-z][A-Z]|[^\s{_LOW},;:.)\]%°=+*/·<>≤≥–—\-?!])|\s*\Z)"
)
_LOWER = re.compile(r"\.(?=\s+[a-zа-я])")
_CJK_TERM = re.compile(r"[。！？．]+[」』”’）)]*")
_PARA = re.compile(r"\n(?:[^\S\n]*\n)+")
_PAR = re.compile(r"[^\S\n]*(?:\[\d{3,5}\]|【[\d０-９]{3,5}】)")
_ITEM = re.compile(r"[^\S\n]*(?:【\s?(?:請求項|청구항)\s?[\d０-９]+\s?】|(?:청구항|請求項)\s?[\d０-９]+\s?[.．:：]?|(?P<num>\d{1,3})\s?[.．]\s+)(?=\s*\S)")
_WIDE = re.compile(rf"[{_CJK}]")
SOFT, SOFT_CLOSE, OPEN_START, OPEN_MID, CLOSE, HARD, HARD_CLAIM = range(7)
N_STATES = 6  # in a sentence; in brackets at its start, in its middle; in a claim; in inner brackets of either
_NEXT = np.array(
    [  # by class: next state of each state
        [0, 1, 2, 3, 4, 5],
        [0, 0, 0, 3, 1, 2],
        [1, 4, 5, 3, 4, 5],
        [2, 4, 5, 3, 4, 5],
        [0, 0, 0, 3, 1, 2],
        [0, 0, 0, 0, 0, 0],
        [3, 3, 3, 3, 3, 3],
    ],
    dtype=np.uint8,
)
_EMITS = np.zeros((7, N_STATES), dtype=bool)
_EMITS[SOFT, 0] = _EMITS[SOFT_CLOSE, 0] = _EMITS[SOFT_CLOSE, 1] = True
_EMITS[HARD] = _EMITS[HARD_CLAIM] = True
#: Events of one chunk of the scan; characters of one piece of a long text; numbers that a claim can have.
CHUNK, PIECE, NUMBERS = 64, 32_768, 1000


def compose(functions: np.ndarray) -> np.ndarray:
    """Row i: the composition of the functions 0..i, each a row of images, in about log2 of their number rounds."""
    step, m = 1, len(functions)
    while step < m:  # after each round row i is the composition of up to 2 * step functions that end at i
        later = functions[step:]
        functions = np.concatenate([functions[:step], np.take_along_axis(later, functions[:-step].astype(np.intp), axis=1)])
        step *= 2
    return functions


def entry_states(classes: np.ndarray) -> np.ndarray:
    """State before each event, from state 0, by chunks and a prefix scan over their functions."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    m = -(-n // CHUNK)
    padded = np.full(m * CHUNK, SOFT, dtype=np.uint8)
    padded[:n] = classes
    rows = padded.reshape(m, CHUNK)
    fold = np.tile(np.arange(N_STATES, dtype=np.uint8), (m, 1))
    for j in range(CHUNK):
        fold = _NEXT[rows[:, j, None], fold]
    fold = compose(fold)
    state = np.concatenate([np.zeros(1, dtype=np.uint8), fold[:-1, 0]])
    out = np.empty((m, CHUNK), dtype=np.uint8)
    for j in range(CHUNK):
        out[:, j] = state
        state = _NEXT[rows[:, j], state]
    return out.reshape(-1)[:n]


_YES, _NO, _ORDINAL, _FIGURE, _LETTER, _CASED = range(6)
_NEXT_LETTER = re.compile(r"\.\s*[^\W\d_]\.")
_KINDS: dict[str, int] = {}


def _kind(token: str) -> int:
    """What a full stop after the token depends on."""
    low = token.lower()
    if not low:
        return _YES
    if low.isdigit():
        return _ORDINAL if len(low) <= 3 else _YES
    if low in NUMBERING:
        return _FIGURE
    if low in NEVER:
        return _NO
    if len(token) == 1 and token.isalpha():
        return _NO if token.isupper() else _YES if low in "дг" else _LETTER
    if "." in token and all(len(p) <= 2 for p in token.split(".")) and token.replace(".", "").isalpha():
        return _YES if low in ("a.m", "p.m") else _NO
    return _CASED


def _ends(text: str, at: int) -> bool:
    """Whether the full stop at `at`, which is followed by white space and no lower case, ends a sentence."""
    if at == 0 or text[at - 1].isspace():
        return True
    token = text[max(0, at - 24) : at].rsplit(None, 1)[-1]
    kind = _KINDS.get(token)
    if kind is None:
        if len(_KINDS) > 200_000:
            _KINDS.clear()
        kind = _KINDS[token] = _kind(token.lstrip("([{\"'„“«‘¿¡"))
    if kind == _CASED:
        after = text[at + 2 : at + 3]
        return after < "ऀ" or not ("ऀ" <= _next(text, at + 1) <= "ॿ")
    if kind <= _NO:
        return kind == _YES
    if kind == _FIGURE:
        return not _next(text, at + 1).isdigit()
    words = text[max(0, at - len(token) - 16) : at - len(token)].split()
    if kind == _LETTER:  # one of several, as in z. B.
        return not (words and words[-1].endswith(".")) and not _NEXT_LETTER.match(text, at)
    return not (words and words[-1].lower() in BEFORE_ORDINAL and _next(text, at + 1).isupper())


def _next(text: str, at: int) -> str:
    while at < len(text) and text[at].isspace():
        at += 1
    return text[at] if at < len(text) else " "


def _events(text: str, claim: int = 0) -> tuple[list[int], list[int], int | None, list[int]]:
    """(classes, positions, last claim in it, numbers) of a text that starts a paragraph; claim: number of the last claim before it.

    The position is the end of the unit that an event may close. numbers are
    those that the entry claim decided on, up to the first that was taken.
    """
    classes: list[int] = []
    at: list[int] = []
    n = len(text)
    soft_end = hard_end = resume = 0  # where the last mark and the last forced boundary end
    asked: list[int] = []
    own = False  # whether the last claim stands in this text

    def back(p: int) -> int:
        while p > 0 and text[p - 1].isspace():
            p -= 1
        return p

    def line_start(p: int) -> None:
        """Events at the start of the line at p."""
        nonlocal hard_end, resume, claim, own
        if "a" <= text[p : p + 1] <= "z":
            return
        stop = text.find("\n", p)
        stop = n if stop < 0 else stop
        if stop - p <= 90:
            line = text[p:stop].strip()
            if line and (line in _HEADS or _CAPITALS.fullmatch(line) or _BLACK.fullmatch(line)):
                classes.extend((HARD, HARD))
                at.extend((back(p), back(stop)))
                hard_end = resume = stop
                return
        if m := _PAR.match(text, p):
            classes.append(HARD)
            at.append(back(p))
            hard_end = resume = m.end()
            return
        m = _ITEM.match(text, p)
        if m is None:
            return
        if m.group("num") is not None:
            k, before = int(m.group("num")), back(p)
            blank = before == 0 or hard_end >= before or text.count("\n", before, p) > 1
            ended = before > 0 and text[before - 1] in ".!?。．;；:：।"
            if not own:
                asked.append(k)
            if not ((blank and (k == 1 or not claim or k > claim)) or (claim and claim < k <= claim + 3 and ended)):
                return
            claim, own = k, True
        classes.append(HARD_CLAIM)
        at.append(back(p))
        hard_end = resume = m.end()

    line_start(0)
    for m in _PLACE.finditer(text):
        s = m.start()
        if s < resume:
            continue
        ch = text[s]
        if ch == "\n":
            if p := _PARA.match(text, s):
                classes.append(HARD)
                at.append(back(s))
                hard_end = resume = p.end()
                line_start(p.end())
            else:
                line_start(s + 1)
        elif ch in ".!?…।":
            t = _TERM.match(text, s)
            if t is None:
                low = ch == "." and _LOWER.match(text, s)
                if not low or not _lower_end(text, s, max(soft_end, hard_end)):
                    continue
                classes.append(SOFT)
                at.append(s + 1)
                soft_end = s + 1
                continue
            e = t.end()
            resume = e
            if ch == "." and e - s == 1 and e < n and not _ends(text, s):
                continue
            classes.append(SOFT_CLOSE if ")" in t.group() else SOFT)
            at.append(e)
            soft_end = e
        elif ch in "。！？．":
            if ch == "．" and s + 1 < n and text[s + 1].isdigit() and s and text[s - 1].isdigit():
                continue
            t = _CJK_TERM.match(text, s)
            k = sum(c in "」』”’）)" for c in t.group())
            for _ in range(k - 1):
                classes.append(CLOSE)
                at.append(s)
            classes.append(SOFT_CLOSE if k else SOFT)
            at.append(t.end())
            soft_end = resume = t.end()
        elif ch in "(（「『":
            classes.append(OPEN_START if back(s) <= max(soft_end, hard_end) else OPEN_MID)
            at.append(s)
        elif ch == "“":
            if s + 1 < n and _WIDE.match(text[s + 1]) or (s and _WIDE.match(text[s - 1])):
                classes.append(OPEN_START if back(s) <= max(soft_end, hard_end) else OPEN_MID)
                at.append(s)
        elif ch == "”":
            if s and _WIDE.match(text[s - 1]) or (s + 1 < n and _WIDE.match(text[s + 1])):
                classes.append(CLOSE)
                at.append(s)
        else:
            classes.append(CLOSE)
            at.append(s)
    classes.append(HARD)
    at.append(back(n))
    return classes, at, claim if own else None, asked


def pieces(text: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, cut at the first paragraph break from `size` characters on."""
    cuts, at = [0], 0
    while len(text) - at > size and (m := _PARA.search(text, at + size)):
        at = m.end()
        if at < len(text):
            cuts.append(at)
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def _read(text: str) -> tuple[np.ndarray, dict[int, tuple[list[int], list[int]]], np.ndarray]:
    """(exit number of each entry number, events by case, case of each entry number) of one piece.

    The entry number only decides which of the piece's numbers is the first
    claim, so that numbers with the same decisions are one case.
    """
    exits, case = np.zeros(NUMBERS, dtype=np.int64), np.full(NUMBERS, -1, dtype=np.int64)
    known: dict[int, tuple[list[int], list[int]]] = {}
    entry = np.arange(NUMBERS)
    while (left := np.flatnonzero(case < 0)).size:
        c = int(left[0])
        classes, at, out, asked = _events(text, c)
        known[c] = (classes, at)
        same = (case < 0) & (entry == c if c == 0 else entry > 0)
        for k in asked:  # the decision on a number depends on whether it lies above the entry number, and by how much
            same &= ((entry < k) == (c < k)) & ((entry + 3 >= k) == (c + 3 >= k))
        case[same] = c
        exits[same] = entry[same] if out is None else out
    return exits, known, case


def events(text: str, size: int | None = None) -> tuple[list[int], list[int]]:
    """(classes, positions) of a text, read in pieces of about `size` characters."""
    parts = pieces(text, size or PIECE)
    if len(parts) == 1:
        return _events(text)[:2]
    read = [_read(text[a:b]) for a, b in parts]
    after = compose(np.stack([exits for exits, _, _ in read]))
    entry = [0, *after[:-1, 0].tolist()]
    classes: list[int] = []
    at: list[int] = []
    for (a, _), (_, known, case), e in zip(parts, read, entry, strict=True):
        c, p = known[int(case[e])]
        classes += c
        before = at[-1] if at else 0  # a boundary at the start of a piece lies at the end of the one before
        at += [x + a if x else before for x in p]
    return classes, at


def _lower_end(text: str, at: int, unit: int) -> bool:
    """Whether a full stop before a lower-case word ends a sentence of a passage written in lower case throughout."""
    first = _next(text, unit)
    if not first.islower():
        return False
    a = at
    while a > 0 and text[a - 1].isalpha():
        a -= 1
    word = text[a:at].lower()
    return len(word) >= 4 and word not in NEVER and text[unit:at].islower()


def unit_ends(texts: list[str]) -> list[np.ndarray]:
    """End positions, in code points, of the units of each text."""
    classes: list[int] = []
    positions: list[int] = []
    bounds = [0]
    for t in texts:
        c, p = events(t)
        classes += c
        positions += p
        bounds.append(len(classes))
    cls = np.array(classes, dtype=np.uint8)
    pos = np.array(positions, dtype=np.int64)
    emits = _EMITS[cls, entry_states(cls)]
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        ends = pos[a:b][emits[a:b]]
        ends = np.unique(ends[ends > 0])
        out.append(ends)
    return out


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, end_char) of every unit of every text that is neither null nor blank.

    Positions count code points of the text as stored; repeated rows give
    repeated units; an empty table gives none; other columns are not read.
    """

    @F.pandas_udf("array<int>")
    def ends(text: pd.Series) -> pd.Series:
        values = text.tolist()
        out = []
        for i in range(0, len(values), 256):
            out += [x.astype(np.int32) for x in unit_ends(values[i : i + 256])]
        return pd.Series(out)

    rows = documents.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(id_col, text_col)
    rows = spread(rows, id_col)
    return rows.select(F.col(id_col).alias("doc_id"), F.explode(ends(text_col)).alias("end_char"))
