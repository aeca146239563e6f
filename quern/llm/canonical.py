"""Free-entered values to the entries of a reference list, through a BK-tree.

Values are stripped of rank and remarks, put back into natural order and freed
of abbreviations; every reading is looked up in a BK-tree of the entries'
names and aliases, which returns all phrases within the edit budget of the
reading's length, and the nearest entry over all readings and shards wins.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from itertools import product
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bktree import BKTree, levenshtein
from quern.session import durable

# Words of rank, which don't change the occupation.
RANKS = ("senior", "sr", "snr", "junior", "jr", "jnr", "lead", "principal", "staff", "chief", "head", "associate", "trainee", "intern", "graduate", "entry level", "mid level", "i", "ii", "iii", "iv", "v")
# Remarks on contract and workplace.
REMARKS = ("remote", "contract", "m f d", "f m d", "m w d", "w m d", "d f m", "hq", "2nd shift", "1st shift", "3rd shift", "night shift", "part time", "full time", "team member", "seasonal", "temporary", "temp", "freelance", "hybrid", "on site", "onsite", "permanent", "interim")
# Contractions that are no prefix of their word.
CONTRACTIONS = {"engr": "engineer", "mgr": "manager", "mngr": "manager", "asst": "assistant", "supv": "supervisor", "spvr": "supervisor", "dev": "developer", "dv": "developer", "mgmt": "management", "acct": "accountant", "sw": "software", "sftw": "software", "techn": "technician", "coordntr": "coordinator", "natl": "national"}

# Grades written after a title.
GRADES = ("i", "ii", "iii", "iv", "v")

#: The reference list is held by every task up to so many phrases; beyond, it is cut into shards of that size.
SHARD_PHRASES = 50_000
#: Readings of a wording that are looked up one by one; beyond, the list is walked along all readings at once, with the same result.
LISTED = 4096
#: Distinct values that meet a shard in one task.
BLOCK_VALUES = 20_000


def flat(text: str) -> str:
    """Lower case without accents' variants, marks as spaces, single spaces."""
    text = unicodedata.normalize("NFKC", text).lower()
    return " ".join(re.sub(r"[^\w.]+|_", " ", text).split())


def budget(phrase: str) -> int:
    """Edits allowed for a phrase: none up to 4 letters, 1 up to 7, else 2 (a swap of neighbours counts 2)."""
    n = len(phrase)
    return 0 if n <= 4 else 1 if n <= 7 else 2


def _swapped(a: str, b: str) -> bool:
    """True if a and b differ by one swap of neighbours."""
    if len(a) != len(b):
        return False
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]


def _is_remark(text: str) -> bool:
    text = text.replace(".", " ").strip()
    return any(levenshtein(text, r) <= (0 if len(r) <= 4 else 1 if len(r) <= 6 else 2) for r in REMARKS)


def _is_rank(token: str) -> bool:
    """True for a word of rank, also with a slip in a word of five letters or more."""
    bare = token.rstrip(".")
    return bare in RANKS or any(len(r) >= 5 and (levenshtein(bare, r) <= 1 or _swapped(bare, r)) for r in RANKS)


def _without_remarks(value: str) -> str:
    """The value without bracketed, appended or trailing remarks."""
    text = " ".join(unicodedata.normalize("NFKC", value).lower().replace("_", " ").split())
    text = re.sub(r"(?<=\S)-@-(?=\S)", " @ ", text)
    text = re.sub(r"(?<=\S)-[-–/]-(?=\S)", " - ", text)
    head, comma, tail = text.partition(",")
    if comma and tail.strip() and _is_remark(flat(head)):
        text = tail.strip(" ,")
    text = re.sub(r"\s*\(([^)]*)\)", lambda m: "" if m.start() > 0 else m[0], text)
    for sep in (" @ ", "@ ", " / ", " /", "/ ", " - ", " – ", " -", "- ", ", ", ",", "/-", "/", "-/"):
        head, found, tail = text.rpartition(sep)
        if found and head and _is_remark(flat(tail)):
            text = head
    return text.strip(" ,-/@")


def _in_order(part: str, word: str) -> bool:
    """True if the letters of part occur in word in the same order."""
    rest = iter(word)
    return all(ch in rest for ch in part)


class Vocabulary:
    """The words of a reference list, found by their beginning or by their first and last letter."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words))
        self.known = set(self.words)
        self.framed: dict[str, list[str]] = {}
        for w in self.words:
            self.framed.setdefault(w[0] + w[-1], []).append(w)

    def starting(self, head: str) -> list[str]:
        found, k = [], bisect_left(self.words, head)
        while k < len(self.words) and self.words[k].startswith(head):
            found.append(self.words[k])
            k += 1
        return found

    def short_for(self, token: str) -> tuple[bool, list[str], list[str], list[str]]:
        """(known, words it begins, words it is the skeleton of, compounds it is the first part and end of)."""
        bare = token.rstrip(".")
        stem, dot, end = token.partition(".")
        begun = [w for w in self.starting(bare) if w != bare] if len(bare) >= 2 else []
        drawn = [w for w in self.framed.get(bare[0] + bare[-1], []) if len(w) > len(bare) + 2 and _in_order(bare, w)] if 3 <= len(bare) <= 6 else []
        joined = [w for w in self.starting(stem) if len(w) > len(stem) + len(end) and levenshtein(w[-len(end) :], end) <= 2] if dot and len(stem) >= 2 and len(end) >= 4 else []
        return bare in self.known, begun, drawn, joined


def written_out(token: str, known: bool, begun: list[str], drawn: list[str], joined: list[str]) -> list[str]:
    """The token, and the words of the list that it may abbreviate."""
    bare = token.rstrip(".")
    if known and not token.endswith("."):
        return [bare, *([] if len(bare) > 5 or len(bare) < 3 else begun)]
    found = [CONTRACTIONS[bare]] if bare in CONTRACTIONS else []
    if len(bare) >= 2 and (token.endswith(".") or len(bare) <= 5):
        found += [w for w in begun if len(w) > len(bare) + 1]
    if not found and not known:
        found = list(drawn)
    return [bare, *dict.fromkeys([*found, *joined])]


def wordings(value: str) -> list[list[str]]:
    """Tokens of a value without rank and remarks, in both orders around a comma, the nearest wording first."""
    base = _without_remarks(value)
    orders = [flat(base)]
    if "," in base:
        head, _, tail = base.partition(",")
        orders.append(flat(f"{tail} {head}"))
        last = flat(tail).split()
        while len(last) > 1 and last[-1] in GRADES:
            last.pop()
        orders.append(f"{' '.join(last)} {flat(head)}")
        ranked = flat(head).split()
        k = 0
        while k < len(ranked) - 1 and _is_rank(ranked[k]):
            k += 1
        if k:
            orders.append(f"{flat(tail)} {' '.join(ranked[k:])}")
    found: dict[tuple[str, ...], None] = {}
    for text in orders:
        tokens = text.split()
        stripped = [tokens]
        while len(tokens) > 1 and _is_rank(tokens[0]):
            tokens = tokens[1:]
            stripped.append(tokens)
        for t in list(stripped):
            u = t
            while len(u) > 1 and u[-1].rstrip(".") in GRADES:
                u = u[:-1]
                stripped.append(u)
        found |= dict.fromkeys(tuple(t) for t in stripped)
    return [list(t) for t in found]


class Readings:
    """All readings of a wording as one automaton: a tree of the words of each token, a space leads to the next token's tree."""

    def __init__(self, choices: list[list[str]]) -> None:
        self.next: list[dict[str, int]] = []
        root = self._node()
        self.ends = {root}  # states in which a reading is complete
        for choice in choices:
            self.ends = set()
            for word in choice:
                at = root
                for ch in word:
                    if ch not in self.next[at]:
                        self.next[at][ch] = self._node()
                    at = self.next[at][ch]
                self.ends.add(at)
            root = self._node()
            for at in self.ends:
                self.next[at][" "] = root

    def _node(self) -> int:
        self.next.append({})
        return len(self.next) - 1

    def _closed(self, states: dict[int, int], most: int) -> dict[int, int]:
        """States with those that further letters of a reading lead to, an edit each."""
        todo = list(states)
        while todo:
            at = todo.pop()
            d = states[at] + 1
            if d <= most:
                for to in self.next[at].values():
                    if d < states.get(to, most + 1):
                        states[to] = d
                        todo.append(to)
        return states

    def start(self, most: int) -> dict[int, int]:
        return self._closed({0: 0}, most)

    def step(self, states: dict[int, int], ch: str, most: int) -> dict[int, int]:
        """Fewest edits between beginnings of readings and a text, by state, after one more letter of the text."""
        found: dict[int, int] = {}
        for at, d in states.items():
            for to, e in ((at, d + 1), *((to, d + (x != ch)) for x, to in self.next[at].items())):
                if e <= most and e < found.get(to, most + 1):
                    found[to] = e
        return self._closed(found, most)

    def distance(self, states: dict[int, int], most: int) -> int:
        """Fewest edits between any reading and the text that led to the states; most + 1 for more."""
        return min((states[at] for at in self.ends & states.keys()), default=most + 1)

    def has(self, text: list[str | None]) -> bool:
        """True if a reading has these letters; None stands for any letter."""
        states = {0}
        for ch in text:
            states = {to for at in states for x, to in self.next[at].items() if ch is None or x == ch}
        return bool(states & self.ends)

    def allows(self, d: int, phrase: str) -> bool:
        """True if some reading at this distance from a phrase, the smallest of all, is near enough for its own length too."""
        if d > budget(phrase):
            return False
        text = list(phrase)
        if d == 2 and len(phrase) < 12:
            return any(self.has([*text[:i], text[i + 1], text[i], *text[i + 2 :]]) for i in range(len(text) - 1))
        if d == 1 and len(phrase) == 5:  # a reading of 4 letters allows no edit
            return any(self.has([*text[:i], None, *text[k:]]) for i in range(len(text) + 1) for k in (i, i + 1) if k <= len(text))
        return True


class Matcher:
    """BK-tree of one shard of (phrase, entry_id)."""

    def __init__(self, shard: list[tuple[str, int]]) -> None:
        self.tree = BKTree()
        self.entries: dict[str, int] = {}
        for phrase, entry in sorted(shard, key=lambda x: (x[1], x[0])):
            self.tree.add(phrase, entry)
            self.entries.setdefault(phrase, entry)
        self.phrases = sorted(self.entries)

    @staticmethod
    def _allowed(d: int, reading: str, phrase: str) -> bool:
        return d <= budget(phrase) and not (d == 2 and len(phrase) < 12 and not _swapped(reading, phrase))

    def _all_at_once(self, choices: list[list[str]], best: tuple[int, int] | None) -> tuple[int, int] | None:
        """The nearest entry over all readings of a wording, without listing them: phrases in order, common beginnings once."""
        readings, most = Readings(choices), 2 if best is None else min(2, best[0])
        before, reached = "", [readings.start(most)]
        for phrase in self.phrases:
            k = len(commonprefix((before, phrase)))
            before = phrase
            del reached[k + 1 :]
            while reached[-1] and len(reached) <= len(phrase):
                reached.append(readings.step(reached[-1], phrase[len(reached) - 1], most))
            if len(reached) <= len(phrase):
                continue
            d = readings.distance(reached[-1], most)
            got = (d, self.entries[phrase])
            if d <= most and (best is None or got < best) and readings.allows(d, phrase):
                best = got
        return best

    def best(self, written: list[list[list[str]]]) -> tuple[int, int] | None:
        """(distance, entry_id) of the nearest entry over all readings of all wordings; None if there is none in reach.

        written: of each wording, of each token the words that it may stand
        for. Ties go to the smaller id.
        """
        best, seen = None, set()
        for choices in written:
            size = 1
            for ch in choices:
                size *= len(ch)
            if size > LISTED:
                best = self._all_at_once(choices, best)
                continue
            for words in product(*choices):
                reading = " ".join(words)
                if reading in seen:
                    continue
                seen.add(reading)
                radius = budget(reading) if best is None else min(budget(reading), best[0])
                for d, phrase, entries in self.tree.within(reading, radius):
                    if self._allowed(d, reading, phrase):
                        got = (d, min(entries))
                        best = got if best is None or got < best else best
        return best


def reference_phrases(entries: DataFrame, id_col: str = "entry_id", name_col: str = "canonical_name", aliases_col: str = "aliases") -> DataFrame:
    """(entry_id, phrase): names and aliases; null and blank ones are left out."""
    names = F.concat(F.array(F.col(name_col)), F.coalesce(F.col(aliases_col), F.array().cast("array<string>")))
    rows = entries.select(F.col(id_col).alias("entry_id"), F.explode(names).alias("phrase"))
    return rows.where(F.trim("phrase") != "")


_RESULT = "value string, entry_id long, distance int"


def map_to_entries(values: DataFrame, value_col: str, entries: DataFrame, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(value, entry_id, distance) of each distinct value that is neither null nor blank.

    entry_id is 0 and distance null where nothing is in reach, also for an
    empty reference list. Ties go to the smaller entry_id. Columns of values
    besides value_col are ignored. The rows are the same for any size of shard.
    """
    distinct = values.select(F.col(value_col).alias("value")).where(~F.col("value").rlike(r"^[\s\p{Z}]*$")).distinct()
    distinct = distinct.repartition(max(values.sparkSession.sparkContext.defaultParallelism, _shuffle_partitions(values)), "value")
    phrases = reference_phrases(entries)
    n = phrases.count()
    if n <= shard_phrases:
        rows = [(flat(r.phrase), r.entry_id) for r in phrases.collect()]  # at most shard_phrases rows
        return distinct.mapInPandas(_whole_list(rows), _RESULT)
    shards = -(-n // shard_phrases)
    blocks = max(1, -(-distinct.count() // BLOCK_VALUES))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    written = durable(_written_values(distinct, phrases))
    cut = phrases.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    asked = written.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    matched = asked.groupBy("shard", "block").cogroup(cut.groupBy("shard", "block")).applyInPandas(_against_shard, _RESULT)
    return matched.groupBy("value").agg(F.min(F.struct(F.coalesce("distance", F.lit(999)).alias("d"), "entry_id", "distance")).alias("w")).select("value", "w.entry_id", "w.distance")


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _frame(values: list[str], hits: list[tuple[int, int] | None]) -> pd.DataFrame:
    return pd.DataFrame({"value": values, "entry_id": [h[1] if h else 0 for h in hits], "distance": pd.array([h[0] if h else None for h in hits], dtype="Int32")})


def _whole_list(rows: list[tuple[str, int]]):
    """Values against a list that one task holds."""

    def run(batches):
        matcher, words, memo = Matcher(rows), Vocabulary([w for p, _ in rows for w in p.split()]), {}
        for batch in batches:
            hits = []
            for value in batch["value"]:
                ways = wordings(value)
                for t in {t for way in ways for t in way} - memo.keys():
                    memo[t] = written_out(t, *words.short_for(t))
                hits.append(matcher.best([[memo[t] for t in way] for way in ways]))
            yield _frame(batch["value"].tolist(), hits)

    return run


def _written_values(distinct: DataFrame, phrases: DataFrame) -> DataFrame:
    """(value, tokens): of each value its distinct tokens with the words of the whole list that they may stand for.

    Tokens and words meet by their first two letters and by their first and
    last letter, so that no task needs all words of the list.
    """

    @F.pandas_udf("array<string>")
    def tokens_of(values: pd.Series) -> pd.Series:
        return pd.Series([sorted({t for way in wordings(v) for t in way}) for v in values])

    @F.pandas_udf("array<string>")
    def words_of(texts: pd.Series) -> pd.Series:
        return pd.Series([flat(t).split() for t in texts])

    bare = F.regexp_replace("token", r"\.+$", "")
    keys = lambda x: F.array_distinct(F.array(F.substring(x, 1, 2), F.concat(F.substring(x, 1, 1), F.lit("_"), F.right(x, F.lit(1)))))
    held = distinct.select("value", F.explode(tokens_of("value")).alias("token"))
    asked = held.select("token").distinct().withColumn("key", F.explode(F.array_distinct(F.concat(keys(bare), F.array(F.substring("token", 1, 2))))))
    words = phrases.select(F.explode(words_of("phrase")).alias("word")).distinct().withColumn("key", F.explode(keys(F.col("word"))))

    def meet(tokens: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        vocabulary, rows = Vocabulary(listed["word"].tolist()), []
        for t in tokens["token"]:
            rows.append((t, *vocabulary.short_for(t)))
        return pd.DataFrame(rows, columns=["token", "known", "begun", "drawn", "joined"])

    lists = ("begun", "drawn", "joined")
    met = asked.groupBy("key").cogroup(words.groupBy("key")).applyInPandas(meet, "token string, known boolean, " + ", ".join(f"{c} array<string>" for c in lists))
    whole = met.groupBy("token").agg(F.bool_or("known").alias("known"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])
    lists = held.join(whole, "token").groupBy("value").agg(F.collect_list(F.struct("token", "known", *lists)).alias("tokens"))
    return distinct.select("value").join(lists, "value", "left").withColumn("tokens", F.coalesce("tokens", F.slice(F.array(F.struct(F.lit("").alias("token"), F.lit(False).alias("known"), *[F.array().cast("array<string>").alias(c) for c in ("begun", "drawn", "joined")])), 1, 0)))


def _against_shard(values: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
    matcher = Matcher([(flat(p), int(e)) for p, e in zip(phrases["phrase"], phrases["entry_id"], strict=True)])
    hits = []
    for value, tokens in zip(values["value"], values["tokens"], strict=True):
        ways = {t["token"]: written_out(t["token"], bool(t["known"]), *(list(t[c]) for c in ("begun", "drawn", "joined"))) for t in tokens}
        hits.append(matcher.best([[ways[t] for t in way] for way in wordings(value)]))
    return _frame(values["value"].tolist(), hits)


def titles_to_entries(experience: DataFrame, taxonomy: DataFrame, salts: int = 16) -> DataFrame:
    """(row_id, entry_id) of every row whose job_title is neither null nor blank; 0 reports an unmatched title.

    Each distinct title is matched once; rows meet their title's entry in a
    salted join, so that a title that holds a third of all rows is spread.
    """
    titles = taxonomy.where(F.col("entry_kind") == "title")
    mapped = map_to_entries(experience, "job_title", titles)
    salted = mapped.select(F.col("value").alias("job_title"), "entry_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    rows = experience.select("row_id", "job_title", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int").alias("_salt"))
    return rows.join(salted, ["job_title", "_salt"]).select("row_id", "entry_id")
