"""Evaluation items that leak into documents, by q-gram lemma and banded alignment.

Texts are reduced to a byte code that ignores case, accents, marks, white
space, look-alike letters and common misreadings (two bytes for a letter of a
large script). The q-grams of all items form a table that every document is
scanned against as one vector; hits of one item are counted in overlapping
bands of diagonals, bands below the lemma's bound are dropped, runs of the
others become stretches, and stretches are verified by a banded edit distance,
many at a time.

A q-gram is stock if at least MANY items hold it that are no variants of each
other. Which q-grams are stock is found over all items before any document is
read, so that results don't depend on how items are cut into passes.
"""

from __future__ import annotations

import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.components import components
from quern.session import durable
from quern.sources.tables import spread

Q = 8
#: Least share of an item's words in a leak.
SHARE = 0.3
#: Items that share this part of the q-grams of the smaller one are variants of one item.
VARIANT = 0.75
#: Items, no variants of each other, that make a q-gram stock.
MANY = 3
#: A passage has somewhere WINDOW bytes with at most EDITS edits, so by the q-gram lemma
#: WINDOW - Q + 1 - EDITS * Q hits within one band of diagonals.
WINDOW, EDITS = 30, 2
BOUND = WINDOW - Q + 1 - EDITS * Q
#: Least share of the q-grams of a run, stock ones aside, that its document must have.
OWN_SHARE = 0.3
#: Edits per byte of a stretch.
BUDGET = 0.16
#: Diagonals of one band; letters between two runs of a stretch; letters of text that may interrupt a passage.
BAND, GAP, BREAK = 10, 60, 420
#: Items of one pass over the documents, in bytes of text; more are scanned in further passes.
PASS_BYTES = 8_000_000

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("асеорхуіјѕԁһԛԝкмтнвгαορνικτυχℓıøœæđł", "aceopxyijsdhqwkmthbraopviktuxlioeadl", strict=True))
# Characters that are misread for each other, as one of them.
MISREAD = {"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "c": "e", "!": "l"}


def _table() -> np.ndarray:
    """Code of each character of the basic plane: 0 dropped, below 256 one byte, else two."""
    lut = np.zeros(0x10000, dtype=np.uint16)
    cyrillic = {ch: 128 + i for i, ch in enumerate("бгджзийлпфцчшщъыьэюяёєїґ")}
    for cp in range(0x21, 0x10000):
        if 0xD800 <= cp < 0xE000 or 0xE000 <= cp < 0xF900:
            continue
        ch = unicodedata.normalize("NFKD", chr(cp).lower())
        ch = next((x for x in ch if not unicodedata.combining(x)), "") if len(ch) < 4 else ""
        ch = LOOKALIKES.get(ch, ch)
        ch = MISREAD.get(ch, ch)
        if not ch:
            continue
        if ch.isascii():
            if ch.isalnum():
                lut[cp] = ord(ch)
        elif ch in cyrillic:
            lut[cp] = cyrillic[ch]
        elif ord(chr(cp)) >= 0x300 and unicodedata.category(chr(cp))[0] in "LN" and cp < 0x10000:
            base = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", chr(cp)))
            lut[cp] = ord(base[0]) if len(base) == 1 and 256 <= ord(base) < 0x10000 else cp
    for a, b in (("|", "l"), ("!", "!")):
        lut[ord(a)] = ord(b) if b != "!" else 0
    return lut


_LUT: np.ndarray | None = None


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, origin): the code of a text and the character that each byte comes from."""
    global _LUT
    if _LUT is None:
        _LUT = _table()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    v = _LUT[np.where(cp < 0x10000, cp, 0)]
    at = np.flatnonzero(v)
    v = v[at]
    wide = v >= 256
    if not wide.any():
        return v.astype(np.uint8), at
    size = 1 + wide
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    out[start] = np.where(wide, v >> 8, v)
    out[start[wide] + 1] = v[wide] & 255
    return out, np.repeat(at, size)


def qgrams(code: np.ndarray) -> np.ndarray:
    """The 8-byte windows of a code as 64-bit numbers, by doubling."""
    if len(code) < Q:
        return np.zeros(0, dtype=np.uint64)
    h = code[:-1].astype(np.uint16) | (code[1:].astype(np.uint16) << np.uint16(8))
    h4 = h[:-2].astype(np.uint32) | (h[2:].astype(np.uint32) << np.uint32(16))
    return h4[:-4].astype(np.uint64) | (h4[4:].astype(np.uint64) << np.uint64(32))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def variants(grams: list[np.ndarray]) -> np.ndarray:
    """Group of each item from its distinct q-grams, the smallest number of its members.

    An item is linked to the first item that holds any of its rarest q-grams
    if they share VARIANT of the smaller one's; items that share so much have
    one of the rarest 1 - VARIANT of the smaller one's in common.
    """
    n = np.array([len(g) for g in grams], dtype=np.int64)
    group = np.arange(len(grams))
    if not n.sum():
        return group
    item = np.repeat(np.arange(len(grams)), n)
    known, slot = np.unique(np.concatenate(grams), return_inverse=True)
    held = np.bincount(slot)
    first = np.full(len(known), len(grams))
    np.minimum.at(first, slot, item)
    start = np.cumsum(n) - n

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = int(group[k])
        return k

    for k in range(len(grams)):
        mine = slot[start[k] : start[k] + n[k]]
        rare = mine[np.lexsort((known[mine], held[mine]))][: len(mine) - int(np.ceil(VARIANT * len(mine))) + 1]
        for other in np.unique(first[rare[held[rare] > 1]]).tolist():
            a, b = root(k), root(other)
            least = VARIANT * min(n[k], n[other])
            if a != b and len(np.intersect1d(grams[k], grams[other], assume_unique=True)) >= least:
                group[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(len(grams))], dtype=np.int64)


def stock_grams(grams: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """The q-grams that at least MANY groups of variants hold, in order."""
    if not grams:
        return np.zeros(0, np.uint64)
    owner = np.repeat(group, [len(g) for g in grams])
    every = np.concatenate(grams)
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    fresh = np.ones(len(every), dtype=bool)
    fresh[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
    known, n = np.unique(every[fresh], return_counts=True)
    return known[n >= MANY]


@dataclass
class Index:
    """q-grams of the items of one pass."""

    ids: list[int]
    codes: list[np.ndarray]
    words: list[np.ndarray]  # number of the word that each byte belongs to
    n_words: list[int]
    grams: np.ndarray = field(default=None)
    first: np.ndarray = field(default=None)
    item: np.ndarray = field(default=None)
    at: np.ndarray = field(default=None)
    stock: np.ndarray = field(default=None)  # of each q-gram
    own: list[np.ndarray] = field(default=None)  # running count of the q-grams along each item that aren't stock
    bits: np.ndarray = field(default=None)
    shift: np.uint64 = field(default=None)

    @classmethod
    def build(cls, rows: list[tuple[int, str]], stock: np.ndarray | None = None) -> Index:
        """Index of (id, text) rows; stock: the stock q-grams of all items, found among the rows if not given."""
        ids, codes, words, counts = [], [], [], []
        for i, text in rows:
            code, origin = encode(text)
            if len(code) < Q:
                continue
            wide = sum("぀" <= ch <= "ヿ" or "一" <= ch <= "鿿" for ch in text)
            if wide * 3 > len(text):
                word_of = np.arange(len(text))
            else:
                space = np.array([ch.isspace() for ch in text])
                word_of = np.cumsum(space[:-1].astype(int) & ~space[1:].astype(int), dtype=int) if len(text) > 1 else np.zeros(0, int)
                word_of = np.concatenate([[0], word_of])
            w = np.unique(word_of[origin], return_inverse=True)[1]
            ids.append(i)
            codes.append(code)
            words.append(w)
            counts.append(int(w.max()) + 1)
        self = cls(ids, codes, words, counts)
        g = [qgrams(c) for c in codes]
        if stock is None:
            distinct = [np.unique(x) for x in g]
            stock = stock_grams(distinct, variants(distinct))
        size = np.array([len(x) for x in g], dtype=np.int64)
        start = np.cumsum(size) - size
        grams = np.concatenate(g) if g else np.zeros(0, np.uint64)
        common = np.isin(grams, stock)
        seen = np.append(0, np.cumsum(~common))
        self.own = [seen[a : a + n + 1] - seen[a] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        item = np.repeat(np.arange(len(g), dtype=np.int32), size)
        at = (np.arange(len(grams)) - np.repeat(start, size)).astype(np.int32)
        order = np.argsort(grams, kind="stable")
        grams, self.item, self.at = grams[order], item[order], at[order]
        self.grams, first = np.unique(grams, return_index=True)
        self.first = np.append(first, len(grams))
        self.stock = common[order][first] if len(first) else np.zeros(0, bool)
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.grams)) * 40))))
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, dtype=bool)
        self.bits[(self.grams * _MIX) >> self.shift] = True
        return self

    def places(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, item, at): every place of the q-grams in slot; which is the number in slot."""
        n = (self.first[slot + 1] - self.first[slot]).astype(np.int64)
        which = np.repeat(np.arange(len(slot)), n)
        where = self.first[slot[which]] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.item[where].astype(np.int64), self.at[where].astype(np.int64)


def _in_bands(key: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The keys of which a band of 2 * BAND diagonals, bands overlapping by half, holds BOUND hits."""
    band = np.concatenate([diagonal // BAND, diagonal // BAND - 1])
    twice = np.concatenate([key, key])
    order = np.lexsort((band, twice))
    twice, band = twice[order], band[order]
    cut = np.flatnonzero((twice[1:] != twice[:-1]) | (band[1:] != band[:-1])) + 1
    start = np.append(0, cut)
    n = np.diff(np.append(start, len(twice)))
    return np.unique(twice[start[n >= BOUND]]) if len(twice) else twice


def _runs(i: np.ndarray, j: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(i0, i1, j0, j1) of runs of hits in overlapping bands of diagonals that hold enough q-grams besides stock.

    Passages that only share an item's turns of phrase have hits on stock
    alone; own is the running count of the other q-grams. Equal runs of
    neighbouring bands count once.
    """
    d = j - i
    band = np.concatenate([d // BAND, d // BAND - 1])
    i, j = np.concatenate([i, i]), np.concatenate([j, j])
    order = np.lexsort((i, j, band))
    i, j, band = i[order], j[order], band[order]
    cut = np.flatnonzero((band[1:] != band[:-1]) | (np.diff(j) > GAP) | (np.diff(i) < -2 * BAND)) + 1
    start = np.append(0, cut)
    end = np.append(cut, len(i))
    out = set()
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        if e - s < 3:
            continue
        hits = np.unique(i[s:e])
        a, b = int(hits[0]), int(hits[-1])
        expected = own[b + 1] - own[a]
        if expected and (own[hits + 1] - own[hits]).sum() >= OWN_SHARE * expected:
            out.add((a, b + Q, int(j[s]), int(j[e - 1]) + Q))
    kept: list[tuple[int, int, int, int]] = []
    for r in sorted(out, key=lambda r: (r[2], -r[3])):
        if not any(k[0] <= r[0] and r[1] <= k[1] and k[2] <= r[2] and r[3] <= k[3] for k in kept[-4:]):
            kept.append(r)
    return kept


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], width: int = 14) -> np.ndarray:
    """Edit distance of each pair within a band of diagonals, all pairs at once; the pair's own larger length if outside."""
    n = len(pairs)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    la = np.array([len(a) for a, _ in pairs])
    lb = np.array([len(b) for _, b in pairs])
    m, k = int(la.max()), 2 * width + 1
    A = np.zeros((n, m), dtype=np.int16)
    B = np.full((n, m + 2 * k + 2), -1, dtype=np.int16)
    for r, (a, b) in enumerate(pairs):
        A[r, : len(a)] = a
        b = b[: m + k]
        B[r, width : width + len(b)] = b
    big = 30_000
    steps = np.arange(k, dtype=np.int32)
    row = np.where(steps - width >= 0, steps - width, big).astype(np.int32)
    row = np.tile(row, (n, 1))
    result = np.maximum(la, lb).astype(np.int32)
    for i in range(1, m + 1):
        sub = row + (B[:, i - 1 : i - 1 + k] != A[:, i - 1, None])
        up = np.full_like(row, big)
        up[:, :-1] = row[:, 1:] + 1
        t = np.minimum(sub, up)
        j = i + steps - width
        t = np.where(j[None, :] == 0, i, np.where(j[None, :] < 0, big, t))
        row = np.minimum.accumulate(t - steps, axis=1) + steps
        done = np.flatnonzero(la == i)
        if len(done):
            at = lb[done] - i + width
            ok = (at >= 0) & (at < k)
            result[done[ok]] = row[done[ok], at[ok]]
    return result


def scan(doc_ids: list[int], texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, item_id, words, item_words, evidence) of verified stretches, the words of a pair's best passage."""
    codes = [encode(t)[0] for t in texts]
    sep = np.zeros(Q, dtype=np.uint8)
    parts, starts, total = [], [], 0
    for c in codes:
        starts.append(total)
        parts += [c, sep]
        total += len(c) + Q
    if total < Q:
        return []
    code = np.concatenate(parts)
    h = qgrams(code)
    maybe = np.flatnonzero(index.bits[(h * _MIX) >> index.shift])
    if not len(maybe) or not len(index.grams):
        return []
    g = h[maybe]
    slot = np.minimum(np.searchsorted(index.grams, g), len(index.grams) - 1)
    hit = index.grams[slot] == g
    maybe, slot = maybe[hit], slot[hit]
    start_arr = np.array(starts)
    doc = np.searchsorted(start_arr, maybe, side="right") - 1
    # candidates: pairs with a band of diagonals that meets the bound on q-grams besides stock
    which, item, i_pos = index.places(slot[~index.stock[slot]])
    of = np.flatnonzero(~index.stock[slot])[which]
    pair = doc[of].astype(np.int64) * len(index.ids) + item
    wanted = _in_bands(pair, maybe[of] - i_pos)
    if not len(wanted):
        return []
    pairs, count = np.unique(pair, return_counts=True)
    evidence = dict(zip(pairs.tolist(), count.tolist(), strict=True))
    keep = np.isin(doc, np.unique(wanted // len(index.ids)))
    maybe, slot, doc = maybe[keep], slot[keep], doc[keep]
    rep, item, i_pos = index.places(slot)
    j_pos = maybe[rep]
    key = doc[rep].astype(np.int64) * len(index.ids) + item
    keep = np.isin(key, wanted)
    key, i_pos, j_pos = key[keep], i_pos[keep], j_pos[keep]
    order = np.argsort(key, kind="stable")
    key, i_pos, j_pos = key[order], i_pos[order], j_pos[order]
    cuts = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    a = 0
    jobs, owners = [], []
    for b in cuts.tolist():
        k = int(key[a])
        it = k % len(index.ids)
        for run in _runs(i_pos[a:b], j_pos[a:b], index.own[it]):
            jobs.append((index.codes[it][run[0] : run[1]], code[run[2] : run[3]]))
            owners.append((k, run))
        a = b
    good: dict[int, list] = {}
    for s in range(0, len(jobs), 512):
        dist = banded_distances(jobs[s : s + 512])
        for (k, run), d in zip(owners[s : s + 512], dist.tolist(), strict=True):
            if d <= BUDGET * max(run[1] - run[0], run[3] - run[2]):
                good.setdefault(k, []).append(run)
    out = []
    for k, runs in good.items():
        d, it = divmod(k, len(index.ids))
        word_of = index.words[it]
        best = 0
        runs.sort(key=lambda r: r[2])
        for s in range(len(runs)):
            covered = np.zeros(index.n_words[it], dtype=bool)
            end = runs[s][3]
            for r in runs[s:]:
                if r[2] - end > BREAK:
                    break
                end = max(end, r[3])
                covered[_whole_words(word_of, r[0], r[1])] = True
            best = max(best, int(covered.sum()))
        out.append((doc_ids[d], index.ids[it], best, index.n_words[it], evidence[k]))
    return out


def _whole_words(word_of: np.ndarray, a: int, b: int) -> np.ndarray:
    """Words of which at least half of the bytes lie in [a, b)."""
    inside = np.bincount(word_of[a:b], minlength=word_of.max() + 1)
    return inside * 2 >= np.bincount(word_of, minlength=word_of.max() + 1)


def _item_grams(texts: DataFrame) -> DataFrame:
    """(item, grams): distinct q-grams of each item, in order; items too short for one are left out."""

    def run(batches):
        for batch in batches:
            grams = [np.unique(qgrams(encode(t)[0])).view(np.int64) for t in batch["text"]]
            kept = [k for k, g in enumerate(grams) if len(g)]
            yield pd.DataFrame({"item": batch["item"].to_numpy()[kept], "grams": [grams[k] for k in kept]})

    return texts.select("item", "text").mapInPandas(run, "item long, grams array<long>")


def _stock_table(texts: DataFrame) -> DataFrame:
    """(gram): `stock_grams` of all items as a table, for item sets that no task could hold.

    As in `variants`, an item is linked to the first holder of its rarest
    q-grams only, so that a q-gram that many items hold makes no pairs among
    them.
    """
    grams = durable(_item_grams(texts))
    held = grams.select("item", F.explode("grams").alias("gram"))
    shared = durable(held.groupBy("gram").agg(F.count("*").alias("n"), F.min("item").alias("first")).where("n > 1"))
    mine = grams.select("item", F.size("grams").alias("size"), F.posexplode("grams").alias("at", "gram")).join(shared, "gram", "left")
    order = Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(1)), F.shiftrightunsigned("gram", 1), F.col("gram").bitwiseAND(1))
    rare = mine.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * VARIANT) + 1) & (F.col("first") < F.col("item")))
    near = rare.select("item", "first").distinct().join(grams.select("item", F.col("grams").alias("a")), "item").join(grams.select(F.col("item").alias("first"), F.col("grams").alias("b")), "first")
    alike = near.where(F.size(F.array_intersect("a", "b")) >= VARIANT * F.least(F.size("a"), F.size("b"))).select("item", "first")
    group = components(alike, "item", "first")
    owned = held.join(shared.select("gram"), "gram").join(group, F.col("item") == F.col("node"), "left").select("gram", F.coalesce("component", "item").alias("owner"))
    return owned.distinct().groupBy("gram").count().where(F.col("count") >= MANY).select("gram")


_BUILT: dict[str, Index] = {}


def _index(token: str, rows: list[tuple[list[int], str]], stock: np.ndarray | None) -> Index:
    """The index of a pass, built once in a worker that runs several of its tasks."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Index.build([(k, text) for k, (_, text) in enumerate(rows)], stock)
    return _BUILT[token]


def leak_stretches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, item_words, evidence): the longest verified passage of each pair.

    Null and empty texts have no rows; items of under 8 letters can't be
    found; empty tables give none; further columns are ignored. Equal item
    texts are searched once and stand for all of their item_ids. The rows are
    the same for any number of passes.
    """
    spark = documents.sparkSession
    sized = items.where(F.length("text") > 0).select("item_id", "text")
    size = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // PASS_BYTES))
    docs = spread(documents.where(F.length("text") > 0).select("doc_id", "text"), "doc_id")
    texts = sized.groupBy("text").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).select("ids", "text")
    if passes > 1:
        texts = durable(texts.select("ids", "text", F.col("ids")[0].alias("item"), F.pmod(F.xxhash64("text"), F.lit(passes)).alias("pass")))
        held = _item_grams(texts).join(texts.select("item", "pass"), "item").select("pass", F.explode("grams").alias("gram")).distinct()
        stock = durable(_stock_table(texts).join(held, "gram"))
    found = None
    for p in range(passes):
        part = texts.where(F.col("pass") == p) if passes > 1 else texts
        rows = [(list(r.ids), r.text) for r in part.orderBy("ids", "text").collect()]  # about PASS_BYTES
        known = np.sort(np.array([r.gram for r in stock.where(F.col("pass") == p).collect()], dtype=np.int64).view(np.uint64)) if passes > 1 else None  # q-grams of these rows only
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows, known))

        def run(batches, shared=shared):
            token, rows, known = shared.value
            index = _index(token, rows, known)
            for batch in batches:
                ids, texts, found, at, chars = batch["doc_id"].tolist(), batch["text"].tolist(), [], 0, 0
                for k, t in enumerate(texts):
                    chars += len(t)
                    if chars > 400_000 or k == len(texts) - 1:
                        found += scan(ids[at : k + 1], texts[at : k + 1], index)
                        at, chars = k + 1, 0
                found = [(d, i, *rest) for d, k, *rest in found for i in rows[k][0]]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "words", "item_words", "evidence"])

        got = docs.mapInPandas(run, "doc_id long, item_id long, words int, item_words int, evidence int")
        found = got if found is None else found.unionByName(got)
    return found


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id) of documents that hold at least `share` of an item's words in one passage."""
    return leak_stretches(documents, items).where(F.col("words") >= F.col("item_words") * share).select("doc_id", "item_id").distinct()
