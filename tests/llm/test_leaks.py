import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import leaks as L

ITEM = "The larvae of datate feed on poroth moss until 29 days old and then spin a sokofol cocoon weighing 258.5 mg. Students who titrate bunute against kurute observe a plateau near 754.7, followed by a second tedad shoulder at 318.9."
LIKE = "The larvae of kopune feed on ribal moss until 61 days old and then spin a menek cocoon weighing 112.7 mg. Students who titrate lorad against simel observe a plateau near 120.3, followed by a second gofun shoulder at 77.1."
CJK = "将重320.3克的嵘岚砚药片浸入菱潼栎盐水51分钟，再用峥嵘翎钩取出放在岚钰煊盘上。槿峥岚相变色期间有795.6毫升菱沐槿蒸汽逸向岚潼棠收集器。"


def test_distance():
    rng = random.Random(4)
    pairs = []
    for _ in range(60):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(0, len(b) + 1)
            b[k : k + rng.randrange(0, 2)] = [rng.randrange(1, 5)] * rng.randrange(0, 2)
        pairs.append((np.array(a, np.uint8), np.array(b, np.uint8)))

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    assert L.banded_distances(pairs).tolist() == [slow(a, b) for a, b in pairs]


def test_leaks(spark):
    words = ITEM.split()
    docs = {
        1: "Intro. " + ITEM + " Outro.", 2: ITEM.upper().replace(" ", "\n"), 3: "X " + " ".join(words[:20]) + " y.", 4: "X " + " ".join(words[8:13]), 5: LIKE, 6: None, 7: "",
        8: ITEM.replace("a", "а").replace("5", "５").replace("moss", "mo​ss"), 9: ITEM.replace("feed", "live").replace("observe", "see"), 10: " ".join(words[:18]) + " An inserted sentence stands here between both. " + " ".join(words[18:]),
        11: "前文。" + CJK[10:50] + "后文。", 12: CJK[:8], 13: ITEM.replace("e", "c").replace("o", "0"), 14: "z " * 50_000 + ITEM,
    }
    d = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(100, ITEM), (200, CJK), (300, None), (400, "ab"), (500, LIKE.replace("61", "99").replace("kopune", "tasol"))], "item_id long, text string")
    got = {tuple(r) for r in L.leaks(d, items).collect()}
    assert {(k, i) for k, i in got if i == 100} == {(k, 100) for k in (1, 2, 3, 8, 9, 10, 13, 14)}
    assert {(k, i) for k, i in got if i == 200} == {(11, 200)}
    assert L.leaks(d.where(F.lit(False)), items).count() == 0 and L.leaks(d, items.where(F.lit(False))).count() == 0


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(L, "PASS_BYTES", 300)
    d = spark.createDataFrame([(1, ITEM), (2, CJK)], "doc_id long, text string")
    items = spark.createDataFrame([(100, ITEM), (200, CJK)], "item_id long, text string")
    assert {tuple(r) for r in L.leaks(d, items).collect()} == {(1, 100), (2, 200)}


def test_repeated_and_nearly_equal_items(spark):
    words = ITEM.split()
    near = ITEM.replace("near 754.7", "near 754.9").replace("29 days", "31 days")
    d = spark.createDataFrame([(1, "Intro. " + ITEM), (2, "X " + " ".join(words[12:27]) + " y."), (3, LIKE), (4, CJK)], "doc_id long, text string")
    items = spark.createDataFrame([(100, ITEM), (100, ITEM), (101, ITEM), (102, near), (103, ITEM.upper()), (200, CJK), (201, CJK)], "item_id long, text string")
    want = {(k, i) for k in (1, 2) for i in (100, 101, 102, 103)} | {(4, 200), (4, 201)}
    assert {tuple(r) for r in L.leaks(d, items).collect()} == want


def test_rows_do_not_depend_on_passes(spark, monkeypatch):
    words, like = ITEM.split(), LIKE.split()
    half = " ".join(words[:19])
    texts = {100: ITEM, 101: ITEM + " More.", 102: half + " " + " ".join(w[::-1] for w in like[19:]), 103: LIKE, 200: CJK, 201: CJK[:40] + "又及", 300: ITEM.lower()}
    d = spark.createDataFrame([(1, "X " + ITEM), (2, "Y " + half + " z."), (3, LIKE), (4, CJK), (5, " ".join(words[24:]))], "doc_id long, text string")
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    whole = {tuple(r) for r in L.leak_stretches(d, items).collect()}
    found = {r[:2] for r in whole if r[2] >= 0.3 * r[3]}
    assert {(1, 100), (1, 101), (1, 300), (2, 100), (2, 102), (4, 200), (4, 201)} <= found
    monkeypatch.setattr(L, "PASS_BYTES", 150)
    assert {tuple(r) for r in L.leak_stretches(d, items).collect()} == whole


def test_index_grows_in_proportion():
    import time

    rng = random.Random(1)
    took = []
    for n in (2_000, 20_000):
        rows = [(k, "".join(rng.choice("abdfghjkmnpqrtuvwxyz") for _ in range(120))) for k in range(n)]
        began = time.time()
        L.Index.build(rows)
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 2
