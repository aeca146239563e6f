import random

import pytest
from pyspark.sql import functions as F

from quern.llm import packing as P


def test_first_fit_decreasing_against_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        cap = rng.randrange(5, 50)
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            b = next((i for i, r in enumerate(room) if r >= s), len(room))
            if b == len(room):
                room.append(cap)
            room[b] -= s
            want.append(b)
        assert P.first_fit_decreasing(sizes, cap) == want


def test_counts_are_exact():
    c = P.TokenCounter()
    for text in ("Hello world, it's 12.5 mm!\n\n  x", "密封電極98bは省略してもよい。", "डॉ. X", "<|endoftext|>", " " * 50, "a" * 3000):
        assert c(text) == len(c.encoding.encode_ordinary(text))


@pytest.mark.parametrize("group", [8192, 4])
def test_containers(spark, group):
    docs = [(i, f"word {i} " * (i % 40 + 1), "ja" if i % 3 else "JP") for i in range(60)] + [(100, None, "ja"), (101, "", None), (102, "long text " * 900, None), (102, "long text " * 900, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    specs = spark.createDataFrame([(1, 64, None), (2, 200, "ja"), (3, 0, None), (4, None, None)], "spec_id int, capacity_tokens int, lang string")
    rows = P.fill_containers(d, specs, group=group).collect()
    assert {r.spec_id for r in rows} == {1, 2} and not {r.doc_id for r in rows} & {100, 101}
    assert {r.doc_id for r in rows if r.spec_id == 2} == set(range(60))
    load, count = {}, P.TokenCounter()
    for r in rows:
        load[r.spec_id, r.container_id] = load.get((r.spec_id, r.container_id), 0) + r.n_tokens
    assert all(t <= {1: 64, 2: 200}[s] for (s, _), t in load.items())
    assert sum(r.n_tokens for r in rows if r.spec_id == 1) == sum(count(t) for _, t, _ in docs if t)
    pieces = sorted((r.first_token, r.n_tokens) for r in rows if r.spec_id == 1 and r.doc_id == 102)
    assert pieces[0][1] == 64 and pieces[-1][1] <= 64
    size = {i: count(t) for i, t, _ in docs if t}
    assert all(r.piece_no == 0 and r.n_tokens == size[r.doc_id] for r in rows if r.spec_id == 2 and size[r.doc_id] <= 200)
    assert P.fill_containers(d.where(F.lit(False)), specs).count() == 0


def test_languages(spark):
    rows = spark.createDataFrame([("JA",), ("jp",), ("zh-CN",), ("ger",), (None,), (" ko-XX",)], "l string")
    assert [r[0] for r in rows.select(P.language(F.col("l"))).collect()] == ["ja", "ja", "zh", "de", None, "ko"]
