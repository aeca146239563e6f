import random

import pytest
from pyspark.sql import functions as F

from quern.llm import canonical as C
from quern.llm.bktree import BKTree, levenshtein


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_distance_and_tree_against_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    for _ in range(2000):
        a, b = rng.choice(words), rng.choice(words)
        assert levenshtein(a, b) == slow(a, b)
    tree = BKTree()
    for i, w in enumerate(words):
        tree.add(w, i)
    for w in words[:40]:
        for r in (0, 1, 3):
            found = sorted(p for _, _, ps in tree.within(w + "a", r) for p in ps)
            assert found == [i for i, x in enumerate(words) if slow(w + "a", x) <= r]
    assert BKTree().within("a", 3) == []


TITLES = [(1, "Platform Engineer", "title", ["infrastructure platform engineer"]), (2, "Registered Nurse", "title", ["rn", "staff nurse", "Krankenpfleger"]), (3, "Data Engineer", "title", None), (4, "Kafka", "skill", []), (5, "Machine Learning Engineer", "title", ["mle"])]
VALUES = [
    ("Engineer, Platform - remote", 1), ("Sr. Platform Eng.", 1), ("Platfrom_Engineer", 1), ("NURSE, REG.", 2), ("Staff nurse", 2), ("Krnakenpfleger (m/f/d)", 2), ("rn", 2), ("rm", 0), ("Princitpal Data Engr II", 3),
    ("Kafka", 0), ("Beekeeper", 0), ("(contract), mle", 5), ("Nursery Gardener", 0), ("x" * 5000, 0), ("???", 0),
]


@pytest.mark.parametrize("shard", [50_000, 2])
def test_titles(spark, shard):
    tax = spark.createDataFrame(TITLES, "entry_id long, canonical_name string, entry_kind string, aliases array<string>").where("entry_kind = 'title'")
    values = spark.createDataFrame([(v, 0) for v, _ in VALUES] * 2 + [(None, 0), ("  ", 0), ("", 0)], "job_title string, entry_id int")
    got = {r.value: r.entry_id for r in C.map_to_entries(values, "job_title", tax, shard).collect()}
    want = dict(VALUES)
    assert {v: got[v] for v in want} == want
    assert None not in got and "" not in got


def test_rows_and_empty_tables(spark):
    tax = spark.createDataFrame(TITLES, "entry_id long, canonical_name string, entry_kind string, aliases array<string>")
    e = spark.createDataFrame([(1, "rn"), (2, "rn"), (3, None), (4, " ")], "row_id long, job_title string")
    assert sorted(tuple(r) for r in C.titles_to_entries(e, tax).collect()) == [(1, 2), (2, 2)]
    assert C.titles_to_entries(e.where(F.lit(False)), tax).count() == 0
    assert {r.entry_id for r in C.titles_to_entries(e, tax.where(F.lit(False))).collect()} == {0}


def test_wordings_with_many_readings_keep_their_tolerance():
    phrases = [("alpha beta gamma delta", 7)]
    matcher = C.Matcher(phrases)
    many = [["a", "alpha", *[f"a{k}" for k in range(20)]], ["beta", *[f"b{k}" for k in range(20)]], ["gama", *[f"g{k}" for k in range(20)]], ["delta", *[f"d{k}" for k in range(20)]]]
    assert matcher.best([many]) == (1, 7) == matcher.best([[["alpha"], ["beta"], ["gama"], ["delta"]]])
    assert matcher.best([[[f"x{k}" for k in range(90)], ["beta"], [f"y{k}" for k in range(90)], ["delta"]]]) is None


def test_many_readings_give_what_listing_them_gives(monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 6)))
    shards = [[(" ".join(word() for _ in range(rng.randrange(1, 4))), rng.randrange(40)) for _ in range(30)] for _ in range(60)]
    asked = [[[[word() for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 4))] for _ in range(2)] for _ in shards]
    shards += [[("data base engineer", 4)], [("database engineer", 4)], [("abcd e", 9)], [("abcde", 9)]]
    asked += [[[["database"], ["engineer"]]], [[["data"], ["base", "bases"], ["engineer"]]], [[["abcde", "abcd"], ["f", "g"]]], [[["abcd"]]]]
    listed = [C.Matcher(s).best(w) for s, w in zip(shards, asked, strict=True)]
    monkeypatch.setattr(C, "LISTED", 0)
    assert [C.Matcher(s).best(w) for s, w in zip(shards, asked, strict=True)] == listed
    assert sum(x is not None for x in listed) > 20
