from pyspark.sql import functions as F

from quern.llm import names as N
from quern.llm.components import components

SAME = ["Kepibipul Tetitoval Laboratories GmbH", "kepibipul tetitoval laboratories", "Kepibipul-Tetitöval Labs", "Kepi. Tetito. Laboratories (Brackwater)", "KepiTeti Laboratories", "Tetitoval, Kepibipul Laboratories", "Kepibipul Tetitoval", "Kiepibipul  Tetitoval Laboratories San Teroso office"]
OTHER = ["Kepibipul Tetitoval Foods S.A.", "Gisolonur-Kolelunas Logistics", "Kepibipul Kolelunas Laboratories", None, "", " ", "GmbH", "?", "x" * 4000]


def test_links(spark):
    df = spark.createDataFrame([("company", n) for n in SAME * 2 + OTHER], "field string, name string")
    got = {(r.name_a, r.name_b) for r in N.link_names(df).collect()}
    want = {tuple(sorted(p)) for i, a in enumerate(SAME) for p in ((a, b) for b in SAME[i + 1 :])}
    want.add(tuple(sorted(("Kepibipul Tetitoval", "Kepibipul Tetitoval Foods S.A."))))
    assert got == want
    assert N.link_names(df.where(F.lit(False))).count() == 0


def test_schools_differ_by_kind():
    assert N.parse_name("Acad. of Arts of Modanopos & Lamupobas", N.SCHOOLS)[:2] == (["modanopos", "lamupobas"], "academy arts")
    assert N.parse_name("University of Bero. Psubokol, Eastmere", N.SCHOOLS)[:2] == (["bero", "psubokol"], "university")


def test_places_after_proper_words(spark):
    names = ["Alpha Beta Gamma Berlin office", "Alpha Beta Delta Berlin office", "Motonal Keruvin", "Motonal Keruvin New Harbour office", "Motonal Keruvin Sulibar Oslo office", "Motonal Keruvin Sulibar", "Global Technology Group"]
    parsed = {r.name: list(r.proper) for r in N.parsed_names(spark.createDataFrame([("company", n) for n in names], "field string, name string")).collect()}
    assert parsed[names[0]] == ["alpha", "beta", "gamma"] and parsed[names[1]] == ["alpha", "beta", "delta"]
    assert parsed[names[3]] == ["motonal", "keruvin"] and parsed[names[4]] == ["motonal", "keruvin", "sulibar"]
    assert parsed[names[6]]


def test_prefix_filter_loses_no_pair(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice(["ka", "lo", "mi", "pe", "tu", "sor"]) for _ in range(4)) for _ in range(60)]
    words = sorted({w[:k] + "x" + w[k:] for w in base for k in (0, 4, len(w))} | set(base))
    keys = spark.createDataFrame([("f", w, [w]) for w in words], "field string, key string, proper array<string>")
    found = {(r.key_a, r.key_b) for r in N.candidate_pairs(keys).collect()}
    g = {w: set(N._grams([w])) for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if len(g[a] & g[b]) >= N.GRAM_SIMILARITY * len(g[a] | g[b]):
                assert (a, b) in found


def test_components(spark):
    links = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), *[(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "p string, q string"), "p", "q").collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["n040"] == "n000" and "z" not in got
