import json

from pyspark.sql import functions as F

from quern.operators import nested as N

BODY = {"experience": [None, {"jobTitle": "x", "responsibilities": ["a", " ", None, {"text": "b"}, {"text": None}], "projects": {"name": "p", "technologiesUsed": "Spark"}}], "education": {"degree": [{"name": "BA"}, ""]}, "projects": [{"technologies_used": []}]}
WANT = {"experience/1", "experience/1/responsibility/0", "experience/1/responsibility/3", "experience/1/project/0", "experience/1/project/0/technology/0", "education/0", "education/0/degree/0", "project/0"}


def frame(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id long, payload string, path string")


def test_shapes_and_envelopes(spark):
    payloads = [json.dumps(BODY), json.dumps({"resume": BODY}), json.dumps({"resume": json.dumps(BODY)}), json.dumps({"result": {"data": {"resume": {"sections": BODY}}}})]
    got = {}
    for r in N.child_paths(frame(spark, payloads)).collect():
        got.setdefault(r.raw_id, []).append(r.path)
    assert all(sorted(got[i]) == sorted(WANT) for i in range(4))


def test_broken_and_empty(spark):
    payloads = ["", None, "{", "null", "[]", '{"error": "timeout"}', '{"experience": null}', '{"experience": []}', '{"experience": ["", " ", "clerk"]}', '"text"', "7"]
    assert [tuple(r) for r in N.child_paths(frame(spark, payloads)).collect()] == [(8, "experience/2")]
    assert N.child_paths(frame(spark, ["{}"]).where(F.lit(False))).count() == 0


def test_tables_hold_the_same_rows(spark):
    tables = N.child_tables(frame(spark, [json.dumps(BODY)] * 2), "raw_id")
    assert set(tables) == {"experience", "experience_responsibility", "experience_project", "experience_project_technology", "education", "education_degree", "project", "project_technology"}
    rows = {n: t.collect() for n, t in tables.items()}
    assert sorted(r.path for t in rows.values() for r in t) == sorted(list(WANT) * 2)
    tech = rows["experience_project_technology"][0]
    assert (tech.parent_key, tech.ordinal, tech.text) == ("experience/1/project/0", 0, "Spark")
    keys = {(r.raw_id, r.path) for t in rows.values() for r in t}
    assert all(not r.parent_key or (r.raw_id, r.parent_key) in keys for t in rows.values() for r in t)


def test_schema_and_levels_are_found(spark):
    odd = {"Doc-Root": {"in it's": {"Experience_s": {"RESPONSIBILITIES": "x"}, "projects": [{"technology used": ["a", {"name": "b"}]}]}}}
    df = frame(spark, [json.dumps(BODY), json.dumps({"resume": json.dumps(BODY)}), json.dumps(odd), "{"])
    schema = {(tuple(r.path), r.kind) for r in N.merged_schema(df, "payload").collect()}
    assert {(("experience",), "array"), (("experience", "[]", "projects", "technologiesUsed"), "text"), (("resume", "{text}", "education", "degree"), "array"), (("Doc-Root", "in it's"), "object")} <= schema
    places, levels = N.found_levels([p for p, _ in schema])
    assert set(places) == {(), ("resume", "{text}"), ("Doc-Root", "in it's")} and levels[0].keys == ("experience", "Experience_s")
    got = {r.path for r in N.child_paths(df).where("raw_id = 2").collect()}
    assert got == {"experience/0", "experience/0/responsibility/0", "project/0", "project/0/technology/0", "project/0/technology/1"}
