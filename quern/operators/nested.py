"""Deeply nested semi-structured records to flat child tables.

The schema is inferred over all records first and merged: every path that
occurs, with the kinds of values met there. From it come the places in their
envelopes where records lie and the spellings of every wanted member, so that
each record is then parsed once into a VARIANT and read by exact paths.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import durable


@dataclass(frozen=True)
class Wanted:
    """A table that is wanted: its name, the beginning of its member's name (folded), the tables below.

    item: members are texts or objects whose text is their `text` or `name`.
    """

    name: str
    stem: str
    item: bool = False
    below: tuple[Wanted, ...] = ()


_PROJECT = Wanted("project", "project", below=(Wanted("technology", "technolog", item=True),))
RESUME = (
    Wanted("experience", "experience", below=(Wanted("responsibility", "responsibilit", item=True), _PROJECT)),
    Wanted("education", "education", below=(Wanted("degree", "degree", item=True),)),
    _PROJECT,
)


@dataclass(frozen=True)
class Level:
    """One array level as found: its table, the spellings of its member, the levels below."""

    name: str
    keys: tuple[str, ...]
    item: bool
    below: tuple[Level, ...]


#: Steps of a schema path besides member names: the members of an array, a record written as JSON text.
MEMBERS, QUOTED = "[]", "{text}"


def _shapes(value, at: tuple[str, ...], found: set) -> None:
    todo = [(value, at)]
    while todo:
        v, path = todo.pop()
        if isinstance(v, dict):
            found.add((path, "object"))
            todo += [(x, (*path, k)) for k, x in v.items()]
        elif isinstance(v, list):
            found.add((path, "array"))
            todo += [(x, (*path, MEMBERS)) for x in v]
        elif v is not None:
            found.add((path, "text" if isinstance(v, str) else "scalar"))
            if isinstance(v, str) and v.lstrip()[:1] == "{":
                try:
                    inner = json.loads(v)
                except (ValueError, RecursionError):
                    continue
                todo.append((inner, (*path, QUOTED)))


def merged_schema(raw: DataFrame, payload: str) -> DataFrame:
    """(path array<string>, kind): every path of all readable payloads with each kind of value met there, once.

    Steps are member names, `[]` for the members of an array and `{text}` for
    JSON inside a text; broken and null payloads have none.
    """

    def run(batches):
        for batch in batches:
            found: set = set()
            for text in batch["_p"]:
                try:
                    _shapes(json.loads(text), (), found)
                except (ValueError, RecursionError):
                    continue
            rows = sorted(found)
            yield pd.DataFrame({"path": pd.Series([list(p) for p, _ in rows], dtype=object), "kind": pd.Series([k for _, k in rows], dtype=object)})

    texts = raw.select(F.col(payload).cast("string").alias("_p")).where(F.col("_p").isNotNull())
    return texts.mapInPandas(run, "path array<string>, kind string").distinct()


def _fold(key: str) -> str:
    return re.sub("[^A-Za-z0-9]", "", key).lower()


def found_levels(paths: list[tuple[str, ...]], wanted: tuple[Wanted, ...] = RESUME) -> tuple[list[tuple[str, ...]], tuple[Level, ...]]:
    """(places, levels): where records lie in their envelopes, the nearest first, and the levels of the wanted tables.

    A place is a path without arrays that has a wanted member; the spellings
    of a level are those found below any of its parents.
    """
    members: dict[tuple[str, ...], set[str]] = {}
    for p in paths:
        if p and p[-1] not in (MEMBERS, QUOTED):
            members.setdefault(p[:-1], set()).add(p[-1])
    stems = tuple(w.stem for w in wanted)
    places = sorted((p for p, keys in members.items() if MEMBERS not in p and any(_fold(k).startswith(stems) for k in keys)), key=lambda p: (len(p), p))
    inside = [w for w in places if not any(_fold(k).startswith(stems) for k in w)]

    def level(parents: list[tuple[str, ...]], w: Wanted) -> Level:
        hits = sorted({(p, k) for p in parents for k in members.get(p, ()) if _fold(k).startswith(w.stem)})
        nodes = [n for p, k in hits for n in ((*p, k), (*p, k, MEMBERS))]
        return Level(w.name, tuple(sorted({k for _, k in hits}, key=lambda k: (len(_fold(k)), k))), w.item, tuple(level(nodes, b) for b in w.below))

    return inside, tuple(level(inside, w) for w in wanted)


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _get(v: Column, path: tuple[str, ...], kind: str = "variant") -> Column:
    """The value at a path of member names; a part written as JSON text is parsed."""
    at, steps = v, []
    for step in path:
        if step == QUOTED:
            at, steps = F.try_parse_json(F.try_variant_get(at, _path(steps), "string")), []
        else:
            steps.append(step)
    return F.try_variant_get(at, _path(steps), kind)


def _path(steps: list[str]) -> str:
    quoted = [f"['{s}']" if "'" not in s else f'["{s}"]' for s in steps]
    return "$" + "".join(quoted)


def _filled(v: Column) -> Column:
    return F.when(v.isNotNull() & ~F.is_variant_null(v), v)


def _member(v: Column, keys: tuple[str, ...]) -> Column:
    """The first of the members of these names that is there and not null."""
    return F.coalesce(*[_filled(_get(v, (k,))) for k in keys]) if keys else F.lit(None).cast("variant")


def _as_list(v: Column) -> Column:
    """The members of an array; a single value or object counts as a list of one; null has none."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.coalesce(_array(v), F.array(v)))


def _blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+", "") == "", F.lit(True))


def _object(v: Column) -> Column:
    """Of an object its text and name, which may be null; null for anything else."""
    return F.try_variant_get(v, "$", "struct<text:variant,name:variant>")


def _text(v: Column, item: Column) -> Column:
    """Text of an item: a scalar itself, of an object its text or name; item is its `_object`."""
    named = [F.try_variant_get(item[k], "$", "string") for k in ("text", "name")]
    first = F.coalesce(*[F.when(~_blank(t), t) for t in named])
    return F.when(item.isNotNull(), first).when(_array(v).isNull(), F.try_variant_get(v, "$", "string"))


def parse_records(raw: DataFrame, id_col: str, payload: str, places: list[tuple[str, ...]], levels: tuple[Level, ...]) -> DataFrame:
    """(id, body): of each record the object at the nearest place that has any of the wanted members.

    Broken payloads and those without any of the wanted members give no row.
    """
    keys = tuple(k for level in levels for k in level.keys)
    rows = raw.select(id_col, F.try_parse_json(F.col(payload)).alias("_v")).where(F.col("_v").isNotNull())
    if not places or not keys:
        return rows.select(id_col, F.col("_v").alias("body")).where(F.lit(False))
    rows = rows.withColumn("_spots", F.array_compact(F.array(*[_get(F.col("_v"), p) for p in places])))  # each place is read once
    good = F.filter("_spots", lambda s: _member(s, keys).isNotNull())
    return rows.select(id_col, F.try_element_at(good, F.lit(1)).alias("body")).where(F.col("body").isNotNull())


CHILD = "at string, parent_key string, path string, ordinal int, text string"


def child_rows(raw: DataFrame, id_col: str = "raw_id", payload: str = "payload", wanted: tuple[Wanted, ...] = RESUME) -> DataFrame:
    """(id, at, parent_key, path, ordinal, text): every child of every readable payload, in one pass over the records.

    at: name of the child's table. path: its key, unique within the record;
    parent_key: the key of its parent, '' at the top; ordinal: 0-based place in
    the source array, empty members counted. A payload is parsed once, each
    round explodes one array level of all parents, and nothing is shuffled.
    Null members, null, empty and blank texts are no children, broken payloads
    have no rows, repeated ids are kept.
    """
    schema = [tuple(r.path) for r in merged_schema(raw, payload).select("path").distinct().collect()]  # one row a path of the schema
    places, levels = found_levels(schema, wanted)
    rows = parse_records(raw, id_col, payload, places, levels)
    rows = rows.select(id_col, F.lit("").alias("at"), F.lit("").alias("parent_key"), F.lit("").alias("path"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("text"), F.col("body").alias("v"))
    wave: dict[str, tuple[Level, ...]] = {"": levels}
    while any(wave.values()):
        fresh = {f"{at}_{x.name}" if at else x.name: x for at, below in wave.items() for x in below}
        own = F.array(F.struct("at", "parent_key", "path", "ordinal", "text", F.lit(None).cast("variant").alias("v")))
        lists = []
        for k, (at, x) in enumerate((at, x) for at, below in wave.items() for x in below):
            name = f"{at}_{x.name}" if at else x.name
            rows = rows.withColumn(f"_v{k}", F.when(F.col("at") == at, _member(F.col("v"), x.keys)))
            child = lambda m, i, name=name, x=x: F.struct(
                F.lit(name).alias("at"), F.col("path").alias("parent_key"), F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("/"))).otherwise(""), F.lit(f"{x.name}/"), i.cast("string")).alias("path"),
                i.cast("int").alias("ordinal"), F.lit(None).cast("string").alias("text"), m.alias("v"),
            )
            lists.append(F.transform(_as_list(F.col(f"_v{k}")), _two(child)))
        rows = rows.select(id_col, F.explode(F.concat(F.filter(own, lambda r: r["at"] != ""), *[F.coalesce(x, F.slice(own, 1, 0)) for x in lists])).alias("c")).select(id_col, "c.*")
        born = F.col("v").isNotNull()
        rows = rows.where(~born | ~F.is_variant_null("v")).withColumn("_o", F.when(born, _object(F.col("v")))).withColumn("text", F.when(born, _text(F.col("v"), F.col("_o"))).otherwise(F.col("text")))
        items = [n for n, x in fresh.items() if x.item]
        rows = rows.where(~born | ~_blank(F.col("text")) | (~F.col("at").isin(*items) & F.col("_o").isNotNull())).drop("_o")
        wave = {n: x.below for n, x in fresh.items()}
    return rows.select(id_col, "at", "parent_key", "path", "ordinal", "text")


def child_tables(raw: DataFrame, id_col: str = "raw_id", payload: str = "payload", wanted: tuple[Wanted, ...] = RESUME) -> dict[str, DataFrame]:
    """One flat table per wanted array level: (id, parent_key, path, ordinal, text), from rows written once."""
    rows = durable(child_rows(raw, id_col, payload, wanted))

    def names(levels: tuple[Wanted, ...], at: str = "") -> list[str]:
        return [n for x in levels for name in (f"{at}_{x.name}" if at else x.name,) for n in (name, *names(x.below, name))]

    return {n: rows.where(F.col("at") == n).drop("at") for n in names(wanted)}


def child_paths(raw: DataFrame, id_col: str = "raw_id", payload: str = "payload", wanted: tuple[Wanted, ...] = RESUME) -> DataFrame:
    """(id, path): the keys of all `child_rows`."""
    return child_rows(raw, id_col, payload, wanted).select(id_col, "path")


def _two(f):
    """f as a lambda of exactly two arguments, which is what tells transform to pass the index."""
    return lambda m, i: f(m, i)
