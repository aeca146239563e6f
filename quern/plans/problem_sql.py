"""DuckDB SQL of the record problems that SQL can express."""

from __future__ import annotations


def _list(x: str) -> str:
    """Members of a JSON value as a list; a single value is a list of one, null has none."""
    return f"(case when {x} is null or json_type({x})='NULL' then []::json[] when json_type({x})='ARRAY' then json_extract({x},'$[*]') else [{x}] end)"


def _filled(x: str) -> str:
    return f"(length(regexp_replace(coalesce({x},''),'[ \\t\\n\\r\\f\\x0B]+','','g'))>0)"


def _has_text(m: str) -> str:
    """Whether a member is a text, or an object whose text or name is one."""
    inner = f"({_filled(m + '->>' + chr(39) + '$.text' + chr(39))} or {_filled(m + '->>' + chr(39) + '$.name' + chr(39))})"
    return f"(case json_type({m}) when 'OBJECT' then {inner} when 'ARRAY' then false when 'NULL' then false else {_filled(m + '->>' + chr(39) + '$' + chr(39))} end)"


def _key(x: str, *names: str) -> str:
    """The first member of an object under any of the spellings that isn't null."""
    tries = ",".join(f"case when json_type({x},'$.{n}')<>'NULL' then json_extract({x},'$.{n}') end" for n in names)
    return f"coalesce({tries})"


def _level(name: str, source: str, list_sql: str, prefix: str, item: bool) -> str:
    keep = _has_text("m") if item else f"(json_type(m)='OBJECT' or {_has_text('m')})"
    return f"""{name} as (select raw_id, path pk, i-1 place, {prefix}||(i-1) path, m from (select raw_id, path, i, l[i] m from (select raw_id, path, l, unnest(range(1,len(l)+1)) i from (select raw_id, path, {list_sql} l from {source}))) where m is not null and {keep})"""


def oracle_sql() -> dict[str, str]:
    tech = _list(_key("m", "technologies_used", "technologiesUsed"))
    levels = [
        _level("ex", "b", _list("json_extract(m,'$.experience')"), "'experience/'", False),
        _level("re", "ex", _list("json_extract(m,'$.responsibilities')"), "path||'/responsibility/'", True),
        _level("ep", "ex", _list("json_extract(m,'$.projects')"), "path||'/project/'", False),
        _level("et", "ep", tech, "path||'/technology/'", True),
        _level("ed", "b", _list("json_extract(m,'$.education')"), "'education/'", False),
        _level("de", "ed", _list("json_extract(m,'$.degree')"), "path||'/degree/'", True),
        _level("pr", "b", _list("json_extract(m,'$.projects')"), "'project/'", False),
        _level("te", "pr", tech, "path||'/technology/'", True),
    ]
    tables = {"ex": "experience", "re": "experience_responsibility", "ep": "experience_project", "et": "experience_project_technology", "ed": "education", "de": "education_degree", "pr": "project", "te": "project_technology"}
    every = " union all ".join(f"select raw_id, path from {n}" for n in tables)
    inner = lambda k: f"case when {_filled(f'm->>{chr(39)}$.{k}{chr(39)}')} then m->>'$.{k}' end"
    text = f"case json_type(m) when 'OBJECT' then coalesce({inner('text')},{inner('name')}) when 'ARRAY' then null else m->>'$' end"
    rows = " union all ".join(f"select raw_id, '{t}' child_table, pk parent_key, path, place::int ordinal, {text} as text from {n}" for n, t in tables.items())
    body = """case when json_type(j,'$.resume')='VARCHAR' then case when json_valid(j->>'$.resume') then (j->>'$.resume')::json end
 when json_type(j,'$.resume')='OBJECT' then json_extract(j,'$.resume') when json_type(j,'$.result.data.resume.sections')='OBJECT' then json_extract(j,'$.result.data.resume.sections') else j end"""
    head = f"""with r as (select raw_id, payload::json j from resume_raw where json_valid(payload)), b as (select raw_id, '' path, {body} m from r where json_type(j)='OBJECT'), {", ".join(levels)}"""
    return {"p7_found": f"{head} {every}", "p7_tables": f"{head} {rows}"}
