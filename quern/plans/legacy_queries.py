"""Queries of the older generation's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import legacy as G
from quern.operators import retrieval as R
from quern.operators import scoring as S
from quern.operators import sections as X
from quern.operators import skills as K
from quern.plans import pair_queries as PQ
from quern.plans import pair_sql as PSQL
from quern.plans import reference_queries as Q
from quern.plans import reference_sql as SQL
from quern.session import durable
from quern.sources.tables import balanced, table

KEYS = ["id", "query_id"]


def l1_normalize(spark, sf):
    e = table(spark, sf, "experience").select("job_title").where(F.col("job_title").isNotNull()).distinct()
    return e.select("job_title", G.plain_key(F.col("job_title")).alias("key"))


def l4_semantic_match(spark, sf):
    best = R.vector_top_k(table(spark, sf, "cpp_score"), "score_id", "resume_embedding", k=1)
    return best.where(F.col("cosine") >= 0.62).select("query_id", "doc_id", "cosine")


def l5_cascade(spark, sf):
    return Q.rounded(G.cascade(table(spark, sf, "experience"), "job_title", K.patterns(Q.taxonomy(spark, sf))))


def l7_grouped_forms(spark, sf):
    return Q.rounded(G.grouped_forms(G.cascade(table(spark, sf, "experience"), "job_title", K.patterns(Q.taxonomy(spark, sf))).where("method <> 'unmatched'")))


def _cascade_skills(spark, sf):
    """(id, canonical, category, confidence, method): the surest match of each name among the titles of a document."""
    found = G.cascade(table(spark, sf, "experience"), "job_title", K.patterns(Q.taxonomy(spark, sf)))
    every = Q.jobs(spark, sf).select("id", F.col("job_title").alias("value")).join(found, "value")
    return every.groupBy("id", "canonical").agg(F.max_by(F.struct("category", "confidence", "method"), F.struct("confidence", "category", "method")).alias("b")).select("id", "canonical", "b.*")


def _legacy(spark, sf):
    docs = durable(balanced(PQ.document_texts(spark, sf), "id"))
    parts = X.parsed(docs, "id", "text")
    c = table(spark, sf, "cpp_score").groupBy(F.col("doc_id").alias("id")).agg(F.max_by(F.struct("resume_embedding", "jd_embedding"), F.struct("scored_at", "score_id")).alias("v"))
    vectors = c.select("id", F.col("v.resume_embedding").alias("summary"), F.col("v.jd_embedding").alias("skills"))
    return G.raw_features(docs, Q.jobs(spark, sf), Q.schools(spark, sf), _cascade_skills(spark, sf), parts["projects"], parts["certificates"], vectors)


def l_raw_features(spark, sf):
    return _legacy(spark, sf)


def l11_normalised(spark, sf):
    return _legacy(spark, sf).select("id", *[T.half_up(T.half_up(v, 9), 4).alias(k) for k, v in S.legacy_normalised(G.FEATURES).items()])


def _heuristic(spark, sf):
    pairs = PQ.scored_pairs(spark, sf).select(*KEYS, R.signed_cosine(F.col("resume_embedding"), F.col("jd_embedding")).alias("similarity"))
    return S.heuristic_score(pairs.join(_legacy(spark, sf), "id"), KEYS, G.FEATURES, "similarity")


def l12_heuristic(spark, sf):
    return _heuristic(spark, sf).select(*KEYS, "retrieval_similarity", "score")


def _gaps(spark, sf, partial=0.5):
    pairs, required = Q._pairs(spark, sf)
    return K.gap_lists(K.gap(pairs, Q._skills(spark, sf), required, K.patterns(Q.taxonomy(spark, sf)), partial))


def l13_narrative(spark, sf):
    return G.narrative(durable(_heuristic(spark, sf)).join(_gaps(spark, sf, 0.45), KEYS), G.FEATURES)


def g1_prompt(spark, sf):
    rows = _gaps(spark, sf).join(Q.resumes(spark, sf), "id")
    return rows.select("id", "query_id", F.md5(G.insight_prompt(F.lit(Q.QUERY), F.col("text"), F.col("matched"), F.col("missing"))).alias("prompt_md5"))


def g2_answers(spark, sf):
    """Payloads of records read as if they were answers of a text service, with fences around every third."""
    raw = table(spark, sf, "resume_raw")
    answer = F.when(F.col("raw_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("payload"), F.lit("\n```"))).otherwise(F.col("payload"))
    summary, suggestions, again = G.model_answer(answer)
    return raw.select(F.when(again, "again").otherwise("read").alias("state"), F.size(suggestions).alias("n_suggestions"), summary.alias("summary")).groupBy("state", "n_suggestions", "summary").agg(F.count("*").alias("n"))


def s13_without_surface(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(G.without_surface(F.col("text"))).alias("text_md5"))


def u2_display(spark, sf):
    t = table(spark, sf, "skill_taxonomy").select("entry_id", F.lower("canonical_name").alias("name"))
    return t.select("entry_id", G.display_name(F.col("name")).alias("shown"))


def u2_feature_table(spark, sf):
    """Features of a document as rows, for display."""
    f = _legacy(spark, sf)
    return f.unpivot(["id"], G.FEATURES, "feature", "value").groupBy("feature").agg(F.count("*").alias("n"), T.half_up(F.max("value"), 4).alias("largest"))


_ALL = [l1_normalize, l4_semantic_match, l5_cascade, l7_grouped_forms, l_raw_features, l11_normalised, l12_heuristic, l13_narrative, g1_prompt, g2_answers, s13_without_surface, u2_display, u2_feature_table]


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    s, up = SQL._s, SQL._up
    key = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({SQL._low(c)},'[\\t\\n\\r]',' ','g'),'[^a-z0-9 +#.]','','g'),' +',' ','g'),' ')"
    held = "greatest(0," + ",".join(f"case when contains(lt,{s(w)}) then {v} else 0 end" for w, v in G.SENIORITY.items()) + ")"
    cascade = f"""with {SQL._PATTERNS}, tv0 as (select distinct job_title v from experience where trim(job_title,' ')<>''), nk as (select {key("pattern")} k, canonical, category from pt qualify row_number() over(partition by {key("pattern")} order by ord, alias_ord)=1),
 ex as (select v as value, canonical, category, 1.0::double confidence, 'exact' as method from tv0 join nk on nk.k={key("v")}), tv as (select v job_title from tv0 where {key("v")} not in (select k from nk)),
 {SQL._FUZZY.replace("0.18*", "0.12*").replace("sim>=0.82", "sim>=0.88")}, ct as (select canonical, min(category) category from pt group by 1), nr as (select value, fz.canonical, ct.category, sim confidence, 'fuzzy' as method from fz join ct on ct.canonical=fz.canonical),
 ca as (select * from ex union all select * from nr union all select job_title, job_title, 'Uncategorized', 0.3, 'unmatched' from tv where job_title not in (select value from nr))"""
    number = lambda rx, k: f"try_cast(nullif(regexp_extract(gpa,'{rx}',{k}),'') as double)"
    two, one = "([0-9]*\\.?[0-9]+)[ \\t\\n\\r]*/[ \\t\\n\\r]*([0-9]*\\.?[0-9]+)", "([0-9]*\\.?[0-9]+)"
    gpa = up(f"case when {number(two, 1)} is not null then case when {number(two, 2)}>0 then {number(two, 1)}/{number(two, 2)} end when {number(one, 1)}<=4 then {number(one, 1)}/4 else {number(one, 1)}/100 end", 4)
    norm = lambda v: up(f"sqrt(coalesce(list_sum(list_transform({v}, lambda x: power(case when x is null or isnan(x) then 0 else x::double end,2))),0))", 4)
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x},{y}), lambda p: p[1]::double*p[2]::double))"
    turn = lambda a, b: f"(case when len({a})=len({b}) and len({a})>0 and {dot(a, a)}>0 and {dot(b, b)}>0 and not isnan({dot(a, b)}) then least(1,{dot(a, b)}/(sqrt({dot(a, a)})*sqrt({dot(b, b)}))) else 0 end)"
    zero = ", ".join(f"coalesce({n},0)::double {n}" for n in G.FEATURES)
    raw = f"""with {PSQL._PARSE}, {cascade[5:]}, e1 as (select *, coalesce(greatest(0, coalesce({SQL._ym("end_date")},24319)-{SQL._ym("start_date")}),0) m, lower(coalesce(job_title,'')) lt from jb),
 e2 as (select id, sum(m)::double total_experience_months, count(*)::double num_positions, {up("avg(m)", 2)} avg_tenure_months, max(coalesce(is_current,false)::int)::double is_currently_employed, max(case when {held}=0 then {G.SENIORITY_DEFAULT} else {held} end)::double max_seniority_score, 1.0::double has_experience from e1 group by id),
 d2 as (select id, {SQL._ladder("degree", G.DEGREES, 0.0)} lvl, institution, lower(trim(coalesce(end_date,''),' ')) in ('present','current','now','ongoing') cur, {gpa} gs from sc),
 d3 as (select id, count(*)::double num_degrees, max(lvl) highest_degree_level, {up("coalesce(avg(gs),0)", 4)} gpa_normalized, max((gs is not null)::int)::double has_gpa, max(cur::int) is_currently_studying, count(distinct nullif(institution,''))::double num_institutions from d2 group by id),
 cs as (select id, canonical, category, confidence, method from (select jb.id, ca.* from jb join ca on ca.value=jb.job_title) qualify row_number() over(partition by id, canonical order by confidence desc, category desc, method desc)=1),
 s3 as (select id, count(*)::double total_canonical_skills, {up("avg((confidence>=0.8)::int)", 4)} high_confidence_skill_ratio, {up("avg((method='unmatched')::int)", 4)} unmatched_skill_ratio, count(distinct category)::double category_diversity, {up(up("avg(confidence)", 9), 4)} avg_skill_confidence from cs group by id),
 k3 as (select id, {up("max(n)::double/sum(n)", 4)} primary_domain_confidence from (select id, category, count(*) n from cs group by all) group by id),
 p3 as (select id, count(*)::double num_projects, {up("avg(len(technologies))", 2)} avg_technologies_per_project, {up("avg((url<>'')::int)", 4)} project_link_ratio, 1 has_projects from pj group by id),
 c3 as (select id, count(*)::double num_certifications, count(distinct nullif(issuer,'')) num_unique_issuers, 1 has_certifications from ce group by id),
 v3 as (select doc_id id, {norm("resume_embedding")} summary_embedding_norm, {norm("jd_embedding")} skills_text_embedding_norm, {up(turn("resume_embedding", "jd_embedding") + "+1", 4)}-1 summary_skills_semantic_consistency from cpp_score qualify row_number() over(partition by doc_id order by scored_at desc nulls last, score_id desc)=1),
 rf as (select id, {zero} from (select distinct id from dx) left join e2 using(id) left join d3 using(id) left join s3 using(id) left join k3 using(id) left join p3 using(id) left join c3 using(id) left join v3 using(id))"""
    scaled_by = lambda c: f"greatest(0,least(1,{'(' + c + '+1)/2' if c == 'summary_skills_semantic_consistency' else c + '/' + str(S.LEGACY_CAPS.get(c, 1.0))}))"
    scaled_of = lambda c: f"1-{scaled_by(c)}" if c == "unmatched_skill_ratio" else scaled_by(c)
    exact = lambda x: up(up(x, 9), 4)
    each = ", ".join(f"{exact(f'({scaled_of(c)})*{0.4 / len(G.FEATURES)!r}::double')} k_{c}" for c in G.FEATURES)
    heuristic = f"""{raw}, pq as (select doc_id id, jd_id query_id, {turn("resume_embedding", "jd_embedding")} sim from cpp_score qualify row_number() over(partition by doc_id, jd_id order by scored_at desc nulls last, score_id desc)=1),
 hk as (select id, query_id, {exact("greatest(0,least(1,(sim+1)/2))*0.6::double")} retrieval_similarity, {each} from pq join rf using(id)), hs_ as (select *, {exact("retrieval_similarity+" + "+".join(f"k_{c}" for c in G.FEATURES))} score from hk)"""
    lists = f"with {SQL._SKILLS}, {SQL._GAP}, gl as (select id, query_id, coalesce(list(skill order by skill) filter (held),[]::varchar[]) matched, coalesce(list(skill order by skill) filter (not held),[]::varchar[]) missing from (select distinct id, query_id, skill, held from gp) group by all)"
    ten = lambda c: f"case when len({c})>0 then array_to_string({c}[1:10],', ') else 'None' end"
    surface = "text"
    for w in G.SURFACE:
        surface = f"replace({surface},{s(w)},'')"
    known = "case lower(name) " + " ".join(f"when {s(a)} then {s(b)}" for a, b in G.DISPLAY.items()) + " else array_to_string(list_transform(string_split(name,' '), lambda w: upper(substr(w,1,1))||lower(substr(w,2))),' ') end"
    scaled = ", ".join(f"{exact(scaled_of(c))} {c}" for c in G.FEATURES)
    surface = "text"
    for w in G.SURFACE:
        surface = f"regexp_replace({surface},{s(w)},'','g')"
    names = "[" + ",".join(f"{{'w':-k_{c},'k':{i},'n':{s(c)}}}" for i, c in enumerate(G.FEATURES)) + "]"
    told = f"""{lists}, kn as (select id, category, canonical kin from sk qualify row_number() over(partition by id, category order by confidence desc, canonical)=1),
 g3 as (select id, query_id, coalesce(list(skill order by skill) filter (held),[]::varchar[]) matched, coalesce(list(skill order by skill) filter (not held and kin is null),[]::varchar[]) missing, coalesce(list(skill||'~'||kin order by skill) filter (not held and kin is not null),[]::varchar[]) near from (select distinct gp.id, query_id, skill, held, kin from gp left join kn on kn.id=gp.id and kn.category=gp.category) group by all)"""
    drivers = f"array_to_string(list_transform(list_sort(list_filter({names}, lambda x: x.w<0))[1:3], lambda x: x.n),', ')"
    bare = "trim(regexp_replace(regexp_replace(trim(case when raw_id%3=0 then '```json'||chr(10)||payload||chr(10)||'```' else payload end,' '),'^```(?:json)?',''),'```$',''),' '||chr(10))"
    return {
        "l1_normalize": f"select job_title, {key('job_title')} as key from (select distinct job_title from experience where job_title is not null)",
        "l4_semantic_match": f"with vp as (select q.score_id query_id, d.score_id doc_id, {SQL._cos('d.resume_embedding', 'q.resume_embedding')} s from cpp_score d join cpp_score q on q.score_id%100=0 and q.score_id<>d.score_id) select query_id, doc_id, cosine from ({SQL._top('vp', 'cosine', 1)}) where cosine>=0.62",
        "l5_cascade": f"{cascade} select value, canonical, category, {up('confidence')} confidence, method from ca",
        "l7_grouped_forms": f"{cascade} select canonical, {up('max(confidence)')} confidence, string_agg(distinct value,'|' order by value) forms from ca where method<>'unmatched' group by 1",
        "l_raw_features": f"{raw} select * from rf",
        "l11_normalised": f"{raw} select id, {scaled} from rf",
        "g2_answers": f"""with a as (select {bare} b from resume_raw), c as (select b is null or b='' or not json_valid(b) or json_type(case when json_valid(b) then b::json end)<>'OBJECT' bad, case when json_valid(b) then b::json end j from a)
 select case when bad then 'again' else 'read' end state, case when bad then 0 else coalesce(len(json_extract(j,'$.suggestions[*]')),0)::int end n_suggestions, case when bad then 'AI summary generation failed or API key was missing.' else coalesce(j->>'$.match_summary','Summary unavailable.') end summary, count(*) n from c group by 1,2,3""",
        "l12_heuristic": f"{heuristic} select id, query_id, retrieval_similarity, score from hs_",
        "l13_narrative": f"""{told}, h3 as (select * from ({heuristic} select * from hs_)) select id, query_id, concat_ws(' ', printf('ATS match score: %.2f (0-1 scale).', {up("score", 2)}), case when {drivers}<>'' then 'Strongest signals: '||{drivers}||'.' end, case when len(matched)>0 then 'Matches '||len(matched)||' required skill(s), including '||array_to_string(matched[1:5],', ')||'.' end,
 case when len(missing)>0 then 'Missing from the resume: '||array_to_string(missing[1:5],', ')||'.' end, case when len(near)>0 then 'Related/partial matches: '||array_to_string(near[1:3],', ')||'.' end) narrative from h3 join g3 using(id,query_id)""",
        "g1_prompt": f"{lists} select gl.id, query_id, md5(case when trim(full_text,' ')<>'' then '--- JOB DESCRIPTION ---'||chr(10)||substr({s(Q.QUERY)},1,1500)||chr(10)||chr(10)||'--- RESUME TEXT ---'||chr(10)||substr(full_text,1,2500)||chr(10)||chr(10)||'--- ATS ENGINE FINDINGS ---'||chr(10)||'Matched Skills: '||{ten('matched')}||chr(10)||'Missing Skills: '||{ten('missing')}||chr(10)||chr(10)||{s(G.CLOSING)} end) prompt_md5 from gl join text_extraction t on t.doc_id=gl.id",
        "s13_without_surface": f"select doc_id, md5(regexp_replace(regexp_replace({surface},'(?m)^[ \\t\\n\\r\\f0-9]+$','','g'),'^[ \\t\\n\\r]+|[ \\t\\n\\r]+$','','g')) text_md5 from documents",
        "u2_display": f"select entry_id, {known} shown from (select entry_id, lower(canonical_name) as name from skill_taxonomy)",
        "u2_feature_table": f"{raw} select feature, count(*) n, {up('max(value)', 4)} largest from (unpivot (select * from rf) on columns(* exclude(id)) into name feature value value) group by feature",
    }
