"""DuckDB SQL with the meaning of the matching queries, written apart from their plans."""

from __future__ import annotations

from quern import lexicon as L
from quern.plans.reference_queries import QUERY

_Q = "'"


def _s(x: str) -> str:
    return _Q + x.replace(_Q, _Q * 2) + _Q


def _list(xs) -> str:
    return "[" + ",".join(map(_s, xs)) + "]"


def _ladder(col: str, steps, default: float) -> str:
    low = f"lower(coalesce({col},''))"
    whens = " ".join(f"when {' or '.join(f'contains({low},{_s(w)})' for w in words)} then {v}::double" for words, v in steps)
    return f"(case {whens} else {default}::double end)"


def _up(x: str, d: int = 6) -> str:
    return f"floor(({x})*{10.0**d}::double+0.5)/{10.0**d}::double"


def _cap(x: str, limit: float) -> str:
    return f"least(1.0::double, ({x})::double/{float(limit)}::double)"


_STOP = _list(L.STOP_WORDS)


def _tok(col: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({col},''),'[^A-Za-z0-9+#]+'), lambda x: lower(x)), lambda x: length(x)>=2 and not list_contains({_STOP},x))"


_TOKENS = f"""
dt as (select doc_id, {_tok("text")} t from documents),
qt as (select item_id query_id, {_tok("text")} t from eval_items),
di as (select doc_id, total, term, count(*) tf from (select doc_id, len(t) total, unnest(t) term from dt) group by all),
qi as (select query_id, total, term, count(*) tf from (select query_id, len(t) total, unnest(t) term from qt) group by all)"""
_BM25 = f"""with {_TOKENS},
bm as (select query_id, doc_id, sum(ln(1+d.total/(d.tf+1))*d.tf*2.5/(d.tf+1.5)) s from di d join qi q using(term) group by all)"""


def _top(pairs: str, name: str, k: int = 5) -> str:
    return f"""select query_id, rank, doc_id, {name} from (select *, row_number() over(partition by query_id order by {name} desc, doc_id) as rank from (select query_id, doc_id, {_up("s")} {name} from {pairs})) where rank<={k}"""


_IDF = "(values " + ",".join(f"({_s(t)},{w}::double)" for t, w in L.IDF.items()) + ") idf(term,w)"
_PAIRS5 = f"{_BM25}, pr as (select query_id, doc_id from ({_top('bm', 'bm25')}))"


def _k1(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({_low(c)},'[_\\-\\t\\n\\r]',' ','g'),'[^a-z+#. ]','','g'),' +',' ','g'),' ')"


def _low(c: str) -> str:
    return f"translate({c},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


def _k2(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_low(c)},'[^a-z0-9+#.&\\-]+',' ','g'),' +',' ','g'),' ')"


def _k3(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_low(c)},'[^a-z0-9+#]+',' ','g'),' +',' ','g'),' ')"


_JOBS = """jb as (select doc_id id, pos, job_title, company, start_date, end_date, is_current, list_filter(coalesce(responsibilities,[]::varchar[]), lambda b: b is not null) b
 from experience qualify row_number() over(partition by doc_id,pos order by received_at desc nulls last, row_id desc)=1)"""
_SCHOOLS = """sc as (select doc_id id, pos, institution, degree, field_of_study, end_date, gpa from education qualify row_number() over(partition by doc_id,pos order by received_at desc nulls last, edu_id desc)=1)"""
_PATTERNS = f"""pt as (select * from (select entry_id ord, canonical_name canonical, category, i alias_ord, {_k2("case when i=0 then canonical_name else aliases[i] end")} pattern
 from (select *, unnest(range(0, len(coalesce(aliases,[]::varchar[]))+1)) i from skill_taxonomy)) where pattern<>''),
fw as (select pattern, canonical, category, ord, alias_ord from pt qualify row_number() over(partition by pattern order by ord, alias_ord)=1)"""


def _scan(source: str) -> str:
    """Hits h(id, st, ln, canonical, category) of the patterns in source(id, text)."""
    return f"""wd as (select id, string_split({_k2("text")},' ') w from {source} where text is not null),
ng as (select id, st, ln, list_aggregate(list_slice(w,st,st+ln-1),'string_agg',' ') pattern from (select id, w, st, unnest(range(1, least(4,len(w)-st+1)+1)) ln from (select id, w, unnest(range(1,len(w)+1)) st from wd))),
h as (select id, st, ln, canonical, category from ng join fw using(pattern))"""


_LONGEST = """lh as (select id, unnest(list_reduce(list_prepend({'e':0,'k':[]::struct(st bigint, ln bigint, canonical varchar, category varchar)[], 'x':null::struct(st bigint, ln bigint, canonical varchar, category varchar)},
 list_transform(hs, lambda y: {'e':0,'k':[]::struct(st bigint, ln bigint, canonical varchar, category varchar)[], 'x':y})),
 lambda a, m: case when m.x.st > a.e then {'e':(m.x.st+m.x.ln-1)::int,'k':list_append(a.k,m.x),'x':null::struct(st bigint, ln bigint, canonical varchar, category varchar)} else a end).k) m
 from (select id, list({'st':st::bigint,'ln':ln::bigint,'canonical':canonical,'category':category} order by st, ln desc, canonical, category) hs from h group by id))"""
_FUZZY = f"""pn as (select {_k3("pattern")} nm, canonical, ord, alias_ord from pt where {_k3("pattern")}<>''),
fz as (select value, canonical, sim from (select value, canonical, case when greatest(length(key),length(nm))=0 then 1 else 1-levenshtein(key,nm)::double/greatest(length(key),length(nm)) end sim, ord, alias_ord
 from (select distinct job_title as value, {_k3("job_title")} as key from tv) v join pn on abs(length(key)-length(nm)) <= 0.18*greatest(length(key),length(nm))+1e-9 where key<>'') where sim>=0.82
 qualify row_number() over(partition by value order by sim desc, ord, alias_ord)=1)"""
_SKILLS = f"""{_JOBS}, {_PATTERNS}, src as (select id||':'||pos id, array_to_string(b,' ') as text from jb), {_scan("src")}, {_LONGEST},
tr as (select distinct split_part(id,':',1)::bigint id, m.canonical canonical, m.category category, 0.95::double confidence, 'trie' as method from lh),
raw as (select id, job_title skill, {_k2("job_title")} pattern from jb where trim(job_title,' ')<>''),
ex as (select id, canonical, category, 1.0::double confidence, 'exact' as method from raw join fw using(pattern)),
rs as (select id, skill from raw anti join fw using(pattern)), tv as (select skill job_title from rs), {_FUZZY},
ct as (select canonical, min(category) category from pt group by 1),
nr as (select id, fz.canonical, ct.category, sim*0.85 confidence, 'fuzzy' as method from rs join fz on rs.skill=fz.value join ct on ct.canonical=fz.canonical),
sk as (select id, canonical, category, confidence, method from (select * from tr union all select * from ex union all select * from nr)
 qualify row_number() over(partition by id, canonical order by confidence desc, method desc)=1)"""
_GAP = """pp as (select distinct doc_id id, jd_id query_id from cpp_score),
rq as (select query_id, canonical_name canonical, category from (select distinct query_id from pp) q join (select * from skill_taxonomy where entry_kind='skill') t on t.entry_id%13=q.query_id%13),
gp as (select pp.id, pp.query_id, rq.canonical skill, rq.category, exists(select 1 from sk where sk.id=pp.id and sk.canonical=rq.canonical) held, exists(select 1 from sk where sk.id=pp.id and sk.category=rq.category) related from pp join rq using(query_id))"""

_YEAR = "regexp_extract({c},'(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ \\t]+((?:19|20)[0-9]{{2}})',{g})"


def _ym(c: str, as_of: int = 2026 * 12 + 7) -> str:
    named, month = _YEAR.format(c=c, g=2), f"lower({_YEAR.format(c=c, g=1)})"
    bare = f"regexp_extract({c},'(?:^|[^A-Za-z0-9_])((?:19|20)[0-9]{{2}})(?:$|[^A-Za-z0-9_])',1)"
    months = _list(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])
    return f"(case when lower(trim({c},' ')) in ('present','current','now','ongoing') then {as_of} when {named}<>'' then try_cast({named} as int)*12+list_position({months},{month})-1 when {bare}<>'' then try_cast({bare} as int)*12+5 end)"


_FIRST_WORD = "lower(regexp_extract(x,'^[ \\t\\n\\r]*([^ \\t\\n\\r]+)',1))"


def _verbs(source: str, verbs) -> str:
    return f"len(list_filter({source}, lambda x: list_contains({_list(verbs)},{_FIRST_WORD})))"


def _seniority_of_query() -> float:
    low = QUERY.lower()
    return next((v for words, v in L.QUERY_SENIORITY if any(w in low for w in words)), L.QUERY_DEFAULT)


_LED = " or ".join(f"contains(lt,{_s(w)})" for w in L.LEADERSHIP)
_EXPERIENCE = f"""{_JOBS},
j1 as (select *, coalesce(greatest(0, coalesce({_ym("end_date")},24319)-{_ym("start_date")}),0) m, {_ladder("job_title", L.TITLE_SENIORITY, L.TITLE_DEFAULT)} sen, lower(coalesce(company,'')) co,
 lower(concat_ws(' ',job_title,company,array_to_string(b,' '))) lt, greatest(0, 24319-coalesce({_ym("start_date")},24319)) since from jb),
j2 as (select *, case when lag(co) over w=co and sen-lag(sen) over w>0.1 then 1 else 0 end up from j1 window w as (partition by id order by pos)),
j3 as (select id, sum(m) total, count(*) n, avg(m) avg_m, max(m) max_m, arg_max(since,pos) since, bool_or(coalesce(is_current,false)) cur, max(sen) max_sen, avg(sen) avg_sen, bool_or({_LED}) led, sum(up) ups,
 sum(len(list_filter(b, lambda x: regexp_matches(x,{_s(L.QUANTITY)})))) quant, sum(len(list_filter(b, lambda x: x<>''))) bul, sum({_verbs("list_filter(b, lambda x: x<>'')", L.ACTION_VERBS)}) verb,
 arg_min(sen,pos) first_sen, arg_max(sen,pos) last_sen, count(*) filter (m>0 and m<12) short from j2 group by id),
fx as (select id, {_up(_cap("total", 240))} total_experience_months, {_up(f"greatest(0,least(1,total*(1-abs(max_sen-{_seniority_of_query()}))/240))")} relevant_experience_months, {_up(_cap("n", 10))} num_positions,
 {_up(_cap("avg_m", 60))} avg_tenure_months, {_up(_cap("max_m", 120))} max_tenure_months, {_up("1-" + _cap("greatest(0,since-total)", 24))} employment_gap_months,
 {_up("1-" + _cap("case when since-total>0 then greatest(1,floor((since-total)/12)) else 0 end", 5))} num_gaps, {_up("cur::int")} is_currently_employed, {_up("max_sen")} max_seniority_score, {_up("avg_sen")} avg_seniority_score,
 {_up("led::int")} has_leadership_keywords, {_up(_cap("ups", 3))} num_promotions, {_up(_cap("quant", 10))} quantified_achievement_count, {_up("case when bul>0 then verb::double/bul else 0 end")} action_verb_density,
 {_up("case when n<2 then 0.5 else greatest(0,least(1,0.5+last_sen-first_sen)) end")} career_progression_score, {_up("(short>=3)::int")} job_hopper_flag, {_up(f"(max_sen>{_seniority_of_query()}+0.3 and total>120)::int")} overqualified_flag from j3)"""

_FIELD = "greatest(0," + ",".join(f"case when contains(fl,{_s(k)}) then {v if k in QUERY.lower() else v * 0.5} else 0 end" for k, v in L.FIELDS.items()) + ")"
_TOP = " or ".join(f"contains(il,{_s(w)})" for w in L.PRESTIGE)
_EDUCATION = f"""{_SCHOOLS},
s1 as (select id, {_ladder("degree", L.DEGREES, 0.0)} lvl, lower(coalesce(field_of_study,'')) fl, lower(coalesce(institution,'')) il, lower(coalesce(end_date,'')) el,
 list_transform(regexp_extract_all(gpa,'([0-9]+\\.?[0-9]*)',1), lambda x: x::double) g, coalesce(try_cast(nullif(regexp_extract(coalesce(end_date,''),'(?:^|[^A-Za-z0-9_])((?:19|20)[0-9]{{2}})(?:$|[^A-Za-z0-9_])',1),'') as int),2015) yr from sc),
s2 as (select id, count(*) n, max(lvl) lvl, max({_FIELD}) fm, max(case when len(g)>0 and coalesce(g[2],1)<>0 then least(1,g[1]/nullif(coalesce(g[2],case when g[1]<=4 then 4 else 100 end),0)) end) gpa,
 max(case when el in ('','present') then 1 else greatest(0,1-greatest(0,2026-yr)/20.0) end) rec, bool_or(el in ('present','current')) cur, bool_or({_TOP}) top, count(distinct nullif(il,'')) insts from s1 group by id),
fe as (select id, {_up(_cap("n", 3))} num_degrees, {_up("lvl")} highest_degree_level, {_up("fm")} degree_field_match, {_up("coalesce(gpa,0)")} gpa_normalized, {_up("(gpa is not null)::int")} has_gpa, {_up("cur::int")} is_currently_studying,
 {_up("rec")} education_recency_score, {_up("top::int")} prestigious_institution_flag, {_up(_cap("insts", 3))} num_institutions, {_up("case when lvl>=0.6 then 1 else 0 end") if any(k in QUERY.lower() for k in ("degree required", "bachelor", "b.s.")) else "0.5::double"} degree_requirement_met from s2)"""
_MONTHS = "(case when mo>=12 then case when mo%12=0 then (mo//12)||' yr'||case when mo//12>1 then 's' else '' end else (mo//12)||' yr '||(mo%12)||' mo' end else mo||' month'||case when mo<>1 then 's' else '' end end)"
_HEADINGS = "(values " + ",".join(f"({_s(h)},{_s(s)},{i * 100 + j})" for i, (s, hs) in enumerate(L.SECTION_HEADINGS.items()) for j, h in enumerate(hs)) + ") hd(heading,section,ord)"
_STRIP = "regexp_replace({c},'^[ \\t\\r\\n]+|[ \\t\\r\\n]+$','','g')"
_LINES = f"""ln as (select id, i-1 line_no, {_STRIP.format(c="x[i]")} line from (select doc_id id, string_split(full_text,chr(10)) x, unnest(range(1,len(string_split(full_text,chr(10)))+1)) i from text_extraction where full_text is not null)),
hs as (select id, line_no, section from (select id, line_no, h.section, h.ord, case when k=h.heading then 0 else 1 end stage from (select id, line_no, regexp_replace(lower(line),'[ \\t]*:$','') k from ln where strlen(line)<=60 and line<>'') l join {_HEADINGS.replace("hd(", "h(")} on starts_with(k,h.heading) and substr(k,length(h.heading)+1,1) in ('',' ','/','&'))
 qualify row_number() over(partition by id,line_no order by stage, ord)=1)"""
_KEPT = """hl as (select id, list({'n':line_no,'s':section} order by line_no) h from hs group by id),
kp as (select id, unnest(list_reduce(list_prepend([]::struct(n bigint, s varchar)[], list_transform(h, lambda y: [y])), lambda a, m: case when len(a)>0 and a[-1].s=m[1].s and m[1].n-a[-1].n<=2 then a else list_append(a,m[1]) end)) m from hl),
lb as (select ln.id, ln.line_no, ln.line, kp.m is not null head, last_value(kp.m.s ignore nulls) over w section, last_value(case when kp.m is not null then ln.line_no end ignore nulls) over w "at" from ln left join kp on kp.id=ln.id and kp.m.n=ln.line_no window w as (partition by ln.id order by ln.line_no))"""


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x},{y}), lambda p: p[1]::double*p[2]::double))"
    return f"(case when len({a})=len({b}) and len({a})>0 and {dot(a, a)}>0 and {dot(b, b)}>0 and not isnan({dot(a, b)}) then greatest(0,least(1,{dot(a, b)}/(sqrt({dot(a, a)})*sqrt({dot(b, b)})))) else 0 end)"


_TECH = _list(L.TECH_TERMS)
_WORDS = "len(regexp_extract_all({c},'[^ \\t\\n\\r\\f\\x0B]+'))"


def oracle_sql() -> dict[str, str]:
    words = _WORDS.format(c="text")
    keys = ",".join(f"nullif(instr(lower(text),{_s(w)}),0)" for w in L.QUERY_KEYWORDS)
    window = f"case when length(text)<=1000 then text when least({keys}) is not null then trim(regexp_replace(substr(text,greatest(least({keys})-50,1),1000),' [^ ]*$',''),' ') else substr(text,1,1000) end"
    clean = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_text,'[•●▪◦·]','-','g'),'[ \\t]{2,}',' ','g'),'\\n{3,}',chr(10)||chr(10),'g'),'^[ \\t\\n\\r]+|[ \\t\\n\\r]+$','','g')"
    sql = {
        "r1_token_counts": f"with {_TOKENS} select doc_id, len(t) n_tokens, len(list_distinct(t)) n_unique from dt",
        "r1_unique_terms": f"with {_TOKENS} select term, count(*) docs, sum(tf)::bigint occurrences from di group by term",
        "r2_bm25_topk": f"{_BM25} {_top('bm', 'bm25')}",
        "r3_bm25_norm": f"{_BM25}, bn as (select query_id, doc_id, s/(s+10) s from bm) {_top('bn', 'bm25_score')}",
        "r4_idf_lookup": f"with {_TOKENS} select q.term, sum(q.tf)::bigint tf, coalesce(max(w),2.0) idf from qi q left join {_IDF} on q.term=idf.term group by q.term",
        "r5_tfidf_cosine": f"""with {_TOKENS}, dw as (select doc_id, di.term, di.tf::double/total*coalesce(w,2.0) x from di left join {_IDF} on di.term=idf.term), qw as (select query_id, qi.term, qi.tf::double/total*coalesce(w,2.0) x from qi left join {_IDF} on qi.term=idf.term),
 dn as (select doc_id, sqrt(sum(x*x)) n from dw group by 1), qn as (select query_id, sqrt(sum(x*x)) n from qw group by 1),
 tp as (select query_id, doc_id, least(1.0, dot/(dn.n*qn.n)) s from (select query_id, doc_id, sum(dw.x*qw.x) dot from dw join qw using(term) group by all) join dn using(doc_id) join qn using(query_id)) {_top("tp", "tfidf")}""",
        "r6_vector_cosine_topk": f"with vp as (select q.vec_id query_id, d.vec_id doc_id, {_cos('d.embedding', 'q.embedding')} s from embeddings d join embeddings q on q.vec_id%100=0 and q.vec_id<>d.vec_id) {_top('vp', 'cosine', 10)}",
        "r6_pair_cosine": f"select score_id, {_up(_cos('resume_embedding', 'jd_embedding'))} cosine_similarity from cpp_score",
        "r7_r15_overlap": f"""{_PAIRS5}, f as (select query_id, doc_id, len(d.t) dn, len(q.t) qn, list_distinct(d.t) du, list_distinct(q.t) qu,
 case when len(d.t)>=2 then list_distinct(list_transform(range(1,len(d.t)), lambda i: d.t[i]||' '||d.t[i+1])) else [] end db, case when len(q.t)>=2 then list_distinct(list_transform(range(1,len(q.t)), lambda i: q.t[i]||' '||q.t[i+1])) else [] end qb
 from pr join dt d using(doc_id) join qt q using(query_id))
 select query_id, doc_id, {_up("case when len(qu)>0 then len(list_intersect(du,qu))::double/len(qu) else 0 end")} keyword_overlap_ratio, {_up("case when len(qu)>0 then len(list_intersect(du,qu))::double/len(qu) else 1 end")} jd_term_coverage, {_up(_cap("len(list_intersect(du,qu))", 30))} keyword_overlap_count,
 {_up("case when len(qb)>0 then len(list_intersect(db,qb))::double/len(qb) else 0 end")} bigram_overlap_ratio, {_up("case when qn>0 then least(1,dn::double/qn/3) else 0.5 end")} resume_jd_length_ratio, {_up(_cap(f"len(list_intersect(qu,{_TECH}))", 20))} jd_tech_term_count, {_up(_cap(f"len(list_intersect(du,{_TECH}))", 30))} resume_tech_term_count,
 {_up(_cap("len(qu)", 200))} jd_unique_term_count, {_up(_cap("len(du)", 400))} resume_unique_term_count, 0.5::double title_match_score, 0.5::double summary_jd_similarity from f""",
        "r13_tf_weighted": f"""{_PAIRS5} select query_id, doc_id, {_up("least(1.0, sum((q.tf::double/q.total)*least(1.0, coalesce(d.tf::double/d.total,0)/((q.tf::double/q.total)+0.001)))/sum(q.tf::double/q.total))")} tf_weighted from pr join qi q using(query_id) left join di d using(doc_id, term) group by query_id, doc_id""",
        "k1_k2_k3_normalizers": f"select job_title, {_k1('job_title')} k1, {_k2('job_title')} k2, {_k3('job_title')} k3 from (select distinct job_title from experience where job_title is not null)",
        "k4_k5_alias_precedence": f"with {_PATTERNS} select pattern, fw.canonical first_canonical, l.canonical last_canonical from fw join (select pattern, canonical from pt qualify row_number() over(partition by pattern order by ord desc, alias_ord desc)=1) l using(pattern)",
        "k9_k10_similarity": f"select ord, a, b, levenshtein(a,b)::int distance, {_up('case when greatest(length(a),length(b))=0 then 1 else 1-levenshtein(a,b)::double/greatest(length(a),length(b)) end')} similarity from (select entry_id ord, {_k3('canonical_name')} a, {_k3('al')} b from (select *, unnest(aliases) al from skill_taxonomy))",
        "k7_dictionary_scan": f"with {_PATTERNS}, src as (select doc_id id, full_text as text from text_extraction), {_scan('src')} select id, canonical, count(*) n, min(st)::int first_word from h group by id, canonical",
        "k8_longest_match": f"with {_JOBS}, {_PATTERNS}, src as (select id||':'||pos id, array_to_string(b,' ') as text from jb), {_scan('src')}, {_LONGEST} select m.canonical canonical, m.ln::int len, count(*) n, count(distinct id) jobs from lh group by 1,2",
        "k11_fuzzy_best": f"with {_PATTERNS}, tv as (select job_title from experience where job_title is not null), {_FUZZY} select value, canonical, {_up('sim')} similarity from fz",
        "k12_extract_skills": f"with {_SKILLS} select id, canonical, category, {_up('confidence')} confidence, method from sk",
        "k13_primary_domain": f"with {_SKILLS} select id, category as domain, {_up('s/total')} share from (select id, category, s, sum(s) over(partition by id) total, row_number() over(partition by id order by s desc, category) rn from (select id, category, sum(confidence) s from sk group by all)) where rn=1",
        "k14_gap": f"with {_SKILLS}, {_GAP} select id, query_id, coalesce(string_agg(skill,'|' order by skill) filter (held),'') matched, (count(*) filter (not held))::int n_missing, {_up('count(*) filter (held)::double/count(*)')} match_ratio from gp group by id, query_id",
        "k15_partial": f"with {_SKILLS}, {_GAP} select query_id, case when held then 'matched' when related then 'partial' else 'missing' end status, count(*) n, count(*) filter (not held and related) named from gp group by 1,2",
        "k14_gap_tpch": """with bt as (select distinct o_custkey, p_type from orders join lineitem on o_orderkey=l_orderkey join part on l_partkey=p_partkey), nd as (select distinct p_brand, p_type from part)
 select o_custkey, p_brand, count(*) matched, (select count(*) from nd n2 where n2.p_brand=nd.p_brand)-count(*) missing from bt join nd using(p_type) group by o_custkey, p_brand""",
        "f_skills_20": f"""with {_SKILLS}, {_GAP}, g as (select id, query_id, count(*) j, count(*) filter (held) m, count(*) filter (not held) x from gp group by 1,2),
 hc as (select id, count(*) c, avg(confidence) ac, avg((confidence>=0.85)::int) hi, count(distinct category) kinds, count(*) filter (method='fuzzy') fz from sk group by 1),
 dm as (select id, s/total share from (select id, category, s, sum(s) over(partition by id) total, row_number() over(partition by id order by s desc, category) rn from (select id, category, sum(confidence) s from sk group by all)) where rn=1),
 a as (select pp.id, pp.query_id, coalesce(j,0) j, coalesce(m,0) m, coalesce(x,0) x, coalesce(c,0) c, coalesce(ac,0) ac, coalesce(hi,0) hi, coalesce(kinds,0) kinds, coalesce(fz,0) fz, coalesce(share,0) share from pp left join g using(id,query_id) left join hc using(id) left join dm using(id)),
 b as (select *, case when j=0 then 1 else m::double/greatest(j,1) end cov, greatest(1,floor(j/2)) crit from a)
 select id, query_id, {_up("cov")} skill_coverage_ratio, {_up("cov")} critical_skill_coverage, {_up("cov")} optional_skill_coverage, {_up(_cap("m", 20))} num_matched_skills, {_up("1-" + _cap("x", 15))} num_missing_skills, 0::double num_partial_skills,
 {_up("case when c>j then least(0.3,(c-j)/20.0) else 0 end")} rare_skill_bonus, {_up(_cap("kinds", 10))} skill_category_diversity, {_up("ac")} avg_skill_confidence, {_up("hi")} high_confidence_skill_ratio, {_up(_cap("c", 30))} total_canonical_skills, {_up(_cap("c", 25))} skills_text_length,
 {_up("case when c>0 then 1 else 0 end")} unmatched_skill_ratio, {_up("share")} primary_domain_confidence, {_up(_cap("j", 20))} jd_skill_count, {_up("case when j=0 then 0 else " + _cap("crit", 10) + " end")} jd_critical_skill_count, {_up(_cap("c-fz", 20))} skill_exact_match_count, {_up(_cap("fz", 10))} skill_fuzzy_match_count,
 {_up("1-least(x,crit)/crit")} skill_missing_critical_count, {_up("case when x=0 then 1 else cov end")} skill_has_all_required from b""",
        "l6_corroboration": f"with {_SKILLS} select sk.id, canonical, {_up('case when (length(lower(full_text))-length(replace(lower(full_text),lower(canonical),chr(0)[1:0])))::double/length(canonical)>1 then least(1.0,confidence+0.05) else confidence end')} boosted from sk join text_extraction t on t.doc_id=sk.id".replace("chr(0)[1:0]", "''"),
        "l8_domain_distribution": f"with {_SKILLS} select id, category, {_up('n::double/sum(n) over(partition by id)', 4)} share from (select id, category, count(*) n from sk group by all)",
        "sec_lines": f"select id, count(*) lines, count(*) filter (line='') blank, max(line_no)::int last_line from (select id, i-1 line_no, {_STRIP.format(c='x[i]')} line from (select doc_id id, string_split(text,chr(10)) x, unnest(range(1,len(string_split(text,chr(10)))+1)) i from (select distinct * from page_extraction) where text is not null)) group by id",
        "sec_headings": f"with {_LINES} select id, line_no::int line_no, section from hs",
        "sec_sections": f"""with {_LINES}, {_KEPT} select id, section, arg_max(a,a)::int start_line, arg_max(n,a)::int n_lines, md5(arg_max(tx,a)) text_md5 from (select id, section, "at" a, count(*) n, string_agg(line,chr(10) order by line_no) tx from lb where not head and section is not null group by all) group by id, section""",
        "sec_preamble": f"with {_LINES}, {_KEPT} select id, length(string_agg(line,chr(10) order by line_no))::int n_chars from lb where not head and section is null group by id",
        "f_experience_15": f"with {_EXPERIENCE} select * from fx",
        "f_education_10": f"with {_EDUCATION} select * from fe",
        "f_quality": f"""with {_JOBS}, pj as (select id, count(*) jobs, sum(len(b)) nb, sum({_verbs("b", L.ACTION_VERBS_GLOBAL)}) nv, sum(coalesce(list_sum(list_transform(b, lambda x: len(regexp_extract_all(x,{_s(L.QUANTITY_GLOBAL)})))),0)) fig, sum(coalesce(list_sum(list_transform(b, lambda x: strlen(x))),0)) chars, avg((coalesce(start_date,'')<>'')::int) dated from jb group by id),
 r as (select doc_id id, coalesce(full_text,'') as text, coalesce(jobs,0) jobs, coalesce(nb,0) nb, coalesce(nv,0) nv, coalesce(fig,0) fig, coalesce(chars,0) chars, dated from text_extraction left join pj on pj.id=doc_id), w as (select *, {words} wc, len(regexp_extract_all(lower(text),'[aeiouy]')) vow, greatest(1,jobs)+len(regexp_extract_all(text,'[.!?]')) sen from r)
 select id, {_up("case when nb>0 then nv::double/nb else 0 end")} action_verb_density_global, {_up(_cap("fig", 20))} quantified_achievements_total, {_up("least(1.0,(case when nb>0 then chars::double/nb else 0 end)/150)")} avg_bullet_length, {_up(_cap("wc", 2000))} total_word_count,
 {_up("case when wc<100 then 0.2 when wc<300 then 0.5 when wc<=2000 then 1 when wc<=2500 then 0.8 else 0.6 end")} resume_length_score, {_up("coalesce(dated,0.5)")} formatting_consistency, {_up("greatest(0,least(1,(206.835-1.015*(wc::double/sen)-84.6*(vow::double/greatest(1,wc)))/100))")} readability_score from w""",
        "c8_rank": "select jd_id, doc_id, overall_score, rank::int as rank from (select *, rank() over(partition by jd_id order by overall_score desc) as rank from (select jd_id, doc_id, max(overall_score) overall_score from cpp_score where overall_score is not null group by all)) where rank<=10",
        "s11_limits": "select case when octet_length(encode(text))>2097152 then 'file' when length(text)>15000 then 'text' else 'fits' end as over, count(*) n, max(length(text))::int longest from documents where text is not null group by 1",
        "s12_page_text": "select doc_id, md5(case when doc_id%3<2 and length(t)>50 then t else b end) text_md5 from (select doc_id, trim(regexp_replace(text,'[ \\t\\n\\r]+',' ','g'),' ') t, trim(regexp_replace('Menu bar '||text||' Foot','[ \\t\\n\\r]+',' ','g'),' ') b from documents where text is not null)",
        "s1_requests": f"""select case when score_id%7=0 then 'unreadable request' when coalesce(full_text,'')='' then 'resume_text is empty' else '' end error, count(*) n, sum(case when score_id%7=0 then 0 else length(coalesce(full_text,'')) end)::bigint chars, 0::bigint n_jd from cpp_score c left join text_extraction t using(doc_id) group by 1""",
        "s5_taxonomy": "select entry_id ord, canonical_name canonical, category, coalesce(len(aliases),0)::int n_aliases from skill_taxonomy",
        "st_percentiles": f"select event_type, count(value) n, {_up('avg(value)')} mean, {', '.join(_up(f'list_sort(list(value) filter (value is not null))[floor(count(value)*{p}::double)::int+1]') + f' p{int(p * 100)}' for p in (0.5, 0.95, 0.99))} from events group by event_type having count(value)>0",
        "st_arrivals": "select doc_id, strftime(received_at,'%Y-%m-%d') as day, count(*) n, floor(epoch(max(received_at)))::bigint last_second from contact where received_at is not null group by 1,2",
        "s1_json_decode": "select event_type, count(*) n, sum((props->>'$.k')::bigint)::bigint total_k from events group by event_type",
        "s4_reject_empty": "select case when text is null then 'missing' when trim(text,' ')='' then 'empty' else 'ok' end status, count(*) n from documents group by 1",
        "s8_ocr_routing": "select doc_id, count(*) pages, count(*) filter (coalesce(length(text),0)<30) needs_ocr from (select distinct * from page_extraction) group by doc_id",
        "s9_ocr_confidence": "select doc_id, coalesce(floor((2*s+n)::double/nullif(2*n,0))/10000,1.0) confidence from (select doc_id, sum(floor(ocr_confidence*10000+0.5)) s, count(ocr_confidence) n from (select distinct * from page_extraction) group by doc_id)",
        "s10_clean_text": f"select doc_id, md5({clean}) clean_md5 from text_extraction",
        "s14_query_window": f"select doc_id, length({window})::int n_chars, md5({window}) text_md5 from documents where text is not null",
        "l9_vocabulary": f"with {_JOBS}, tx as (select id, lower(string_agg(array_to_string(b,' '),' ')) as text from jb group by id) select id, count(*) n_skills from tx join (select distinct lower(canonical_name) nm from skill_taxonomy where entry_kind='skill') on contains(text,nm) group by id",
        "l10_set_gap": f"with {_SKILLS}, {_GAP} select id, query_id, coalesce(string_agg(skill,'|' order by skill) filter (held),'') matched, (count(*) filter (not held))::int n_missing, {_up('count(*) filter (held)::double/count(*)', 4)} ratio from (select distinct id, query_id, skill, held from gp) group by id, query_id",
        "m4_auc": f"with g as (select overall_score s, sum(jd_id%2) p, count(*) n from cpp_score where overall_score is not null group by 1), r as (select *, coalesce(sum(n) over(order by s rows between unbounded preceding and 1 preceding),0) b from g) select {_up('(sum(p*(b+(n+1)/2.0))-sum(p)*(sum(p)+1)/2.0)/nullif(sum(p)*sum(n-p),0)')} auc from r",
        "tenure_orders": "with o as (select o_custkey, o_orderkey, year(o_orderdate)*12+month(o_orderdate)-1 m from orders), g as (select *, m-lag(m) over(partition by o_custkey order by m, o_orderkey) gap from o) select o_custkey, count(*) n, max(coalesce(gap,0))::int max_gap, (max(m)-min(m))::int span from g group by 1",
        "m2_split": "select label, case when substr(md5(concat_ws('|',coalesce(vec_id::varchar,''),label::varchar)),1,8)<'cccccccc' then 'train' else 'test' end part, count(*) n from embeddings group by 1,2",
    }
    return {k: v for k, v in sql.items() if v}
