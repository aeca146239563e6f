"""DuckDB SQL of the parser's queries and of the composed score, written apart from their plans."""

from __future__ import annotations

import re

from quern import lexicon as L
from quern.operators import pairs as P
from quern.operators import scoring as S
from quern.plans import pair_queries as Q
from quern.plans import reference_sql as SQL

_s, _up, _cap, _list, _ladder = SQL._s, SQL._up, SQL._cap, SQL._list, SQL._ladder


def _strip(c: str) -> str:
    return SQL._STRIP.format(c=c)


_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_WORD_END = "(?:$|[^A-Za-z0-9_])"
_DATE_LINE = f"'(?i)(?:^|[^A-Za-z0-9_])(?:{_MONTHS}|january|february|march|april|june|july|august|september|october|november|december|[0-9]{{4}}){_WORD_END}'"
_RANGE = f"'(?i)((?:(?:{_MONTHS})[a-z]*[ \\t]+)?[0-9]{{4}})[ \\t]*(?:-|–|—|to)+[ \\t]*((?:present|current|now|ongoing)|(?:(?:{_MONTHS})[a-z]*[ \\t]+)?[0-9]{{4}})'"
_BULLET = "'^[\\-•*·▪◦][ \\t\\n\\r\\f]*'"
_YEAR = "'\\b(?:19|20)[0-9]{2}\\b'"
_DEGREE = "'(?i)\\b(?:ph\\.?d|doctorate|doctoral|master|m\\.tech|mtech|msc|m\\.s\\.|mba|b\\.tech|btech|bsc|b\\.s\\.|bachelor|be|b\\.e\\.|associate|diploma|high school|secondary)\\b'"
_URL = "'(?i)(?:https?://|github\\.com/|gitlab\\.com/)[A-Za-z0-9_\\-./]+'"
_TOOLS = "'(?i)\\b(?:using|built with|technologies|technology|technologie|tech stack|tools|tool)[ \\t]*:?[ \\t]*(.+)'"
_GPA = "'(?i)gpa[ \\t]*:?[ \\t]*([0-9.]+)[ \\t]*/?[ \\t]*([0-9.]+)?'"


def _parts(c: str) -> str:
    one = _strip(f"regexp_replace({_strip('x')},'^(?:-[ \\t\\r\\n]*)+','')")
    return f"list_filter(list_transform(string_split_regex({c},'[,|;•·●▪◦]'), lambda x: {one}), lambda x: strlen(x)>1)"


_CONTACT = """cn as (select doc_id id, full_name, email, phone, linkedin_url linkedin, github_url github from contact qualify row_number() over(partition by doc_id order by received_at desc nulls last, full_name desc nulls last, email desc nulls last, phone desc nulls last, linkedin_url desc nulls last, github_url desc nulls last)=1)"""
_nl = "chr(10)"
_DOCS = f"""{SQL._JOBS}, {SQL._SCHOOLS}, {_CONTACT},
wk as (select id, string_agg(concat_ws({_nl}, concat_ws(' at ',job_title,company), concat_ws(' - ',start_date,end_date), array_to_string(list_transform(b, lambda x: '- '||x),{_nl})), {_nl}||{_nl} order by pos) t from jb group by id),
st as (select id, string_agg(concat_ws({_nl}, concat_ws(', ', concat_ws(' in ',degree,field_of_study), institution, end_date), 'GPA: '||gpa), {_nl}||{_nl} order by pos) t, string_agg(coalesce(field_of_study,''),', ' order by pos) f, string_agg(concat_ws(' - ',degree,concat_ws(', ',institution,end_date)),{_nl} order by pos) l from sc group by id),
wr as (select id, concat_ws({_nl}||{_nl}, case when cn.id is not null then concat_ws({_nl}, full_name, concat_ws(' | ',email,phone,linkedin,github)) else '' end, 'EXPERIENCE'||{_nl}||wk.t, 'EDUCATION'||{_nl}||st.t, 'SKILLS'||{_nl}||st.f, 'CERTIFICATIONS'||{_nl}||st.l) w from cn full join wk using(id) full join st using(id)),
dx as (select coalesce(wr.id,t.doc_id) id, coalesce(t.full_text, nullif(w,'')) as text from wr full join text_extraction t on t.doc_id=wr.id)"""
_LINES = SQL._LINES.replace("(select doc_id id, string_split(full_text,chr(10)) x, unnest(range(1,len(string_split(full_text,chr(10)))+1)) i from text_extraction where full_text is not null)", "(select id, string_split(text,chr(10)) x, unnest(range(1,len(string_split(text,chr(10)))+1)) i from dx where text is not null)")
assert "from dx" in _LINES
_SECTIONS = f"""{_DOCS}, {_LINES}, {SQL._KEPT},
sx as (select id, section, arg_max(tx,a) t from (select id, section, "at" a, string_agg(line,{_nl} order by line_no) tx from lb where not head and section is not null group by all) group by id, section),
pr as (select id, string_agg(line,{_nl} order by line_no) t from lb where not head and section is null group by id)"""


def _lines_of(name: str, section: str, source: str = "sx") -> str:
    where = f" where section='{section}'" if section else ""
    return f"{name} as (select id, i-1 line_no, x[i] raw from (select id, string_split(t,chr(10)) x, unnest(range(1,len(string_split(t,chr(10)))+1)) i from {source}{where}))"


_AT = "(?:^|[^A-Za-z0-9_])at(?:$|[^A-Za-z0-9_])"
_EXPERIENCE = f"""{_lines_of("xl", "EXPERIENCE")},
xm as (select *, lag(line) over(partition by id order by line_no) prev from (select id, line_no, {_strip("raw")} line from xl)),
xn as (select *, regexp_matches(line,{_RANGE}) head, sum(regexp_matches(line,{_RANGE})::int) over(partition by id order by line_no) pos, {_strip(f"regexp_replace(line,{_RANGE},'','g')")} rest from xm where line<>''),
xp as (select *, regexp_matches(rest,'(?i){_AT}') has_at, instr(rest,',') comma, case when coalesce(prev,'')<>'' and not regexp_matches(prev,{_DATE_LINE}) then prev else '' end above, {_strip(f"regexp_replace(line,{_BULLET},'')")} b from xn),
xh as (select id, pos, case when has_at then {_strip(f"regexp_extract(rest,'(?i)^(.*?){_AT}(.*)$',1)")} when comma>0 then {_strip("substr(rest,1,comma-1)")} when above<>'' then above else rest end job_title,
 case when has_at then {_strip(f"regexp_extract(rest,'(?i){_AT}(.*)$',1)")} when comma>0 then {_strip("substr(rest,comma+1)")} when above<>'' then rest else '' end company,
 regexp_extract(line,{_RANGE},1) start_date, regexp_extract(line,{_RANGE},2) end_date from xp where head),
xb as (select id, pos, list(b order by line_no) bullets from xp where not head and pos>0 and strlen(b)>5 group by id, pos),
xe as (select id, pos, job_title, company, start_date, end_date, lower(end_date) in ('present','current','now','ongoing') is_current, coalesce(bullets,[]::varchar[]) bullets from xh left join xb using(id,pos) where job_title<>'' or company<>''),
xu as (select id, 1 pos, 'Unknown' job_title, '' company, '' start_date, '' end_date, false is_current, list(b order by line_no) bullets from (select id, line_no, regexp_replace(line,{_BULLET},'') b from xn where strlen(line)>5) where b<>'' and id not in (select id from xe) group by id),
xx as (select * from xe union all select * from xu)"""
_EDUCATION = f"""{_lines_of("el", "EDUCATION")},
em as (select *, regexp_matches(line,{_DEGREE}) named, min(case when regexp_matches(line,{_DEGREE}) or regexp_matches(line,{_YEAR}) then line_no end) over(partition by id) first from (select id, line_no, {_strip("raw")} line from el) where line<>''),
en as (select *, coalesce(named or line_no=first,false) st, sum(coalesce(named or line_no=first,false)::int) over(partition by id order by line_no) pos, regexp_extract(line,{_DEGREE},0) known, regexp_extract_all(line,{_YEAR}) as yrs from em),
ep as (select *, {_strip("regexp_replace(regexp_replace(" + _strip("substr(line,instr(line,known)+length(known))") + ",'^(?:in|of|,)[ \\t]*',''),'\\b(?:19|20)[0-9]{2}\\b','','g')")} fld, {_strip(f"regexp_replace(regexp_replace(line,{_DEGREE},'','g'),{_YEAR},'','g')")} here from en),
eh as (select id, pos, case when named then {_strip("known")} else '' end degree, case when named and strlen(fld)>2 and strlen(fld)<80 then fld else '' end field_of_study, case when strlen(here)>5 then here end here, case when len(yrs)>1 then yrs[1] else '' end start_date, coalesce(case when len(yrs)>1 then yrs[2] else yrs[1] end,'') yr from ep where st),
eg as (select id, pos, arg_max(concat_ws('/',regexp_extract(line,{_GPA},1),nullif(regexp_extract(line,{_GPA},2),'')),line_no) filter (regexp_matches(line,{_GPA})) gpa, arg_min(line,line_no) filter (strlen(line)>5 and strlen(line)<100 and not regexp_matches(line,{_DATE_LINE})) below, bool_or(regexp_matches(lower(line),'present|current')) op from en where not st and pos>0 group by id, pos),
ee as (select id, pos, degree, field_of_study, coalesce(here,below,'') institution, start_date, case when coalesce(op,false) then 'Present' else yr end end_date, coalesce(gpa,'') gpa from eh left join eg using(id,pos) where coalesce(here,below,'')<>'')"""


def _skill_list(name: str, section: str, source: str) -> str:
    body = f"regexp_replace({_strip('raw')},'^[A-Za-z0-9_ \\t&/]+:[ \\t]*','')"
    bare = _strip(f"regexp_replace(body,{_BULLET},'')")
    return f"""{_lines_of(name + "l", section, source)},
{name} as (select id, row_number() over(partition by id order by line_no,k) pos, skill from (select * from (select id, line_no, k, p[k] skill from (select id, line_no, p, unnest(range(1,len(p)+1)) k from (select id, line_no, case when len({_parts("body")})>=2 then {_parts("body")} else [{bare}] end p from (select id, line_no, {body} body from {name}l)))) where strlen(skill) between 2 and 50 qualify row_number() over(partition by id, {SQL._low("skill")} order by line_no,k)=1))"""


_SKILL_LIST = f"""{_skill_list("sl", "SKILLS", "sx")}, fb as (select id, regexp_extract(text,'(?is)(?:skills?|technologies|proficiencies)[: \\t\\n\\r]+(.+?)(?:\\n\\n|$)',1) t from dx where id not in (select id from sl)), fd as (select * from fb where t<>''),
{_skill_list("sf", "", "fd")}, ss as (select * from sl union all select * from sf)"""
_PROJECTS = f"""{_lines_of("pl", "PROJECTS")},
pm as (select id, line_no, raw, {_strip(f"regexp_replace(raw,{_BULLET},'')")} line from (select id, line_no, {_strip("raw")} raw from pl)),
po as (select *, raw='' blank, (not regexp_matches(raw,{_BULLET}) and strlen(line) between 3 and 80 and regexp_matches(line,'[A-Z]') and not regexp_matches(line,{_DATE_LINE})) st from pm),
pg as (select *, sum((st or blank)::int) over(partition by id order by line_no) grp, regexp_extract(line,{_URL},0) link, regexp_matches(line,{_TOOLS}) tl, {_strip(f"regexp_extract(line,{_TOOLS},1)")} tools from po),
pa as (select id, grp, max(line) filter (st) title, arg_max(link,line_no) filter (not st and not blank and link<>'') url, string_agg(line,' ' order by line_no) filter (not st and not blank and not tl) tx, flatten(list({_parts("tools")} order by line_no) filter (not st and not blank and tl)) technologies from pg group by id, grp),
pb as (select *, regexp_extract(title,{_URL},0) own from pa where title is not null),
pj as (select id, row_number() over(partition by id order by grp) pos, name, case when coalesce(tx,'')<>'' then tx||' ' else '' end description, coalesce(technologies,[]::varchar[]) technologies, coalesce(url,own) url from (select *, case when own<>'' then {_strip("substr(title,1,instr(title,own)-1)")} else title end as name from pb) where name<>'')"""
_CERTS = f"""{_lines_of("cl", "CERTIFICATIONS")},
cm as (select id, line_no pos, line, list_filter(list_transform(string_split_regex(line,'[,\\-–—][ \\t]*'), lambda x: {_strip("regexp_replace(x,'\\b20[0-9]{2}\\b','','g')")}), lambda x: x<>'') p from (select id, line_no, {_strip("regexp_replace(" + _strip("raw") + f",{_BULLET},'')")} line from cl) where strlen(line)>=3),
ce as (select id, pos::int pos, coalesce(p[1],line) as name, coalesce(p[2],'') issuer, regexp_extract(line,'\\b20[0-9]{{2}}\\b',0) issue_date from cm)"""
_SUMMARY = f"sm as (select id, {_strip('t')} summary from sx where section='SUMMARY')"
_LISTS = f"""li as (select id, section, i-1 pos, p[i] item from (select id, section, p, unnest(range(1,len(p)+1)) i from (select id, section, case when len({_parts("t")})>0 then {_parts("t")} else list_filter(list_transform(string_split(t,{_nl}), lambda y: {_strip(f"regexp_replace({_strip('y')},{_BULLET},'')")}), lambda y: y<>'') end p from sx where section in ('LANGUAGES','AWARDS'))))"""

_one = lambda texts: "(case query_id%" + str(len(texts)) + " " + " ".join(f"when {i} then {_s(t)}" for i, t in enumerate(texts)) + " end)"
_QUERIES = f"""tk as (select entry_id%{Q.SHARES} k, arg_min(canonical_name,entry_id) filter (entry_kind='title') title, coalesce(string_agg(canonical_name,', ' order by entry_id) filter (entry_kind='skill'),'') skills from skill_taxonomy group by 1),
qx as (select query_id, {_one(Q.RANKS)}||title||{_nl}||'Requirements: '||skills||' preferred'||{_nl}||{_one(Q.DEMANDS)} as text from (select distinct jd_id query_id from cpp_score) q join tk on k=query_id%{Q.SHARES})"""


def _again(sql: str, suffix: str) -> str:
    """The same tables of hits under other names."""
    return re.sub(r"\b(wd|ng|h|lh)\b", rf"\g<1>{suffix}", sql)


_SKILLS = f"""{SQL._PATTERNS}, dsrc as (select id, text from dx where text<>''), {SQL._scan("dsrc")}, {SQL._LONGEST},
tr as (select distinct id, m.canonical canonical, m.category category, 0.95::double confidence, 'trie' as method from lh),
raw as (select id, skill, {SQL._k2("skill")} pattern from ss), ex as (select id, canonical, category, 1.0::double confidence, 'exact' as method from raw join fw using(pattern)),
rs as (select id, skill from raw anti join fw using(pattern)), tv as (select skill job_title from rs), {SQL._FUZZY},
ct as (select canonical, min(category) category from pt group by 1),
nr as (select id, fz.canonical, ct.category, sim*0.85 confidence, 'fuzzy' as method from rs join fz on rs.skill=fz.value join ct on ct.canonical=fz.canonical),
sk as (select id, canonical, category, confidence, method from (select * from tr union all select * from ex union all select * from nr) qualify row_number() over(partition by id, canonical order by confidence desc, method desc)=1),
qsrc as (select query_id id, text from qx), {_again(SQL._scan("qsrc"), "2")}, {_again(SQL._LONGEST, "2")},
qn as (select distinct id query_id, m.canonical canonical, m.category category from lh2),
pp as (select doc_id id, jd_id query_id, resume_embedding re, jd_embedding je from cpp_score qualify row_number() over(partition by doc_id, jd_id order by scored_at desc nulls last, score_id desc)=1),
ok as (select pp.*, dx.text dtext, qx.text qtext, lower(qx.text) low from pp join dx using(id) join qx using(query_id) where dx.text<>''),
gp as (select ok.id, ok.query_id, qn.canonical skill, sk.canonical is not null held from ok join qn using(query_id) left join sk on sk.id=ok.id and sk.canonical=qn.canonical),
gl as (select ok.id, ok.query_id, coalesce(list(skill order by skill) filter (held),[]::varchar[]) matched, coalesce(list(skill order by skill) filter (not held),[]::varchar[]) missing from ok left join gp using(id,query_id) group by 1,2),
g as (select id, query_id, len(matched) m, len(missing) x, len(matched)+len(missing) j, matched, missing, list_transform(list_concat(matched,missing), lambda y: lower(y)) need from gl),
hc as (select id, count(*) c, avg(confidence) ac, avg((confidence>=0.85)::int) hi, count(distinct category) kinds, count(*) filter (method='fuzzy') fz from sk group by 1),
dm as (select id, s/total share from (select id, category, s, sum(s) over(partition by id) total, row_number() over(partition by id order by s desc, category) rn from (select id, category, sum(confidence) s from sk group by all)) where rn=1)"""

_J3 = SQL._EXPERIENCE[len(SQL._JOBS) + 2 : SQL._EXPERIENCE.index(",\nfx as")]
_INNER = "string_split_regex({t},'[ \\t]+')"
_TABLES = f"""{_J3},
s1 as (select id, {_ladder("degree", L.DEGREES, 0.0)} lvl, lower(coalesce(field_of_study,'')) fl, lower(coalesce(institution,'')) il, lower(coalesce(end_date,'')) el,
 list_transform(regexp_extract_all(gpa,'([0-9]+\\.?[0-9]*)',1), lambda x: x::double) g, coalesce(try_cast(nullif(regexp_extract(coalesce(end_date,''),'(?:^|[^A-Za-z0-9_])((?:19|20)[0-9]{{2}})(?:$|[^A-Za-z0-9_])',1),'') as int),2015) yr from sc),
s2 as (select id, count(*) n, max(lvl) lvl, string_agg(fl,'|') fls, max(case when len(g)>0 and coalesce(g[2],1)<>0 then least(1,g[1]/nullif(coalesce(g[2],case when g[1]<=4 then 4 else 100 end),0)) end) gpa,
 max(case when el in ('','present') then 1 else greatest(0,1-greatest(0,2026-yr)/20.0) end) rec, bool_or(el in ('present','current')) cur, bool_or({SQL._TOP}) top, count(distinct nullif(il,'')) insts from s1 group by id),
p1 as (select id, count(*) n, avg(len(technologies)) tech, avg((url<>'')::int) links, list_distinct(flatten(list(list_transform(technologies, lambda y: lower(y))))) every, list(lower(concat_ws(' ',description,name))) texts, bool_or(contains(lower(url),'github')) oss,
 avg(strlen(nullif(description,''))) ln, avg(coalesce(regexp_matches(nullif(description,''),{_s(L.QUANTITY)}),false)::int) quant, sum(len(regexp_extract_all(description,{_s(L.QUANTITY_GLOBAL)}))) figures from pj group by id),
c1 as (select id, count(*) n, count(distinct nullif(lower(issuer),'')) iss, list_distinct(flatten(list(list_filter(string_split_regex(lower(name),'[ \\t]+'), lambda w: strlen(w)>3)))) words, max(case when regexp_extract(issue_date,'(20[0-9]{{2}})',1)='' then 0.5 else greatest(0,1-greatest(0,2026-try_cast(regexp_extract(issue_date,'(20[0-9]{{2}})',1) as int))/10.0) end) rec,
 bool_or(contains(lower(name),'cloud') or contains(lower(name),'aws') or contains(lower(name),'azure') or contains(lower(name),'gcp')) cloud, bool_or(contains(lower(name),'security') or contains(lower(name),'cissp') or contains(lower(name),'ceh') or contains(lower(name),'oscp')) sec from ce group by id),
b1 as (select id, count(*) jobs, sum(len(b)) nb, sum({SQL._verbs("b", L.ACTION_VERBS_GLOBAL)}) nv, sum(coalesce(list_sum(list_transform(b, lambda x: len(regexp_extract_all(x,{_s(L.QUANTITY_GLOBAL)})))),0)) fig, sum(coalesce(list_sum(list_transform(b, lambda x: strlen(x))),0)) chars, avg((coalesce(start_date,'')<>'')::int) dated from jb group by id),
l1 as (select id, count(*) n from ss group by id),
dt as (select id, {SQL._tok("text")} t from dsrc), qt as (select query_id, {SQL._tok("text")} t from qx),
di as (select id, total, term, count(*) tf from (select id, len(t) total, unnest(t) term from dt) group by all), qi as (select query_id, total, term, count(*) tf from (select query_id, len(t) total, unnest(t) term from qt) group by all),
dn as (select id, sqrt(sum(power(tf::double/total*coalesce(w,2.0),2))) nd from di left join {SQL._IDF} on di.term=idf.term group by 1), qm as (select query_id, sqrt(sum(power(tf::double/total*coalesce(w,2.0),2))) nd from qi left join {SQL._IDF} on qi.term=idf.term group by 1),
mt as (select ok.id, ok.query_id, sum(case when d.tf>0 then ln(1+d.total/(d.tf+1))*d.tf*2.5/(d.tf+1.5) else 0 end) bm, sum(case when d.tf>0 then d.tf::double/d.total*q.tf/q.total*power(coalesce(w,2.0),2) else 0 end) dot, count(d.tf) shared, count(*) nq,
 sum(q.tf::double/q.total*least(1.0,coalesce(d.tf::double/d.total,0)/(q.tf::double/q.total+0.001)))/sum(q.tf::double/q.total) tfw from ok join qi q using(query_id) left join di d on d.id=ok.id and d.term=q.term left join {SQL._IDF} on q.term=idf.term group by 1,2)"""

_SEN = _ladder("low", L.QUERY_SENIORITY, L.QUERY_DEFAULT)
_FIELD = "greatest(0," + ",".join(f"case when contains(e.fls,{_s(k)}) then case when contains(low,{_s(k)}) then {v} else {v * 0.5} end else 0 end" for k, v in L.FIELDS.items()) + ")"
_BI = "case when len({t})>=2 then list_distinct(list_transform(range(1,len({t})), lambda i: {t}[i]||' '||{t}[i+1])) else []::varchar[] end"
_WORDS = SQL._WORDS.format(c="dtext")
_FORMULAS = {
    "skill_coverage_ratio": "cov", "critical_skill_coverage": "cov", "optional_skill_coverage": "cov", "num_matched_skills": _cap("g.m", 20), "num_missing_skills": "1-" + _cap("g.x", 15), "num_partial_skills": "0",
    "rare_skill_bonus": "case when sc_>g.j then least(0.3,(sc_-g.j)/20.0) else 0 end", "skill_category_diversity": _cap("h0.kinds", 10), "avg_skill_confidence": "h0.ac", "high_confidence_skill_ratio": "h0.hi", "total_canonical_skills": _cap("sc_", 30),
    "skills_text_length": _cap("sc_", 25), "unmatched_skill_ratio": "(sc_>0)::int", "primary_domain_confidence": "dm.share", "jd_skill_count": _cap("g.j", 20), "jd_critical_skill_count": "case when g.j=0 then 0 else " + _cap("crit", 10) + " end",
    "skill_exact_match_count": _cap("sc_-coalesce(h0.fz,0)", 20), "skill_fuzzy_match_count": _cap("h0.fz", 10), "skill_missing_critical_count": "1-least(g.x,crit)/crit", "skill_has_all_required": "case when g.x=0 then 1 else cov end",
    "total_experience_months": _cap("x.total", 240), "relevant_experience_months": f"x.total*(1-abs(x.max_sen-{_SEN}))/240", "num_positions": _cap("x.n", 10), "avg_tenure_months": _cap("x.avg_m", 60), "max_tenure_months": _cap("x.max_m", 120),
    "employment_gap_months": "1-" + _cap("greatest(0,x.since-x.total)", 24), "num_gaps": "1-" + _cap("case when x.since-x.total>0 then greatest(1,floor((x.since-x.total)/12)) when x.n>0 then 0 end", 5), "is_currently_employed": "x.cur::int", "max_seniority_score": "x.max_sen", "avg_seniority_score": "x.avg_sen",
    "has_leadership_keywords": "x.led::int", "num_promotions": _cap("x.ups", 3), "quantified_achievement_count": _cap("x.quant", 10), "action_verb_density": "case when x.bul>0 then x.verb::double/x.bul else 0 end", "career_progression_score": "case when x.n<2 then 0.5 when x.n>=2 then greatest(0,least(1,0.5+x.last_sen-x.first_sen)) end",
    "num_degrees": _cap("e.n", 3), "highest_degree_level": "e.lvl", "degree_field_match": f"case when e.n>0 then {_FIELD} end", "gpa_normalized": "e.gpa", "has_gpa": "(e.gpa is not null)::int", "is_currently_studying": "e.cur::int", "education_recency_score": "e.rec", "prestigious_institution_flag": "e.top::int", "num_institutions": _cap("e.insts", 3),
    "degree_requirement_met": "case when e.n is null then 0 when not (contains(low,'degree required') or contains(low,'bachelor') or contains(low,'b.s.')) then 0.5 when e.lvl>=0.6 then 1 else 0 end",
    "num_projects": _cap("p.n", 10), "avg_technologies_per_project": _cap("p.tech", 8), "project_link_ratio": "p.links", "project_tech_overlap": "case when p.n>0 then case when g.j>0 then len(list_intersect(p.every,g.need))::double/g.j else 0.5 end end",
    "project_domain_relevance": "least(1,list_sum(list_transform(p.texts, lambda t: len(list_filter(g.need, lambda y: contains(t,y)))))::double/greatest(1,g.j))", "has_open_source": "p.oss::int", "avg_project_desc_length": _cap("p.ln", 300), "project_quantification_score": "p.quant",
    "num_certifications": _cap("c.n", 8), "num_unique_issuers": _cap("c.iss", 5), "has_certifications": "(c.n>0)::int", "jd_cert_match": "(len(list_filter(c.words, lambda w: contains(low,w)))>0)::int", "cert_recency_score": "c.rec", "has_cloud_cert": "c.cloud::int", "has_security_cert": "c.sec::int",
    "section_completeness_score": "((coalesce(cn.full_name,'')<>'')::int+(coalesce(cn.email,'')<>'')::int+(coalesce(sm.summary,'')<>'')::int+(coalesce(x.n,0)>0)::int+(coalesce(e.n,0)>0)::int+(coalesce(l1.n,0)>0)::int+(coalesce(p.n,0)>0)::int+(coalesce(c.n,0)>0)::int)/8.0",
    "action_verb_density_global": "case when b.nb>0 then b.nv::double/b.nb else 0 end", "quantified_achievements_total": _cap("coalesce(b.fig,0)+coalesce(p.figures,0)", 20), "avg_bullet_length": "least(1.0,(case when b.nb>0 then b.chars::double/b.nb else 0 end)/150)", "total_word_count": _cap("wc", 2000),
    "resume_length_score": "case when wc<100 then 0.2 when wc<300 then 0.5 when wc<=2000 then 1 when wc<=2500 then 0.8 else 0.6 end", "formatting_consistency": "coalesce(b.dated,0.5)", "has_summary": "(coalesce(sm.summary,'')<>'')::int", "has_links": "(coalesce(cn.linkedin,'')<>'' or coalesce(cn.github,'')<>'')::int", "has_contact_info": "(coalesce(cn.email,'')<>'' or coalesce(cn.phone,'')<>'')::int",
    "bm25_score": "mt.bm/(mt.bm+10)", "tfidf_cosine_similarity": "case when dn.nd*qm.nd>0 then least(1.0,mt.dot/(dn.nd*qm.nd)) else 0 end", "keyword_overlap_count": _cap("mt.shared", 30), "keyword_overlap_ratio": "mt.shared::double/mt.nq", "cosine_similarity": SQL._cos("ok.re", "ok.je"), "jd_term_coverage": "mt.shared::double/mt.nq",
    "resume_jd_length_ratio": "least(1,len(dt.t)::double/len(qt.t)/3)", "bigram_overlap_ratio": f"case when len({_BI.format(t='qt.t')})>0 then len(list_intersect({_BI.format(t='dt.t')},{_BI.format(t='qt.t')}))::double/len({_BI.format(t='qt.t')}) else 0 end", "title_match_score": "0.5", "summary_jd_similarity": "0.5",
    "jd_unique_term_count": _cap("len(list_distinct(qt.t))", 200), "resume_unique_term_count": _cap("len(list_distinct(dt.t))", 400), "jd_tech_term_count": _cap(f"len(list_intersect(list_distinct(qt.t),{SQL._TECH}))", 20), "resume_tech_term_count": _cap(f"len(list_intersect(list_distinct(dt.t),{SQL._TECH}))", 30), "tf_weighted_keyword_score": "mt.tfw",
    "job_hopper_flag": "(x.short>=3)::int", "overqualified_flag": f"(x.max_sen>{_SEN}+0.3 and x.total>120)::int", "readability_score": "(206.835-1.015*(wc::double/sen_)-84.6*(len(regexp_extract_all(lower(dtext),'[aeiouy]'))::double/greatest(1,wc)))/100", "keyword_stuffing_penalty": "(coalesce(l1.n,0)::double/greatest(1,wc)>0.25)::int",
}


def _guarded(name: str) -> str:
    """A feature in 0..1, 0 where the document has none of its children."""
    some = {"experience": "x.n>0", "education": "e.n>0", "projects": "p.n>0", "certificates": "c.n>0"}
    group = next(g for g, names in P.GROUPS.items() if name in names)
    when = some.get(group) or ("x.n>0" if name in ("job_hopper_flag", "overqualified_flag") else "sc_>0" if "h0." in _FORMULAS[name] else "true")
    return f"(case when {when} then greatest(0,least(1,coalesce(({_FORMULAS[name]})::double,0))) else 0 end)"


_PARSE = f"{_SECTIONS}, {_EXPERIENCE}, {_EDUCATION}, {_SKILL_LIST}, {_PROJECTS}, {_CERTS}, {_SUMMARY}, {_LISTS}"
_FEATURES = f"""with {_PARSE}, {_QUERIES}, {_SKILLS}, {_TABLES},
fv as (select ok.id, ok.query_id, g.matched, g.missing, {", ".join(f"{_guarded(f)} {f}" for f in P.FEATURES)}
 from (select *, {_WORDS} wc from ok) ok left join (select *, case when j=0 then 1 else m::double/greatest(j,1) end cov, greatest(1,floor(j/2)) crit from g) g using(id,query_id) left join hc h0 using(id) left join lateral (select coalesce(h0.c,0) sc_) z on true left join dm using(id) left join j3 x using(id) left join s2 e using(id) left join p1 p using(id) left join c1 c using(id) left join b1 b using(id)
 left join l1 using(id) left join sm using(id) left join cn using(id) left join lateral (select greatest(1,coalesce(b.jobs,0))+len(regexp_extract_all(dtext,'[.!?]')) sen_) z2 on true left join dt using(id) left join qt using(query_id) left join dn using(id) left join qm using(query_id) left join mt using(id,query_id))"""


def _score(name: str) -> str:
    return "greatest(0,least(100,100*(" + "+".join(f"{k}*({w})" for k, w in L.CATEGORY_WEIGHTS[name].items()) + ")))"


_SCORES = f"""{_FEATURES}, cs as (select *, {", ".join(f"{_score(n)} {n}_score" for n in S.CATEGORIES)} from fv),
co as (select *, {_up(_up("least(100,greatest(0," + "+".join(f"{n}_score*{w}" for n, w in L.OVERALL_WEIGHTS.items()) + "))"), 1)} overall_score from cs)"""
_RULES = "(values " + ",".join(f"({i},{_s(n)},{p}::double,{q}::double,{_s(a)},{_s(b)})" for i, (n, p, q, a, b) in enumerate(L.EXPLANATIONS)) + ") ru(ord,feature,pos,neg,pt,nt)"
_VALUES = "(" + " union all ".join(f"select id, query_id, {_s(n)} feature, {n} v from fv" for n, *_ in L.EXPLANATIONS) + ")"
_RULED = f"""fw_ as (select *, floor(v*240+1e-9)::int mo from {_VALUES}),
ff as (select id, query_id, ord, feature, case when v>=pos then 'positive' else 'negative' end side, case when v>=pos then v else 1-v end weight,
 replace(case when v>=pos then pt else nt end, '{{value}}', case when feature='relevant_experience_months' then {SQL._MONTHS} else round_even(v*100,0)::int||'%' end) as text from fw_ join {_RULES} using(feature) where v>=pos or v<neg)"""
_SOME = "array_to_string({c}[1:3],', ')||case when len({c})>3 then ' +'||(len({c})-3)||' more' else '' end"
_NAMED = f"""sf_ as (select id, query_id, 100 ord, 'missing' feature, 'negative' side, 0.9::double weight, 'Missing required skills: '||{_SOME.format(c="missing")} as text from fv where len(missing)>0 union all select id, query_id, 101, 'matched', 'positive', 0.85, 'Strong alignment: '||array_to_string(matched[1:3],', ') from fv where len(matched)>0),
tf_ as (select id, query_id, side, rank, text from (select *, row_number() over(partition by id, query_id, side order by weight desc, ord) as rank from (select * from ff union all select * from sf_)) where rank<=5)"""
_FALL = f"""sd as (select id, query_id, bool_or(side='positive') p, bool_or(side='negative') n from tf_ group by 1,2),
fa as (select id, query_id, side, rank, text from tf_ union all select co.id, co.query_id, 'positive', 1, {_s(S.BASELINE_FACTOR)} from co left join sd using(id,query_id) where not coalesce(p,false) and (skills_score+experience_score+semantic_score)/3>=40
 union all select co.id, co.query_id, 'negative', 1, {_s(S.NO_GAP_FACTOR)} from co left join sd using(id,query_id) where not coalesce(n,false))"""


def oracle_sql() -> dict[str, str]:
    head = f"coalesce(pr.t,'')||{_nl}||coalesce(substr(text,1,list_max(list_filter(range(0,501), lambda k: strlen(substr(text,1,k))<=500))),'')"
    phone = "regexp_extract(hd,'\\+?[0-9 \\t\\n\\r\\-().]{7,18}[0-9]',0)"
    flags = "concat_ws('; '," + ",".join(f"case when {c}>0.5 then {_s(t)} end" for c, t in S.RED_FLAGS.items()) + ")"
    return {
        "x1_x3_contacts": f"""with {_SECTIONS}, hh as (select dx.id, {head} hd from dx left join pr using(id)) select id, regexp_extract(hd,'[A-Za-z0-9_.+\\-]+@[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_.]{{2,}}',0) email, case when length(regexp_replace({phone},'[^0-9]','','g'))>=7 then {_strip(phone)} else '' end phone,
 regexp_extract(hd,'(?i)linkedin\\.com/in/[A-Za-z0-9_\\-]+',0) linkedin, regexp_extract(hd,'(?i)github\\.com/[A-Za-z0-9_\\-]+',0) github from hh""",
        "x4_full_name": f"""with {_SECTIONS}, {_lines_of("nl", "", "pr")} select id, arg_min(line,line_no) full_name from (select *, list_filter(string_split_regex(line,'[ \\t]+'), lambda w: w<>'') ws from (select id, line_no, {_strip("raw")} line from nl) where not regexp_matches(line,'@|http|linkedin|github'))
 where len(ws) between 2 and 5 and len(list_filter(ws, lambda w: length(regexp_replace(w,'[^A-Za-z]','','g')) < 0.7*strlen(w)))=0 group by id""",
        "x5_summary": f"with {_SECTIONS}, {_SUMMARY} select id, length(summary)::int n_chars, md5(summary) summary_md5 from sm",
        "x6_experience": f"with {_SECTIONS}, {_EXPERIENCE} select id, pos::bigint pos, job_title, company, start_date, end_date, is_current, len(bullets)::int n_bullets, md5(array_to_string(bullets,'|')) bullets_md5 from xx",
        "x8_education": f"with {_SECTIONS}, {_EDUCATION} select id, pos::bigint pos, degree, field_of_study, institution, start_date, end_date, gpa from ee",
        "x10_skills": f"with {_SECTIONS}, {_SKILL_LIST} select id, pos::int pos, skill from ss",
        "x11_projects": f"with {_SECTIONS}, {_PROJECTS} select id, pos::int pos, name, md5(description) description_md5, array_to_string(technologies,'|') technologies, url from pj",
        "x12_certs": f"with {_SECTIONS}, {_CERTS} select * from ce",
        "x13_lists": f"with {_SECTIONS}, {_LISTS} select id, section, pos::int pos, item from li",
        "x15_parse": f"with {_PARSE} select dx.id, coalesce(a.n,0) n_experience, coalesce(b.n,0) n_education, coalesce(c.n,0) n_skills, coalesce(d.n,0) n_projects, coalesce(e.n,0) n_certificates, coalesce(f.n,0) n_lists from dx "
        + " ".join(f"left join (select id, count(*) n from {t} group by id) {k} using(id)" for t, k in (("xx", "a"), ("ee", "b"), ("ss", "c"), ("pj", "d"), ("ce", "e"), ("li", "f"))) + " where text<>''",
        "c_pair_features": f"{_FEATURES} select id, query_id, {', '.join(f'{_up(f, 4)} {f}' for f in P.FEATURES)} from fv",
        "c1_c8_scores": f"{_SCORES} select id, query_id, {', '.join(f'{_up(_up(f"{n}_score"), 1)} {n}_score' for n in S.CATEGORIES)}, overall_score, case when overall_score>=75 then 'high' when overall_score>=50 then 'medium' else 'low' end band, 'linear_fallback' as ranking_method from co",
        "e1_rules": f"{_FEATURES}, {_RULED} select feature, side, count(*) n from ff group by 1,2",
        "e3_skill_factors": f"{_FEATURES}, {_RULED}, {_NAMED} select id, query_id, side, text from sf_",
        "e4_top_factors": f"{_FEATURES}, {_RULED}, {_NAMED} select id, query_id, side, rank::int as rank, text from tf_",
        "e5_fallbacks": f"{_SCORES}, {_RULED}, {_NAMED}, {_FALL} select side, rank::int as rank, count(*) n, count(distinct text) texts from fa group by 1,2",
        "u1_red_flags": f"{_FEATURES} select id, query_id, {flags} flags from fv",
        "s2_report_json": f"""{_SCORES} select pp.id, pp.query_id, coalesce(overall_score,0) overall_score, coalesce({_up(_up("semantic_score"), 1)},0) semantic, coalesce(len(matched),0)::int n_matched, coalesce(len(missing),0)::int n_missing, case when co.id is not null then 'linear_fallback' end ranking_method,
 case when co.id is null then case when coalesce(dx.text,'')='' then 'resume_text is empty' else 'jd_text is empty' end end error, {_up("bm25_score", 4)} bm25_score from pp left join dx using(id) left join co using(id,query_id)""",
    }
