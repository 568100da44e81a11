"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: brute-force joins and plain window
functions where the Spark side uses as-of carries, hash pre-filters or
aggregates.  Fixed values (rule lists, formats, lexicon) come from the same
constants so both sides read the same rules.
"""

from __future__ import annotations

from commitlens.functions import fixed
from commitlens.functions.fixed import DIFF_FILE_FORMAT, DIFF_INPUT_TEMPLATE, FILTER_INPUT_TEMPLATE
from commitlens.operators.sampling import initial_size
from commitlens.operators.scoring import lexicon_pattern
from commitlens.plans import jobs
from commitlens.plans.adapters import _PROJECT_SQL, ADAPTER_SQL

LB = r"'\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]'"
WORD = r"'[^ \t\n\r\f\x0B]+'"
ASCII_RX = r"'[\x00-\x7F]+'"


def lit(s: str) -> str:
    """SQL string literal; newlines and tabs as chr() so the text stays exact."""
    parts = []
    buf = ""
    for ch in s:
        if ch in "\n\t":
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def strip(x: str) -> str:
    from commitlens.functions.text import PY_WHITESPACE
    return f"regexp_replace({x}, '^{PY_WHITESPACE}+|{PY_WHITESPACE}+$', '', 'g')"


def splitlines(x: str) -> str:
    p = f"string_split_regex({x}, {LB})"
    return f"(case when {p}[-1] = '' then {p}[1:len({p}) - 1] else {p} end)"


def indent(x: str, n: int = 1) -> str:
    return f"array_to_string(list_transform({splitlines(x)}, lambda l: {lit(chr(9) * n)} || l), chr(10))"


def is_ascii(x: str) -> str:
    return f"regexp_full_match({x}, {ASCII_RX})"


def with_ctes(*ctes: tuple[str, str], body: str) -> str:
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in ctes) + "\n" + body


def A(name: str) -> tuple[str, str]:
    return (name, ADAPTER_SQL[name])


# --- shared pieces --------------------------------------------------------------

ASCII_OK = (f"commit_title is not null and {is_ascii('commit_title')} and "
            f"(commit_description is null or {is_ascii('commit_description')})")
STOP = "lower(commit_title) in (" + ", ".join(lit(t) for t in sorted({t.lower() for t in fixed.USELESS_TITLES})) + ")"
RULES = [("useless_title", STOP)] + [(n, f"regexp_matches(commit_title, {lit(p)})") for n, p in fixed.TITLE_PATTERNS]
F1 = ("f1", f"select * from commits where {ASCII_OK} and not (commit_description is null and ("
      + " or ".join(c for _, c in RULES) + "))")
MSG = "concat(commit_title, chr(10), coalesce(commit_description, 'EMPTY'))"
U = ("u", "select commit_title, commit_description, commit_link, commit_diff_file from (select *, row_number() over "
     "(partition by commit_title, commit_description order by commit_link, commit_diff_file) as rn from f1) where rn = 1")


def answer(text: str) -> str:
    found = f"regexp_extract(lower(coalesce({text}, '')), {lit(lexicon_pattern())}, 1)"
    head = f"{fixed.FILTER_IS_PERF_HEADER}\n    "
    yes = lit(f"{head}Yes\n\n\n{fixed.FILTER_TYPE_HEADER}\n    ")
    no = lit(f"{head}No\n\n\n{fixed.FILTER_TYPE_HEADER}\n    {fixed.NA_MARKER}")
    return f"(case when {found} <> '' then {yes} || {found} else {no} end)"


TYPE_H = lit(fixed.FILTER_TYPE_HEADER)
HAS_TYPE = f"contains(answer, {TYPE_H})"
ISSUE = f"(case when {HAS_TYPE} then {strip(f'string_split(answer, {TYPE_H})[-1]')} else 'Not Match Format' end)"
IS_PERF = (f"(case when {HAS_TYPE} then " +
           strip(f"string_split(string_split(answer, {lit(fixed.FILTER_IS_PERF_HEADER)})[-1], "
                 f"{lit(chr(10) + fixed.FILTER_TYPE_HEADER)})[1]") + " else 'Not Match Format' end)")
POSITIVE = f"(not contains({ISSUE}, 'N/A'))"
SCORED = ("s", f"select commit_title, commit_description, commit_link, {answer(MSG)} as answer from u")
POS_MSG = ("pos", "select f1.* from f1 join (select commit_title, commit_description from s where " + POSITIVE
           + ") v on f1.commit_title = v.commit_title and f1.commit_description is not distinct from v.commit_description")

# classification answers
CLS_TYPES = strip(f"split_part(split_part(answer, {lit(fixed.CLASS_CAUSE_HEADER)}, 1), {lit(fixed.CLASS_TYPE_HEADER)}, 2)")
CLS_CAUSES = strip(f"split_part(answer, {lit(fixed.CLASS_CAUSE_HEADER)}, 2)")


def items(x: str, drop_na: bool) -> str:
    parts = rf"string_split(regexp_replace({x}, '[\[\]]', '', 'g'), ',')"
    if drop_na:
        parts = f"list_filter({parts}, lambda y: y <> 'N/A')"
    return f"list_transform({parts}, lambda y: {strip('y')})"


CLS = ("cls", f"""select commit_link, types_text, causes_text,
 case when types_text = '[N/A]' then ['N/A'] else {items('types_text', True)} end as pi_types,
 case when causes_text = '[N/A]' then ['N/A'] else {items('causes_text', False)} end as root_causes,
 types_text = '[N/A]' as is_na
from (select commit_link, {CLS_TYPES} as types_text, {CLS_CAUSES} as causes_text from
 (select * from (select *, row_number() over (partition by commit_link order by answer) as rn from answers) where rn = 1))""")
IGNORED = "(" + ", ".join(lit(x) for x in fixed.TAXONOMY_IGNORED) + ")"
KNOWN = "(" + ", ".join(lit(x) for x in [k for k, _ in fixed.TAXONOMY] + fixed.TAXONOMY_IGNORED) + ")"
CASE_MAP = "case y " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in fixed.TAXONOMY) + " end"
MERGED = ("merged", f"""select *, list_filter(list_transform(list_filter(pi_types, lambda y: y not in {IGNORED}),
 lambda y: {CASE_MAP}), lambda y: y is not null) as unique_pi_types from cls where not is_na""")

N0 = f"cast('{initial_size()!r}' as double)"


def size_expr(n: str) -> str:
    return f"cast(ceil({N0} / (1.0 + ({N0} - 1.0) / cast({n} as double))) as bigint)"


def ranked_sample(strata: str, key: str, stratum: str, seed: str, occurrences: bool = False) -> str:
    pop = "count(*)" if occurrences else f"count(distinct {key})"
    return f"""select {key}, {stratum}, rank from (
 select x.{key}, x.{stratum}, n.sample_size,
  row_number() over (partition by x.{stratum} order by md5(concat_ws('|', cast(x.{key} as varchar), x.{stratum}, '{seed}')), x.{key}) as rank
 from (select distinct {key}, {stratum} from {strata}) x
 join (select {stratum}, {size_expr(pop)} as sample_size from {strata} group by {stratum}) n
 on x.{stratum} = n.{stratum}) where rank <= sample_size"""


# release matching
CD = ("cd", "select distinct git_link, commit_link, commit_date from commits where commit_date is not null")
USEFUL = ("useful", """select * from (select distinct * from release_assets) a where exists (select 1 from release_assets b
 where b.git_link = a.git_link and b.apk_version = a.apk_version and b.download_file_name like '%.apk')""")
APK = ("apk", """select git_link, apk_version, download_link as apk_download_link from (select *, row_number() over
 (partition by git_link, apk_version order by case when download_file_name = 'app-universal-release.apk' then 0
  when download_file_name = 'mobile.apk' then 1 else 2 end, length(download_file_name), download_file_name, download_link) as rn
 from useful where download_file_name like '%.apk') where rn = 1""")
ZIP = ("zip", """select g.git_link, g.apk_version,
 case when z.nz = 1 then za.k else zb.k end as source_code_download_link
from (select distinct git_link, apk_version from useful) g
left join (select git_link, apk_version, count(*) as nz from useful where contains(download_file_name, '.zip') group by all) z
 on z.git_link = g.git_link and z.apk_version = g.apk_version
left join (select git_link, apk_version, download_link as k from (select *, row_number() over (partition by git_link, apk_version
  order by length(download_file_name), download_file_name, download_link) as rn from useful
  where contains(download_file_name, '.zip')) where rn = 1) za on za.git_link = g.git_link and za.apk_version = g.apk_version
left join (select git_link, apk_version, download_link as k from (select *, row_number() over (partition by git_link, apk_version
  order by length(download_file_name), download_file_name, download_link) as rn from useful
  where contains(download_file_name, '.zip') and download_file_name <> 'html.zip') where rn = 1) zb
 on zb.git_link = g.git_link and zb.apk_version = g.apk_version""")
FIRST = ("firstdate", "select git_link, apk_version, min(release_date) as apk_release_time from useful group by all")
APAIRS = ("apairs", """select m.git_link, m.commit_link, m.commit_date as commit_release_time, f.apk_release_time, m.apk_version,
 apk.apk_download_link, zip.source_code_download_link
from (select cd.*, u.apk_version, row_number() over (partition by cd.commit_link
  order by u.release_date desc, u.apk_version desc, u.download_link desc) as rn
  from cd join useful u on u.git_link = cd.git_link and u.release_date < cd.commit_date) m
join firstdate f on f.git_link = m.git_link and f.apk_version = m.apk_version
join apk on apk.git_link = m.git_link and apk.apk_version = m.apk_version
left join zip on zip.git_link = m.git_link and zip.apk_version = m.apk_version
where m.rn = 1""")
SPAIRS = ("spairs", """select git_link, commit_link, commit_date as commit_release_time, release_date as apk_release_time,
 apk_version, apk_download_link, source_code_download_link from (select cd.*, st.apk_version, st.release_date,
  st.apk_download_link, st.source_code_download_link, row_number() over (partition by cd.commit_link
  order by st.release_date desc, st.apk_version desc, st.apk_download_link desc, st.source_code_download_link desc) as rn
 from cd join (select distinct * from store_releases) st on st.git_link = cd.git_link and st.release_date < cd.commit_date)
where rn = 1""")
NORM = r"nullif(regexp_extract({v}, '\d+(\.\d+)+', 0), '')"
RELEASE_CTES = [A("commits"), A("release_assets"), A("store_releases"), CD, USEFUL, APK, ZIP, FIRST, APAIRS, SPAIRS]

# verification
PIVOT = ("pv", """select commit_link, path, max(case when side = 'before' then content end) as before,
 max(case when side = 'release' then content end) as release, max(case when side = 'after' then content end) as after,
 bool_or(side = 'before') as has_before from snapshot group by all""")
LINE_I = strip(f"{splitlines('before')}[i]")
FX = ("fx", f"""select ch.commit_link, ch.path, case when suffix(ch.path, '.apk') or suffix(ch.path, '.so') then null
 when len(ch.deleted_lines) = 0 and len(ch.added_lines) > 0 and {splitlines('pv.after')}[len(ch.added_lines) + 1] is null
  and {splitlines('pv.after')}[len(ch.added_lines)] is not null then not coalesce(pv.has_before, false)
 when pv.before is null then null when pv.release is null then false
 when len(ch.deleted_lines) = 0 then pv.release = pv.before
 when list_bool_or(list_transform(ch.deleted_lines, lambda i: {LINE_I.replace('before', 'pv.before')} is null)) then null
 else list_bool_and(list_transform(ch.deleted_lines, lambda i: contains(pv.release, {LINE_I.replace('before', 'pv.before')})))
 end as ok
from changes ch left join pv on pv.commit_link = ch.commit_link and pv.path = ch.path""")

# prompts
_tpl = FILTER_INPUT_TEMPLATE.split(fixed.TEMPLATE_SLOT)
DESC_OR_EMPTY = "coalesce(commit_description, 'EMPTY')"
FILLED = f"{lit(_tpl[0])} || {indent('commit_title')} || {lit(_tpl[1])} || {indent(DESC_OR_EMPTY)} || {lit(_tpl[2])}"
_ex_in, _ex_out = jobs.EXAMPLES[0]
PROMPT_TEXT = (f"{lit('system: ' + jobs.SYSTEM_TEXT + chr(10) * 2 + 'user: ' + _ex_in + chr(10) * 2 + 'assistant: ' + _ex_out + chr(10) * 2 + 'user: ')}"
               f" || {FILLED}")
_head, _rest = DIFF_FILE_FORMAT.split("{name}")
_pre_n, _post_n = _head.split("{n}")
_mid, _tail = _rest.split("{patch}")
FILE_PIECE = (f"{lit(_pre_n)} || cast(rn as varchar) || {lit(_post_n.replace('{{', '{'))} || file_name || {lit(_mid)} || "
              f"{indent('patch', 2)} || {lit(_tail.replace('}}', '}'))}")
_dt = DIFF_INPUT_TEMPLATE.split(fixed.TEMPLATE_SLOT)

# Pages: the expected rows of page parsers that read given pages use the same few patterns; pytest
# compares those with Python's HTML parser, so they are not only checked against themselves.
QUOTED = r"""("[^"]*"|'[^']*')"""
OPEN_A = lit(r"(?is)<a(?:\s[^>]*?)?\shref\s*=\s*" + QUOTED)
ANCHOR = lit(r"(?is)<a(?:\s[^>]*?)?\shref\s*=\s*" + QUOTED + r"[^>]*>(.*?)</a\s*>")
BASE = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"


def decode(x: str) -> str:
    for name, ch in fixed.HTML_ENTITIES:
        x = f"replace({x}, {lit(name)}, {lit(ch)})"
    return x


def inner(x: str) -> str:
    return decode(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


def unquoted(x: str) -> str:
    return decode(f"substr({x}, 2, length({x}) - 2)")


VISIBLE = "html"
for _p in (r"(?s)<!--.*?-->", r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>", r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>"):
    VISIBLE = f"regexp_replace({VISIBLE}, {lit(_p)}, '', 'g')"
VIS = ("vis", f"select page_id, {BASE} as base, {VISIBLE} as h from pages")


def tag(t: str) -> str:
    return "nullif(" + strip(inner(f"regexp_extract(h, {lit(rf'(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}\s*>')}, 1)")) + ", '')"


SQL: dict[str, str] = {
    "heuristic_filter": with_ctes(A("commits"), F1, body="select * from f1"),
    "title_only_filter": with_ctes(A("commits"), body=f"select * from commits where commit_title is not null and {is_ascii('commit_title')}"),
    "rule_audit": with_ctes(A("commits"), ("base", f"select * from commits where {ASCII_OK}"), body=
        "select rule, count(*) as n_rows from (" + " union all ".join(
            f"select '{n}' as rule from base where commit_description is null and {c}" for n, c in RULES)
        + ") group by rule"),
    "funnel": with_ctes(A("commits"), F1, U, SCORED, POS_MSG,
                        ("capped", "select * from pos where commit_link in (select commit_link from pos group by 1 having count(*) <= 5)"),
                        body=" union all ".join(
                            f"select {i} as stage_order, '{n}' as stage, count(*) as n_rows, count(distinct commit_link) as n_commits from {t}"
                            for i, (n, t) in enumerate([("crawled", "commits"), ("heuristic", "f1"), ("positive", "pos"), ("capped", "capped")]))),
    "ascii_documents": f"select doc_id, lang, {is_ascii('text')} as is_ascii from documents",
    "token_budget": f"select doc_id, cast(len(regexp_extract_all(text, {WORD})) as bigint) as n_words from documents",
    "fanout_cap": with_ctes(A("commits"), body="select * from commits where commit_link in (select commit_link from commits group by 1 having count(*) <= 5)"),
    "fanout_hist": with_ctes(A("commits"), body="select n_rows, count(*) as n_keys from (select commit_link, count(*) as n_rows from commits group by 1) group by 1"),
    "fanout_share": with_ctes(A("commits"), body="""select 5 as k, cast(sum(case when n <= 5 then 1 else 0 end) as bigint) as n_at_most,
 count(*) as n_keys, avg(case when n <= 5 then cast(1 as double) else cast(0 as double) end) as share
 from (select commit_link, count(*) as n from commits group by 1)"""),
    "dedup_messages": with_ctes(A("commits"), body="""select commit_title, commit_description, commit_link, commit_diff_file, n_rows from
 (select *, row_number() over (partition by commit_title, commit_description order by commit_link, commit_diff_file) as rn,
  count(*) over (partition by commit_title, commit_description) as n_rows from commits) where rn = 1"""),
    "first_per_commit": with_ctes(A("commits"), body="""select git_link, commit_link, commit_title, commit_description, commit_diff_file, commit_date
 from (select *, row_number() over (partition by commit_link order by commit_diff_file) as rn from commits) where rn = 1"""),
    "exact_dedup": "select distinct text from documents",
    "hash_split": with_ctes(A("commits"), body=f"""select commit_link, case when cast(('0x' || substr(md5(commit_link || 's'), 1, 8))::BIGINT as double)
 / cast(4294967296 as double) < cast('{2 / 3!r}' as double) then 'first' else 'second' end as part
 from (select distinct commit_link from commits)"""),
    "commit_keys": with_ctes(A("commits"), body="""select commit_link, p as project, string_split(commit_link, '/')[-1] as commit_hash,
 concat_ws('___', string_split(p, '/')[-2], string_split(p, '/')[-1]) as project_key,
 translate(regexp_replace(p, '^https?://', ''), '/?', '__') as safe_name,
 concat_ws('/', string_split(commit_link, '/')[-3], 'commit', string_split(commit_link, '/')[-1]) as short_key,
 p as stripped
 from (select distinct commit_link, split_part(commit_link, '/commit/', 1) as p from commits)"""),
    "semi_projects": with_ctes(A("commits"), F1, body="""select c_custkey, c_name, git_link from (select c_custkey, c_name,
 concat('https://github.com/o', cast(c_custkey % 50 as varchar), '/r', cast(c_custkey as varchar)) as git_link from customer)
 where git_link in (select git_link from f1)"""),
    "project_commits": with_ctes(A("commits"), A("release_assets"), F1, body="""select commit_link, commit_diff_file from f1
 where split_part(commit_link, '/commit/', 1) in (select git_link from release_assets)"""),
    "anti_done": with_ctes(A("commits"), F1, ("ol", """select o_orderstatus, o_orderpriority, concat('https://github.com/o',
 cast(o_custkey % 50 as varchar), '/r', cast(o_custkey as varchar), '/commit/', cast(o_orderkey as varchar)) as commit_link from orders"""),
        body="""select distinct commit_link from f1 where commit_link not in (select commit_link from ol where o_orderstatus = 'F')
 and commit_link not in (select commit_link from ol where o_orderpriority = '5-LOW')"""),
    "flag_positive": with_ctes(A("commits"), F1, U, SCORED, body=f"""select f1.*, f1.commit_link in
 (select commit_link from s where {POSITIVE}) as is_perf from f1"""),
    "propagate_message": with_ctes(A("commits"), F1, U, SCORED, body=f"""select f1.*, v.commit_title is not null as is_perf from f1
 left join (select commit_title, commit_description from s where {POSITIVE}) v on f1.commit_title = v.commit_title
 and f1.commit_description is not distinct from v.commit_description"""),
}

_ORD = ("c", "select o_custkey, o_orderkey as commit_key, cast(o_orderdate as date) as commit_date from orders where o_orderstatus = 'O'")
_REL = ("r", "select o_custkey, o_orderkey as release_key, cast(o_orderdate as date) as release_date from orders where o_orderstatus = 'F'")


def _asof_sql(cmp: str, join: str) -> str:
    return with_ctes(_ORD, _REL, body=f"""select o_custkey, commit_key, commit_date, release_key, release_date from
 (select c.o_custkey, c.commit_key, c.commit_date, r.release_key, r.release_date, row_number() over (partition by c.commit_key
  order by r.release_date desc nulls last, r.release_key desc nulls last) as rn
  from c {join} r on c.o_custkey = r.o_custkey and r.release_date {cmp} c.commit_date) where rn = 1""")


SQL.update({
    "asof_release": _asof_sql("<", "join"),
    "asof_left": _asof_sql("<", "left join"),
    "asof_inclusive": _asof_sql("<=", "left join"),
    "asof_events": """select event_id, user_id, ts, signup_id, signup_ts from (select p.event_id, p.user_id, p.ts,
 s.event_id as signup_id, s.ts as signup_ts, row_number() over (partition by p.event_id order by s.ts desc nulls last,
 s.event_id desc nulls last) as rn from (select * from events where event_type = 'purchase') p
 left join (select * from events where event_type = 'signup') s on s.user_id = p.user_id and s.ts < p.ts) where rn = 1""",
    "enrich_time": with_ctes(A("commits"), body="""select c.commit_link, c.commit_diff_file,
 coalesce(case when c.commit_description is not null then c.commit_date end, o.d) as commit_release_time
 from commits c left join (select concat('https://github.com/o', cast(o_custkey % 50 as varchar), '/r', cast(o_custkey as varchar),
 '/commit/', cast(o_orderkey as varchar)) as commit_link, cast(o_orderdate as date) as d from orders where o_orderstatus = 'F') o
 on o.commit_link = c.commit_link"""),
    "verdict_update": with_ctes(("p", f"select commit_key, release_key from ({_asof_sql('<', 'join')})"), body="""select p.commit_key,
 p.release_key, v."check" from p left join (select o_orderkey as commit_key, case when o_totalprice > 100000 then 'same'
 else 'different' end as "check" from orders where o_orderpriority = '1-URGENT') v on v.commit_key = p.commit_key"""),
    "lookup_guard": with_ctes(*RELEASE_CTES, F1, ("pu", """select commit_link, case when apk_version like 'v%' then 'same' end as "check"
 from (select * from apairs union all select * from spairs)"""), body="""select w.commit_link, cast(coalesce(a.n, 0) as bigint) as n_matches,
 case when coalesce(a.n, 0) = 0 then 'missing' when a.n > 1 then 'multiple' when a.v is not null then 'done' else 'todo' end as status
 from (select distinct commit_link from f1) w left join (select commit_link, count(*) as n, max("check") as v from pu group by 1) a
 on a.commit_link = w.commit_link"""),
    "short_key_match": with_ctes(A("answers"), A("commits"), ("links", """select commit_link from commits where cast(string_split(commit_link, '/')[-1] as bigint) % 17 <> 0
 union all select concat('https://github.com/fork/', string_split(commit_link, '/')[-3], '/commit/', string_split(commit_link, '/')[-1])
 from commits where cast(string_split(commit_link, '/')[-1] as bigint) % 13 = 0"""), ("keyed", """select concat_ws('/', string_split(commit_link, '/')[-3], 'commit',
 string_split(commit_link, '/')[-1]) as short_key, commit_link from links"""), body="""select i.short_key,
 case when r.n = 1 then r.l end as commit_link,
 case when coalesce(r.n, 0) = 0 then 'missing' when r.n > 1 then 'ambiguous' else 'ok' end as match_status
 from (select distinct concat_ws('/', string_split(commit_link, '/')[-3], 'commit', string_split(commit_link, '/')[-1]) as short_key
 from answers) i left join (select short_key, count(distinct commit_link) as n, min(commit_link) as l from keyed group by 1) r
 on r.short_key = i.short_key"""),
    "versions_with_binary": with_ctes(A("release_assets"), body="""select * from release_assets a where exists (select 1 from release_assets b
 where b.git_link = a.git_link and b.apk_version = a.apk_version and b.download_file_name like '%.apk')"""),
    "pick_asset": with_ctes(A("release_assets"), USEFUL, APK, body="select * from apk"),
    "pick_archive": with_ctes(A("release_assets"), USEFUL, ZIP, body="select * from zip"),
    "first_release_date": with_ctes(A("release_assets"), USEFUL, FIRST, body="select * from firstdate"),
    "store_pairs": with_ctes(*RELEASE_CTES, body="select * from spairs"),
    "match_releases": with_ctes(*RELEASE_CTES, ("have", f"""select distinct git_link, {NORM.format(v='apk_version')} as nv from apairs
 where {NORM.format(v='apk_version')} is not null"""), body=f"""select *, 'release' as source from apairs union all
 select distinct s.*, 'store' as source from spairs s where s.apk_version = {NORM.format(v='s.apk_version')}
 and not exists (select 1 from have h where h.git_link = s.git_link and h.nv = {NORM.format(v='s.apk_version')})"""),
    "version_norm": with_ctes(A("release_assets"), A("store_releases"), body=f"""select apk_version, {NORM.format(v='apk_version')} as norm_version
 from (select apk_version from release_assets union select apk_version from store_releases)"""),
    "date_formats": """select o_orderkey, store_text, iso_text, strptime(store_text, '%b %d, %Y')::date as store_date,
 cast(split_part(iso_text, 'T', 1) as date) as iso_date from (select o_orderkey, strftime(o_orderdate, '%b %-d, %Y') as store_text,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso_text from orders)""",
    "parse_answer": with_ctes(A("answers"), CLS, body="""select commit_link, types_text, causes_text, array_to_string(pi_types, '|') as pi_types,
 array_to_string(root_causes, '|') as root_causes, is_na from cls"""),
    "parse_filter_answer": with_ctes(A("commits"), F1, U, (SCORED[0], SCORED[1].replace(answer(MSG), f"case when commit_title like 'Speed%' then 'I cannot tell.' else {answer(MSG)} end")), body=f"""select commit_title, commit_description, {IS_PERF} as is_perf,
 {ISSUE} as issue_type, not {HAS_TYPE} as bad_format, {POSITIVE} as positive from s"""),
    "label_counts": with_ctes(A("answers"), CLS, body="select label, count(*) as n from (select unnest(pi_types) as label from cls) group by 1"),
    "taxonomy_merge": with_ctes(A("answers"), CLS, MERGED, body=f"""select commit_link, array_to_string(unique_pi_types, '|') as unique_pi_types,
 array_to_string(list_filter(pi_types, lambda y: y not in {KNOWN}), '|') as unmapped from merged"""),
    "category_counts": with_ctes(A("answers"), CLS, MERGED, body="select label, count(*) as n from (select unnest(unique_pi_types) as label from merged) group by 1"),
    "kappa": """with cont as (select quality as a, toxic as b, count(*) as n from labels where quality is not null and toxic is not null group by 1, 2),
pc as (select a as c, n as na, 0 as nb, case when a = b then n else 0 end as nd from cont union all select b as c, 0 as na, n as nb, 0 as nd from cont),
marg as (select c, sum(na) as na, sum(nb) as nb, sum(nd) as nd from pc group by c),
tot as (select cast(sum(na) as double) as n, sum(cast(na as double) * nb) as pe_num, cast(sum(nd) as double) as po_num from marg)
select cast(n as bigint) as n_items, po_num / n as po, pe_num / (n * n) as pe,
 case when pe_num / (n * n) = 1.0 then null else (po_num / n - pe_num / (n * n)) / (1 - pe_num / (n * n)) end as kappa from tot""",
    "segment_rollup": "select c_mktsegment, count(*) as n from customer group by rollup (c_mktsegment)",
    "sample_sizes": f"select event_type, count(distinct event_id) as population, {size_expr('count(distinct event_id)')} as sample_size from events group by 1",
    "stratified_sample": ranked_sample("events", "event_id", "event_type", "0"),
    "label_sheet": with_ctes(A("answers"), A("commits"), CLS, MERGED, ("strata", "select commit_link, unnest(unique_pi_types) as label from merged"),
        ("picked", f"select distinct commit_link from ({ranked_sample('strata', 'commit_link', 'label', '0', True)})"),
        ("firsts", "select * from (select *, row_number() over (partition by commit_link order by commit_diff_file) as rn from commits) where rn = 1"),
        body="""select commit_link, array_to_string(unique_pi_types, '|') as unique_pi_types, array_to_string(root_causes, '|') as root_causes,
 f.commit_title, f.commit_description,
 '' as contain_perf, '' as PI_caused_class, '' as PI_causes_method, '' as PI_root_causes, '' as optimization_method
 from merged left join firsts f using (commit_link) where commit_link in (select commit_link from picked)"""),
    "build_prompt": with_ctes(A("commits"), F1, U, ("pt", f"select commit_title, commit_description, {PROMPT_TEXT} as prompt_text from u"),
        body=f"select commit_title, commit_description, prompt_text, cast(len(regexp_extract_all(prompt_text, {WORD})) as bigint) as n_words from pt"),
    "diff_prompt": with_ctes(A("diffs"), ("numbered", "select *, row_number() over (partition by commit_link order by file_name, patch) as rn from diffs"),
        ("rendered", f"select commit_link, string_agg({FILE_PIECE}, '' order by rn) as d, min(message) as message, count(*) as n_files from numbered group by 1"),
        body=f"""select commit_link, {lit(_dt[0])} || {indent('message')} || {lit(_dt[1])} || {indent('d')} || {lit(_dt[2])} as prompt_text,
 cast(n_files as bigint) as n_files from rendered"""),
    "hunk_lines": with_ctes(A("diffs"), ("h", r"select *, regexp_extract_all(patch, '@@ -(\d+)(?:,\d+)? \+(\d+)', 1) as olds, regexp_extract_all(patch, '@@ -(\d+)(?:,\d+)? \+(\d+)', 2) as news from diffs"),
        body="""select commit_link, file_name, i - 1 as hunk, cast(olds[i] as integer) as old_start, cast(news[i] as integer) as new_start
 from h, unnest(range(1, len(olds) + 1)) as u(i)"""),
    "example_pairs": """select u.conv_id, u.turn, u.text as input, a.text as output from conversations u join conversations a
 on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'""",
    "verify_pairs": with_ctes(A("snapshot"), A("changes"), PIVOT, FX, body="""select commit_link,
 case when bool_and(ok) or bool_and(ok) is null then 'same' else 'different' end as "check",
 count(*) as n_files, count(*) filter (where ok is null) as n_skipped from fx group by 1"""),
    "page_links": with_ctes(VIS, ("l", f"select page_id, base, unnest(list_transform(regexp_extract_all(h, {OPEN_A}, 1), lambda x, i: {{'q': x, 'pos': i - 1}})) as x from vis"),
        ("u", f"select page_id, base, cast(x.pos as bigint) as pos, {unquoted('x.q')} as href from l"),
        body="select page_id, pos, href, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then href else base || href end as abs_url from u"),
    "page_anchors": with_ctes(VIS, ("l", f"""select page_id, unnest(list_transform(regexp_extract_all(h, {ANCHOR}, 1),
 lambda x, i: {{'q': x, 't': regexp_extract_all(h, {ANCHOR}, 2)[i], 'pos': i - 1}})) as x from vis"""),
        body=f"select page_id, cast(x.pos as bigint) as pos, {unquoted('x.q')} as href, {inner('x.t')} as anchor_text from l"),
    "page_title": with_ctes(VIS, body=f"""select page_id, {tag('title')} as title, {tag('h1')} as h1,
 {unquoted("nullif(regexp_extract(h, " + lit(r"(?is)<a(?:\s[^>]*?)?\shref\s*=\s*" + QUOTED + r"[^>]*>\s*(?:<[^>]*>\s*)*and\s*(?:<[^>]*>\s*)*</a\s*>") + ", 1), '')")} as and_link from vis"""),
    "json_props": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "lexicon_score": with_ctes(A("commits"), F1, U, SCORED, body=f"select commit_title, commit_description, answer, {POSITIVE} as positive from s"),
    "stream_ingest_dedup": "select event_id, ts, user_id, event_type from events",
    "stream_ingest_report": """with l as (select max(ts) - interval 31 day as line from events where event_id % 3 < 2)
 select 0::bigint as batch_id, 2 * count(*) as n_rows, count(*) as n_repeats_in_batch, 0::bigint as n_repeats_earlier, count(*) as n_accepted,
 0::bigint as n_late, 0::bigint as n_late_accepted
 from events where event_id % 3 < 2
 union all select 1, count(*), 0, count(*) filter (event_id % 3 < 2), count(*) filter (event_id % 3 >= 2), count(*) filter (ts < line),
 count(*) filter (ts < line and event_id % 3 >= 2) from events, l""",
    "stream_score_resume": f"select doc_id, {answer('text')} as answer from documents",
    "stream_counts": "select cast(date_trunc('day', ts) as timestamp) as window_start, event_type, count(*) as n from events group by all",
    "csv_roundtrip": "select doc_id, text, lang from documents",
    "line_counts": r"select source, cast(sum(len(string_split_regex(text, '\r\n|\r|\n'))) as bigint) as n_lines from documents group by source",
})
# M1 and M4 must give exactly the native scorer's answers; M3 too, with a mark on what the second scorer answered.
for _k in ("udf_score", "score_incremental"):
    SQL[_k] = SQL["lexicon_score"]
SQL["score_fallback"] = with_ctes(A("commits"), F1, U, SCORED, body=f"""select commit_title, commit_description, answer, {POSITIVE} as positive,
 case when contains({MSG}, 'scroll') then 'second' else 'first' end as answered_by from s""")

SQL.update({
    "csv_recursive": "select lang as category, count(*) as n_docs, sum(n_chars) as n_chars from documents group by 1",
    "json_roundtrip": "select doc_id, lang, n_chars, text from documents",
    "whole_text_sizes": "select source, cast(sum(length(text) + 1) as bigint) as n_chars from documents group by 1",
    "snapshot_index": with_ctes(("mr", SQL["match_releases"]), body="""select git_link, commit_link, commit_release_time, apk_release_time, apk_version, apk_download_link,
 source_code_download_link, source, project_name, commit_hash,
 concat_ws('/', 'data/Saved_Projects', project_name, commit_hash) || '/before_change' as before_change_dir,
 concat_ws('/', 'data/Saved_Projects', project_name, commit_hash) || '/after_change' as after_change_dir
 from (select *, row_number() over (partition by project_name, commit_hash
 order by commit_link, source, apk_version, apk_download_link nulls first, source_code_download_link nulls first) as rn2 from
 (select *, concat_ws('___', string_split(git_link, '/')[-2], string_split(git_link, '/')[-1]) as project_name,
  string_split(commit_link, '/')[-1] as commit_hash from mr)) where rn2 = 1"""),
    "benchmark_report": with_ctes(("mr", SQL["match_releases"]), body="select count(distinct commit_link) as n_commits, count(distinct apk_download_link) as n_apks from mr"),
    "project_sizes": with_ctes(A("commits"), body="""select split_part(commit_link, '/commit/', 1) as git_link, count(*) as n_commits
 from (select distinct commit_link from commits) group by 1 having count(*) <= 10"""),
    "label_report": with_ctes(A("answers"), CLS, body="select label, count(*) as n from (select unnest(pi_types) as label from cls) group by 1"),
})

SQL.update({
    "gap_fill": SQL["match_releases"].replace("select *, 'release' as source from apairs union all\n", "").replace(
        "select distinct s.*, 'store' as source from spairs s", "select distinct s.* from spairs s"),
    "page_sections": with_ctes(VIS, ("l", r"""select page_id, unnest(list_transform(string_split_regex(h, '(?i)<p(?:\s[^>]*)?>')[2:],
 lambda b, i: {'b': string_split_regex(b, '(?i)</p\s*>')[1], 'pos': i - 1})) as x from vis"""),
        body=f"select page_id, cast(x.pos as bigint) as pos, {strip(inner('x.b'))} as text from l"),
    "unmapped_labels": with_ctes(A("answers"), CLS, body=f"""select label, count(*) as n from (select unnest(list_filter(pi_types,
 lambda y: y not in {KNOWN})) as label from cls where not is_na) group by 1"""),
    "stream_page_links": SQL["page_links"],
})

SQL.update({
    "shortest_path": with_ctes(A("snapshot"), body="""select commit_link, path from (select commit_link, path,
 row_number() over (partition by commit_link order by length(path), path) as rn from snapshot
 where side = 'release' and not suffix(path, '.1') and not suffix(path, '.apk')) where rn = 1"""),
})

SQL.update({
    "csv_quarantine": """select 'good' as kind, count(*) as n from (select distinct * from documents)
 union all select 'quarantined' as kind, count(*) as n from events""",
})


def _class_answer_sql(msg: str) -> str:
    from commitlens.operators.scoring import CLASS_LEXICON
    t = f"lower(coalesce({msg}, ''))"
    types = "list_filter([" + ", ".join(
        f"case when regexp_matches({t}, {lit(lexicon_pattern(terms))}) then {lit(label)} end" for label, terms in CLASS_LEXICON
    ) + "], lambda x: x is not null)"
    causes = "list_filter([" + ", ".join(
        f"nullif(regexp_extract({t}, {lit(lexicon_pattern(terms))}, 1), '')" for _, terms in CLASS_LEXICON
    ) + "], lambda x: x is not null)"
    tt = f"case when len({types}) > 0 then '[' || array_to_string({types}, ', ') || ']' else '[N/A]' end"
    ct = f"case when len({causes}) > 0 then '[' || array_to_string({causes}, ', ') || ']' else '[N/A]' end"
    return f"{lit(fixed.CLASS_TYPE_HEADER)} || {tt} || {lit(fixed.CLASS_CAUSE_HEADER + chr(10) + '    ')} || {ct}"


def _classified_sql(by: str) -> str:
    return with_ctes(A("commits"), F1, U, SCORED, POS_MSG,
        ("answers", f"select commit_title, commit_description, {by} as answered_by, {_class_answer_sql(MSG)} as answer from s where {POSITIVE}"),
        ("parsed", f"""select commit_title, commit_description, answered_by, {CLS_TYPES} as types_text, {CLS_CAUSES} as causes_text from answers"""),
        ("v", f"""select commit_title, commit_description, answered_by,
 case when types_text = '[N/A]' then ['N/A'] else {items('types_text', True)} end as pi_types,
 case when causes_text = '[N/A]' then ['N/A'] else {items('causes_text', False)} end as root_causes,
 types_text = '[N/A]' as is_na from parsed"""),
        body=f"""select c.commit_link, c.commit_diff_file, array_to_string(v.pi_types, '|') as pi_types,
 array_to_string(v.root_causes, '|') as root_causes,
 array_to_string(list_filter(list_transform(list_filter(v.pi_types, lambda y: y not in {IGNORED}),
 lambda y: {CASE_MAP}), lambda y: y is not null), '|') as unique_pi_types, v.answered_by
 from pos c join v on c.commit_title = v.commit_title and c.commit_description is not distinct from v.commit_description
 where not v.is_na""")


SQL["classify_commits"] = _classified_sql("'second'")
SQL["classify_scorer"] = _classified_sql(f"case when commit_title like 'Reduce%' then 'done' when contains({MSG}, 'player') then 'second' else 'first' end")

SQL.update({
    "file_inventory": "select source, '.txt' as ext, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by 1",
})

SQL["stream_label_counts"] = SQL["label_counts"]

_LINK = "concat('https://github.com/o', cast(o_custkey % 50 as varchar), '/r', cast(o_custkey as varchar), '/commit/', cast(o_orderkey as varchar))"
_GIT = "concat('https://github.com/o', cast(c_custkey % 50 as varchar), '/r', cast(c_custkey as varchar))"
SQL.update({
    "verify_write_back": with_ctes(A("snapshot"), A("changes"), PIVOT, FX,
        ("pairs", """select distinct commit_link, unnest(case when n % 7 = 0 then ['1.0', '2.0'] else ['1.0'] end) as apk_version,
 case when n % 5 = 0 then 'same' end as "check" from (select doc_id % 100 as n, concat('c', cast(doc_id % 100 as varchar)) as commit_link from documents)"""),
        ("verdicts", "select commit_link, case when bool_and(ok) or bool_and(ok) is null then 'same' else 'different' end as v from fx group by 1"),
        ("todo", """select commit_link from pairs group by 1 having count(*) = 1 and max("check") is null"""),
        body="""select p.commit_link, p.apk_version, coalesce(p."check", v.v) as "check" from pairs p
 left join (select * from verdicts where commit_link in (select commit_link from todo)) v using (commit_link)"""),
    "commit_json": with_ctes(A("diffs"), ("m", "select commit_link, min(message) as message from diffs group by 1"),
        body="select commit_link, m.message, file_name as filename, patch from diffs join m using (commit_link)"),
    "commit_page": f"""select commit_link, 'Fixes <#' || cast(o_orderkey % 100 as varchar) || '> & ' || o_orderpriority as commit_description,
 row_number() over (partition by o_orderkey order by ln, qty) - 1 as file_pos, 'src/F' || ln || '.java' as commit_diff_file,
 concat('int q;', chr(10), '-List<Q> q = ', qty, ';', chr(10), '+if (a && b) q = ', qty + 1, ';', chr(10)) as commit_diff,
 cast(ln * 10 + 1 as varchar) as added_lines, cast(ln * 10 as varchar) as deleted_lines
 from (select {_LINK} as commit_link, o_orderkey, o_orderpriority, cast(l_linenumber as integer) as ln, cast(l_quantity as bigint) as qty
 from orders join lineitem on l_orderkey = o_orderkey)""",
    "commit_time": f"select distinct {_LINK} as commit_link, cast(epoch(o_orderdate) as bigint) as commit_time from orders join lineitem on l_orderkey = o_orderkey",
    "store_page": with_ctes(A("store_releases"), body="select git_link, apk_version as version, release_date as added_on, apk_download_link, source_code_download_link from store_releases"),
    "release_page": with_ctes(A("release_assets"), body="""select distinct git_link, apk_version, download_link || '/' || download_file_name as download_link, download_file_name,
 strftime(release_date, '%Y-%m-%d') as apk_release_time from release_assets where not (apk_version like 'v%' and git_link like '%0')"""),
    "changelog_page": f"""select c_custkey, ch as changelog_link, meta as build_metadata, coalesce(ch = git || '/releases', false) and meta is not null as valid
 from (select c_custkey, {_GIT} as git, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then {_GIT} || '/tags' else {_GIT} || '/releases' end as ch,
 case when c_custkey % 5 <> 0 then '/meta/' || c_custkey || '?a=1&b=2' end as meta from customer)""",
    "next_pages": """select c_custkey, case when c_custkey % 3 <> 0 then 'https://host.example/page/' || (c_custkey + 1) || '/' end as next_listing,
 case when c_custkey % 3 = 1 and c_custkey % 6 <> 1 then 'https://host.example/list/' || (c_custkey + 1) end as next_commits from customer""",
    "commit_list": """select o_custkey as page_id, '/o/r/commit/' || o_orderkey as href, 'Fix <' || o_orderkey || '>' as anchor_text,
 cast(o_orderkey as varchar) as commit_hash from orders where o_orderkey % 6 <> 0""",
    "text_between": r"""select doc_id, nullif(split_part(split_part(text, ' the ', 2), ' of ', 1), '') as after_the,
 nullif(regexp_extract(text, '(?s)\bth\w+ (.*?)[.,]', 1), '') as between from documents""",
    "digits": "select c_custkey, c_custkey * 37 as n, cast(null as bigint) as none from customer",
    "host_filter": "select page_id, url from pages where starts_with(url, 'https://www.')",
    "max_batch": "select max(o_orderkey) as max_batch from orders",
    "seeded_order": with_ctes(A("commits"), F1, body="select distinct commit_link from f1"),
    "key_union": with_ctes(A("commits"), A("answers"), F1, body="select commit_link from f1 union select commit_link from answers"),
    "ext_counts": "select '.json' as ext, count(distinct lang) as n_files from documents union all select '.csv', count(distinct source) from documents",
    "read_lines": "select source as value from documents",
    "category_file": "select true as named, count(*) as n from documents",
    "append_batches": "select o_orderkey, o_orderstatus, case o_orderstatus when 'O' then 1 when 'P' then 2 else 0 end as batch_id from orders",
})

LIST_PAGES = """n as (select o_custkey, cast(ceil(count(*) / 10.0) as bigint) as n_pages from orders group by 1),
lp as (select distinct o_custkey, n_pages, (o_orderkey * 7919) % n_pages as no from orders join n using (o_custkey)),
e as (select 'https://host.example/list/' || o_custkey || '/' || no as p, 'https://host.example/list/' || o_custkey || '/' ||
 case when no + 1 < n_pages then no + 1 when o_custkey % 7 = 0 then 0 when o_custkey % 7 = 1 then 1 end as nx from lp)"""
SQL["page_chains"] = f"""with recursive {LIST_PAGES},
pred as (select nx as p, min(p) as prev from e group by nx),
c as (select e.p, e.p as listing, 0::bigint as position from e left join pred using (p) where prev is null
 union all select e.p, c.listing, c.position + 1 from c join pred on pred.prev = c.p join e on e.p = pred.p),
left_over as (select p, prev from e join pred using (p) where p not in (select p from c)),
ring as (select p, prev as q from left_over union select ring.p, l.prev from ring join left_over l on l.p = ring.q),
r as (select p, min(q) as listing from ring group by p),
t as (select listing, count(*) as n_pages, max_by(p, position) as last from c group by listing),
s as (select listing, n_pages, case when nx is null then 'complete' when nx in (select p from e) then 'merged' else 'broken' end as state
 from t join e on e.p = t.last)
select p as page, listing, position, n_pages, state from c join s using (listing)
union all select p, listing, null, count(*) over (partition by listing), 'cyclic' from r"""
SQL["section_links"] = with_ctes(VIS, ("n", "select page_id, base, regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1) as h from vis"),
    ("l", f"select page_id, base, unnest(list_transform(regexp_extract_all(h, {ANCHOR}, 1), lambda x, i: {{'q': x, 'pos': i - 1, 't': regexp_extract_all(h, {ANCHOR}, 2)[i]}})) as x from n"),
    ("u", f"select page_id, base, x.pos::bigint as pos, {unquoted('x.q')} as href, {inner('x.t')} as anchor_text from l"),
    body="select page_id, pos, href, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then href else base || href end as abs_url, anchor_text from u")
SQL["post_links"] = f"""with {LIST_PAGES.split("),", 1)[0]}),
o as (select o_custkey || '/' || (o_orderkey * 7919) % n_pages as page, o_orderkey as k from orders join n using (o_custkey))
select page, '/in/' || k as href, 'in ' || k as anchor_text from o union all select page, '/item/' || k || '?a=1&b=2', '<item>' from o"""

SQL["stream_funnel"] = """with r as (select *, case when l_orderkey % 5 = 0 then 2 when l_orderkey % 3 >= 1 then 1 else 0 end as delivery from lineitem),
f as (select l_orderkey, l_returnflag <> 'N' as scored, l_returnflag <> 'N' and (l_quantity + 10 * delivery) % 50 > 25 as positive from r),
k as (select l_orderkey, count(*) as crawled, count(*) filter (scored) as scored, count(*) filter (positive) as positive from f group by 1),
c as (select *, case when positive <= 2 then positive else 0 end as capped from k)
select 0 as stage_order, 'crawled' as stage, sum(crawled)::bigint as n_rows, count(*) as n_commits from c
union all select 1, 'heuristic', sum(scored)::bigint, count(*) filter (scored > 0) from c
union all select 2, 'positive', sum(positive)::bigint, count(*) filter (positive > 0) from c
union all select 3, 'capped', sum(capped)::bigint, count(*) filter (capped > 0) from c"""
SQL["update_in_place"] = """with l as (select l_orderkey as k, min(l_linestatus) as s, min(l_returnflag) as m from lineitem group by 1)
select o_orderkey, case when o_orderkey % 7 = 0 then coalesce(s, o_orderstatus) else o_orderstatus end as o_orderstatus,
 case when o_orderkey % 3 = 0 then m end as note from orders left join l on k = o_orderkey"""

SQL["patch_line_numbers"] = f"""with l as (select distinct c_link as commit_link, l_linenumber::bigint as ln, l_quantity::bigint % 3 + 1 as d, l_quantity::bigint % 4 + 1 as a
 from (select *, concat({_PROJECT_SQL}, '/commit/', cast(o_orderkey as varchar)) as c_link from orders join lineitem on l_orderkey = o_orderkey)),
x as (select commit_link, list_transform(range(1, a + 1), lambda i: ln * 100 + 5 + 1 + i) as news, list_transform(range(1, d + 1), lambda i: ln * 100 + i) as olds from l)
select commit_link, array_to_string(list_sort(flatten(list(news))), ',') as added_lines, array_to_string(list_sort(flatten(list(olds))), ',') as deleted_lines
 from x group by 1"""
_HITS = [f"(commit_description is null and {c})" for _, c in RULES]


def _chain(order: list[int]) -> str:
    return "case " + " ".join(f"when {_HITS[i]} then '{RULES[i][0]}'" for i in order) + " end"


def _rules_in(label: str, order: list[int]) -> str:
    alone = " + ".join(f"({h})::int" for h in _HITS)
    return " union all ".join(f"""select '{label}' as rule_order, {k} as step, '{RULES[i][0]}' as rule, count(*) filter ({_chain(order)} = '{RULES[i][0]}') as n_first,
 count(*) filter ({_HITS[i]}) as n_alone, count(*) filter ({_HITS[i]} and {alone} = 1) as n_only from base""" for k, i in enumerate(order))


_BASE_ROWS = ("base", f"select * from commits where {ASCII_OK}")
SQL["rule_order"] = with_ctes(A("commits"), _BASE_ROWS,
                              body=_rules_in("given", list(range(len(RULES)))) + " union all " + _rules_in("reverse", list(range(len(RULES)))[::-1]))
SQL["rule_of_rows"] = with_ctes(A("commits"), _BASE_ROWS, ("r", f"select commit_link, commit_title, {_chain(list(range(len(RULES))))} as rule from base"),
                                body="select * from r where rule is not null")
SQL["csv_unreadable"] = """select doc_id, lang, 'ok' as status from documents where lang in ('en', 'es')
 union all select null, 'fr', 'encoding' union all select null, 'de', 'binary' union all select null, 'cut', 'unreadable'"""
SQL["batch_plan"] = f"""with d as (select doc_id, text, row_number() over (order by doc_id) as n, len(regexp_extract_all(text, {WORD})) as w from documents),
b as (select *, (n - 1) // 100 as block from d),
c as (select *, coalesce(sum(w) over (partition by block order by n rows between unbounded preceding and 1 preceding), 0) as before from b)
select doc_id, (block * 1000000 + before::bigint // 10000)::bigint as batch_id, {answer('text')} as answer from c"""
