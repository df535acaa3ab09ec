"""Queries for what stands between extraction and rules, and for the whole chain, each with its rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import net, text
from reportloom.operators import enrich, evaluate, evidence, extract, finetune, kb, mapping, records, retrieval, sigma
from reportloom.plans import pipeline
from reportloom.plans.queries import PUBLIC, STIX, SYNTH_STRICT, TERMS, TOKENS, joined, query, strict, stix, synth, table, techniques

# ---- functions whose every case is reached ---------------------------------------------------------------------

DEFANGED = ["hXXps : / /a.b/", "hxxp：//a.b/", "a[ : ]b", "a(:)b", "a[.]b", "a( . )b", "a{.}b", "a[DOT]b", "a(dot)b", "a Dot b", "a[at]b", "a( AT )b"]
WHOLE = ["https://a.b/", "http://a.b/", "a:b", "a:b", "a.b", "a.b", "a.b", "a.b", "a.b", "a.b", "a@b", "a@b"]


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


@query(f"select c_custkey, c_custkey || ' ' || ({WHOLE!r})[c_custkey % {len(WHOLE)} + 1] || c_custkey as refanged from customer")
def refang_forms(spark, d):
    """Every defanged form, in either case and with blanks where they may be."""
    k = F.col("c_custkey")
    said = F.concat(k.cast("string"), F.lit(" "), _pick(DEFANGED, k), k.cast("string"))
    return table(spark, d, "customer").select("c_custkey", text.refang(said).alias("refanged"))


MARKS = ["plain", "a*b", "[REDACTED]", "Redacted", "[base64", "base64-encoded", "[computer", "[username"]


@query(f"select c_custkey, c_custkey % {len(MARKS)} <> 0 as placeholder, c_custkey % 4 in (1, 2) as masked from customer")
def placeholders_and_masks(spark, d):
    k = F.col("c_custkey")
    # a mark 8 characters before the match, or just out of reach
    around = _pick(["123456 8evil.com", "*234567 evil.com", "evil.com [redacted", "*23456789evil.com"], k)
    at = F.locate("evil.com", around) - 1
    return table(spark, d, "customer").select("c_custkey", text.has_placeholder(_pick(MARKS, k)).alias("placeholder"), text.is_masked(text.blocks(around), at, at + F.when(k % 4 == 2, 10).otherwise(8)).alias("masked"))


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 'http://one.com/' || c_custkey when c_custkey % 3 = 1 then 'http://one.com/a,ftp://two.net/' || c_custkey else 'HTTP://one.com/,https://b.org/x,http://c.org/' || c_custkey end as urls
from customer
""")
def merged_urls(spark, d):
    k = F.col("c_custkey")
    raw = F.concat(_pick(["http://one.com/", "oh http://one.com/aftp://two.net/", "HTTP://one.com/https://b.org/xhttp://c.org/"], k), k.cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(net.split_urls(raw), ",").alias("urls"))


@query("""
select p_partkey, ['md5', 'sha1', 'sha256', 'ipv4', 'domain_or_path', 'path_or_url', 'string'][p_partkey % 7 + 1] as kind from part
""")
def indicator_kinds(spark, d):
    k = F.col("p_partkey")
    s = k.cast("string")
    values = [F.md5(s.cast("binary")), F.sha1(s.cast("binary")), F.sha2(s, 256), F.concat_ws(".", *[(k % 200).cast("string")] * 4), F.concat(s, F.lit(".exe")), F.concat(F.lit("C:\\"), s), F.concat(F.lit("run "), s)]
    return table(spark, d, "part").select("p_partkey", finetune.kind_of(F.element_at(F.array(*values), (k % 7 + 1).cast("int"))).alias("kind"))


# ---- extraction over whole documents, every kind found and every filter at work ----------------------------------

ADDED = [
    ("' hxxp://evil-' || k || '[.]com/A'", [("url", "'http://evil-' || k || '.com/a'"), ("domain", "'evil-' || k || '.com'")]),
    ("' https://github.com/x' || k", []),
    ("' visit ***bad-' || k || '.com now'", []),
    ("' http://bad-' || k || '.com/[redacted]'", [("domain", "'bad-' || k || '.com'")]),
    ("' report-' || k || '.zip and se.sa and embassy.us and microsoft.com'", []),
    ("' 1.1.1.1 10.0.0.' || k % 256 || ' 3.228.54.173 8.8.' || k % 256 || '.4 08.8.8.8 224.0.0.1'", [("ipv4", "'8.8.' || k % 256 || '.4'")]),
    ("' ' || repeat('ab', 16) || ' ' || md5(cast(k as string))", [("md5", "md5(cast(k as string))")]),
    ("' ' || upper(md5(cast(k as string))) || ' ' || md5(cast(k as string))", [("md5", "upper(md5(cast(k as string)))"), ("md5", "md5(cast(k as string))")]),
    ("' http://one-' || k || '.com/ahttp://two-' || k || '.net/b'", [("url", "'http://one-' || k || '.com/a'"), ("url", "'http://two-' || k || '.net/b'"), ("domain", "'one-' || k || '.com'"), ("domain", "'two-' || k || '.net'")]),
    ("' sha ' || {sha256} || ' cve-2023-' || (1000 + k % 9000)", [("sha256", "{sha256}"), ("cve", "'CVE-2023-' || (1000 + k % 9000)")]),
    ("' http://8.8.8.8/x and www.evil-' || k || '.org.'", [("ipv4", "'8.8.8.8'"), ("domain", "'evil-' || k || '.org'")]),
]


def _duck(c: str) -> str:
    return c.replace("{sha256}", "sha256(cast(k as varchar))").replace("as string", "as varchar")


EXPECTED = " union all ".join(f"select k, '{t}', {_duck(v)} from (select doc_id as k from documents where doc_id % {len(ADDED)} = {n})" for n, (_, found) in enumerate(ADDED) for t, v in found)


@query(rf"""
with ips as (select doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) as ip from documents),
p as (select doc_id, ip, split_part(ip, '.', 1) as s1, split_part(ip, '.', 2) as s2, split_part(ip, '.', 3) as s3, split_part(ip, '.', 4) as s4 from ips
      where regexp_full_match(ip, '(?:(?:0|[1-9][0-9]?|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])\.){{3}}(?:0|[1-9][0-9]?|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])')),
n as (select doc_id, ip, s1::int as a, s2::int as b, s3::int as c, s4::int as d from p),
-- what is not ASCII is a letter to the reader, as an underscore is
t as (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') as t from documents),
m as (select doc_id, unnest(regexp_extract_all(t, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+(?:[A-Za-z]{{2,24}})\b')) as v from t),
h as (select doc_id, unnest(regexp_extract_all(t, '\b[a-fA-F0-9]+\b')) as v from t)
select doc_id, 'ipv4' as type, ip as value from n where {PUBLIC} and ip not in ('1.1.1.1', '1.2.3.4', '2.2.2.2', '3.228.54.173')
union select doc_id, 'domain', lower(regexp_extract(v, '[^.]+[.][^.]+$')) from m where regexp_matches(lower(v), '[.](com|net|org|zip)$')
union select doc_id, case length(v) when 32 then 'md5' when 40 then 'sha1' else 'sha256' end, v from h where length(v) in (32, 40, 64) and len(list_distinct(string_split(lower(v), ''))) > 2
union {EXPECTED}
""")
def ioc_documents(spark, d):
    """Whole texts, each with something added that a filter has to drop or a kind to find."""
    docs = table(spark, d, "documents").withColumn("k", F.col("doc_id"))
    more = F.lit("")
    for n, (said, _) in enumerate(ADDED):
        more = F.when(F.col("k") % len(ADDED) == n, F.expr(said.replace("{sha256}", "sha2(cast(k as string), 256)"))).otherwise(more)
    out = extract.extract(docs.select(F.col("doc_id").alias("report_id"), F.concat("text", more).alias("text")), net.suffix_rules(spark), context=False)
    # a sentence's end and the next one's start may look like a domain; those of other countries are left aside
    usual = (F.col("type") != "domain") | F.col("normalized_value").rlike("[.](com|net|org|zip)$") | F.col("normalized_value").isin("se.sa", "embassy.us")
    return out.filter(usual).select(F.col("report_id").alias("doc_id"), "type", F.col("normalized_value").alias("value"))


# ---- layout, enrichment, evidence --------------------------------------------------------------------------------


@query("""
with t as (select p_partkey as k, p_name as n from part where p_partkey % 7 <> 0)
select k as report_id, 0 as ord, 'heading' as type, n as content from t
union all select k, 1, 'paragraph', 'p' || k from t union all select k, 2, null, 'late' from t
union all select k, 3, 'list', null from t union all select k, 4, 'list item', 'i' from t union all select k, 5, 'caption', 'deep' from t where k % 2 = 0
""")
def layout_flatten(spark, d):
    """Children of either key, arrays in arrays, values of other types; one tree in seven is broken."""
    k = F.col("p_partkey")
    tree = F.concat(
        F.lit('{"type": "document", "kids": [{"list items": [{"content": "late", "type": 5}], "type": "heading", "content": "'), F.col("p_name"), F.lit('", "kids": [[{"type": "paragraph", "content": "p'), k.cast("string"),
        F.lit('"}], 7, "x"]}, {"type": "list", "list items": [{"type": "list item", "content": "i"'), F.when(k % 2 == 0, ', "kids": {"type": "caption", "content": "deep"}').otherwise(""), F.lit("}]}]"), F.when(k % 7 != 0, "}").otherwise(""),
    )
    return enrich.flatten_layout(table(spark, d, "part").select(k.alias("report_id"), tree.alias("layout")))


def _ip_rows(spark, d):
    k = F.col("s_suppkey")
    ip = F.concat(F.lit("8.8."), (k % 250).cast("string"), F.lit(".9"))
    rows = table(spark, d, "supplier").withColumn("ip", ip)
    iocs = rows.select(
        k.alias("report_id"), F.lit("ipv4").alias("type"), F.col("ip").alias("value"), F.col("ip").alias("normalized_value"), F.lit("unknown").alias("section"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("seen "), F.col("ip"), F.lit(":81"))).alias("context"), F.lit(0.6).alias("confidence"), F.array(F.lit("regex")).alias("source"),
    )
    said = F.when(k % 3 == 0, F.concat(F.lit("c2 "), F.col("ip"), F.lit(" ："), F.lit(" 8080"))).when(k % 3 == 1, F.concat(F.lit("only "), F.col("ip"))).otherwise("nothing here")
    parts = rows.select(k.alias("report_id"), F.lit(1).alias("ord"), F.when(k % 2 == 0, "Appendix IOC").otherwise("Summary").alias("section_title"), said.alias("text"))
    return iocs, parts


@query("""
with t as (select s_suppkey as k, '8.8.' || s_suppkey % 250 || '.9' as ip, s_suppkey % 3 <> 2 as found,
  case when s_suppkey % 3 = 0 then '8080' when s_suppkey % 3 = 2 and s_suppkey % 5 <> 0 then '81' end as port from supplier)
select k as report_id, case when not found then 'unknown' when k % 2 = 0 then 'Appendix IOC' else 'Summary' end as section, port,
  (case when port is not null then 0.9 when found and k % 2 = 0 then 0.85 when found then 0.75 else 0.6 end)::double as confidence,
  case when k % 5 <> 0 then 'regex_ioc_extractor:unknown:seen ' || ip || ':81;' else '' end
    || case when k % 3 = 0 then 'pdf_layout_parser:' || case when k % 2 = 0 then 'Appendix IOC' else 'Summary' end || ':c2 ' || ip || ' ： 8080;'
            when k % 3 = 1 then 'pdf_layout_parser:' || case when k % 2 = 0 then 'Appendix IOC' else 'Summary' end || ':only ' || ip || ';' else '' end as evidence,
  case when port is not null then ip || ':' || port || ':possible_c2' else '' end as c2
from t
""")
def enriched_addresses(spark, d):
    """Ports from the section or, without one, the context; evidence that is empty left out; the C2 list."""
    iocs, parts = _ip_rows(spark, d)
    out = enrich.enrich(iocs, parts)
    c2 = enrich.threat_context(parts, out).select("report_id", F.array_join(F.transform("c2", lambda c: F.concat_ws(":", c["ip"], c["port"].cast("string"), c["role"])), ",").alias("c2"))
    told = F.array_join(F.transform("evidence", lambda e: F.concat(F.concat_ws(":", e["source"], e["section_title"], e["content"]), F.lit(";"))), "")
    return out.select("report_id", "section", "port", "confidence", told.alias("evidence")).join(c2, "report_id")


@query("""
with s as (select s_suppkey as k, '8.8.' || s_suppkey % 250 || '.9' as ip from supplier),
e as (
  select k, 0 as phase, '1' as place, 'section' as source, case when k % 2 = 0 then 'Appendix IOC' else 'Summary' end as title, case when k % 3 = 0 then 'c2 ' || ip || ' : 8080' when k % 3 = 1 then 'only ' || ip else 'nothing here' end as text from s
  union all select k, 1, '1', 'ioc_evidence:ipv4:' || ip, 'unknown', 'seen ' || ip || ':81' from s where k % 5 <> 0
  union all select k, 2, '1', 'threat_context', 'threat_context', 'file operation' from s),
f as (select *, row_number() over (partition by k, lower(text) order by phase, place) as n from e where phase = 2 or length(text) >= 12)
select k as report_id, row_number() over (partition by k order by phase, place)::int as ord, source, title as section_title, text from f where n = 1
""")
def evidence_union(spark, d):
    """Sections, then each indicator's evidence and context, then behaviours; a text counts once, short ones do not."""
    iocs, parts = _ip_rows(spark, d)
    iocs = iocs.withColumn("evidence", F.filter(F.array(F.struct(F.lit("regex_ioc_extractor").alias("source"), F.lit("unknown").alias("section_title"), F.col("context").alias("content"))), lambda e: e["content"] != ""))
    parts = parts.withColumn("text", F.replace("text", F.lit("："), F.lit(":")))
    behaviors = parts.select("report_id", F.array(F.lit("file operation")).alias("behaviors"))
    out = evidence.rows(evidence.parts(parts, iocs, behaviors), min_chars=12)
    return out.select("report_id", "ord", "source", "section_title", "text")


# ---- knowledge base, prompts and answers -------------------------------------------------------------------------

KB_DOCS = f"""
select row_number() over (order by t) - 1 as doc_id, t, p_name as name, t || chr(10) || p_name || chr(10) || p_name || chr(10) || p_name || chr(10) || p_type || chr(10)
  || case when p_partkey % 2 = 0 then 'execution' else 'persistence' end || chr(10) || 'Windows Linux' || chr(10) || p_brand as text from ({STIX})
"""
KB_TERMS = TERMS.replace("from documents", f"from ({KB_DOCS}) documents")


@query(f"""
{KB_TERMS},
w as (select doc_id, token, (1 + ln(n)) * idf as w from c join i using (token)),
dn as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
asked as (select p_partkey as item_id, p_name || ' ' || p_brand || ' unknownword' as text from part),
qt as (select item_id, unnest({TOKENS}) as token, unnest(range(0, len({TOKENS}))) as p from asked),
q as (select item_id, token, (1 + ln(count(*))) * any_value(idf) as q, min(p) as p from qt join i using (token) group by item_id, token),
qn as (select item_id, sqrt(sum(q * q)) as norm from q group by item_id),
s as (select item_id, doc_id, sum(q * w) as dot, min(p) as p from q join w using (token) group by item_id, doc_id),
r as (select item_id, doc_id, p, round(dot / (qn.norm * dn.norm), 6) as score from s join qn using (item_id) join dn using (doc_id)),
top as (select *, row_number() over (partition by item_id order by score desc, p, doc_id) as rank from r),
l as (select item_id, string_agg(t || '=' || name, ',' order by rank) as candidates from top join ({KB_DOCS}) k using (doc_id) where rank <= 5 group by item_id)
select cast(a.item_id as varchar) as query_id, coalesce(candidates, '') as candidates, a.text as evidence, 'Select the MITRE ATT&CK techniques that are supported by the evidence.' as task, 5 as rules,
  'prompt_only_mode_no_llm_called' as errors from asked a left join l on l.item_id = a.item_id
""")
def mapping_prompts(spark, d):
    """Requests to a model about names of parts: the five nearest techniques with what the base knows, and nothing called."""
    base = techniques(spark, d)
    asked = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("query_id"), F.concat_ws(" ", "p_name", "p_brand", F.lit("unknownword")).alias("text"))
    hits = retrieval.search(retrieval.build(base), asked, 5)
    rows = asked.join(mapping.candidates(hits, base, ["query_id"]), "query_id", "left")
    none = F.array().cast(rows.schema["candidates"].dataType)
    out = mapping.prompt_only(rows.withColumn("candidates", F.coalesce("candidates", none)))
    said = F.from_json("user_prompt", "task string, rules array<string>, evidence string, candidate_techniques array<struct<technique_id:string,name:string>>")
    out = out.withColumn("p", said)
    listed = F.array_join(F.transform("p.candidate_techniques", lambda c: F.concat(c["technique_id"], F.lit("="), c["name"])), ",")
    return out.select("query_id", listed.alias("candidates"), F.col("p.evidence").alias("evidence"), F.col("p.task").alias("task"), F.size("p.rules").alias("rules"), joined("validation_errors").alias("errors"))


@query(f"""
select count(*) as techniques, count(*) filter (p_partkey % 3 = 0) as subtechniques, count(*) filter (p_partkey in (select p_partkey from part where p_size > 25)) as with_examples,
  md5(string_agg(case when p_size > 25 then least(p_size, 28) - 25 else 0 end, ',' order by t)) as examples from ({STIX})
""")
def kb_with_examples(spark, d):
    """The base joined to labelled examples: three at most for each technique, and their counts."""
    rows = table(spark, d, "part").filter("p_size > 25").select(
        F.lit("a").alias("file"), F.explode(F.sequence(F.lit(26), F.col("p_size"))).alias("line"), F.concat(F.lit("['T"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("']")).alias("labels"), "p_partkey"
    )
    rows = rows.withColumn("text1", F.concat(F.lit("said "), F.col("line").cast("string")))
    base = kb.build(stix(spark, d), kb.first_examples(rows, 3))
    sizes = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("technique_id", F.size("examples").alias("n")))), lambda x: x["n"].cast("string")), ",").cast("binary"))
    return kb.counts(base).crossJoin(base.agg(sizes.alias("examples")))


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 'r' || c_custkey || '.iocs.attack.json' when c_custkey % 3 = 1 then 'r' || c_custkey || '.attack.json' end as match from customer
""")
def mapping_priority_join(spark, d):
    """The mapping file of an indicator file: of its whole stem, else of the stem without .iocs, else none."""
    k = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer")
    full = rows.filter("c_custkey % 3 = 0").select(F.concat(F.lit("r"), k, F.lit(".iocs.attack.json")).alias("name"))
    short = rows.filter("c_custkey % 3 <> 2").select(F.concat(F.lit("r"), k, F.lit(".attack.json")).alias("name"))
    files = rows.select("c_custkey", F.concat(F.lit("r"), k, F.lit(".iocs.json")).alias("file"))
    return enrich.first_by_priority(files, full.unionByName(short), enrich.mapping_names(F.col("file"))).select("c_custkey", "match")


def _orders_as_reports(spark, d):
    """Reports with up to dozens of indicators, made of each customer's orders."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_custkey") % 4 == 0, "cve").when(F.col("o_orderkey") % 3 == 0, "md5").when(F.col("o_custkey") % 4 == 1, "ipv4").when(F.col("o_custkey") % 4 == 2, "domain").otherwise("url")
    iocs = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("report_id"), kind.alias("type"), F.lit("").alias("normalized_value"), F.concat(F.lit("v"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("value"))
    reports = iocs.select("report_id").distinct().withColumn("report_title", F.when(F.length("report_id") % 2 == 0, F.concat(F.lit("T "), F.col("report_id"))).otherwise(""))
    mappings = reports.select("report_id", F.explode(F.array(F.lit("T1105"), F.lit("T1071.001"))).alias("technique_id"), F.lit("n").alias("technique_name"), F.array(F.lit("execution")).alias("tactics"))
    return iocs, reports, mappings


ORDER_REPORTS = """
select 'c' || o_custkey as report_id, case when o_custkey % 4 = 0 then 'cve' when o_orderkey % 3 = 0 then 'md5' when o_custkey % 4 = 1 then 'ipv4' when o_custkey % 4 = 2 then 'domain' else 'url' end as type,
  'v' || lpad(cast(o_orderkey as varchar), 9, '0') as value, o_custkey from orders
"""


@query(f"""
with i as (select *, row_number() over (partition by report_id order by type, value) as n from ({ORDER_REPORTS})),
g as (select report_id, string_agg(type || '=' || value, ',' order by n) filter (n <= 12) as candidates, bool_or(type = 'url') as url, bool_or(type = 'domain') as domain, bool_or(type = 'ipv4') as ip from i group by report_id)
select report_id, candidates, case when url then 'proxy' when domain then 'dns' when ip then 'network_connection' else 'process_creation:windows' end as logsource,
  'CTI report ' || case when length(report_id) % 2 = 0 then 'T ' || report_id else report_id end || ' contains indicators and ATT&CK mappings.' as description, 'T1071.001,T1105' as attack, 'system,user' as roles from g
""")
def rule_prompts(spark, d):
    """What a rule model is asked: the first twelve indicators, the log source that they call for, the techniques."""
    iocs, reports, mappings = _orders_as_reports(spark, d)
    out = finetune.rule_prompt(reports, iocs, mappings)
    shape = "report_context struct<description:string>, ioc_candidates array<struct<type:string,value:string>>, attack_context array<struct<technique_id:string>>, expected_logsource struct<category:string,product:string>"
    out = out.withColumn("p", F.from_json(F.col("messages")[1]["content"], shape))
    return out.select(
        "report_id",
        F.array_join(F.transform("p.ioc_candidates", lambda c: F.concat(c["type"], F.lit("="), c["value"])), ",").alias("candidates"),
        F.concat_ws(":", "p.expected_logsource.category", "p.expected_logsource.product").alias("logsource"),
        F.col("p.report_context.description").alias("description"),
        F.array_join(F.transform("p.attack_context", lambda a: a["technique_id"]), ",").alias("attack"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
    )


@query(f"""
with i as (select *, row_number() over (partition by report_id order by type, value) as n from ({ORDER_REPORTS})),
g as (select report_id, o_custkey as k, string_agg(value, '|' order by value) filter (n <= 12) as vs from i group by all),
h as (select *, sha256(report_id || 'hf_lora' || vs) as h, case when length(report_id) % 2 = 0 then 'T ' || report_id else report_id end as t from g)
select report_id, case when k % 2 = 0 then 'Own' else 'Sigma Rule from ' || t end as title, case when k % 3 = 0 then 'given' else h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] end as id,
  'Generated from CTI report ' || t || '.' as description, 'experimental' as status, case when k % 5 = 0 then 'high' else 'medium' end as level, 'Unknown' as falsepositives, '2026/06/04' as date, 'someone' as author,
  case when k % 7 = 0 then 'own.tag' else 'attack.t1071.001,attack.t1105' end as tags from h
""")
def finalized_rules(spark, d):
    """Drafts of a model with what they lack filled in: only empty ids, authors and dates are replaced, and missing tags."""
    iocs, reports, mappings = _orders_as_reports(spark, d)
    k = F.substring("report_id", 2, 20).cast("long")
    null = F.lit(None).cast("string")
    drafts = reports.select(
        "report_id", F.when(k % 2 == 0, "Own").alias("title"), null.alias("status"), null.alias("description"), F.lit(None).cast("array<string>").alias("falsepositives"), F.when(k % 5 == 0, "high").alias("level"),
        F.when(k % 3 == 0, "given").otherwise("").alias("id"), F.lit("").alias("author"), null.alias("date"), F.when(k % 7 == 0, F.array(F.lit("own.tag"))).alias("tags"),
    )
    out = sigma.finalize(drafts, reports, iocs, mappings, author="someone")
    return out.select("report_id", "title", "id", "description", "status", "level", joined("falsepositives").alias("falsepositives"), "date", "author", joined("tags").alias("tags"))


@query("""
with t as (select s_suppkey as k, list_transform(range(0, s_suppkey % 40), lambda x: 'v' || lpad(cast(x as varchar), 3, '0')) as vs, s_suppkey % 9 as refs from supplier)
select k as path, least(len(vs), 25) as candidates, least(refs, 5) as refs, case when len(vs) = 0 then '' else vs[least(len(vs), 25)] end as last from t
""")
def sft_limits(spark, d):
    """Of a rule's indicators the first 25 different ones count, of its references the first five."""
    k = F.col("s_suppkey")
    listed = lambda n, mark, width: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.concat(F.lit(f'"{mark}'), F.lpad(i.cast("string"), width, "0"), F.lit('"'))), ", ")
    twice = F.concat_ws(", ", F.nullif(listed(k % 40, "v", 3), F.lit("")), F.nullif(listed(k % 40, "v", 3), F.lit("")))
    body = F.concat(
        F.lit('{"title": "t", "description": "d", "logsource": {"category": "dns"}, "detection": {"selection": ['), twice, F.lit('], "condition": " selection"}, "falsepositives": ["u"], "level": "low", "references": ['),
        listed(k % 9, "https://x/", 1), F.lit("]}"),
    )
    out = finetune.records(table(spark, d, "supplier").select(k.alias("path"), body.alias("rule_json")))
    user = F.from_json(F.col("messages")[1]["content"], "report_context struct<references:array<string>>, ioc_candidates array<struct<value:string>>")
    out = out.withColumn("u", user)
    return out.select("path", F.size("u.ioc_candidates").alias("candidates"), F.size("u.report_context.references").alias("refs"), F.coalesce(F.try_element_at("u.ioc_candidates", F.lit(-1))["value"], F.lit("")).alias("last"))


@query("""
with t as (select p_partkey as k, p_brand as path, p_partkey % 8 as wrong from part),
f as (select path, count(*) as records, count(*) filter (wrong <> 0) as error_count, count(*) filter (wrong = 4) as twice from t group by path)
select path, records, error_count, error_count = 0 as valid, least(error_count + twice, 50)::int as told,
  (select string_agg(distinct case wrong when 1 then 'invalid JSONL record' when 2 then 'messages must contain system/user/assistant' when 3 then 'unexpected roles [''system'', ''user'', ''robot'']' when 4 then 'user content is not JSON'
     when 5 then 'assistant output missing [''level'']' when 6 then 'assistant output should not include id/author/date' when 7 then 'user payload lacks attack mappings and IoC candidates' end, '|')
   from t) is not null as kinds, (select count(distinct path) from t) as files, (select count(*) from t) as all_records, false as all_valid
from f
""")
def sft_checks(spark, d):
    """Every check of a chat record; a file tells its first fifty errors; the roll-up over files."""
    k = F.col("p_partkey") % 8
    answer = F.concat(F.lit('{\\"title\\":1,\\"status\\":1,\\"description\\":1,\\"logsource\\":1,\\"detection\\":1,\\"falsepositives\\":1'), F.when(k != 5, ',\\"level\\":1').otherwise(""), F.when(k == 6, ',\\"date\\":1').otherwise(""), F.lit("}"))
    user = F.when(k == 4, "{").when(k == 7, "{}").otherwise('{\\"ioc_candidates\\": [1]}')
    line = F.concat(F.lit('{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "'), user, F.lit('"}'), F.when(k == 2, "").otherwise(F.concat(F.lit(', {"role": "'), F.when(k == 3, "robot").otherwise("assistant"), F.lit('", "content": "'), answer, F.lit('"}'))), F.when(k == 1, "").otherwise("]}"))
    lines = table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), line.alias("value"))
    out = finetune.verify(lines)
    # a user text that is no JSON lacks both lists too; it is told once here
    known = ["invalid JSONL record", "messages must contain system/user/assistant", "unexpected roles ['system', 'user', 'robot']", "user content is not JSON", "assistant output missing ['level']", "assistant output should not include id/author/date", "user payload lacks attack mappings and IoC candidates"]
    every = finetune.verify_lines(lines).select(F.explode("errors").alias("e")).agg(F.array_sort(F.collect_set(F.regexp_replace("e", "^line [0-9]+: ", ""))).alias("all"))
    own = finetune.verify_lines(lines).filter(F.size("errors") > 0).groupBy("path").agg(F.count(F.lit(1)).alias("wrong_lines"))
    total = finetune.verify_summary(out).select(F.col("files"), F.col("records").alias("all_records"), "all_valid")
    out = out.join(own, "path").crossJoin(total).crossJoin(every)
    kinds = F.col("all") == F.array_sort(F.array(*map(F.lit, known)))
    return out.select("path", "records", F.col("wrong_lines").alias("error_count"), "valid", F.size("errors").alias("told"), kinds.alias("kinds"), "files", "all_records", "all_valid")


@query("""
with t as (select s_suppkey as k, ['ipv4', 'domain', 'url', 'domain', 'url', 'cve', 'md5', 'IPv4'][s_suppkey % 8 + 1] as type,
  ['8.8.4.4', 'GitHub.com', 'http://a.QQ.com/x', 'evil-site.com', 'http://evil.com/', 'CVE-1', '', ' 8.8.8.8 '][s_suppkey % 8 + 1] as value from supplier)
select k as report_id, lower(type) as type, case when k % 8 = 6 then 'v' || k else trim(value) end as value from t where k % 8 not in (1, 2, 5)
""")
def rule_indicators(spark, d):
    """What rules are made of: known types with a value, without benign domains, and urls that hold one."""
    k = F.col("s_suppkey")
    kinds, values = ["ipv4", "domain", "url", "domain", "url", "cve", "md5", "IPv4"], ["8.8.4.4", "GitHub.com", "http://a.QQ.com/x", "evil-site.com", "http://evil.com/", "CVE-1", "", " 8.8.8.8 "]
    rows = table(spark, d, "supplier").select(k.alias("report_id"), _pick(kinds, k).alias("type"), _pick(values, k).alias("normalized_value"), F.concat(F.lit("v"), k.cast("string")).alias("value"))
    return sigma.usable(rows)


# ---- the whole chain ---------------------------------------------------------------------------------------------


def _chain(spark, d):
    reports = synth(spark, d).select("report_id", "text", F.col("report_id").alias("report_title"), F.lit("https://x/").alias("original_link"), F.lit("").alias("source"), F.lit("a.pdf").alias("pdf_file"), "k")
    # every tenth report has nothing that the strict pass keeps, every eleventh nothing at all
    bare = F.when(F.col("k") % 11 == 0, "nothing").when(F.col("k") % 10 == 0, "only 10.0.0.1 here").otherwise(F.col("text"))
    reports = reports.withColumn("text", bare).drop("k")
    sections = reports.select("report_id", F.lit(1).alias("ord"), F.lit("Appendix IOC").alias("section_title"), text.refang(F.col("text")).alias("text"))
    return reports, sections


CHAIN = f"""
select r.report_id, k, case when k % 10 = 0 or k % 11 = 0 then 0 else n end as strict_count, case when k % 11 = 0 then 0 when k % 10 = 0 then 1 else n end as ioc_count,
  case when k % 11 = 0 then 0 when k % 10 = 0 then 1 else m end as rule_count, k % 10 = 0 or k % 11 = 0 as retried, k % 11 = 0 as nothing
from (select o_orderkey as k, 'r' || o_orderkey as report_id from orders) r join (select report_id, count(*) as n, count(*) filter (type <> 'cve') as m from ({SYNTH_STRICT}) group by report_id) s on s.report_id = r.report_id
"""


@query(f"""
select report_id, strict_count, ioc_count, true as fallback_used, rule_count, 0::bigint as invalid_count, nothing as human_review_required, (4 + retried::int + nothing::int)::int as events, '' as errors from ({CHAIN})
""")
def report_pipeline(spark, d):
    """All stages over all reports, prompts only: where each report's route led."""
    reports, sections = _chain(spark, d)
    out = pipeline.run(reports, sections, techniques(spark, d), net.suffix_rules(spark))
    return out.routes.select("report_id", "strict_count", "ioc_count", "fallback_used", "rule_count", "invalid_count", "human_review_required", F.size("events").alias("events"), joined("errors").alias("errors"))


@query(f"""
select report_id, 'intermediate/' || report_id || '.iocs.json' as ioc_json, 'intermediate/' || report_id || '.attack.json' as attack_json, 'validation_results.json' as validation, rule_count::int as files, rule_count as valid_count,
  1 + retried::int as ioc_attempts, 1 + nothing::int as rule_attempts, nothing as human_review_required, '' as errors,
  'ioc_extraction,' || case when retried then 'ioc_retry,' else '' end || 'ttp_mapping,ttp_fallback,rule_validation' || case when nothing then ',rule_retry' else '' end as nodes from ({CHAIN})
""")
def pipeline_states(spark, d):
    """The final state of every report and what a run says at its end."""
    reports, sections = _chain(spark, d)
    out = pipeline.states(pipeline.run(reports, sections, techniques(spark, d), net.suffix_rules(spark)))
    told = pipeline.overview(out).select("report_id", "ioc_json", "attack_json", "validation", "human_review_required", joined("errors").alias("errors"))
    rest = out.select("report_id", F.size("rule_paths").alias("files"), F.col("validation_summary.valid_count").alias("valid_count"), "ioc_attempts", "rule_attempts", F.array_join(F.transform("events", lambda e: e["node"]), ",").alias("nodes"))
    return told.join(rest, "report_id")


@query(f"""
with c as (select report_id, type, count(*) as n from ({SYNTH_STRICT}) where report_id in ('r1', 'r2', 'r3', 'r4', 'r5') group by all),
r as (select report_id, sum(n)::bigint as n, string_agg(type || ':' || n, ',' order by type) as s from c group by report_id)
select 'extraction evaluation subset' as purpose, 'malicious,benign,placeholder,false_positive,uncertain' as labels, 'malicious' as positive, 'uncertain' as ignored, string_agg(report_id || '=' || n || '(' || s || ')', ';' order by report_id) as reports,
  sum(n)::bigint as candidate_count from r
""")
def subset_manifest(spark, d):
    """The manifest of an annotation sheet for five reports."""
    iocs, wanted = strict(spark, d), ["r1", "r2", "r3", "r4", "r5"]
    about = synth(spark, d).select("report_id", F.lit("a.pdf").alias("pdf_file"))
    full = records.reports(about, iocs).filter(F.col("report_id").isin(wanted))
    out = records.subset_manifest(full, evaluate.annotation_sheet(full, iocs, wanted))
    per = F.transform(F.array_sort(F.map_entries(F.col("x.ioc_summary"))), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    each = out.select("*", F.posexplode("reports").alias("n", "x"))
    told = F.concat(F.col("x.report_id"), F.lit("="), F.col("x.candidate_count").cast("string"), F.lit("("), F.array_join(per, ","), F.lit(")"))
    each = each.groupBy("purpose", "positive_label", "ignored_label", "candidate_count", "allowed_labels").agg(F.array_sort(F.collect_list(F.struct("n", told.alias("t")))).alias("t"))
    return each.select("purpose", joined("allowed_labels").alias("labels"), F.col("positive_label").alias("positive"), F.col("ignored_label").alias("ignored"), F.array_join(F.transform("t", lambda t: t["t"]), ";").alias("reports"), "candidate_count")


def _fails(f) -> bool:
    try:
        f()
    except Exception:  # noqa: BLE001 - that it fails is the result
        return True
    return False


@query("select 'unknown label' as input, true as fails union all select 'known labels', false union all select 'unknown report', true union all select 'empty knowledge base', true union all select 'missing prediction', true union all select 'no input', true")
def fatal_inputs(spark, d):
    """Inputs that must stop a run, and one that must not."""
    from reportloom.sources import readers, tables, writers

    label = lambda said: evaluate.checked_labels(table(spark, d, "region").select(F.lit(said).alias("label"))).collect()
    ids = table(spark, d, "region").select(F.col("r_name").alias("report_id"), F.lit("t").alias("report_title"))
    empty = tables.new_path(spark, "empty")
    writers.jsonl(spark.createDataFrame([], "technique_id string"), empty)
    told = [
        ("unknown label", _fails(lambda: label("odd"))),
        ("known labels", _fails(lambda: label("benign"))),
        ("unknown report", _fails(lambda: evaluate.annotation_sheet(ids, None, ["nowhere"]))),
        ("empty knowledge base", _fails(lambda: readers.knowledge_base(spark, empty, "technique_id string"))),
        ("missing prediction", _fails(lambda: readers.predictions_for(ids.filter("report_id <> 'ASIA'"), ids))),
        ("no input", _fails(lambda: readers.inputs(spark))),
    ]
    return spark.createDataFrame(told, "input string, fails boolean")
