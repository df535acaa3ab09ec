"""One query for each operator, over the whole driver tables, with the same result in DuckDB SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions import net, text, yaml
from reportloom.operators import enrich, evaluate, evidence, extract, finetune, kb, mapping, records, retrieval, sigma
from reportloom.plans import pipeline
from reportloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- texts with indicators, made alike in both engines -------------------------------------------------------

SYNTH = """
select o_orderkey as k, 'r' || o_orderkey as report_id,
  'Payload ' || md5(cast(o_orderkey as varchar)) || ' and ' || sha256(cast(o_orderkey as varchar))
  || ' from hxxp://c2-' || (o_orderkey % 97) || '[.]evil-' || (o_orderkey % 13) || '(.)com/a' || (o_orderkey % 7)
  || ' see cve-2024-' || (1000 + o_orderkey % 9000) || ', beacon ' || (1 + o_orderkey % 223) || '.' || (o_orderkey % 251)
  || '.' || (o_orderkey % 17) || '.' || (o_orderkey % 255) || ':' || (1024 + o_orderkey % 5000) || '; zero '
  || repeat(case when o_orderkey % 2 = 0 then '0' else 'a' end, 32) as text
from orders
"""


def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    parts = [
        F.lit("Payload "), F.md5(s.cast("binary")), F.lit(" and "), F.sha2(s, 256), F.lit(" from hxxp://c2-"), (k % 97).cast("string"),
        F.lit("[.]evil-"), (k % 13).cast("string"), F.lit("(.)com/a"), (k % 7).cast("string"), F.lit(" see cve-2024-"),
        (1000 + k % 9000).cast("string"), F.lit(", beacon "), (1 + k % 223).cast("string"), F.lit("."), (k % 251).cast("string"), F.lit("."),
        (k % 17).cast("string"), F.lit("."), (k % 255).cast("string"), F.lit(":"), (1024 + k % 5000).cast("string"), F.lit("; zero "),
        F.repeat(F.when(k % 2 == 0, "0").otherwise("a"), F.lit(32)),
    ]
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("r"), s).alias("report_id"), F.concat(*parts).alias("text"))


SYNTH_IPS = f"""
select k, report_id, (1 + k % 223) as a, k % 251 as b, k % 17 as c, k % 255 as d,
  (1 + k % 223) || '.' || (k % 251) || '.' || (k % 17) || '.' || (k % 255) as ip from ({SYNTH})
"""
PUBLIC = """
not (a = 0 or a = 10 or a = 127 or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 0 and c = 0 and d not in (9, 10))
  or (a = 192 and b = 0 and c = 2) or (a = 192 and b = 168) or (a = 198 and b in (18, 19)) or (a = 198 and b = 51 and c = 100)
  or (a = 203 and b = 0 and c = 113) or a >= 224)
"""
SYNTH_STRICT = f"""
select report_id, 'url' as type, 'http://c2-' || (k % 97) || '.evil-' || (k % 13) || '.com/a' || (k % 7) as normalized_value, 'regex' as source from ({SYNTH})
union all select report_id, 'domain', 'evil-' || (k % 13) || '.com', 'url_host' from ({SYNTH})
union all select report_id, 'ipv4', ip, 'ipaddress,regex' from ({SYNTH_IPS}) where {PUBLIC} and ip not in ('1.1.1.1', '1.2.3.4', '2.2.2.2', '3.228.54.173')
union all select report_id, 'sha256', sha256(cast(k as varchar)), 'regex' from ({SYNTH})
union all select report_id, 'md5', md5(cast(k as varchar)), 'regex' from ({SYNTH})
union all select report_id, 'cve', 'CVE-2024-' || (1000 + k % 9000), 'regex' from ({SYNTH})
"""


def strict(spark: SparkSession, sf_dir: str, context: bool = False) -> DataFrame:
    return extract.extract(synth(spark, sf_dir).select("report_id", "text"), net.suffix_rules(spark), context=context)


def joined(c: str) -> F.Column:
    return F.array_join(c, ",")


# ---- text functions ------------------------------------------------------------------------------------------


@query(f"select report_id, replace(replace(replace(text, 'hxxp://', 'http://'), '[.]', '.'), '(.)', '.') as refanged from ({SYNTH})")
def refang_text(spark, d):
    return synth(spark, d).select("report_id", text.refang(F.col("text")).alias("refanged"))


@query(r"""select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as collapsed, md5(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'), '.,;:!?)>]}''"')) as cleaned from documents""")
def clean_collapse(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.collapse(F.col("text")).cast("binary")).alias("collapsed"), F.md5(text.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query("select doc_id, case when length(c) > 900 then rtrim(left(c, 897)) || '...' else c end as short from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as c from documents)")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shorten(F.col("text"), 900).alias("short"))


@query("select p_partkey, case when s = '' then 'cti-report' else s end as slug from (select p_partkey, lower(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '-')) as s from part)")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("""
with h as (select o_custkey, sha256('report-' || o_custkey || 'ipv4' || string_agg(v, '|' order by v)) as h
           from (select distinct o_custkey, cast(o_orderkey as varchar) as v from orders) group by o_custkey)
select o_custkey, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] as id from h
""")
def stable_ids(spark, d):
    values = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("v"))
    return values.select("o_custkey", text.stable_id(F.concat(F.lit("report-"), F.col("o_custkey").cast("string")), F.lit("ipv4"), F.col("v")).alias("id"))


@query("""
select p_partkey, array_to_string(list_sort(list_distinct(list_filter([upper(trim(x, ' ''"')) for x in string_split(
  't' || (1000 + p_partkey % 700) || ', ''T' || (1000 + p_partkey % 30) || '.00' || (p_partkey % 9) || ''', t' || (1000 + p_partkey % 700), ',')], lambda x: x <> ''))), ',') as labels
from part
""")
def label_sets(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("t"), (1000 + k % 700).cast("string"), F.lit(", 'T"), (1000 + k % 30).cast("string"), F.lit(".00"), (k % 9).cast("string"), F.lit("', t"), (1000 + k % 700).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.label_set(raw), ",").alias("labels"))


@query("""
select c_custkey, case when v = '' then '""' when regexp_full_match(v, '[A-Za-z0-9_.:/@+-]+') then v else '"' || v || '"' end as yaml
from (select c_custkey, case when c_custkey % 7 = 0 then '' when c_custkey % 3 = 0 then c_mktsegment || ' x' else c_mktsegment end as v from customer)
""")
def yaml_scalars(spark, d):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    v = F.when(k % 7 == 0, "").when(k % 3 == 0, F.concat(seg, F.lit(" x"))).otherwise(seg)
    return table(spark, d, "customer").select("c_custkey", yaml.scalar(v).alias("yaml"))


# ---- extraction ----------------------------------------------------------------------------------------------

@query(r"""
with u as (select page_id, unnest(regexp_extract_all(url, '(?i)(?:https?|ftp)://[^\s<>''"\])}]+')) as raw from pages),
v as (select page_id, trim(raw, '.,;:!?)>]}''"') as value from u),
h as (select page_id, value, split_part(split_part(regexp_replace(value, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/', 1), ':', 1) as host from v)
select page_id, 'url' as type, lower(value) as normalized_value from h
union select page_id, 'domain', lower(regexp_extract(host, '[^.]+[.][^.]+$')) from h
""")
def ioc_urls_pages(spark, d):
    reports = table(spark, d, "pages").select(F.col("page_id").alias("report_id"), F.col("url").alias("text"))
    out = extract.extract(reports, net.suffix_rules(spark), kinds=["url"], context=False)
    return out.select(F.col("report_id").alias("page_id"), "type", "normalized_value")


@query("select page_id, split_part(split_part(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/', 1), ':', 1) as host, regexp_extract(split_part(split_part(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/', 1), ':', 1), '[^.]+[.][^.]+$') as domain from pages")
def registered_domains(spark, d):
    rows = table(spark, d, "pages").select("page_id", net.url_host(F.col("url")).alias("host"))
    return net.with_registered_domain(rows, "host", net.suffix_rules(spark)).select("page_id", "host", "domain")


@query(SYNTH_STRICT)
def ioc_strict(spark, d):
    return strict(spark, d).select("report_id", "type", "normalized_value", joined("source").alias("source"))


@query(rf"""
with t as (select doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) as ip from documents),
p as (select doc_id, ip, split_part(ip, '.', 1) as s1, split_part(ip, '.', 2) as s2, split_part(ip, '.', 3) as s3, split_part(ip, '.', 4) as s4 from t
      where regexp_full_match(ip, '(?:(?:0|[1-9][0-9]?|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])\.){{3}}(?:0|[1-9][0-9]?|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])')),
n as (select doc_id, ip, s1::int as a, s2::int as b, s3::int as c, s4::int as d from p)
select distinct doc_id, ip from n where {PUBLIC} and ip not in ('1.1.1.1', '1.2.3.4', '2.2.2.2', '3.228.54.173')
""")
def ioc_ipv4_documents(spark, d):
    reports = table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), "text")
    out = extract.extract(reports, net.suffix_rules(spark), kinds=["ipv4"], context=False)
    return out.select(F.col("report_id").alias("doc_id"), F.col("normalized_value").alias("ip"))


@query(f"select report_id, ip, {PUBLIC} as public from ({SYNTH_IPS})")
def ipv4_public_filter(spark, d):
    k = F.col("k")
    ip = F.concat_ws(".", *[x.cast("string") for x in (1 + k % 223, k % 251, k % 17, k % 255)])
    return synth(spark, d).select("report_id", ip.alias("ip"), net.is_public_ipv4(ip).alias("public"))


@query(f"select report_id, h as value, len(list_distinct(string_split(h, ''))) <= 2 as low from (select report_id, unnest(regexp_extract_all(text, '\\b[a-fA-F0-9]{{32}}\\b')) as h from ({SYNTH}))")
def hash_entropy_filter(spark, d):
    found = text.matches(F.col("text"), dict(extract.PATTERNS)["md5"])
    rows = synth(spark, d).select("report_id", F.explode(found).alias("m"))
    return rows.select("report_id", F.col("m.value").alias("value"), extract.low_entropy(F.col("m.value")).alias("low"))


@query(r"""
with t as (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') as t from documents),
m as (select doc_id, unnest(regexp_extract_all(t, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:[A-Za-z]{2,24})\b')) as v from t)
select distinct doc_id, lower(regexp_extract(v, '[^.]+[.][^.]+$')) as domain from m where regexp_matches(lower(v), '[.](com|net|org)$')
""")
def ioc_domains_documents(spark, d):
    reports = table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), "text")
    out = extract.extract(reports, net.suffix_rules(spark), strict=False, kinds=["domain"], context=False)
    return out.filter("normalized_value rlike '[.](com|net|org)$'").select(F.col("report_id").alias("doc_id"), F.col("normalized_value").alias("domain"))


@query(f"select type, count(*) as n, count(distinct normalized_value) as values from ({SYNTH_STRICT}) group by type")
def ioc_summary(spark, d):
    return strict(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("normalized_value").alias("values"))


@query(f"""
with relaxed as (
  select report_id, type, normalized_value, case type when 'domain' then 'pipeline_relaxed_url_host' else 'pipeline_relaxed' end as source from ({SYNTH_STRICT}) where type <> 'ipv4'
  union all select report_id, 'ipv4', ip, 'pipeline_relaxed' from ({SYNTH_IPS})
  union all select report_id, 'md5', repeat(case when k % 2 = 0 then '0' else 'a' end, 32), 'pipeline_relaxed' from ({SYNTH})),
allrows as (select report_id, type, normalized_value, unnest(string_split(source, ',')) as s, 1 as strict from ({SYNTH_STRICT})
  union all select report_id, type, normalized_value, source, 0 from relaxed)
select report_id, type, normalized_value, case when max(strict) = 1 then 0.6 else 0.35 end::double as confidence, string_agg(distinct s, ',' order by s) as source
from allrows group by report_id, type, normalized_value
""")
def ioc_strict_relaxed_merge(spark, d):
    reports, rules = synth(spark, d).select("report_id", "text"), net.suffix_rules(spark)
    out = extract.extract_both(reports, rules, context=False)
    return out.select("report_id", "type", "normalized_value", "confidence", joined("source").alias("source"))


@query(f"""
with t as (select report_id, k, replace(replace(replace(text, 'hxxp://', 'http://'), '[.]', '.'), '(.)', '.') as t from ({SYNTH})),
m as (select report_id, t, 'http://c2-' || (k % 97) || '.evil-' || (k % 13) || '.com/a' || (k % 7) as v from t),
p as (select report_id, t, strpos(t, v) - 1 as s, length(v) as n from m)
select report_id, trim(t[greatest(0, s - 180) + 1 : s + n + 180]) as context from p
""")
def context_windows(spark, d):
    return strict(spark, d, context=True).filter("type = 'url'").select("report_id", "context")


@query("""
with t as (select c_custkey as report_id, 'host-' || c_custkey || '.com' as h from customer)
select report_id, 'domain' as type, h as value, 'url_host' as source, 'see ' || h || ' first, then http://www.' || h || '/Y and http://WWW.' || h || '/Y again' as context from t
union all select report_id, 'url', 'http://www.' || h || '/Y', 'regex', 'see ' || h || ' first, then http://www.' || h || '/Y and http://WWW.' || h || '/Y again' from t
""")
def ioc_first_wins(spark, d):
    """Urls come before bare domains, and of urls that differ in case only the first stays."""
    h = F.concat(F.lit("host-"), F.col("c_custkey").cast("string"), F.lit(".com"))
    said = F.concat(F.lit("see "), h, F.lit(" first, then http://www."), h, F.lit("/Y and http://WWW."), h, F.lit("/Y again"))
    out = extract.extract(table(spark, d, "customer").select(F.col("c_custkey").alias("report_id"), said.alias("text")), net.suffix_rules(spark))
    return out.select("report_id", "type", "value", joined("source").alias("source"), "context")


# ---- sections and enrichment ---------------------------------------------------------------------------------

ELEMENTS = """
select doc_id as report_id, i as ord, case when length(l) < 30 then 'heading' else 'paragraph' end as type, trim(regexp_replace(l, '\\s+', ' ', 'g')) as content
from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(0, len(string_split(text, chr(10))))) as i from documents)
"""
SECTIONS = f"""
with e as (select *, sum((type = 'heading')::int) over (partition by report_id order by ord rows unbounded preceding) as run from ({ELEMENTS}) where content <> '')
select report_id, run::int as ord, coalesce(max(content) filter (type = 'heading'), 'unknown') as section_title, string_agg(content, ' ' order by ord) filter (type <> 'heading') as text
from e group by report_id, run having count(*) filter (type <> 'heading') > 0
"""


def elements(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "content"))
    return lines.withColumn("type", F.when(F.length("content") < 30, "heading").otherwise("paragraph"))


@query(f"select report_id, ord, section_title, md5(text) as text from ({SECTIONS})")
def sections_from_lines(spark, d):
    out = enrich.sections(elements(spark, d))
    return out.select("report_id", "ord", "section_title", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"""
with v as (select doc_id, lower(regexp_extract_all(text, '[A-Za-z]+')[8]) as v from documents where len(regexp_extract_all(text, '[A-Za-z]+')) >= 8),
s as (select * from ({SECTIONS})),
f as (select v.doc_id, v.v, min(s.ord) as ord from v left join s on s.report_id = v.doc_id and contains(lower(s.text), v.v) group by v.doc_id, v.v)
select f.doc_id as report_id, f.v as value, coalesce(s.section_title, 'unknown') as section,
  (case when f.ord is null then 0.6 when contains(lower(s.section_title), 'ioc') then 0.85 else 0.75 end)::double as confidence,
  case when f.ord is null then 'regex' else 'pdf_layout_parser,regex' end as source
from f left join s on s.report_id = f.doc_id and s.ord = f.ord
""")
def section_first_match(spark, d):
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), 0)
    value = F.lower(F.get(words, F.lit(7)))
    iocs = table(spark, d, "documents").select(
        F.col("doc_id").alias("report_id"), F.lit("string").alias("type"), value.alias("value"), value.alias("normalized_value"), F.lit("unknown").alias("section"),
        F.lit("").alias("context"), F.lit(0.6).alias("confidence"), F.array(F.lit("regex")).alias("source"),
    ).filter("value is not null")
    out = enrich.enrich(iocs, enrich.sections(elements(spark, d)))
    return out.select("report_id", "value", "section", "confidence", joined("source").alias("source"))


@query("""
select o_orderkey, greatest(case when o_orderkey % 5 = 0 or o_orderkey % 11 = 0 then 0.6 else (o_orderkey % 11) / 10.0 end, case when o_orderkey % 2 = 0 then 0.75 else 0 end,
  case when o_orderkey % 3 = 0 then 0.85 else 0 end, case when o_orderkey % 7 = 0 then 0.9 else 0 end)::double as confidence
from orders
""")
def confidence_ladder(spark, d):
    k = F.col("o_orderkey")
    base = F.when(k % 5 != 0, (k % 11) / 10.0)
    title = F.when(k % 3 == 0, "Appendix IOC").otherwise("Summary")
    return table(spark, d, "orders").select("o_orderkey", enrich.confidence(base, k % 2 == 0, title, k % 7 == 0).alias("confidence"))


@query(f"select report_id, ip, cast(1024 + k % 5000 as varchar) as port from ({SYNTH_IPS})")
def port_lookup(spark, d):
    k = F.col("k")
    ip = F.concat_ws(".", *[x.cast("string") for x in (1 + k % 223, k % 251, k % 17, k % 255)])
    return synth(spark, d).select("report_id", ip.alias("ip"), net.port_for(ip, F.col("text")).alias("port"))


@query(f"""
with s as (select report_id, lower(string_agg(text, ' ' order by ord)) as t from ({SECTIONS}) group by report_id)
select report_id, array_to_string(list_filter(['CrimsonRAT', 'RAT', 'Dropper'], lambda x: contains(t, lower(x))), ',') as malware,
  array_to_string(list_filter(['APT-C-56', 'Transparent Tribe', 'APT36', 'ProjectM', 'C-Major', 'SideCopy', 'Sidewinder'], lambda x: contains(t, lower(x))), ',') as actors,
  array_to_string(list_sort(list_distinct(list_transform(list_filter([['macro', 'malicious macro execution'], ['Dropper', '.NET dropper'], ['C&C', 'C2 communication'],
    ['download', 'file download or RAT download'], ['auto-start', 'auto-start persistence'], ['Enumerate processes', 'process enumeration'],
    ['screenshots', 'screenshot capture'], ['file', 'file operation'], ['user information', 'user information collection']], lambda x: contains(t, lower(x[1]))), lambda x: x[2]))), ',') as behaviors
from s
""")
def threat_terms(spark, d):
    out = enrich.threat_context(enrich.sections(elements(spark, d)))
    return out.select("report_id", joined("malware").alias("malware"), joined("actor_aliases").alias("actors"), joined("behaviors").alias("behaviors"))


# ---- retrieval -----------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = rf"list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_+-]*|\d+(?:\.\d+)?'), lambda x: lower(x)), lambda x: length(x) > 1 and x not in ({STOP}))"
TERMS = f"""
with t as (select doc_id, unnest({TOKENS}) as token from documents),
c as (select doc_id, token, count(*) as n from t group by doc_id, token),
i as (select token, ln(((select count(*) from documents) + 1) / (count(*) + 1)) + 1 as idf, count(*) as df from c group by token)
"""


def corpus(spark, d):
    return retrieval.build(table(spark, d, "documents").select(F.col("doc_id").alias("doc_ix"), F.col("text").alias("search_document")))


@query(f"select doc_id, len({TOKENS}) as n, md5(array_to_string({TOKENS}, ' ')) as tokens from documents")
def tokenize_terms(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens"))


@query(f"{TERMS} select token, df from i")
def doc_freq(spark, d):
    return retrieval.document_frequency(retrieval.token_counts(table(spark, d, "documents"), "doc_id"))


@query(f"{TERMS} select token, round(idf, 9) as idf from i")
def idf(spark, d):
    return corpus(spark, d).idf.select("token", F.round("idf", 9).alias("idf"))


@query(f"{TERMS} select doc_id, round(sqrt(sum(pow((1 + ln(n)) * idf, 2))), 6) as norm, count(*) as terms from c join i using (token) group by doc_id")
def tfidf_norms(spark, d):
    rows = corpus(spark, d).weights.groupBy("doc_ix").agg(F.round(F.sqrt(F.sum(F.pow("weight", F.lit(2)))), 6).alias("norm"), F.count(F.lit(1)).alias("terms"))
    return rows.withColumnRenamed("doc_ix", "doc_id")


TOPK = f"""
{TERMS},
w as (select doc_id, token, (1 + ln(n)) * idf as w from c join i using (token)),
dn as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
qt as (select item_id, unnest({TOKENS}) as token, unnest(range(0, len({TOKENS}))) as p from benchmark),
q as (select item_id, token, (1 + ln(count(*))) * any_value(idf) as q, min(p) as p from qt join i using (token) group by item_id, token),
qn as (select item_id, sqrt(sum(q * q)) as norm from q group by item_id),
s as (select item_id, doc_id, sum(q * w) as dot, min(p) as p from q join w using (token) group by item_id, doc_id),
r as (select item_id, doc_id, p, round(dot / (qn.norm * dn.norm), 6) as score from s join qn using (item_id) join dn using (doc_id)),
top as (select *, row_number() over (partition by item_id order by score desc, p, doc_id) as rank from r)
"""


@query(f"{TOPK} select item_id, doc_id, rank, score from top where rank <= 10")
def tfidf_topk(spark, d):
    hits = retrieval.search(corpus(spark, d), table(spark, d, "benchmark"), 10, key="item_id")
    return hits.select("item_id", F.col("doc_ix").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score")


@query(f"""
{TOPK},
p as (select item_id, list(doc_id order by rank) as pred from top where rank <= 10 group by item_id),
smp as (select b.item_id, [b.item_id * 7 % 1000, b.item_id] as labels, coalesce(pred, []) as pred from benchmark b left join p on p.item_id = b.item_id),
m as (select *, list_min(list_filter([list_position(pred, labels[1]), list_position(pred, labels[2])], lambda x: x > 0)) as first, len(list_distinct(labels)) as nl from smp)
select count(*) as samples, count(*) filter (len(pred) > 0) as evaluated,
  round(avg((len(list_intersect(labels, pred[1:5])) > 0)::int) filter (len(pred) > 0), 6) as hit5, round(avg((len(list_intersect(labels, pred)) > 0)::int) filter (len(pred) > 0), 6) as hit10,
  round(avg(len(list_intersect(labels, pred)) / nl) filter (len(pred) > 0), 6) as recall10, round(avg(coalesce(1.0 / first, 0)) filter (len(pred) > 0), 6) as mrr
from m
""")
def retrieval_metrics(spark, d):
    asked = table(spark, d, "benchmark")
    hits = retrieval.search(corpus(spark, d), asked, 10, key="item_id")
    names = table(spark, d, "documents").select(F.col("doc_id").alias("doc_ix"), F.col("doc_id").cast("string").alias("technique_id"))
    labels = F.array_distinct(F.array((F.col("item_id") * 7 % 1000).cast("string"), F.col("item_id").cast("string")))
    out = retrieval.evaluate(retrieval.predicted(hits, names, asked.select("item_id", labels.alias("labels")), "item_id"))
    round_ = lambda c: F.round(c, 6)
    return out.select("samples", F.col("evaluated_samples").alias("evaluated"), round_("top_5_hit_rate").alias("hit5"), round_("top_10_hit_rate").alias("hit10"), round_("label_recall_at_10").alias("recall10"), round_("mrr").alias("mrr"))


# ---- mapping -------------------------------------------------------------------------------------------------


def sets(spark, d):
    rows = table(spark, d, "lineitem")
    gold = F.concat(F.lit("T"), (F.col("l_partkey") % 40).cast("string"), F.lit("."), (F.col("l_suppkey") % 3).cast("string"))
    own = F.concat(F.lit("T"), (F.col("l_suppkey") % 40).cast("string"), F.lit("."), (F.col("l_partkey") % 3).cast("string"))
    return rows.groupBy("l_orderkey").agg(F.collect_set(gold).alias("labels"), F.collect_set(own).alias("selected"))


@query("""
with r as (select l_orderkey, list(distinct 'T' || (l_partkey % 40) || '.' || (l_suppkey % 3)) as g, list(distinct 'T' || (l_suppkey % 40) || '.' || (l_partkey % 3)) as s from lineitem group by l_orderkey)
select count(*) as evaluated, round(avg(list_has_any(g, s)::int), 9) as exact, round(avg(list_has_any([split_part(x, '.', 1) for x in g], [split_part(x, '.', 1) for x in s])::int), 9) as family,
  round(avg(len(s)), 9) as selected, round(avg(len(g)), 9) as gold from r
""")
def rag_metrics(spark, d):
    m = mapping.metrics(sets(spark, d))
    names = {"evaluated_samples": "evaluated", "sample_exact_hit_rate": "exact", "sample_family_hit_rate": "family", "avg_selected_per_sample": "selected", "avg_gold_per_sample": "gold"}
    return m.select(*[(F.col(a) if b == "evaluated" else F.round(a, 9)).alias(b) for a, b in names.items()])


@query(r"""
with r as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as e, 'T' || (1000 + doc_id % 37) as t from documents),
f as (select t, e, min(doc_id) as doc_id from r where e <> '' group by t, e),
n as (select *, row_number() over (partition by t order by doc_id) as rank from f)
select t as technique_id, count(*) as n, md5(string_agg(e, '|' order by rank)) as examples from n where rank <= 8 group by t
""")
def kb_examples_first_n(spark, d):
    rows = table(spark, d, "documents").select(F.lit("a").alias("file"), F.col("doc_id").alias("line"), F.col("text").alias("text1"), F.concat(F.lit("['T"), (1000 + F.col("doc_id") % 37).cast("string"), F.lit("']")).alias("labels"))
    out = kb.first_examples(rows, 8)
    return out.select("technique_id", F.size("examples").cast("long").alias("n"), F.md5(F.array_join("examples", "|").cast("binary")).alias("examples"))


def stix(spark, d):
    """Objects with the fields of a STIX bundle, made from parts."""
    k = F.col("p_partkey")
    ref = lambda s, i, u: F.struct(F.lit(s).alias("source_name"), i.cast("string").alias("external_id"), u.cast("string").alias("url"))
    ident = F.concat(F.lit("T"), F.lpad(k.cast("string"), 7, "0"))
    return table(spark, d, "part").select(
        F.when(k % 10 == 0, "malware").otherwise("attack-pattern").alias("type"),
        F.concat(F.lit("attack-pattern--"), k.cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        (k % 11 == 0).alias("revoked"),
        (k % 13 == 0).alias("x_mitre_deprecated"),
        (k % 3 == 0).alias("x_mitre_is_subtechnique"),
        F.array(F.lit("Windows"), F.lit("Linux")).alias("x_mitre_platforms"),
        F.array(F.col("p_brand")).alias("x_mitre_data_sources"),
        F.lit(None).cast("array<string>").alias("x_mitre_permissions_required"),
        F.array(
            F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.when(k % 2 == 0, "execution").otherwise("persistence").alias("phase_name")),
            F.struct(F.lit("other").alias("kill_chain_name"), F.lit("none").alias("phase_name")),
        ).alias("kill_chain_phases"),
        F.array(ref("capec", F.lit("1"), F.lit("x")), ref("mitre-attack", F.when(k % 17 != 0, ident), F.lit("")), ref("mitre-attack", F.when(k % 17 != 0, F.lit("second")), F.concat(F.lit("https://a/"), ident))).alias("external_references"),
    )


STIX = "select *, 'T' || lpad(cast(p_partkey as varchar), 7, '0') as t from part where p_partkey % 10 <> 0 and p_partkey % 11 <> 0 and p_partkey % 13 <> 0 and p_partkey % 17 <> 0"


@query(f"""
select t as technique_id, p_name as name, case when p_partkey % 2 = 0 then 'execution' else 'persistence' end as tactic, p_partkey % 3 = 0 as sub, 'https://a/' || t as url,
  md5(t || chr(10) || p_name || chr(10) || p_name || chr(10) || p_name || chr(10) || p_type || chr(10) || case when p_partkey % 2 = 0 then 'execution' else 'persistence' end
      || chr(10) || 'Windows Linux' || chr(10) || p_brand) as document, row_number() over (order by t) - 1 as doc_ix
from ({STIX})
""")
def kb_from_stix(spark, d):
    out = kb.build(stix(spark, d))
    return out.select("technique_id", "name", joined("tactics").alias("tactic"), F.col("is_subtechnique").alias("sub"), "url", F.md5(F.col("search_document").cast("binary")).alias("document"), F.col("doc_ix").cast("long").alias("doc_ix"))


@query(f"select count(*) as techniques, count(*) filter (p_partkey % 3 = 0) as subtechniques, 0::bigint as with_examples from ({STIX})")
def kb_counts(spark, d):
    return kb.counts(kb.build(stix(spark, d)))


@query(f"select case when p_partkey % 2 = 0 then 'execution' else 'persistence' end as tactic, count(*) as n from ({STIX}) group by 1")
def tactic_counts(spark, d):
    return kb.tactic_counts(kb.build(stix(spark, d)))


CHUNKS = r"""
with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents),
n as (select doc_id, t, greatest(ceil((length(t) - 1200) / 1050.0), 0)::int as last from t),
c as (select doc_id, i, trim(t[i * 1050 + 1 : i * 1050 + 1200]) as c from n, lateral (select unnest(range(0, last + 1)) as i) g)
select doc_id, (row_number() over (partition by doc_id order by i))::int as chunk_index, c as text from c where c <> ''
"""


@query(f"select doc_id, chunk_index, md5(text) as text from ({CHUNKS})")
def evidence_chunks(spark, d):
    rows = tables.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.chunk_index", F.md5(F.col("c.text").cast("binary")).alias("text"))


@query(f"""
with c as (select doc_id % 100 as report_id, doc_id, chunk_index, text from ({CHUNKS}) where length(text) >= 80),
f as (select * from (select *, row_number() over (partition by report_id, lower(text) order by doc_id, chunk_index) as n from c) where n = 1),
o as (select *, row_number() over (partition by report_id order by doc_id, chunk_index) as ord from f)
select report_id, ord::int as ord, chunk_index, md5(text) as text from o where ord <= 8
""")
def evidence_dedupe_limit(spark, d):
    sections = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("report_id"), F.col("doc_id").alias("ord"), F.lit("s").alias("section_title"), "text")
    out = evidence.rows(evidence.parts(sections), max_evidence=8)
    return out.select("report_id", "ord", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text"))


def techniques(spark, d):
    return kb.build(stix(spark, d))


def selections(spark, d):
    """Mapping records made from order lines: every line selects a technique."""
    s = F.struct(
        F.concat(F.lit("t"), F.lpad((F.col("l_partkey") % 200).cast("string"), 7, "0")).alias("technique_id"), F.lit("").alias("name"), (F.col("l_linenumber") / 8.0).alias("confidence"),
        F.col("l_returnflag").alias("reason"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus")).otherwise("").alias("evidence"),
    )
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("ord"), F.lit("section").alias("source"), F.lit("s").alias("section_title"), F.col("l_linenumber").cast("int").alias("chunk_index"),
        F.col("l_returnflag").alias("text"), F.array(s).alias("selected_techniques"), F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("validation_errors"),
    )


MAPPED = f"""
select l_orderkey as report_id, 'T' || lpad(cast(l_partkey % 200 as varchar), 7, '0') as technique_id, max(l_linenumber / 8.0)::double as confidence,
  string_agg(distinct l_returnflag, ',' order by l_returnflag) as reasons,
  string_agg(case when l_suppkey % 2 = 0 then l_linestatus else l_returnflag end, ',' order by l_linenumber, case when l_suppkey % 2 = 0 then l_linestatus else l_returnflag end) as evidence from lineitem group by all
"""


@query(f"""
select report_id, m.technique_id, coalesce(k.p_name, '') as name, coalesce(case when k.p_partkey % 2 = 0 then 'execution' when k.p_partkey % 2 = 1 then 'persistence' end, '') as tactics, round_even(confidence, 4) as confidence, reasons, evidence
from ({MAPPED}) m left join ({STIX}) k on k.t = m.technique_id
""")
def mapping_aggregate(spark, d):
    out = mapping.aggregate(selections(spark, d), techniques(spark, d), "x")
    said = F.array_join(F.transform("evidence", lambda e: e["text"]), ",")
    return out.select("report_id", "technique_id", F.col("technique_name").alias("name"), joined("tactics").alias("tactics"), "confidence", joined("reasons").alias("reasons"), said.alias("evidence"))


@query(f"""
select l.report_id, evidence, errors, techniques from
  (select l_orderkey as report_id, count(*) as evidence, count(*) filter (l_suppkey % 3 = 0) as errors from lineitem group by 1) l
  join (select report_id, count(*) as techniques from ({MAPPED}) group by 1) m on l.report_id = m.report_id
""")
def mapping_summary(spark, d):
    records = selections(spark, d)
    out = mapping.summary(records, mapping.aggregate(records, techniques(spark, d), "x"))
    return out.select("report_id", F.col("evidence_count").alias("evidence"), F.col("validation_error_count").alias("errors"), F.col("technique_count").alias("techniques"))


ORDER_TYPES = "case o_orderkey % 4 when 0 then 'cve' when 1 then 'md5' when 2 then 'domain' else 'sha1' end"


@query(f"""
with t as (select o_custkey as report_id, list_sort(list(distinct {ORDER_TYPES})) as types from orders group by 1)
select report_id, unnest(case when list_contains(types, 'domain') then ['T1071.001', 'T1105'] when list_has_any(types, ['md5', 'sha1']) then ['T1204.002'] else [] end) as technique_id,
  0.35::double as confidence, 'Fallback selected from IoC types: [''' || array_to_string(types, ''', ''') || ''']' as evidence from t
""")
def ttp_fallback(spark, d):
    iocs = table(spark, d, "orders").select(F.col("o_custkey").alias("report_id"), F.expr(ORDER_TYPES).alias("type"))
    out = mapping.fallback(iocs, techniques(spark, d))
    return out.select("report_id", "technique_id", "confidence", F.col("evidence")[0]["text"].alias("evidence"))


@query("""
select l_orderkey, l_linenumber, case when l_partkey % 4 <> 3 then 'T' || (l_partkey % 4) else '' end as selected,
  case when l_partkey % 4 = 3 then 'rejected hallucinated technique_id: T3' else '' end as errors from lineitem
""")
def hallucination_guard(spark, d):
    answer = F.concat(F.lit('```json\n{"selected_techniques": [{"technique_id": " t'), (F.col("l_partkey") % 4).cast("string"), F.lit('", "confidence": 0.5}], "rejected_candidates": []}\n```'))
    known = F.array(*[F.struct(F.lit(t).alias("technique_id")) for t in ("T0", "T1", "T2")])
    out = mapping.checked(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", known.alias("candidates"), answer.alias("answer")))
    return out.select("l_orderkey", "l_linenumber", F.array_join(F.transform("selected_techniques", lambda s: s["technique_id"]), ",").alias("selected"), joined("validation_errors").alias("errors"))


# ---- rules ---------------------------------------------------------------------------------------------------


def rule_inputs(spark, d):
    iocs = tables.saved(strict(spark, d).select("report_id", "type", "value", "normalized_value"), "strict").withColumn("report_id", F.concat(F.lit("c"), F.pmod(F.substring("report_id", 2, 20).cast("long"), F.lit(50)).cast("string")))
    reports = iocs.select("report_id").distinct().select("report_id", F.concat(F.lit("Report "), F.col("report_id")).alias("report_title"), F.concat(F.lit("https://x/"), F.col("report_id")).alias("original_link"), F.lit("feed").alias("source"), F.lit("a.pdf").alias("pdf_file"))
    mappings = reports.select("report_id", F.lit("T1071.001").alias("technique_id"), F.array(F.lit("command_and_control")).alias("tactics"), F.array(F.struct(F.lit("section").alias("source"))).alias("evidence"))
    return iocs, reports, mappings


RULES = f"""
with v as (select distinct 'c' || (cast(report_id[2:] as bigint) % 50) as report_id, type, normalized_value as v from ({SYNTH_STRICT}) where type <> 'cve'),
g as (select report_id, type, count(*) as n, string_agg(v, '|' order by v) as vs, list(v order by v) as l from v group by 1, 2),
h as (select *, sha256(report_id || type || vs) as h from g),
r as (select report_id, type, n, l, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] as id,
  'Detect ' || case type when 'ipv4' then 'IP Infrastructure' when 'domain' then 'Domain Infrastructure' when 'url' then 'URL Infrastructure' when 'md5' then 'MD5 Hash' else 'SHA256 Hash' end
  || ' from Report ' || report_id as title from h)
"""


@query(f"{RULES} select report_id, type, n, id, title from r")
def sigma_rules(spark, d):
    out = sigma.rules(*rule_inputs(spark, d))
    return out.select("report_id", "type", F.size("values").cast("long").alias("n"), "id", "title")


@query("select distinct 'c' || (o_orderkey % 50) as report_id, 'attack.command-and-control,attack.t1071.001' as tags, 'https://x/c' || (o_orderkey % 50) as refs from orders")
def sigma_tags(spark, d):
    iocs, reports, mappings = rule_inputs(spark, d)
    rows = sigma.tags(mappings).join(sigma.references(reports, mappings), "report_id")
    return rows.select("report_id", joined("tags").alias("tags"), joined("references").alias("refs"))


@query(f"""
{RULES}
select report_id || '.' || id || '.sigma.yml' as file_name, 'title: "' || title || '"' || chr(10) || 'id: ' || id || chr(10) || 'status: experimental' || chr(10)
  || 'description: "Detects ipv4 indicators extracted from CTI report ''Report ' || report_id || '''. Generated from extracted indicators and mapped techniques."' || chr(10)
  || 'references:' || chr(10) || '  - https://x/' || report_id || chr(10) || 'author: reportloom' || chr(10) || 'date: 2026/06/04' || chr(10)
  || 'tags:' || chr(10) || '  - attack.command-and-control' || chr(10) || '  - attack.t1071.001' || chr(10) || 'logsource:' || chr(10) || '  category: network_connection' || chr(10)
  || 'detection:' || chr(10) || '  selection_dst_ip:' || chr(10) || '    DestinationIp:' || chr(10) || array_to_string([('      - ' || x) for x in l], chr(10)) || chr(10)
  || '  selection_dst_ip_alt:' || chr(10) || '    dst_ip:' || chr(10) || array_to_string([('      - ' || x) for x in l], chr(10)) || chr(10)
  || '  condition: "selection_dst_ip or selection_dst_ip_alt"' || chr(10) || 'fields:' || chr(10) || '  - DestinationIp/dst_ip' || chr(10)
  || 'falsepositives:' || chr(10) || '  - "Indicators may appear in threat research, sandbox, or internal security testing traffic."' || chr(10)
  || '  - "Validate against local asset ownership and approved threat intelligence feeds."' || chr(10) || 'level: high' as yaml
from r where type = 'ipv4'
""")
def sigma_yaml(spark, d):
    out = sigma.as_yaml(sigma.rules(*rule_inputs(spark, d)).filter("type = 'ipv4'"))
    return out.select("file_name", "yaml")


@query("""
select o_orderkey as path, (o_orderkey % 2 = 0 and o_orderkey % 5 <> 0) as valid,
  array_to_string(list_filter([case when o_orderkey % 5 = 0 then 'missing top-level field: level' end, case when o_orderkey % 2 = 1 then 'missing detection.condition' end], lambda x: x is not null), '|') as errors,
  array_to_string(list_filter([case when o_orderkey % 3 = 0 then 'id does not look like a UUID' end, case when o_orderkey % 7 = 0 then 'no ATT&CK tags present' end], lambda x: x is not null), '|') as warnings
from orders
""")
def sigma_validate(spark, d):
    k = F.col("o_orderkey")
    pick = lambda when, a, b="": F.when(when, a).otherwise(b)
    body = F.concat(
        F.lit("title: x\nid: "), pick(k % 3 == 0, "none", "0f653f0b-135a-ac53-922e-874cb7c3a9db"), F.lit("\nstatus: s\ndescription: d\n"), pick(k % 7 != 0, "tags:\n  - a\n"),
        F.lit("logsource:\n  category: dns\ndetection:\n  selection:\n    a: b\n"), pick(k % 2 == 0, "  condition: selection\n"), F.lit("falsepositives:\n  - condition: no\n"), pick(k % 5 != 0, "level: high\n"),
    )
    out = sigma.validate(table(spark, d, "orders").select(k.alias("path"), body.alias("yaml")))
    return out.select("path", "valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query("select count(*) as rule_count, count(*) filter (o_orderkey % 2 = 0) as valid_count, count(*) filter (o_orderkey % 2 <> 0) as invalid_count from orders")
def validation_rollup(spark, d):
    return sigma.validation_summary(table(spark, d, "orders").select((F.col("o_orderkey") % 2 == 0).alias("valid")))


# ---- evaluation ----------------------------------------------------------------------------------------------

LABEL = "case o_orderkey % 7 when 0 then '' when 1 then 'malicious' when 2 then 'benign' when 3 then 'uncertain' when 4 then ' malicious ' when 5 then 'placeholder' else 'false_positive' end"


def annotations(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("candidate_id"), F.col("o_custkey").alias("report_id"), F.lit("t").alias("report_title"), F.col("o_orderpriority").alias("type"),
        F.col("o_orderkey").cast("string").alias("normalized_value"), F.col("o_orderstatus").alias("context"), F.expr(LABEL).alias("label"), F.lit("").alias("reviewer_note"),
    )


def missed(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("report_id"), F.when(F.col("c_custkey") % 3 == 0, "1-URGENT").when(F.col("c_custkey") % 3 == 1, " ").otherwise("5-LOW").alias("type"),
        F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("normalized_value"), F.lit("e").alias("evidence"), F.lit("").alias("reviewer_note"),
    )


COUNTED = f"""
select o_orderpriority as type, (trim({LABEL}) = 'malicious')::int as tp, (trim({LABEL}) in ('benign', 'placeholder', 'false_positive'))::int as fp, 0 as fn from orders
union all select case when c_custkey % 3 = 0 then '1-URGENT' else '5-LOW' end, 0, 0, 1 from customer where c_custkey % 3 <> 1
"""


@query(f"""
select type, tp, fp, fn, precision, recall, case when precision + recall <> 0 then round_even(2 * precision * recall / (precision + recall), 4) end as f1_score from (
  select *, case when tp + fp > 0 then round_even(tp / (tp + fp), 4) end as precision, case when tp + fn > 0 then round_even(tp / (tp + fn), 4) end as recall from (
    select type, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from ({COUNTED}) group by rollup (type)))
""")
def annotations_prf_by_type(spark, d):
    return evaluate.annotated(annotations(spark, d), missed(spark, d))


@query(f"""
select count(*) filter (not gone) as candidate_count, count(*) filter (not gone and l <> '') as reviewed_count, count(*) filter (not gone and l = '') as unreviewed_count,
  count(*) filter (l = 'uncertain') as uncertain_count, count(*) filter (l not in ('', 'uncertain')) as scored_candidate_count, count(*) filter (gone) as missed_ioc_count, count(*) filter (not gone and l = '') = 0 as complete
from (select trim({LABEL}) as l, false as gone from orders union all select '', true from customer where c_custkey % 3 <> 1)
""")
def review_status(spark, d):
    return evaluate.review_status(annotations(spark, d), missed(spark, d))


@query(f"select trim({LABEL}) as label, count(*) as n from orders where trim({LABEL}) <> '' group by 1")
def label_counts(spark, d):
    return evaluate.label_counts(annotations(spark, d))


@query(f"""
with r as (select cast(o_custkey as varchar) as report_id, 0 as phase, cast(o_orderkey as varchar) as place, cast(o_orderkey as varchar) as v from orders where trim({LABEL}) = 'malicious'
  union all select cast(c_custkey as varchar), 1, '', 'm' || c_custkey from customer where c_custkey % 3 <> 1)
select report_id, count(*) as n, string_agg(v, ',' order by phase, place) as found from r group by report_id
""")
def ground_truth_nest(spark, d):
    out = evaluate.ground_truth(annotations(spark, d).withColumn("report_id", F.col("report_id").cast("string")), missed(spark, d))
    return out.select("report_id", F.size("iocs").cast("long").alias("n"), F.array_join(F.transform("iocs", lambda i: i["normalized_value"]), ",").alias("found"))


@query(f"""
select report_id || '::' || lpad(cast(row_number() over (partition by report_id order by type, normalized_value) as varchar), 3, '0') as candidate_id, type, normalized_value from ({SYNTH_STRICT})
""")
def annotation_sheet(spark, d):
    iocs = strict(spark, d)
    reports = iocs.select("report_id").distinct().withColumn("report_title", F.col("report_id"))
    return evaluate.annotation_sheet(reports, iocs).select("candidate_id", "type", "normalized_value")


@query(f"""
with p as (select distinct o_custkey % 20 as report_id, o_orderpriority as type, cast(o_orderkey % 40 as varchar) as v from orders where o_orderkey % 2 = 0),
t as (select distinct o_custkey % 20 as report_id, o_orderpriority as type, cast(o_orderkey % 40 as varchar) as v from orders where o_orderkey % 3 = 0),
j as (select coalesce(p.type, t.type) as type, p.v is not null as p, t.v is not null as t from p full join t on p.report_id = t.report_id and p.type = t.type and p.v = t.v)
select type, count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn from j group by type
""")
def ioc_output_compare(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("report_id"), F.col("o_orderpriority").alias("type"), F.concat(F.lit(" "), (F.col("o_orderkey") % 40).cast("string")).alias("normalized_value"), "o_orderkey")
    return evaluate.counts(evaluate.compare(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 3 = 0")), "type")


# ---- files, resumption and fine-tuning data ------------------------------------------------------------------


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber >= 4)")
def resume_anti_join(spark, d):
    from reportloom.sources import readers

    done = table(spark, d, "lineitem").filter("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.remaining(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""
select 'r' || c_custkey || '.iocs.json' as file, case when c_custkey % 4 = 0 then 'r' || c_custkey || '.iocs.json' when c_custkey % 4 = 1 then 'r' || c_custkey || '.json' end as match from customer
""")
def filename_priority_join(spark, d):
    k = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer")
    files = rows.select(F.concat(F.lit("r"), k, F.lit(".iocs.json")).alias("file"))
    full = rows.filter("c_custkey % 4 = 0").select(F.concat(F.lit("r"), k, F.lit(".iocs.json")).alias("name"))
    short = rows.filter("c_custkey % 4 in (0, 1)").select(F.concat(F.lit("r"), k, F.lit(".json")).alias("name"))
    return enrich.first_by_priority(files, full.unionByName(short), enrich.layout_names(F.col("file")))


@query("select split, n from (select 'train' as split, (count(*) * 8 // 10)::bigint as n from orders union all select 'validation', (count(*) // 10)::bigint from orders union all select 'test', (count(*) - count(*) * 8 // 10 - count(*) // 10)::bigint from orders)")
def finetune_split(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"))
    return finetune.split(rows).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def corpus_rules(spark, d):
    """Rule JSON made from parts; some lack a condition or are broken."""
    k = F.col("p_partkey")
    body = F.concat(
        F.lit('{"title": "'), F.col("p_name"), F.lit('", "description": "d", "logsource": {"category": "dns"}, "detection": {"selection": {"a": ["'), F.md5(k.cast("string").cast("binary")), F.lit('", "'), F.col("p_brand"),
        F.lit('", "x.exe"]}'), F.when(k % 5 != 0, ', "condition": "selection"').otherwise(""), F.lit('}, "falsepositives": ["u"], "level": "low", "tags": ["attack.execution", "attack.t'), (1000 + k % 9).cast("string"), F.lit('"]'), F.when(k % 7 != 0, "}").otherwise(""),
    )
    return table(spark, d, "part").select(k.alias("path"), body.alias("rule_json"))


@query("""
select p_partkey as path, '[{"type":"md5","value":"' || md5(cast(p_partkey as varchar)) || '"},{"type":"string","value":"' || p_brand || '"},{"type":"domain_or_path","value":"x.exe"}]' as candidates,
  '[{"technique_id":"T' || (1000 + p_partkey % 9) || '","technique_name":"","tactics":["execution"],"confidence":1.0}]' as mappings,
  'title,status,description,logsource,detection,falsepositives,level,tags' as answer_keys
from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0
""")
def sft_records(spark, d):
    out = finetune.records(corpus_rules(spark, d))
    user, answer = F.col("messages")[1]["content"], F.col("messages")[2]["content"]
    return out.select("path", F.get_json_object(user, "$.ioc_candidates").alias("candidates"), F.get_json_object(user, "$.attack_mappings").alias("mappings"), F.array_join(F.json_object_keys(answer), ",").alias("answer_keys"))


@query("""
select p_brand as path, count(*) as records, (count(*) filter (p_partkey % 3 = 0) + count(*) filter (p_partkey % 4 = 0)) = 0 as valid,
  (count(*) filter (p_partkey % 3 = 0) + count(*) filter (p_partkey % 4 = 0))::bigint as error_count from part group by p_brand
""")
def sft_verify(spark, d):
    k = F.col("p_partkey")
    good = '{\\"title\\":1,\\"status\\":1,\\"description\\":1,\\"logsource\\":1,\\"detection\\":1,\\"falsepositives\\":1,\\"level\\":1'
    line = F.concat(
        F.lit('{"messages": [{"role": "'), F.when(k % 3 == 0, "robot").otherwise("system"), F.lit('", "content": "s"}, {"role": "user", "content": "{\\"attack_mappings\\": [1]}"}, {"role": "assistant", "content": "' + good),
        F.when(k % 4 == 0, ',\\"id\\":1').otherwise(""), F.lit('}"}]}'),
    )
    out = finetune.verify(table(spark, d, "part").select(F.col("p_brand").alias("path"), k.alias("line"), line.alias("value")))
    return out.select("path", "records", "valid", "error_count")


@query("""
select count(*) as sample_count, round_even(avg((p_partkey % 6 <> 0)::int), 4) as valid_json_rate, round_even(avg((p_partkey % 6 <> 0 and p_partkey % 2 = 0)::int), 4) as logsource_exact_rate,
  round_even(avg(case when p_partkey % 6 = 0 then 0 when p_partkey % 5 = 0 then 0.5 else 1 end), 4) as avg_attack_tag_recall,
  round_even(avg(case when p_partkey % 6 = 0 then 0 else 0.5 end), 4) as avg_ioc_preservation from part
""")
def model_scores(spark, d):
    k = F.col("p_partkey")
    expected = F.lit('{"logsource": {"category": "dns"}, "tags": ["attack.t1", "attack.T2", "attack.execution"]}')
    said = F.concat(F.lit('{"title": "v1", "logsource": {"category": "'), F.when(k % 2 == 0, "dns").otherwise("file"), F.lit('"}, "tags": ["attack.t1"'), F.when(k % 5 != 0, ', "attack.t2"').otherwise(""), F.lit("]}"))
    user = F.lit('{"ioc_candidates": [{"value": "v1"}, {"value": "v2"}]}')
    rows = table(spark, d, "part").select(F.when(k % 6 != 0, said).alias("predicted"), expected.alias("expected"), user.alias("user"))
    out = finetune.score_summary(finetune.score(rows))
    return out.select("sample_count", "valid_json_rate", "logsource_exact_rate", "avg_attack_tag_recall", "avg_ioc_preservation")


@query("select p_partkey, case when p_partkey % 3 = 0 then null else '{\"a\": \"}' || p_partkey || '\"}' end as found from part")
def json_object_scan(spark, d):
    k = F.col("p_partkey")
    answer = F.when(k % 3 == 0, "no object {").when(k % 3 == 1, F.concat(F.lit('```json\n{"a": "}'), k.cast("string"), F.lit('"}\n```'))).otherwise(F.concat(F.lit('Here: {"a": "}'), k.cast("string"), F.lit('"} trailing }')))
    return table(spark, d, "part").select("p_partkey", finetune.object_in(answer).alias("found"))


@query(f"""
with c as (select report_id, type, count(*) as n from ({SYNTH_STRICT}) group by all)
select report_id, sum(n)::bigint as iocs, string_agg(type || '=' || n, ',' order by type) as summary, 'cti-enriched-lite-v1' as version from c group by report_id
""")
def report_records(spark, d):
    iocs = strict(spark, d)
    out = records.reports(synth(spark, d).select("report_id", F.lit("a.pdf").alias("pdf_file")), iocs)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("ioc_summary")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("report_id", F.size("iocs").cast("long").alias("iocs"), told.alias("summary"), F.col("schema_version").alias("version"))


@query(f"""
select m.report_id, string_agg(technique_id, ',' order by technique_id) as techniques, any_value(e) as evidence
from ({MAPPED}) m join (select l_orderkey as report_id, count(*) as e from lineitem group by 1) l on l.report_id = m.report_id group by m.report_id
""")
def attack_records(spark, d):
    rows = selections(spark, d)
    found = mapping.aggregate(rows, techniques(spark, d), "x")
    about = rows.select("report_id").distinct().withColumn("report_title", F.col("report_id").cast("string"))
    out = records.attack_reports(about, found, mapping.summary(rows, found), "x", 10)
    return out.select("report_id", F.array_join(F.transform("ttp_mappings", lambda m: m["technique_id"]), ",").alias("techniques"), F.col("mapping_summary.evidence_count").alias("evidence"))


@query(f"{RULES} select count(*) as rule_count, count(distinct report_id) as reports_with_rules, 0::bigint as reports_without_rules from r")
def rule_manifest(spark, d):
    iocs, reports, mappings = rule_inputs(spark, d)
    return records.rule_manifest(sigma.rules(iocs, reports, mappings), reports)


# ---- the whole chain -----------------------------------------------------------------------------------------


@query(f"""
with s as (select report_id, count(*) as n from ({SYNTH_STRICT}) group by report_id),
w as (select k, 'r' || k as report_id from (select k from ({SYNTH}))), r as (select w.report_id, k, k % 10 = 0 as bare from w)
select r.report_id, case when bare then 0 else s.n end as strict_count, bare as needs_retry, case when bare then 1 else s.n end as ioc_count, false as human_review from r join s using (report_id)
""")
def pipeline_routes(spark, d):
    rows = synth(spark, d)
    bare = F.when(F.col("k") % 10 == 0, F.lit("only 10.0.0.1 here")).otherwise(F.col("text"))
    _, routes = pipeline.ioc_stage(rows.select("report_id", bare.alias("text")), net.suffix_rules(spark), pipeline.Settings())
    return routes.select("report_id", "strict_count", "needs_retry", "ioc_count", "human_review")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of urls and texts by type: how many, how different, in how many reports."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("report_id"), F.col("url").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("report_id"), "text")
    found = extract.extract(pages.unionByName(docs), net.suffix_rules(spark), context=False)
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("normalized_value").alias("values"), F.countDistinct("report_id").alias("reports"))
