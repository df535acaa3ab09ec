"""Queries that write rows of a table as files with the library's writers and read them back with its readers.

Files go to a folder of their own below the shared one. What one tool would read as a single file is small here, as it
is there; SQL over the same table says what should come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions import net, text
from reportloom.operators import enrich, evaluate, extract, finetune, kb, mapping, records, sigma
from reportloom.plans import pipeline
from reportloom.plans.queries import STIX, SYNTH_STRICT, TOKENS, joined, query, rule_inputs, stix, strict, synth, table, techniques
from reportloom.sources import readers, tables, writers


def _text_files(rows: DataFrame, folder: str, name: Column, line: Column, order: str, head: str = "") -> None:
    """A file for each name, with a line for each row in the given order."""
    writers.lines(rows.select(name.alias("name"), line.alias("l"), F.col(order).alias("o")), folder, "name", "l", ["o"], head)


# ---- sources -----------------------------------------------------------------------------------------------------


@query("""
with l as (select s_suppkey % 40 as n, max(s_suppkey) as k from supplier group by 1),
f as (select n_nationkey as n, 'r' || n_nationkey || '.pdf' as file from nation union all select -1, 'x.y.pdf')
select file, regexp_replace(file, '\\.[^.]*$', '') as report_id, case when k is null then regexp_replace(file, '\\.[^.]*$', '') else 'Title, "' || k || '"' end as report_title, case when k is null then '' else cast(2000 + k % 20 as varchar) end as year,
  case when k is null then '' else 'https://x/' || k end as original_link from f left join l on l.n = f.n
""")
def metadata_log(spark: SparkSession, d: str) -> DataFrame:
    """A download log in CSV joined to files: the last row of a file counts, and a file without any has its stem as title."""
    path, k = tables.new_path(spark, "log"), F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("r"), (F.col("s_suppkey") % 40).cast("string"), F.lit('.pdf,"Title, ""'), k, F.lit('""",s,'), (2000 + F.col("s_suppkey") % 20).cast("string"), F.lit(",https://x/"), k)
    _text_files(table(spark, d, "supplier"), path, F.lit("log.csv"), line, "s_suppkey", "Saved File,Title,Source,Year,Link\n")
    files = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("file")).union(spark.createDataFrame([("x.y.pdf",)], "file string"))
    return readers.with_metadata(files, readers.metadata(spark, f"{path}/log.csv")).select("file", "report_id", "report_title", "year", "original_link")


@query("""
select 's' || s_suppkey || '.pdf' as file, case when s_suppkey % 10 = 9 then 0 else 2 end as page_count,
  case when s_suppkey % 10 = 9 then '' else chr(10) || chr(10) || '[Page 1]' || chr(10) || 'Beacon (' || s_suppkey || ')' || chr(10) || 'to 8.8.4.4' || chr(10) || chr(10) || chr(10) || '[Page 2]' || chr(10) || s_name end as text,
  (s_suppkey % 10 = 9)::int as errors from supplier
""")
def pdf_texts(spark, d):
    """PDF files of two pages, one in ten broken, beside files of another kind."""
    path, k = tables.new_path(spark, "pdf"), F.col("s_suppkey").cast("string")
    first = F.concat(F.lit("BT /F1 12 Tf 72 720 Td (Beacon \\("), k, F.lit("\\)) Tj 0 -14 Td (to 8.8) Tj (.4.4) Tj ET"))
    second = F.concat(F.lit("BT /F1 12 Tf 72 720 Td ("), F.col("s_name"), F.lit(") Tj ET"))
    obj = lambda n, body: F.concat(F.lit(f"{n} 0 obj\n"), body, F.lit("\nendobj\n"))
    shown = lambda n, c: obj(n, F.concat(F.lit("<< /Length "), F.length(c).cast("string"), F.lit(" >>\nstream\n"), c, F.lit("\nendstream")))
    page = lambda n, of: obj(n, F.lit(f"<< /Type /Page /Parent 2 0 R /Contents {of} 0 R /Resources << /Font << /F1 7 0 R >> >> /MediaBox [0 0 612 792] >>"))
    whole = F.concat(F.lit("%PDF-1.4\n"), obj(1, F.lit("<< /Type /Catalog /Pages 2 0 R >>")), obj(2, F.lit("<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>")), page(3, 5), page(4, 6), shown(5, first), shown(6, second), obj(7, F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")), F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF\n"))
    rows = table(spark, d, "supplier").withColumn("body", F.when(F.col("s_suppkey") % 10 == 9, "no pdf").otherwise(whole))
    writers.collect_named(rows.select(F.concat(F.lit("s"), k, F.lit(".pdf")).alias("name"), "body").union(spark.createDataFrame([("s1.txt", "x")], "name string, body string")), path, "name", "body")
    out = readers.pdf_text(readers.pdf_files(spark, path))
    return out.select("file", "page_count", "text", F.size("extraction_errors").alias("errors"))


@query(f"""
with c as (select report_id, type, count(*) as n from ({SYNTH_STRICT}) group by all), r as (select report_id, sum(n)::bigint as iocs, string_agg(type || '=' || n, ',' order by type) as summary from c group by report_id)
select report_id, 'new ' || report_id as report_title, iocs, 'cti-enriched-lite-v1' as version, 'c.pdf' as pdf_file from r
""")
def reports_array(spark, d):
    """All reports' records, each twice, as one JSON array, read back: of an id the last one counts."""
    path, iocs = tables.new_path(spark, "array"), tables.saved(strict(spark, d, context=True), "strict")
    ids = synth(spark, d).select("report_id", F.lit("c.pdf").alias("pdf_file"))
    full = records.reports(ids.withColumn("report_title", F.concat(F.lit("old "), "report_id")), iocs).withColumn("__o", F.lit(0))
    full = full.unionByName(records.reports(ids.withColumn("report_title", F.concat(F.lit("new "), "report_id")), iocs).withColumn("__o", F.lit(1)))
    writers.combined(full.drop("ioc_summary"), path, "all_reports_iocs.json", ["__o", "report_id"])
    rows = readers.reports_json(spark, f"{path}/all_reports_iocs.json", "n")
    out = readers.last_by_id(rows, "n")
    return out.select("report_id", "report_title", F.size("iocs").cast("long").alias("iocs"), F.col("schema_version").alias("version"), "pdf_file")


@query("select 'n' || n_nationkey || '.iocs.json' as file, 'n' || n_nationkey as report_id, n_name as report_title, 1 as iocs, 'ipaddress,pdf_layout_parser,regex' as source, 'Part' as section, true as indented from nation where n_nationkey % 5 <> 0")
def merged_files(spark, d):
    """Merged records, pretty JSON under the name of the indicator file; reports without a layout file are left out."""
    path, k = tables.new_path(spark, "merged"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    rows = table(spark, d, "nation").withColumn("report_id", k)
    about = rows.select("report_id", F.col("n_name").alias("report_title"), F.concat(k, F.lit(".iocs.json")).alias("file"))
    parts = rows.filter("n_nationkey % 5 <> 0").select("report_id", F.lit(1).alias("ord"), F.lit("Part").alias("section_title"), F.lit("beacon 8.8.4.4").alias("text"))
    layouts = rows.filter("n_nationkey % 5 <> 0").select(F.concat("report_id", F.lit(".json")).alias("name"))
    about = enrich.first_by_priority(about, layouts, enrich.layout_names(F.col("file"))).filter("match is not null").drop("match")
    found = extract.extract(rows.select("report_id", F.lit("c2 8.8.4.4").alias("text")), net.suffix_rules(spark))
    full = records.reports(about, enrich.enrich(found, parts), parts, enrich.threat_context(parts), layout=True)
    body = writers.pretty(F.struct(*[c for c in full.columns if c != "file"]))
    writers.collect_named(full.select("file", body.alias("body")), path, "file", "body")
    read = readers.reports_json(spark, path)
    lines = readers.jsonl(spark, path).groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg((F.count(F.lit(1)) > 20).alias("indented"))
    out = read.select("file", "report_id", "report_title", F.size("iocs").alias("iocs"), F.array_join(F.col("iocs")[0]["source"], ",").alias("source"), F.col("iocs")[0]["section"].alias("section"))
    return out.join(lines, "file")


@query(f"select t as technique_id, p_name as name, p_partkey % 3 = 0 as sub, 'https://a/' || t as url from ({STIX})")
def stix_bundle(spark, d):
    """A STIX bundle, one JSON file, read back and made a knowledge base, which is written as JSON lines and read back."""
    path, lines = tables.new_path(spark, "stix"), tables.new_path(spark, "kb")
    writers.combined(stix(spark, d), path, "bundle.json", head='{"type":"bundle","objects":[', tail="]}")
    base = kb.build(readers.stix_objects(spark, f"{path}/bundle.json"))
    writers.jsonl(base, lines)
    read = readers.knowledge_base(spark, lines, base.schema)
    return read.select("technique_id", "name", F.col("is_subtechnique").alias("sub"), "url")


@query("""
with n as (select n_regionkey as r, n_nationkey as k, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation)
select case when r % 2 = 0 then 'a/set' || r || '_train.tsv' else 'b/c/set' || r || '.tsv' end as file, i::int as row_id, n_name as text, 'T' || (1000 + k) || ',T2' as labels, r % 2 = 0 as train from n where k % 4 <> 0 and k % 7 <> 0
""")
def labelled_sets(spark, d):
    """Tab-separated sets in folders of folders: rows are numbered before those without text or labels are left out."""
    path, k = tables.new_path(spark, "sets"), F.col("n_nationkey")
    rows = table(spark, d, "nation")
    said = F.when(k % 4 == 0, " ").otherwise(F.col("n_name"))
    labels = F.when(k % 7 == 0, "[]").otherwise(F.concat(F.lit("['t2', 'T"), (1000 + k).cast("string"), F.lit("']")))
    name = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("a/set"), F.col("n_regionkey").cast("string"), F.lit("_train.tsv"))).otherwise(F.concat(F.lit("b/c/set"), F.col("n_regionkey").cast("string"), F.lit(".tsv")))
    _text_files(rows, path, name, F.concat(said, F.lit("\t"), labels), "n_nationkey", "text1\tlabels\n")
    train = readers.labelled(spark, path, "*_train.tsv").select("file", "row_id", F.lit(True).alias("train"))
    out = readers.labelled(spark, path).join(train, ["file", "row_id"], "left")
    return out.select(F.regexp_extract("file", "/([ab]/.*)$", 1).alias("file"), "row_id", "text", joined("labels").alias("labels"), F.coalesce("train", F.lit(False)).alias("train"))


@query("select s_suppkey, nullif(s_name, '') as name, 'a \"b\", c' as note from supplier union all select null, 'none', null")
def sheet_with_mark(spark, d):
    """A sheet in CSV that begins with a byte order mark, and an empty one of which only the header is there."""
    path = tables.new_path(spark, "sheet")
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.lit('a "b", c').alias("note"))
    writers.csv_with_bom(rows, path, "rows.csv", ["s_suppkey", "name", "note"])
    writers.csv_with_bom(rows.limit(0), path, "empty.csv", ["s_suppkey", "name", "note"])
    read = readers.csv_rows(spark, f"{path}/rows.csv").select(F.col("s_suppkey").cast("long"), "name", "note")
    none = readers.csv_rows(spark, f"{path}/empty.csv").agg(F.when(F.count(F.lit(1)) == 0, "none").alias("name")).select(F.lit(None).cast("long").alias("s_suppkey"), "name", F.lit(None).cast("string").alias("note"))
    return read.unionByName(none)


@query("""
with l as (select s_nationkey % 4 as f, row_number() over (partition by s_nationkey % 4 order by s_suppkey) as line, s_suppkey as k from supplier),
v as (select *, row_number() over (partition by f order by line) as n from l where k % 6 <> 0)
select 'all' as read, 'f' || f || '.jsonl' as file, line, k from v union all select 'first 3', 'f' || f || '.jsonl', line, k from v where n <= 3 union all select 'none', 'f' || f || '.jsonl', line, k from v where n <= 0
""")
def limited_lines(spark, d):
    """Lines of JSON with blank ones between: all, the first three of each file, and a limit of 0 that means none."""
    path, k = tables.new_path(spark, "lines"), F.col("s_suppkey")
    line = F.when(k % 6 == 0, "  ").otherwise(F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}")))
    _text_files(table(spark, d, "supplier"), path, F.concat(F.lit("f"), (F.col("s_nationkey") % 4).cast("string"), F.lit(".jsonl")), line, "s_suppkey")
    every = readers.jsonl(spark, path)
    parts = [("all", every), ("first 3", readers.jsonl(spark, path, 3)), ("none", readers.first_rows(every, 0, ["path"], ["line"], zero="none"))]
    rows = [r.select(F.lit(name).alias("read"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("line").cast("long").alias("line"), F.get_json_object("value", "$.k").cast("long").alias("k")) for name, r in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""
select 'r' || s_suppkey || case when s_suppkey % 2 = 0 then '.yml' else '.yaml' end as file, s_suppkey % 2 = 1 as late, s_suppkey % 3 = 0 as valid, case when s_suppkey % 5 <> 0 and s_suppkey % 3 = 0 then 'Rule "' || s_suppkey || '"' end as title
from supplier
""")
def rule_files(spark, d):
    """Rule files by name, *.yml before *.yaml: their checks, and the titles of those a corpus admits. One in five is broken."""
    path, k = tables.new_path(spark, "rules"), F.col("s_suppkey").cast("string")
    rows = table(spark, d, "supplier")
    body = F.concat(
        F.lit("title: 'Rule \""), k, F.lit("\"'\nid: 0f653f0b-135a-ac53-922e-874cb7c3a9db\nstatus: s\ndescription: d\nlogsource:\n  category: dns\ndetection:\n  selection:\n    a: [b, 1]\n"),
        F.when(F.col("s_suppkey") % 3 == 0, "  condition: selection\n").otherwise(""), F.lit("falsepositives:\n  - x\nlevel: low\n"), F.when(F.col("s_suppkey") % 5 == 0, "oops: [\n").otherwise(""),
    )
    name = F.concat(F.lit("r"), k, F.when(F.col("s_suppkey") % 2 == 0, ".yml").otherwise(".yaml"))
    writers.collect_named(rows.select(name.alias("name"), body.alias("body")), path, "name", "body")
    file = F.element_at(F.split("path", "/"), -1)
    texts = readers.rule_texts(spark, path)
    checked = sigma.validate(texts).join(texts.select("path", F.col("ord")[texts.schema["ord"].dataType.names[0]].alias("late")), "path").select(file.alias("file"), "late", "valid")
    titles = finetune.admitted(readers.rule_corpus(spark, path)).select(file.alias("file"), F.try_variant_get("rule", "$.title", "string").alias("title"))
    return checked.join(titles, "file", "left")


@query("select o_orderkey as row_id from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0")
def resumed_rows(spark, d):
    """Rows that two earlier runs, the second appending, have not written."""
    path, none = tables.new_path(spark, "done"), tables.new_path(spark, "nothing")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    writers.jsonl(rows.filter("row_id % 3 = 0"), path)
    writers.jsonl(rows.filter("row_id % 5 = 0"), path, "append")
    done = readers.existing(spark, path, "row_id long").unionByName(readers.existing(spark, none, "row_id long"))
    return readers.remaining(rows, done, ["row_id"])


@query("select 'n' || n_nationkey as report_id, case when n_nationkey % 3 = 0 then 'mapped' when n_nationkey % 3 = 1 then 'mapped' else 'skipped_existing' end as status, 'N ' || n_name as report_title, 2 as evidence from nation")
def resumed_reports(spark, d):
    """Reports whose mapping was written whole before are skipped; a broken file is done again. What the summary lists."""
    path = tables.new_path(spark, "attack")
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("report_id"), F.concat(F.lit("N "), F.col("n_name")).alias("report_title"))
    body = F.when(F.col("n_nationkey") % 3 == 1, '{"report_id": "broken').otherwise(F.to_json(F.struct("report_id", "report_title")))
    writers.collect_named(rows.filter("n_nationkey % 3 <> 0").select(F.concat("report_id", F.lit(".attack.json")).alias("name"), body.alias("body")), path, "name", "body")
    done = readers.completed(spark, path, "*.attack.json").select(F.get_json_object("value", "$.report_id").alias("report_id"))
    told = rows.select("report_id", F.lit(2).cast("long").alias("evidence_count"), F.lit(0).cast("long").alias("technique_count"), F.expr("map()").cast("map<string,bigint>").alias("tactic_counts"), F.lit(0).cast("long").alias("validation_error_count"))
    none = mapping.fallback(rows.select("report_id", F.lit("cve").alias("type")), techniques(spark, d))
    out = records.mapping_overview(records.attack_reports(rows.select("report_id", "report_title"), none, told, "prompt-only", 10), done)
    return out.select("report_id", "status", "report_title", F.col("mapping_summary.evidence_count").cast("int").alias("evidence"))


@query("""
with t as (select distinct 'n' || s_nationkey as r, 'domain' as type, 'd' || s_suppkey % 9 || '.com' as v from supplier where s_suppkey % 2 = 0), p as (select distinct 'n' || s_nationkey as r, 'domain' as type, 'd' || s_suppkey % 9 || '.com' as v from supplier where s_suppkey % 3 <> 0),
j as (select t.r is not null as t, p.r is not null as p from t full join (select * from p where r in (select r from t)) p on t.r = p.r and t.v = p.v)
select count(*) filter (t and p) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn from j
""")
def truth_files(spark, d):
    """A ground truth file against prediction files, one for each report; reports that the truth does not have are left out."""
    path, rows = tables.new_path(spark, "truth"), table(spark, d, "supplier")
    report, value = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("D"), (F.col("s_suppkey") % 9).cast("string"), F.lit(".com"))
    one = lambda f: rows.filter(f).groupBy(report.alias("report_id")).agg(F.collect_list(F.struct(F.lit("domain").alias("type"), value.alias("normalized_value"))).alias("iocs"))
    whole = one("s_suppkey % 2 = 0").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("report_id", F.struct(F.lit("t").alias("report_title"), "iocs")))).alias("reports"))).alias("body"))
    writers.collect_named(whole.select(F.lit("truth.json").alias("name"), "body"), path, "name", "body")
    said = one("s_suppkey % 3 <> 0").join(one("s_suppkey % 2 = 0").select("report_id"), "report_id", "full").select("report_id", F.coalesce("iocs", F.array().cast("array<struct<type:string,normalized_value:string>>")).alias("iocs"))
    writers.collect_named(said.select(F.concat("report_id", F.lit(".iocs.json")).alias("name"), F.to_json(F.struct("report_id", "iocs")).alias("body")), f"{path}/out", "name", "body")
    truth = readers.ground_truth(spark, f"{path}/truth.json")
    found = readers.predictions_for(readers.inputs(spark, folder=f"{path}/out"), truth).select("report_id", F.explode("iocs").alias("i")).select("report_id", "i.type", "i.normalized_value")
    return evaluate.counts(evaluate.compare(found, truth))


@query("select 'n' || n_nationkey as report_id, n_name as report_title, 'n' || n_nationkey || '.iocs.json' as file from nation where n_nationkey % 2 = 0 union all select 'single', 'one', 'single.json'")
def resolved_inputs(spark, d):
    """One file and a folder's indicator files; other files of the folder are not read."""
    path = tables.new_path(spark, "inputs")
    rows = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".iocs.json").otherwise(".json")).alias("name"), F.to_json(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("report_id"), F.col("n_name").alias("report_title"))).alias("body"))
    writers.collect_named(rows, path, "name", "body")
    writers.collect_named(spark.createDataFrame([("single.json", '{"report_id": "single", "report_title": "one"}')], "name string, body string"), f"{path}/single", "name", "body")
    return readers.inputs(spark, f"{path}/single/single.json", path).select("report_id", "report_title", "file")


@query(f"select '--text' as file, 1 as row_id, 'Beacon of the C2 server' as text, len({TOKENS}) as n, array_to_string({TOKENS}, ' ') as tokens, 0 as labels from (select 'Beacon of the C2 server' as text)")
def single_text(spark, d):
    """A text given by hand, in the shape of a labelled set."""
    t = text.tokens(F.col("text"))
    return readers.single_text(spark, "Beacon of the C2 server").select("file", "row_id", "text", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"), F.size("labels").alias("labels"))


# ---- sinks -------------------------------------------------------------------------------------------------------


@query("select 'set__' || s_nationkey % 3 || '.tsv' as split, count(*) as n, sum(s_suppkey)::bigint as total from supplier group by 1")
def predictions_by_split(spark, d):
    """Predictions in a folder for each split, slashes in names replaced."""
    path = tables.new_path(spark, "splits")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("set/"), (F.col("s_nationkey") % 3).cast("string"), F.lit(".tsv")).alias("split"), "s_suppkey")
    writers.by_split(rows, path)
    return spark.read.schema("s_suppkey long, split string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total"))


@query("""
with r as (select distinct s_nationkey % 4 as n from supplier)
select 'rules/n' || n as folder, 'name: n' || n || chr(10) || 'n: ' || n as body from r
""")
def named_folders(spark, d):
    """Texts written by the tasks that hold them, a folder for each name."""
    path = tables.new_path(spark, "named")
    n = (F.col("s_nationkey") % 4).cast("string")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("n"), n).alias("file"), F.concat(F.lit("name: n"), n, F.lit("\nn: "), n).alias("body")).distinct()
    writers.named_text(rows, path, "file", "body")
    read = spark.read.text(path, wholetext=True)
    return read.select(F.concat(F.lit("rules/"), "name").alias("folder"), F.rtrim(F.regexp_replace("value", "\n+$", "")).alias("body"))


@query(f"""
with v as (select distinct 'c' || (cast(report_id[2:] as bigint) % 50) as report_id, type from ({SYNTH_STRICT}) where type <> 'cve')
select count(*) as rule_count, count(distinct report_id) as reports_with_rules, 0::bigint as reports_without_rules, count(*) as entries, count(*) as valid_count, 0::bigint as invalid_count, 'sets' as rules_dir, 'a c|b' as order_of_columns from v
""")
def manifests(spark, d):
    """The manifest of rules with its entries, and the summary of their checks, written as JSON and read back."""
    path = tables.new_path(spark, "manifest")
    iocs, reports, mappings = rule_inputs(spark, d)
    made = tables.saved(sigma.as_yaml(sigma.rules(iocs, reports, mappings)), "rules")
    count = writers.combined(records.rule_entries(made), path, "rules.json", ["report_id", "path"])
    writers.summary(records.rule_manifest(made, reports), path, "manifest.json", {"rules_dir": "sets", "entries": count})
    writers.summary(sigma.validation_summary(sigma.validate(made.select(F.col("file_name").alias("path"), "yaml"))), path, "validation.json")
    writers.csv(spark.createDataFrame([("b", "a c")], "b string, a string"), f"{path}/csv", ["a", "b"])
    read = spark.read.json(f"{path}/manifest.json", multiLine=True).crossJoin(spark.read.json(f"{path}/validation.json", multiLine=True).select("valid_count", "invalid_count"))
    listed = spark.read.json(f"{path}/rules.json", multiLine=True).agg(F.count("id").alias("listed"))
    order = spark.read.text(f"{path}/csv").agg(F.max(F.when(F.col("value") != "a,b", F.replace("value", F.lit(","), F.lit("|")))).alias("order_of_columns"))
    return read.crossJoin(listed).filter("listed = entries").drop("listed").crossJoin(order)


@query("""
select row_number() over (order by p_partkey) as line, 'system,user' as prompt, p_partkey % 6 <> 0 as valid_json, p_partkey % 6 <> 0 and p_partkey % 2 = 0 as logsource_exact, (case when p_partkey % 6 = 0 then 0 else 0.5 end)::double as ioc_preservation from part
""")
def message_scores(spark, d):
    """Chat records in JSON lines, split into what a model is asked and what it should answer, and its answers scored."""
    path, k = tables.new_path(spark, "chat"), F.col("p_partkey")
    record = F.struct(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in zip(finetune.ROLES, (F.lit("s"), F.lit('{"ioc_candidates": [{"value": "v1"}, {"value": "v2"}]}'), F.lit('{"logsource": {"category": "dns"}, "tags": ["attack.t1"]}')), strict=True)]).alias("messages"))
    _text_files(table(spark, d, "part"), path, F.lit("test.jsonl"), F.to_json(record), "p_partkey")
    asked = finetune.split_messages(readers.jsonl(spark, path))
    answers = table(spark, d, "part").select((k + 1).alias("line"), F.when(k % 6 == 0, "no answer").otherwise(F.concat(F.lit('So: {"title": "v1", "logsource": {"category": "'), F.when(k % 2 == 0, "dns").otherwise("file"), F.lit('"}}'))).alias("raw"))
    out = finetune.score(asked.join(answers, "line").withColumn("predicted", finetune.object_in("raw")))
    return out.select("line", F.array_join(F.transform("prompt", lambda m: m["role"]), ",").alias("prompt"), "valid_json", "logsource_exact", "ioc_preservation")


@query("select 'n' || n_nationkey as report_id, 'n' || n_nationkey as said, n_nationkey % 2 = 1 as review, 1 + (n_nationkey % 2) as attempts from nation")
def state_files(spark, d):
    """The final states of a run as files, one for each report, as a tool that handles one report at a time writes them."""
    path = tables.new_path(spark, "states")
    rows = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("report_id"), F.when(F.col("n_nationkey") % 2 == 0, "8.8.4.4").otherwise("nothing").alias("text"), F.lit("t").alias("report_title"), F.lit("").alias("original_link"), F.lit("").alias("source"), F.lit("").alias("pdf_file"))
    parts = rows.select("report_id", F.lit(1).alias("ord"), F.lit("s").alias("section_title"), "text")
    out = pipeline.states(pipeline.run(rows, parts, techniques(spark, d), net.suffix_rules(spark)))
    body = writers.pretty(F.struct(*out.columns))
    writers.collect_named(out.select(F.concat("report_id", F.lit(".state.json")).alias("name"), body.alias("body")), path, "name", "body")
    read = readers.completed(spark, path, "*.state.json")
    said = F.from_json("value", "report_id string, human_review_required boolean, ioc_attempts int")
    return read.select(F.regexp_extract("file", r"^(.*)\.state\.json$", 1).alias("report_id"), said.alias("s")).select("report_id", F.col("s.report_id").alias("said"), F.col("s.human_review_required").alias("review"), F.col("s.ioc_attempts").alias("attempts"))
