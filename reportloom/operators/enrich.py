"""Sections from layout elements, indicators enriched by them, and the threat context of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import net, text
from reportloom.sources.tables import spread

# Terms whose presence anywhere in a report's text is reported.
ACTORS = ["APT-C-56", "Transparent Tribe", "APT36", "ProjectM", "C-Major", "SideCopy", "Sidewinder"]
MALWARE = ["CrimsonRAT", "RAT", "Dropper"]
BEHAVIORS = {
    "macro": "malicious macro execution",
    "Dropper": ".NET dropper",
    "C&C": "C2 communication",
    "download": "file download or RAT download",
    "auto-start": "auto-start persistence",
    "Enumerate processes": "process enumeration",
    "screenshots": "screenshot capture",
    "file": "file operation",
    "user information": "user information collection",
}
TEXT_TYPES = ["paragraph", "caption", "list item"]


def flatten_layout(layouts: DataFrame, column: str = "layout") -> DataFrame:
    """report_id, ord, type, content: the elements of each report's layout tree (JSON text), parents first.

    Children are under `kids`, then `list items`. Level by level within a row: each level's nodes (objects, which are
    elements, and arrays, which only hold nodes) give the next one's, with their path from the root, and at last the
    paths are sorted. There are no more levels than twice the keys for children; the JSON parser allows 1,000. A null
    or broken tree has no elements.
    """
    nodes, none = "array<struct<path:array<int>,node:variant>>", "array<struct<path:array<int>,type:string,content:string>>"
    kind = lambda v: F.schema_of_variant(v)

    def said(v: Column, key: str) -> Column:
        found = F.try_variant_get(v, f"$.{key}", "variant")
        return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))

    def below(x: Column) -> Column:
        """The nodes right under a node."""
        v, path = x["node"], x["path"]
        named = [F.struct(F.concat(path, F.array(F.lit(k))).alias("path"), F.try_variant_get(v, f"$['{key}']", "variant").alias("node")) for k, key in enumerate(("kids", "list items"))]
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda y, i: F.struct(F.concat(path, F.array(i)).alias("path"), y.alias("node")))
        own = F.when(kind(v).startswith("ARRAY"), listed).when(kind(v).startswith("OBJECT"), F.array(*named)).otherwise(F.array().cast(nodes))
        return F.filter(own, lambda y: kind(y["node"]).startswith("OBJECT") | kind(y["node"]).startswith("ARRAY"))

    def level(a: Column, _: Column) -> Column:
        elements = F.filter(a["now"], lambda x: kind(x["node"]).startswith("OBJECT"))
        told = F.transform(elements, lambda x: F.struct(x["path"].alias("path"), said(x["node"], "type").alias("type"), said(x["node"], "content").alias("content")))
        return F.struct(F.flatten(F.transform(a["now"], below)).alias("now"), F.concat(a["found"], told).alias("found"))

    tree = F.try_parse_json(F.col(column))
    root = F.struct(F.array().cast("array<int>").alias("path"), F.try_variant_get(tree, "$.kids", "variant").alias("node"))
    start = F.struct(F.filter(F.array(root), lambda x: x["node"].isNotNull()).cast(nodes).alias("now"), F.array().cast(none).alias("found"))
    levels = F.least(2 * F.regexp_count(F.col(column), F.lit('"(?:kids|list items)"')) + 2, F.lit(1000))
    found = F.array_sort(F.aggregate(F.sequence(F.lit(1), levels), start, level, lambda a: a["found"]))
    rows = layouts.filter(tree.isNotNull()).select("report_id", F.posexplode(found).alias("ord", "x"))
    return rows.select("report_id", "ord", "x.type", "x.content")


def sections(elements: DataFrame) -> DataFrame:
    """report_id, ord, section_title, text: runs of text below each heading of elements (report_id, ord, type, content).

    Text before the first heading belongs to "unknown"; a heading without text below it is no section.
    """
    # what has a character other than white space has one after normalizing too, so blanks go before that work
    rows = elements.filter(F.col("type").isin("heading", *TEXT_TYPES) & text.text_of(F.col("content")).rlike(f"{text.UNICODE}[^\\s\\x1c-\\x1f]"))
    rows = spread(rows).withColumn("content", text.normalize_layout(F.col("content")))
    heading = F.col("type") == "heading"
    run = F.count_if(heading).over(Window.partitionBy("report_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = rows.withColumn("run", run).groupBy("report_id", "run")
    texts = F.array_sort(F.collect_list(F.when(~heading, F.struct("ord", "content"))))
    out = runs.agg(F.max(F.when(heading, F.col("content"))).alias("title"), texts.alias("texts")).filter(F.size("texts") > 0)
    return out.select("report_id", F.col("run").cast("int").alias("ord"), F.coalesce("title", F.lit("unknown")).alias("section_title"), F.array_join(F.transform("texts", lambda t: t["content"]), " ").alias("text"))


def nested(sections_: DataFrame) -> DataFrame:
    """report_id, sections: array(struct(section_title, text)) in order."""
    lists = sections_.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("ord", "section_title", "text"))).alias("s"))
    return lists.select("report_id", F.transform("s", lambda s: F.struct(s["section_title"].alias("section_title"), s["text"].alias("text"))).alias("sections"))


def first_section(value: Column, sections_: Column) -> Column:
    """The first section whose text holds value, compared in lower case after normalizing. Null if none does."""
    wanted = F.lower(text.normalize_layout(value))
    held = F.filter(sections_, lambda s: s["norm"].contains(wanted))
    return F.when(wanted != "", F.try_element_at(held, F.lit(1)))


def confidence(base: Column, matched: Column, title: Column, has_port: Column) -> Column:
    """Raised to 0.75 by a section, 0.85 by one with ioc in its title, 0.90 by a port. 0 counts as the usual 0.6."""
    start = F.when(base.isNull() | (base == 0), 0.6).otherwise(base)
    steps = [start, F.when(matched, 0.75), F.when(F.lower(title).contains("ioc"), 0.85), F.when(has_port, 0.90)]
    return F.bround(F.greatest(*steps), 2)


def enrich(iocs: DataFrame, sections_: DataFrame) -> DataFrame:
    """iocs with section, port, network_indicator, confidence, source and evidence from the report's sections.

    Sections stay nested in one row for each report and are normalized there once, so that finding the first one
    with a value is no join on substrings.
    """
    lists = nested(sections_).select("report_id", F.transform("sections", lambda s: F.struct(s["section_title"].alias("section_title"), s["text"].alias("text"), F.lower(text.normalize_layout(s["text"])).alias("norm"))).alias("__sections"))
    rows = iocs.join(lists, "report_id", "left")
    key = F.coalesce(text.truthy(F.col("normalized_value")), F.col("value"), F.lit(""))
    rows = rows.withColumn("__s", first_section(key, F.col("__sections")))
    found = F.col("__s").isNotNull()
    title = F.when(found, F.col("__s.section_title")).otherwise(F.col("section"))
    near = F.coalesce(text.truthy(F.col("__s.text")), text.text_of(F.col("context")))
    port = F.when(F.col("type") == "ipv4", net.port_for(F.col("normalized_value"), near))
    rows = rows.withColumn("port", port)
    has_port = F.col("port").isNotNull()
    indicator = F.when(has_port, F.struct(F.col("normalized_value").alias("ip"), F.col("port").cast("int").alias("port"), F.lit("possible_c2").alias("role")))
    own = F.struct(F.lit("regex_ioc_extractor").alias("source"), F.col("section").alias("section_title"), text.text_of(F.col("context")).alias("content"))
    layout = F.struct(F.lit("pdf_layout_parser").alias("source"), F.col("__s.section_title").alias("section_title"), F.col("__s.text").alias("content"))
    evidence = F.filter(F.array(own, F.when(found, layout)), lambda e: e.isNotNull() & (e["content"] != ""))
    return rows.select(
        "report_id",
        "type",
        "value",
        "normalized_value",
        F.coalesce(text.truthy(title), F.lit("unknown")).alias("section"),
        "context",
        confidence(F.col("confidence"), found, title, has_port).alias("confidence"),
        text.source_union(F.col("source"), F.when(found, "pdf_layout_parser")).alias("source"),
        evidence.alias("evidence"),
        "port",
        indicator.alias("network_indicator"),
    )


def present(terms: list[str], full_text: Column) -> Column:
    """The terms that occur in full_text, whatever the case, in their order."""
    low = F.lower(full_text)
    return F.filter(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t)))


def threat_context(sections_: DataFrame, iocs: DataFrame | None = None) -> DataFrame:
    """report_id, actor_aliases, malware, behaviors, c2: what sections and enriched iocs tell about a report."""
    rows = nested(sections_).select("report_id", F.array_join(F.transform("sections", lambda s: s["text"]), " ").alias("t"))
    labels = F.create_map(*[F.lit(x) for kv in BEHAVIORS.items() for x in kv])
    behaviors = F.transform(present(list(BEHAVIORS), F.col("t")), lambda k: F.element_at(labels, k))
    out = rows.select("report_id", present(ACTORS, F.col("t")).alias("actor_aliases"), present(MALWARE, F.col("t")).alias("malware"), F.array_sort(F.array_distinct(behaviors)).alias("behaviors"))
    if iocs is None:
        return out
    with_port = iocs.filter("type = 'ipv4' and port is not null")
    c2 = with_port.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(F.col("normalized_value").alias("ip"), F.col("port").cast("int").alias("port"), F.lit("possible_c2").alias("role")))).alias("c2"))
    joined = out.join(c2, "report_id", "full_outer")
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty).alias(c) for c in ("actor_aliases", "malware", "behaviors")]
    return joined.select("report_id", *lists, F.coalesce("c2", F.array().cast("array<struct<ip:string,port:int,role:string>>")).alias("c2"))


def first_by_priority(left: DataFrame, files: DataFrame, names: list[Column], key: str = "file") -> DataFrame:
    """left with `match`: the first of names (tried in order) that is in files (name); null if none is."""
    tries = F.array(*[F.struct(F.lit(k).alias("priority"), n.alias("name")) for k, n in enumerate(names)])
    rows = left.select(key, F.explode(tries).alias("t")).select(key, "t.*").join(files.select("name").distinct(), "name")
    best = rows.groupBy(key).agg(F.min_by("name", "priority").alias("match"))
    return left.join(best, key, "left")


def layout_names(file: Column) -> list[Column]:
    """Names of the layout file for an indicator file: the same, its stem with .json, its stem without .iocs."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return [file, F.concat(stem, F.lit(".json")), F.concat(F.regexp_replace(stem, r"\.iocs$", ""), F.lit(".json"))]


def mapping_names(file: Column) -> list[Column]:
    """Names of the mapping file for an indicator file: its stem, then its stem without .iocs, with .attack.json."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return [F.concat(stem, F.lit(".attack.json")), F.concat(F.regexp_replace(stem, r"\.iocs$", ""), F.lit(".attack.json"))]
