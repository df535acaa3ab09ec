"""Readers. All go through Spark's file sources, so any path that Spark can open will do."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reportloom.functions import text, yaml
from reportloom.operators import kb as kb_ops

IOC = (
    "struct<type:string,value:string,normalized_value:string,section:string,context:string,confidence:double,source:array<string>,"
    "evidence:array<struct<source:string,section_title:string,content:string>>,port:string,network_indicator:struct<ip:string,port:int,role:string>>"
)
REPORT = (
    "schema_version string, report_id string, report_title string, source_type string, source string, year string, original_link string, "
    "pdf_file string, page_count int, text_length bigint, extraction_errors array<string>, sections array<struct<section_title:string,text:string>>, "
    f"iocs array<{IOC}>"
)
METADATA = "`Saved File` string, Title string, Source string, Year string, Link string"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file, content: the PDF files of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _plain_pages(content: bytes) -> list[str]:
    """Texts of the pages of a PDF whose pages show literal strings in one-byte encodings: enough for plain exports.

    Objects are found by their marks; a page's content streams are inflated where they say so, and the strings that
    are shown are joined, with a new line where the text's place moves. Fails where there is no page.
    """
    objects = {int(n): body for n, body in re.findall(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", content)}
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def literal(s: bytes) -> str:
        plain = re.sub(rb"(?s)\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else escapes.get(m[1], m[1]), s)
        return plain.decode("latin-1")

    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        out = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", found[1]) if found else []:
            head, _, rest = objects[int(ref)].partition(b"stream")
            data = re.sub(rb"^\r?\n", b"", rest[: rest.rfind(b"endstream")])
            data = zlib.decompress(data) if b"/FlateDecode" in head else data
            for token in re.findall(rb"(?s)\((?:[^()\\]|\\.)*\)|\bT[dDm*]\B|\bT[dDm]\b|T\*|'", data):
                if token[:1] == b"(":
                    out.append(literal(token[1:-1]))
                elif out and out[-1] != "\n":
                    out.append("\n")
        pages.append("".join(out).rstrip("\n"))
    if not pages:
        raise ValueError("no page found")
    return pages


def pdf_text(files: DataFrame) -> DataFrame:
    """file, page_count, text, extraction_errors of files (file, content); pages are marked, a page that fails is an error.

    pypdf reads them where the executors have it. Elsewhere a plain reader does, which knows literal strings only.
    """

    def pages_of(content: bytes):
        import io

        try:
            from pypdf import PdfReader
        except ImportError:
            return [lambda t=t: t for t in _plain_pages(content)]
        return [p.extract_text for p in PdfReader(io.BytesIO(content)).pages]

    def run(batches):
        for batch in batches:
            pages, texts, errors = [], [], []
            for content in batch.column(1).to_pylist():
                found, wrong, readers = [], [], []
                try:
                    readers = pages_of(content)
                except Exception as exc:  # noqa: BLE001 - a broken file is a row's result
                    wrong.append(f"file: {type(exc).__name__}: {exc}")
                for k, read in enumerate(readers):
                    try:
                        found.append(f"\n\n[Page {k + 1}]\n{read() or ''}")
                    except Exception as exc:  # noqa: BLE001 - as above
                        wrong.append(f"page {k + 1}: {type(exc).__name__}: {exc}")
                pages.append(len(readers))
                texts.append("\n".join(found))
                errors.append(wrong)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.list_(pa.string()))], names=["file", "page_count", "text", "extraction_errors"])

    return files.select("file", "content").mapInArrow(run, "file string, page_count int, text string, extraction_errors array<string>")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """file, title, source, year, link of a CSV download log; of several rows for a file the last one counts. A log is a
    file that one task reads, as its rows may span lines."""
    rows = spark.read.csv(path, header=True, schema=METADATA, multiLine=True, enforceSchema=False, escape='"')
    # a log is one file, read in one piece because rows may span lines: its order is the row's number
    rows = rows.withColumn("__n", F.monotonically_increasing_id())
    last = rows.groupBy(F.col("Saved File").alias("file")).agg(F.max_by(F.struct("Title", "Source", "Year", "Link"), "__n").alias("x"))
    return last.select("file", *[F.col(f"x.{c}").alias(c.lower()) for c in ("Title", "Source", "Year", "Link")])


def with_metadata(files: DataFrame, log: DataFrame) -> DataFrame:
    """files (file) with report_id (the stem), report_title, source, year and original_link; empty where the log has none."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rows = files.join(log, "file", "left")
    none = {n: F.coalesce(c, F.lit("")) for n, c in (("source", "source"), ("year", "year"), ("original_link", "link"))}
    return rows.withColumns({"report_id": stem, "report_title": F.coalesce("title", stem), **none}).drop("title", "link")


def _by_lines(spark: SparkSession, path: str, shape: str, head: str, tail: str) -> DataFrame | None:
    """piece, id, x: the elements of one JSON array that stands with an element in each line between a line like head
    and one like tail, as writers.combined() writes it; read in pieces by many tasks. None if a line is anything else:
    then only a parser of the whole file knows where elements end."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"), F.rtrim("value").alias("value"))
    first, last = F.col("value").rlike(head), F.col("value").rlike(tail)
    body = F.regexp_replace("value", ",$", "")
    whole = F.col("value").startswith("{") & F.try_parse_json(body).isNotNull()
    at = F.struct("path", "piece", "id")
    told = rows.agg(
        F.count_if(~(first | last | whole | (F.col("value") == ""))).alias("other"), F.count_if(first).alias("heads"), F.count_if(last).alias("tails"), F.countDistinct("path").alias("files"),
        F.min_by(first, at).alias("begins"), F.max_by(last, at).alias("ends"),
    ).first()
    if told.other or (told.heads, told.tails, told.files, told.begins, told.ends) != (1, 1, 1, True, True):
        return None
    return rows.filter(~first & ~last & (F.col("value") != "")).select("path", "piece", "id", F.from_json(body, shape).alias("x"))


def reports_json(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """Reports of JSON files, each an object or an array of them, with the file's name; in arrays the last of an id counts.

    ordinal: a column that ascends in a file's order. An array with a report in each line is read by many tasks.
    """
    split = _by_lines(spark, path, REPORT, r"^\[$", r"^\]$")
    if split is not None:
        rows = split.select("x.*", F.element_at(F.split("path", "/"), -1).alias("file"), F.struct("piece", "id").alias("__n"))
    else:
        rows = spark.read.schema(REPORT).json(path, multiLine=True)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        rows = rows.select("*", name.alias("file"), F.struct(F.lit(0).cast("long").alias("piece"), F.monotonically_increasing_id().alias("id")).alias("__n"))
    return rows.withColumnRenamed("__n", ordinal) if ordinal else rows.drop("__n")


def last_by_id(reports: DataFrame, ordinal: str, key: str = "report_id") -> DataFrame:
    """One row for each id: that of the greatest ordinal."""
    columns = [c for c in reports.columns if c != key]
    return reports.groupBy(key).agg(F.max_by(F.struct(*columns), ordinal).alias("x")).select(key, "x.*")


def layouts_json(spark: SparkSession, path: str) -> DataFrame:
    """report_id (the file's stem), file, layout (JSON text) of layout files."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("layout"))
    return rows.withColumn("report_id", F.regexp_replace("file", r"\.[^.]*$", ""))


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a STIX bundle, with the fields that the knowledge base needs. A bundle with an object in each line is
    read by many tasks."""
    split = _by_lines(spark, path, kb_ops.OBJECT, r'^\{.*"objects"\s*:\s*\[$', r"^\]\s*\}$")
    if split is not None:
        return split.select("x.*")
    rows = spark.read.schema(kb_ops.BUNDLE).json(path, multiLine=True)
    return rows.select(F.explode("objects").alias("o")).select("o.*")


def knowledge_base(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A knowledge base in JSON lines; fails if there is none."""
    rows = spark.read.schema(schema).json(path)
    if rows.isEmpty():
        raise ValueError(f"empty knowledge base: {path}")
    return rows


def labelled(spark: SparkSession, path: str, pattern: str = "*.tsv") -> DataFrame:
    """file, row_id, text, labels of labelled sets under a folder. row_id counts a file's rows from 1, those without
    text or labels too, which are then left out. Each file is read by one task, as its rows may span lines."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path, sep="\t", header=True, schema="text1 string, labels string", multiLine=True, enforceSchema=False, escape='"')
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "text1", "labels", F.monotonically_increasing_id().alias("n"))
    # a file with rows over several lines is read in one piece, so its rows' ids ascend in file order
    rows = rows.withColumn("row_id", F.row_number().over(Window.partitionBy("file").orderBy("n")))
    rows = rows.select("file", "row_id", text.strip(text.text_of(F.col("text1"))).alias("text"), text.label_set(F.col("labels")).alias("labels"))
    return rows.filter((F.col("text") != "") & (F.size("labels") > 0))


def single_text(spark: SparkSession, said: str) -> DataFrame:
    """The same shape for one text given by hand; its origin keeps its row_id apart from a set's."""
    return spark.createDataFrame([("--text", 1, said, [])], "file string, row_id int, text string, labels array<string>")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, strings only, quotes doubled, whose first name may follow a byte order mark."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def inputs(spark: SparkSession, file: str | None = None, folder: str | None = None) -> DataFrame:
    """Reports of one file and of a folder's *.iocs.json files; fails if neither is given."""
    parts = [reports_json(spark, file)] if file else []
    if folder:
        parts.append(spark.read.schema(REPORT).option("pathGlobFilter", "*.iocs.json").json(folder, multiLine=True).withColumn("file", _name()))
    if not parts:
        raise ValueError("give a file or a folder")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def jsonl(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """path, line, value of JSON lines files, blank lines left out; the first `limit` of each file (0: all).

    Files are read in pieces by many tasks. A line's number is its place in its piece and the lines of the pieces before,
    whose counts, a row for each piece, are all that is gathered.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"), "value")
    pieces = rows.groupBy("path", "piece").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    rows = rows.join(pieces.select("path", "piece", "first", before.alias("before")), ["path", "piece"])
    rows = rows.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value").filter(text.strip(F.col("value")) != "")
    return first_rows(rows, limit, ["path"], ["line"]) if limit else rows


def first_rows(rows: DataFrame, limit: int, by: list[str], order: list[str], zero: str = "all") -> DataFrame:
    """The first `limit` rows of each group. zero: what a limit of 0 means, "all" rows (files of lines and rule corpora)
    or "none" (labelled sets)."""
    if not limit:
        return rows if zero == "all" else rows.limit(0)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).filter(F.col("__n") <= limit).drop("__n")


def completed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file, value: the files of a folder that an earlier run has written whole, that is, whose JSON parses."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(_name().alias("file"), "value")
    return rows.filter(F.try_parse_json("value").isNotNull())


def _name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def rule_texts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, yaml, ord: rule files, *.yml by path, then *.yaml."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.{yml,yaml}")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("yaml"))
    return rows.withColumn("ord", F.struct(F.col("path").endswith(".yaml"), "path"))


def rule_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, rule_json of a rule corpus; broken YAML has null."""
    return rule_texts(spark, path, recursive=True).select("path", yaml.to_json_text("yaml").alias("rule_json"))


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What an earlier run wrote at path; no rows if there is nothing yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def remaining(inputs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """inputs whose key an earlier run has not done."""
    return inputs.join(done.select(*key), key, "left_anti")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """report_id, type, normalized_value: the different indicators of a ground truth file."""
    shape = "reports map<string,struct<report_title:string,iocs:array<struct<type:string,normalized_value:string>>>>"
    rows = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("reports").alias("report_id", "r"))
    return rows.select("report_id", F.explode("r.iocs").alias("i")).select("report_id", "i.type", "i.normalized_value").distinct()


def predictions_for(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions of the reports that truth has; fails if one is missing."""
    ids = truth.select("report_id").distinct()
    if (gone := ids.join(predictions.select("report_id"), "report_id", "left_anti").first()) is not None:
        raise ValueError(f"no prediction for report {gone.report_id}")
    return predictions.join(ids, "report_id", "left_semi")
