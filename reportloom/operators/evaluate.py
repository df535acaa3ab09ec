"""Precision, recall and F1 of extraction against labels or a ground truth, and annotation sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text

# Labels a reviewer may give.
POSITIVE, IGNORED = "malicious", "uncertain"
NEGATIVES = ["benign", "placeholder", "false_positive"]
LABELS = [POSITIVE, *NEGATIVES, IGNORED]
ANNOTATION = "candidate_id report_id report_title type value normalized_value section context label reviewer_note".split()
MISSED = "report_id type normalized_value evidence reviewer_note".split()


def ratio(a: Column, b: Column) -> Column:
    """a / b to 4 places, half to even; null if b is 0."""
    return F.bround(F.when(b != 0, a / b), 4)


def scores(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1_score. F1 is of the rounded two."""
    rows = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1_score", F.bround(F.when(total != 0, 2 * F.col("precision") * F.col("recall") / total), 4))


def key(type_: Column, value: Column) -> Column:
    return text.normalized(type_, text.strip(value))


def compare(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """report_id, type, value, predicted, true: distinct indicators of either side (report_id, type, normalized_value)."""
    side = lambda d, name: d.select("report_id", "type", key(F.col("type"), F.col("normalized_value")).alias("value")).distinct().withColumn(name, F.lit(True))
    rows = side(predicted, "predicted").join(side(truth, "true"), ["report_id", "type", "value"], "full_outer")
    return rows.select("report_id", "type", "value", F.coalesce("predicted", F.lit(False)).alias("predicted"), F.coalesce("true", F.lit(False)).alias("true"))


def counts(compared: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn by the columns given; with none, one row."""
    said, right = F.col("predicted"), F.col("true")
    return compared.groupBy(*by).agg(F.count_if(said & right).alias("tp"), F.count_if(said & ~right).alias("fp"), F.count_if(~said & right).alias("fn"))


def checked_labels(annotations: DataFrame) -> DataFrame:
    """annotations with stripped labels; fails on a label that isn't known."""
    label = text.strip(text.text_of(F.col("label")))
    known = (label == "") | label.isin(LABELS)
    return annotations.withColumn("label", F.when(known, label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("string")))


def clean_missed(missed: DataFrame) -> DataFrame:
    """Rows with report, type and value."""
    full = F.lit(True)
    for c in ("report_id", "type", "normalized_value"):
        full = full & (text.strip(text.text_of(F.col(c))) != "")
    return missed.filter(full)


def review_status(annotations: DataFrame, missed: DataFrame) -> DataFrame:
    """One row of counts."""
    label = F.col("label")
    rows = checked_labels(annotations).select("label", F.lit(False).alias("gone"))
    rows = rows.unionByName(clean_missed(missed).select(F.lit("").alias("label"), F.lit(True).alias("gone")))
    own = ~F.col("gone")
    return rows.agg(
        F.count_if(own).alias("candidate_count"),
        F.count_if(own & (label != "")).alias("reviewed_count"),
        F.count_if(own & (label == "")).alias("unreviewed_count"),
        F.count_if(own & (label == IGNORED)).alias("uncertain_count"),
        F.count_if(own & (label != "") & (label != IGNORED)).alias("scored_candidate_count"),
        F.count_if("gone").alias("missed_ioc_count"),
    ).withColumn("complete", F.col("unreviewed_count") == 0)


def annotated(annotations: DataFrame, missed: DataFrame) -> DataFrame:
    """type, tp, fp, fn and scores for each type, and for all (type null), in one grouping."""
    label = F.col("label")
    rows = checked_labels(annotations).select("type", (label == POSITIVE).cast("long").alias("tp"), label.isin(NEGATIVES).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    rows = rows.filter("tp + fp > 0").unionByName(clean_missed(missed).select("type", *[F.lit(v).cast("long").alias(n) for n, v in (("tp", 0), ("fp", 0), ("fn", 1))]))
    sums = rows.rollup("type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return scores(sums)


def label_counts(annotations: DataFrame) -> DataFrame:
    return checked_labels(annotations).filter("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def ground_truth(annotations: DataFrame, missed: DataFrame) -> DataFrame:
    """report_id, report_title, iocs: what was found right, then what was missed."""
    fields = ["type", "normalized_value", "evidence", "source", "reviewer_note"]
    right = checked_labels(annotations).filter(F.col("label") == POSITIVE)
    right = right.select("report_id", F.lit(0).alias("phase"), F.col("candidate_id").alias("place"), "report_title", "type", "normalized_value", F.col("context").alias("evidence"), F.lit("reviewed_candidate").alias("source"), "reviewer_note")
    gone = clean_missed(missed)
    gone = gone.select("report_id", F.lit(1).alias("phase"), F.concat_ws("\u0000", "type", "normalized_value").alias("place"), F.lit("").alias("report_title"), "type", "normalized_value", "evidence", F.lit("manually_added_missed_ioc").alias("source"), "reviewer_note")
    rows = right.unionByName(gone).groupBy("report_id").agg(F.max("report_title").alias("report_title"), F.array_sort(F.collect_list(F.struct("phase", "place", *fields))).alias("x"))
    return rows.select("report_id", "report_title", F.transform("x", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("iocs"))


def annotation_sheet(reports: DataFrame, iocs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """ANNOTATION columns: a numbered row for each indicator of the wanted reports, for a reviewer to label.

    Fails if a wanted report isn't among reports (report_id, report_title).
    """
    if wanted is not None:
        known = {r.report_id for r in reports.filter(F.col("report_id").isin(wanted)).select("report_id").collect()}  # bounded by wanted
        if missing := [w for w in wanted if w not in known]:
            raise ValueError(f"unknown report ids: {missing}")
        iocs = iocs.filter(F.col("report_id").isin(wanted))
    n = F.row_number().over(Window.partitionBy("report_id").orderBy("type", "normalized_value"))
    rows = iocs.withColumn("n", n).join(reports.select("report_id", "report_title"), "report_id", "left")
    rows = rows.withColumns({"candidate_id": text.candidate_id(F.col("report_id"), F.col("n")), "label": F.lit(""), "reviewer_note": F.lit("")})
    return rows.select(*ANNOTATION)
