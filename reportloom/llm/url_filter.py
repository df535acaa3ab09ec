"""URL filters: a list of rules, and gradient-boosted trees on lexical features for what no rule covers.

Host and path are cut out of the url, the longest rule that fits gives the verdict. URLs that a rule judges are
the labelled ones: the trees learn allow and block from them, on length, depth, digit ratio, entropy, numbers of
parameters and statistics of the host's suffix and the path's first part, and judge all others. Such a
statistic is the shrunk share of blocked URLs among the labelled ones with the same last two labels of the host,
or the same first part of the path; one that was not labelled has the overall share. URLs fall into FOLDS folds by
hash; a labelled one's shares are those of the other folds, so that no url's own label is among its features. The
first fold is left out of the trees: the threshold for block is the least score of a half or more from which at least
PRECISION of that fold are blocked ones, so that the trees leave a url alone when in doubt.

What the trees learn from is bounded: MOST_LABELLED urls, taken evenly by a hash of the url. Everything else covers
all rows; features, rules and trees are column expressions. The shares of all suffixes and first parts are tables,
broadcast up to MOST_BROADCAST keys; beyond that they are joined by shuffling, but for the MOST_SHARES most frequent
keys, which are kept in the plan, so that rows of a frequent key do not meet in one task.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by the
trees from features that are all zero. Repeated rows are judged alike. Without labelled urls of both kinds all
verdicts of the trees are allow. An empty table gives an empty result.
Input columns with the names of added ones are replaced, others stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm import boosting
from reportloom.llm.runtime import cleared, materialize

# verdict, rule
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
MOST_LABELLED = 50_000
MOST_SHARES = 500
MOST_BROADCAST = 500_000
PRECISION = 0.9
FOLDS = 4
# Features of a url, the two shares included.
COUNT = 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def entropy(s: Column) -> Column:
    """Bits for each character of s, over its characters."""
    letters = F.split(s, "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.greatest(F.size(letters), F.lit(1)))
    return F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def features(url: Column, host: Column, path: Column, shares: list[Column]) -> list[Column]:
    """Lexical features in thousandths, as whole numbers."""
    u = F.coalesce(url, F.lit(""))
    some = F.greatest(F.length(u), F.lit(1))
    labels = F.split(host, "\\.")
    last = F.element_at(F.split(path, "/"), -1)
    out = [
        F.length(u),
        F.length(host),
        F.length(path),
        F.regexp_count(path, F.lit("/[^/]")),
        F.size(labels),
        F.regexp_count(u, F.lit("[0-9]")) / some,
        F.regexp_count(host, F.lit("[0-9-]")),
        F.regexp_count(u, F.lit("[?&][^=&?#]+=")),
        F.regexp_count(u, F.lit("#")),
        F.length(last),
        F.when(path.rlike("\\.[a-z]{2,5}$"), 1).otherwise(0),
        F.when(path.endswith("/"), 1).otherwise(0),
        F.when(u.startswith("https"), 1).otherwise(0),
        entropy(host),
        entropy(path),
        F.length(F.element_at(labels, -1)),
        *shares,
    ]
    return [F.floor(c * 1000).cast("int") for c in out]


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def head_of(path: Column) -> Column:
    return F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(4), url), F.lit(FOLDS)).cast("int")


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and block_score (of the trees) added."""
    pages = cleared(pages, ["host", "path", "rule", "verdict", "block_score", "__found", "__f", "__suffix", "__head", "__fold"], keep=[url])
    rows = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rows = rows.withColumn("__found", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.filter("__found is not null").select(url, "host", "path", (F.col("__found.verdict") == "block").alias("blocked"), fold_of(F.col(url)).alias("__fold"))
    yes, no = labelled.agg(F.count_if("blocked"), F.count_if(~F.col("blocked"))).first()
    overall = (yes + 1) / (yes + no + 2)
    for name, key in (("__suffix", suffix_of(F.col("host"))), ("__head", head_of(F.col("path")))):
        known = materialize(_shares(labelled, key, overall), "shares")
        labelled = _with_share(labelled, name, key, url, known, overall, F.col("__fold"))
        rows = _with_share(rows, name, key, url, known, overall, F.lit(FOLDS))
    made = F.array(*features(F.col(url), F.col("host"), F.col("path"), [F.col("__suffix"), F.col("__head")]))
    model, least = _fit(labelled, url, made, yes + no)
    rows = rows.withColumn("__f", made)
    rows = rows.withColumn("block_score", boosting.as_column(model, [F.col("__f")[k] for k in range(COUNT)]))
    verdict = F.coalesce(F.col("__found.verdict"), F.when(F.col("block_score") >= least, "block").otherwise("allow"))
    return rows.withColumns({"rule": F.col("__found.rule"), "verdict": verdict}).drop("__found", "__f", "__suffix", "__head")


def _shares(labelled: DataFrame, key: Column, overall: float) -> DataFrame:
    """(__key, __n, __share): for every key the shrunk shares of blocked urls among those labelled, without each fold in
    turn, and at last of all folds."""
    here = [F.col("__fold") == k for k in range(FOLDS)]
    counts = [F.count_if(F.col("blocked") & h).alias(f"yes{k}") for k, h in enumerate(here)] + [F.count_if(h).alias(f"n{k}") for k, h in enumerate(here)]
    counts = labelled.groupBy(key.alias("__key")).agg(*counts, F.count_if("blocked").alias("yes"), F.count(F.lit(1)).alias("__n"))
    left = [(F.col("yes") - F.col(f"yes{k}") + 10 * overall) / (F.col("__n") - F.col(f"n{k}") + 10) for k in range(FOLDS)]
    return counts.select("__key", "__n", F.array(*left, (F.col("yes") + 10 * overall) / (F.col("__n") + 10)).alias("__share"))


def _with_share(rows: DataFrame, name: str, key: Column, url: str, known: DataFrame, overall: float, which: Column) -> DataFrame:
    """rows with the share of their key that `which` picks, the overall one where it was not labelled."""
    table = known.select("__key", "__share")
    rows = rows.withColumn("__key", key)
    if known.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), "__key", "left").withColumn(name, F.coalesce(F.get("__share", which), F.lit(overall))).drop("__key", "__share")
    top = known.orderBy(F.col("__n").desc(), "__key").limit(MOST_SHARES).collect()
    often = F.try_element_at(F.create_map(*[x for r in top for x in (F.lit(r["__key"]), F.array(*map(F.lit, r["__share"])))]), F.col("__key"))
    rows = rows.withColumn(name, F.get(often, which))
    # rows that have their share are spread over keys that no table has
    spread = F.concat(F.lit("\0/"), F.pmod(F.xxhash64(url), F.lit(4096)).cast("string"))
    rows = rows.withColumn("__key", F.when(F.col(name).isNull(), F.col("__key")).otherwise(spread))
    return rows.join(table, "__key", "left").withColumn(name, F.coalesce(name, F.get("__share", which), F.lit(overall))).drop("__key", "__share")


def _fit(labelled: DataFrame, url: str, made: Column, n: int) -> tuple[tuple[float, list], float]:
    if n > MOST_LABELLED:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit(3), url), F.lit(1_000_000)) < int(1_000_000 * MOST_LABELLED / n))
    table = labelled.select(made.alias("f"), F.col("blocked").cast("int").alias("blocked"), "__fold").toArrow()  # bounded by MOST_LABELLED
    if len(table.column("blocked").unique()) < 2:
        return (0.0, []), 2.0
    f = table.column("f").combine_chunks().flatten().to_numpy().reshape(-1, COUNT)
    x = np.column_stack([f, table.column("blocked").to_numpy(), table.column("__fold").to_numpy()]).astype(np.int64)
    x = x[np.lexsort(x.T[::-1])]
    if not (x[:, -1] > 0).any():
        return (0.0, []), 2.0
    left_out, blocked = x[:, -1] == 0, x[:, -2].astype(np.float64)
    model = boosting.fit(x[~left_out, :-2], blocked[~left_out], 1 - blocked[~left_out], trees=30, depth=3, least=5.0)
    score = boosting.predict(model, x[left_out, :-2])
    order = np.argsort(-score)
    ordered = score[order]
    right = np.cumsum(blocked[left_out][order]) / np.arange(1, len(order) + 1)
    # a cut only between different scores
    ends = np.append(ordered[1:] < ordered[:-1], True) & (right >= PRECISION) if len(order) else np.empty(0, bool)
    return model, max(0.5, float(ordered[ends].min()) - 1e-9) if ends.any() else 2.0
