"""Host-level quality rules: failures by host, shrunk rates, verdicts joined back to the documents.

1. Every document is measured once (word, symbol, line and repetition counts) and checked against the rules.
2. Failures are summed by host. Host rates are shrunk by a beta prior with the corpus's rate as its mean. Its strength
   comes from how much more hosts differ than chance alone would make them (moments, hosts weighted by their
   documents; at most MOST_STRENGTH documents), so small hosts, and hosts of an even corpus, lean on the corpus.
3. A host is trusted if its shrunk rate is below TRUST of the corpus's, distrusted above the inverse. It decides on
   borderline documents, those that fail one rule but not the base rule: a trusted host's stay, a distrusted host's
   go, and any other's stay if the failure is mild (the measure is within half as much again of its limit).
   Documents that fail nothing stay and those that fail more go, whatever their host.

Edge cases: a null or empty text has no words, fails the base rule and is rejected. A null host is a host
of its own. Repeated rows are separate documents. An empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reportloom.llm.runtime import as_bytes, cleared, materialize

WINDOW = 5
# A host whose shrunk rate is below this share of the corpus's is trusted.
TRUST = 0.98
# The prior counts as much as this many documents at most, and as one at least.
MOST_STRENGTH = 1000.0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window found twice or more, the first one included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = np.zeros(n - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - WINDOW + 1 + k]
            mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]
    seen = Counter(windows)
    cover = np.zeros(n + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if seen[w] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure_text(text: bytes | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # on bytes this splits at \x20 and \x09-\x0D only
    chars = len(text.decode("utf-8", "surrogatepass")) - sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = text.split(b"\n")
    again = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                again += bool(line.strip(b" \t\n\v\f\r"))
            else:
                seen.add(line)
    return len(words), chars, symbols, again, repeated_words(words)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS added, in one narrow pass."""
    schema = docs.schema
    names = schema.names
    at = names.index(text)

    def run(batches):
        for batch in batches:
            counts = np.array([measure_text(t) for t in as_bytes(batch.column(at))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], names=[*names, *COUNTS])

    return docs.mapInArrow(run, StructType([*schema.fields, *(StructField(c, LongType()) for c in COUNTS)]))


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def failures() -> Column:
    """How many rules a document fails. Integer arithmetic only, so that every engine agrees."""
    rules = [
        base_failed(),
        10 * F.col("n_symbols") > F.col("n_words"),
        10 * F.col("n_symbols") > 5 * F.col("n_words"),
        F.col("word_chars") > 15 * F.col("n_words"),
        F.col("word_chars") < 2 * F.col("n_words"),
        20 * F.col("n_dup_lines") > F.col("n_words"),
    ]
    return sum((r.cast("long") for r in rules[1:]), rules[0].cast("long"))


def mild() -> Column:
    """Is every failed rule's measure within half as much again of its limit?"""
    return (
        (20 * F.col("n_symbols") <= 3 * F.col("n_words"))
        & (2 * F.col("word_chars") <= 45 * F.col("n_words"))
        & (3 * F.col("word_chars") >= 4 * F.col("n_words"))
        & (40 * F.col("n_dup_lines") <= 3 * F.col("n_words"))
    )


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """__host, host_rate (the failure rate shrunk towards the corpus's by a beta prior) and host_trust (1, 0 or -1). A row
    for each host."""
    hosts = measured.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_failures") > 0).alias("failed"))
    hosts = materialize(hosts, "hosts")
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    all_, bad, squares, spread, count = hosts.agg(F.sum(n), F.sum(failed), F.sum(n * n), F.sum(failed * failed / n), F.count(F.lit(1))).first()
    mean, strength = (bad / all_, MOST_STRENGTH) if count else (0.0, MOST_STRENGTH)
    chance = mean * (1 - mean)
    if count and count > 1 and chance > 0:
        # of the hosts' spread around the mean, what chance alone would not make, as a share
        extra = (spread - all_ * mean * mean) / chance - (count - 1)
        share = extra / (all_ - squares / all_ - (count - 1)) if all_ - squares / all_ > count - 1 else 0.0
        strength = min(max(1 / share - 1, 1.0), MOST_STRENGTH) if share > 0 else MOST_STRENGTH
    rate = (F.lit(mean * strength) + failed) / (F.lit(strength) + n)
    trust = F.when(rate < mean * TRUST, 1).when(rate * TRUST > mean, -1).otherwise(0)
    return hosts.select("__host", rate.alias("host_rate"), trust.alias("host_trust"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with COUNTS, base_failed, n_failures, host_rate, host_trust and kept added.

    Input columns with the names of added ones are replaced. With keep_text the texts stay and are measured
    twice, once for the hosts and once for the verdicts, rather than written in between.
    """
    docs = cleared(docs, [*COUNTS, "base_failed", "n_failures", "host_rate", "host_trust", "kept", "__host"], keep=[host, text])
    measured = measure(docs, text).withColumns({"base_failed": base_failed(), "n_failures": failures()})
    if not keep_text:
        measured = materialize(measured.drop(text), "rules")
    rates = host_rates(measured, host)
    joined = measured.join(rates, measured[host].eqNullSafe(rates["__host"]), "left").drop("__host")
    borderline = (F.col("n_failures") == 1) & ((F.col("host_trust") > 0) | ((F.col("host_trust") == 0) & mild()))
    return joined.withColumn("kept", ~F.col("base_failed") & ((F.col("n_failures") == 0) | borderline))
