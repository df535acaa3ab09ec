"""Document fingerprints by order MinHash, with an edited neighbour for comparison.

A text's k-mers of code points are numbered by occurrence, so that repeats differ. Each of SLOTS slots selects
the PICK numbered k-mers with the least hashes, puts them back into text order and hashes the tuple. Moving
passages around changes tuples although the set of k-mers stays, so equal slots follow the edit distance.

A long text's numbered k-mers are dealt out to slots by the leading bits of one hash, each slot selecting among
its own; a slot that gets fewer than PICK that way selects among all of them by a hash of its own.

Neighbours: documents are ordered by doc_id (null first), then by text, and cut into ranges of about as many bytes
at approximate quantiles. Each range gets the first document of the next one besides, so no range waits for another
and the texts are shuffled once, each range to a partition of its own. The last document's neighbour is the first.

Edge cases: a null or empty text has no k-mers and a fingerprint of zeros. A text shorter than K is one k-mer.
Equal texts have equal fingerprints. Repeated rows are documents of their own and neighbours of each other; all rows
with the same doc_id are in one range, as doc_id is meant to be a key. An empty table gives an empty result; a single
document is its own neighbour.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.runtime import as_bytes, partitions_for

K = 8
SLOTS = 64
PICK = 2
# Small ranges whose bytes are summed before as many are put together as make a partition.
FINE = 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SALTS = np.random.default_rng(11).integers(0, 1 << 63, SLOTS).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _B
        x = (x ^ (x >> np.uint64(29))) * _A
        return x ^ (x >> np.uint64(32))


def _kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k code points from each position; k is a power of two. Shorter texts: one of all they have."""
    with np.errstate(over="ignore"):
        h = _mix(points.astype(np.uint64) + np.uint64(1))
        if len(h) < k:
            whole = np.uint64(len(h))
            for x in h:
                whole = whole * _A + x
            return _mix(np.array([whole], np.uint64))
        width = 1
        while width < k:
            h = h[: len(h) - width] * _A + _mix(h[width:] + np.uint64(width))
            width *= 2
    return _mix(h)


def _numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many times it came before)."""
    bits = np.uint64(max(20, int(len(h)).bit_length()))
    key = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    value = key >> bits
    at = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = value[1:] != value[:-1]
    before = at - np.maximum.accumulate(np.where(new, at, 0))
    if not before.any():
        return _mix(h)
    count = np.empty(len(h), np.uint64)
    count[place] = before.astype(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(h + count * _B)


def _tuples(items: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the items at places (a row for each slot) in text order."""
    places = np.sort(places, axis=1)
    out = np.zeros(len(places), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(places.shape[1]):
            out = _mix(out * _A + items[places[:, k]])
    return out


def sketch(text: str) -> np.ndarray:
    """SLOTS hashes of 16 bits."""
    out = np.zeros(SLOTS, np.uint64)
    if not text:
        return out.astype(np.uint16)
    items = _numbered(_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), K))
    n = len(items)
    pick = min(PICK, n)
    bits = np.uint64(max(20, n.bit_length()))
    key = np.sort((items >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.searchsorted(key, np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - (SLOTS - 1).bit_length()))
    enough = np.diff(np.append(first, n)) >= PICK
    if enough.any():
        out[enough] = _tuples(items, place[first[enough][:, None] + np.arange(PICK)])
    for s in np.flatnonzero(~enough):
        own = _mix(items ^ _SALTS[s])
        out[s] = _tuples(items, np.argpartition(own, pick - 1)[None, :pick] if n > pick else np.arange(n)[None, :])[0]
    return (_mix(out + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """About the share of text that is common and in the same order, 0 to 1. Two texts without k-mers are alike.

    If a share s of two equally long texts is common, s / (2 - s) of their k-mers is, and a slot is equal when all
    PICK k-mers it selects are among them.
    """
    common = float(np.mean(a == b)) ** (1 / PICK)
    return 2 * common / (1 + common)


def edited(text: str, following: str) -> str:
    """The last quarter of text's code points replaced by as many from the start of following."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: fingerprints of its text and its edited text, and how alike they are."""
    least = -(1 << 63)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(least))
    n = partitions_for(rows, "text")
    cuts = rows.agg(F.percentile_approx(key, [k / (FINE * n) for k in range(1, FINE * n)], max(10_000, 4 * FINE * n))).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def place_in(cuts: np.ndarray):
        @F.pandas_udf("int")
        def place(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

        return place

    rows = rows.withColumn("key", key)
    # a row for each small range: at most FINE times as many as there are partitions
    fine = rows.select("key", F.octet_length("text").alias("size")).withColumn("fine", place_in(cuts)("key")).groupBy("fine").agg(F.min("key").alias("first"), F.sum("size").alias("bytes"))
    fine = sorted(tuple(r) for r in fine.collect())
    if not fine:
        return docs.sparkSession.createDataFrame([], _OUT)
    # a partition begins where the bytes before it pass the next n-th of all
    before = np.cumsum([0] + [b for *_, b in fine[:-1]])
    step = max(1.0, (before[-1] + fine[-1][2]) / n)
    heads = [k for k in range(len(fine)) if k == 0 or before[k] // step > before[k - 1] // step]
    starts = [fine[k][1] for k in heads]
    range_of = place_in(np.array(starts[1:], np.int64))
    heads = docs.sparkSession.createDataFrame([(part, starts[(part + 1) % len(starts)]) for part in range(len(starts))], "part int, first long")
    own = rows.withColumn("part", range_of("key")).withColumn("head", F.lit(0))
    # bounded by the number of partitions
    other = rows.join(F.broadcast(heads), F.col("key") == F.col("first")).select("doc_id", "text", "key", "part", F.lit(1).alias("head"))
    dealt = own.unionByName(other).repartitionById(len(starts), F.col("part")).sortWithinPartitions("part", "head", "key", "text")

    def run(batches):
        names = [c.split()[0] for c in _OUT.split(", ")]
        part_now = done = held = None  # held: id, text and sketch of the document that waits for its neighbour
        for batch in batches:
            out = []
            for ident, raw, part, head in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if part != part_now:
                    part_now, held, done = part, None, False
                if done:
                    continue
                now = raw.decode("utf-8", "surrogatepass")
                s = sketch(now)
                if held:
                    ident_0, text_0, s_0 = held
                    changed = edited(text_0, now)
                    s_1 = sketch(changed)
                    out.append((ident_0, len(text_0), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), _hex(s_0), _hex(s_1), likeness(s_0, s_1), likeness(s_0, s)))
                held, done = (ident, now, s), bool(head)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return dealt.mapInArrow(run, _OUT)
