"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of ROLL lines (60 bits of md5 each) decides after which line a chunk ends, so an
insertion moves only the boundaries around it. Chunks of two lines or more, with a word on any of them, are counted over the whole
corpus by a 128-bit hash; all occurrences but the first (by doc_id, then line) are removed, once the bytes of all
chunks with that hash have been compared and found equal. Chunks whose hash stands for different bytes stay. A
blank line is a line, so a paragraph and the blank line beside it are a chunk.

The count has partial sums, so a chunk in a third of all documents is one row from each task. Only hashes
travel for it. The bytes compared are the least and the greatest text of a hash, again with partial results.

Edge cases: a null text stays null and has no lines; an empty text is one empty line and has no chunk. Repeated
rows (same doc_id and text) are one document and get the same result. A null doc_id counts as the smallest.
An empty table gives an empty result. Input columns with the names of added ones are replaced, others stay.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from reportloom.llm.runtime import as_bytes, cleared, materialize

ROLL = 2
# A boundary falls on one in DIVISOR rolling hashes; a chunk has LEAST lines at least, but for a text's last.
DIVISOR = 2
LEAST = 2
# Repeated chunks, counted first, that are sent to every task; more are joined by shuffling.
MOST_BROADCAST = 100_000
_FACTOR = 1_000_003
_PRIME = (1 << 31) - 1


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of the chunks of a UTF-8 text, in order; together they are the text."""
    lines = text.split(b"\n")
    out, start, rolled = [], 0, []
    for i, line in enumerate(lines):
        rolled = [*rolled[len(rolled) + 1 - ROLL :], int.from_bytes(md5(line).digest()[:8]) >> 4]
        mixed = 0
        for h in rolled:
            mixed = (mixed * _FACTOR + h) % _PRIME
        if i + 1 - start >= LEAST and mixed % DIVISOR == 0 or i + 1 == len(lines):
            out.append((start, i + 1 - start, b"\n".join(lines[start : i + 1])))
            start = i + 1
    return out


def eligible(chunk: bytes) -> bool:
    """Has it a word?"""
    return bool(chunk.strip(b" \t\n\v\f\r"))


def _chunk_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows, start, count, digests = [], [], [], []
            for k, text in enumerate(as_bytes(batch.column(2))):
                if text and b"\n" in text:
                    for s, n, chunk in chunks(text):
                        if n > 1 and eligible(chunk):
                            rows.append(k)
                            start.append(s)
                            count.append(n)
                            digests.append(xxh3_128_digest(chunk))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                names=["__id", "__mark", "start", "lines", "h1", "h2"],
            )

    return docs.mapInArrow(run, "__id long, __mark long, start int, lines int, h1 long, h2 long")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with repeated chunks taken out of text, and n_lines and n_removed (lines) added."""
    docs = cleared(docs, ["n_lines", "n_removed", "__id", "__mark", "__cut"], keep=[text, doc_id])
    mark = F.xxhash64(F.col(text))
    found = materialize(_chunk_rows(docs.select(F.col(doc_id).cast("long").alias("__id"), mark.alias("__mark"), text)), "chunks")
    place = F.struct("__id", "__mark", "start")
    often = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    # written before it is joined: its size is known, and the places of one very common chunk can be split over tasks
    often = materialize(often.filter("n > 1 and first < last").select("h1", "h2", "first"), "often")
    if often.count() <= MOST_BROADCAST:
        often = F.broadcast(often)
    again = materialize(found.join(often, ["h1", "h2"]).select("__id", "__mark", "start", "lines", "h1", "h2", (place == F.col("first")).alias("stays")).distinct(), "again")

    def listed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("__id", "__mark").agg(F.array_sort(F.collect_list(F.struct("start", "lines", "h1", "h2"))).alias("__cut"))

    def with_cuts(rows: DataFrame, how: str) -> DataFrame:
        cuts = listed(rows)
        return docs.join(cuts, docs[doc_id].cast("long").eqNullSafe(cuts["__id"]) & (mark == cuts["__mark"]), how)

    chunk = F.array_join(F.slice(F.split(F.col(text), "\n", -1), F.col("c.start") + 1, F.col("c.lines")), "\n")
    texts = with_cuts(again, "inner").select(text, F.explode("__cut").alias("c")).select("c.h1", "c.h2", chunk.alias("chunk"))
    differ = materialize(texts.groupBy("h1", "h2").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a <> b").select("h1", "h2"), "differ")
    goes = again.filter("not stays").join(differ, ["h1", "h2"], "left_anti")
    joined = with_cuts(goes, "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.exists("__cut", lambda c: (i >= c["start"]) & (i < c["start"] + c["lines"]))), "\n")
    removed = F.coalesce(F.aggregate("__cut", F.lit(0).cast("long"), lambda a, c: a + c["lines"]), F.lit(0).cast("long"))
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out[text] = F.when(F.col("__cut").isNull(), F.col(text)).otherwise(kept)
    return joined.select(*[v.alias(k) for k, v in out.items()], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_removed"))
