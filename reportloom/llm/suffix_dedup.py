"""Suffix-array dedup: bytes of strings of LENGTH bytes that start earlier in the corpus are removed.

Every window of LENGTH bytes has a minimizer, the leftmost least hash of its GRAM-byte strings. Windows that
share their minimizer are consecutive; the bytes under them are that anchor's segment. Equal windows have equal
anchors at equal offsets, so only segments with the same anchor hash have to be compared:

1. `_anchors`: one pass over the texts finds anchors. Within a task, all but the first of equal segments are
   marked at once, so that a passage in a third of all documents leaves one row in each task. The rest is packed
   (some 24 bytes for each anchor) and dealt out by anchor hash.
2. `_meet`: in each partition, equal segments are marked but for the first. Anchors that are left with several
   different segments ask for their bytes, one request for each different segment.
3. `_expand`: the requested segments of an anchor come together. Their suffixes are sorted, and on the
   Burrows-Wheeler transform intervals are extended backwards, breadth first, one byte in each round: round k
   yields exactly the boundaries where k bytes are the common prefix, in increasing order, and stops at LENGTH. What is not a
   boundary by then is a group of equal windows, of which all but the first are marked.
   An anchor with more than BLOCK bytes of segments isn't gathered. Its windows are split by a further minimizer,
   of another hash, of which equal windows again have the same; equal pieces are marked but for the first, and the
   others expanded as above. What is too large after LEVELS such splits is dealt out by the windows' own hashes, with
   the least place kept by partial aggregates.
4. `remove`: each document's marked windows are merged into spans.

Segments are compared by 64 bits of hash besides the 64 of the anchor; all others byte by byte.

Edge cases: a null text counts as empty. Texts shorter than LENGTH lose nothing. Documents are ordered by
doc_id, null first, then by a hash of the text; repeated rows (same doc_id and text) are one document and get
the same result. An empty table gives an empty result. Input columns with the names of added ones are
replaced, others stay.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from xxhash import xxh3_64_intdigest

from reportloom.llm.runtime import cleared, flat, materialize, partitions_for, ranges

LENGTH = 100
GRAM = 32
# Most bytes of segments of one anchor that are sorted together.
BLOCK = 4 << 20
LEVELS = 4

_A = np.uint64(0x9E3779B97F4A7C15)
# hash, hash of the segment, place: id and mark of the document, first window and number of windows
_ANCHOR = np.dtype([("anchor", "<u8"), ("segment", "<u8"), ("id", "<i8"), ("mark", "<i8"), ("start", "<i4"), ("windows", "<i4")])


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each position, by doubling; gram is a power of two."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * _A
        width = 1
        while width < gram:
            h = (h[: len(h) - width] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[width:] + np.uint64(width))
            h ^= h >> np.uint64(32)
            h *= _A
            width *= 2
    return h


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of width entries from each position."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors_of(data: np.ndarray, length: int, gram: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchor hashes, the first window and the number of windows of each. level: which order of hashes."""
    h = _gram_hashes(data, gram)
    if level:
        with np.errstate(over="ignore"):
            h = (h ^ (np.uint64(level) * _A)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * _A
    at = np.arange(len(h), dtype=np.uint64)
    # the leftmost of equal ones is least: 40 bits of hash, then 24 of place within blocks that overlap
    step = (1 << 24) - length
    places = []
    for k in range(0, len(data) - length + 1, step):
        part = h[k : k + step + length - gram]
        key = (part >> np.uint64(24) << np.uint64(24)) | at[: len(part)]
        places.append((_window_least(key, length - gram + 1)[:step] & np.uint64((1 << 24) - 1)).astype(np.int64) + k)
    place = np.concatenate(places)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    return h[place[first]], first, np.diff(np.append(first, len(place)))


def _first_of(table: np.ndarray, *names: str) -> np.ndarray:
    """Sorts table by names and place; True where another combination of names begins."""
    table[:] = table[np.lexsort([table[n] for n in ("start", "mark", "id", *names[::-1])])]
    new = np.ones(len(table), bool)
    if len(table) > 1:
        new[1:] = np.any([table[n][1:] != table[n][:-1] for n in names], axis=0)
    return new


def _same_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["id"] == b["id"]) & (a["mark"] == b["mark"]) & (a["start"] == b["start"])


def _settle(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of equal segments, the others). table: _ANCHOR rows. A row that is there twice counts once."""
    if not len(table):
        return table, table
    new = _first_of(table, "anchor", "segment")
    twice = np.zeros(len(table), bool)
    twice[1:] = ~new[1:] & _same_place(table[1:], table[:-1])
    return table[new], table[~new & ~twice]


def _pack(kind: str, keys: np.ndarray, table: np.ndarray) -> list[tuple[str, int, bytes]]:
    """(kind, key, rows of table with it)"""
    order = np.argsort(keys, kind="stable")
    keys, table = keys[order], table[order]
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    return [(kind, int(keys[s]), _dump(table[s:e])) for s, e in zip(cuts, cuts[1:], strict=False)]


def _dump(table: np.ndarray) -> bytes:
    """_ANCHOR rows column by column, each as differences from its least value in as few bytes as they need."""
    out = [struct.pack("<q", len(table))]
    for name in table.dtype.names:
        v = table[name].astype(np.int64, copy=True) if table.dtype[name] != np.uint64 else table[name].copy()
        v = v.view(np.uint64)
        least = v.min()
        v = v - least
        width = next(w for w in (0, 1, 2, 4, 8) if w == 8 or int(v.max()) < 1 << 8 * w)
        out.append(struct.pack("<bQ", width, int(least)) + (v.astype(f"<u{width}").tobytes() if width else b""))
    return b"".join(out)


def _load(data: bytes) -> np.ndarray:
    table = np.empty(struct.unpack_from("<q", data)[0], _ANCHOR)
    at = 8
    for name in _ANCHOR.names:
        width, least = struct.unpack_from("<bQ", data, at)
        at += 9
        v = np.full(len(table), least, np.uint64)
        if width:
            with np.errstate(over="ignore"):
                v += np.frombuffer(data, f"<u{width}", len(table), at)
        at += width * len(table)
        table[name] = v if _ANCHOR[name] == np.uint64 else v.view(np.int64)
    return table


def _packed_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kind, key, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.int64()), pa.array(data, pa.binary())], names=["kind", "key", "data"])


_PACKED = "kind string, key long, data binary"


def _anchors(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """kind 'anchor': packed _ANCHOR rows by bucket. kind 'mark': rows whose windows are all marked, dealt out evenly."""

    def run(batches):
        held, size = [], 0

        def out():
            first, others = _settle(np.concatenate(held) if held else np.empty(0, _ANCHOR))
            rows = _pack("anchor", (first["anchor"] % np.uint64(buckets)).astype(np.int64), first)
            spread = (np.arange(len(others)) // 4096 + (int(others["start"][0]) if len(others) else 0)) % buckets
            return _packed_batch(rows + _pack("mark", spread, others))

        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = flat(batch.column(2))
            for k, (s, e) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                if e - s < length:
                    continue
                hashes, first, windows = anchors_of(data[s:e], length, gram)
                view = memoryview(data[s:e])
                t = np.empty(len(first), _ANCHOR)
                t["anchor"], t["id"], t["mark"], t["start"], t["windows"] = hashes, ids[k], marks[k], first, windows
                t["segment"] = [xxh3_64_intdigest(view[a : a + n + length - 1]) for a, n in zip(first.tolist(), windows.tolist(), strict=True)]
                held.append(t)
                size += len(t)
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, _PACKED)


def _meet(dealt: DataFrame) -> DataFrame:
    """Rows (id, mark, anchor, span): windows of a segment to mark (anchor null), or a segment to fetch for anchor."""

    def run(batches):
        kept, names = [], ["id", "mark", "anchor", "start", "windows"]

        def batch_of(t, anchor):
            return pa.RecordBatch.from_arrays([pa.array(t["id"]), pa.array(t["mark"]), anchor, pa.array(t["start"]), pa.array(t["windows"])], names=names)

        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = _load(data)
                if kind == "anchor":
                    kept.append(t)
                else:
                    yield batch_of(t, pa.nulls(len(t), pa.int64()))
        first, others = _settle(np.concatenate(kept) if kept else np.empty(0, _ANCHOR))
        kept = []
        yield batch_of(others, pa.nulls(len(others), pa.int64()))
        if len(first):
            same = first["anchor"][1:] == first["anchor"][:-1]
            several = np.append(same, False) | np.insert(same, 0, False)
            asked = first[several]
            yield batch_of(asked, pa.array(asked["anchor"].view(np.int64)))

    return dealt.mapInArrow(run, "id long, mark long, anchor long, start int, windows int")


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of text (integer symbols) sorted by their first length symbols at least, by prefix doubling."""
    rank, n, width = text, len(text), 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        width *= 2
        if width >= length or rank[order[-1]] == n - 1:
            return order


def equal_prefix_groups(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place i > 0 of the sorted suffixes: do suffixes i-1 and i share their first length symbols?

    Breadth-first backward extension on the Burrows-Wheeler transform. An interval holds the suffixes that begin
    with some string w. For each symbol c before them, cw has an interval of its own, found by counting c in the
    transform. Intervals of length-k strings are extended in round k; an extension whose right end is no boundary
    yet makes it one, with k as the length of the common prefix there, and goes on to the next round. Boundaries
    thus come in increasing order of common prefix, and after `length` rounds all shorter ones are known.
    """
    n = len(text)
    before = text[order - 1]  # the transform; the text is taken as a circle
    symbols, codes = np.unique(before, return_inverse=True)
    # where the suffixes with each first symbol begin, and where each transform entry's suffix stands (LF)
    by_symbol = np.argsort(codes, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    left, right = np.array([0]), np.array([n])  # the interval of the empty string
    for _ in range(length):
        # an interval's entries, by symbol: each run's images are consecutive, as LF keeps the order within a symbol
        at = ranges(left, right - left)
        owner = np.repeat(np.arange(len(left)), right - left)
        image = lf[at]
        # only extensions that end at no boundary yet matter; sort the images, and runs of the same owner and symbol are the new intervals
        place = np.argsort(image, kind="stable")
        image, owner, code = image[place], owner[place], codes[at[place]]
        ends = np.append((owner[1:] != owner[:-1]) | (code[1:] != code[:-1]) | (image[1:] != image[:-1] + 1), True) if len(image) else np.empty(0, bool)
        end = image[ends] + 1
        start = image[np.flatnonzero(np.insert(ends[:-1], 0, True))] if len(image) else end
        fresh = ~boundary[end]
        boundary[end[fresh]] = True
        left, right = start[fresh], end[fresh]
        if not len(left):
            break
    return ~boundary[1:n]


def repeated_windows(segments: list[bytes], windows: list[int], rank: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(segment, window) of the windows whose bytes are those of a window with a smaller rank. rank: of each window, segment after segment."""
    # a symbol of its own ends each segment, so that no common prefix crosses it
    total = sum(map(len, segments)) + len(segments)
    text = np.empty(total, np.int64)
    starts, at = [], 0
    for k, s in enumerate(segments):
        text[at : at + len(s)] = np.frombuffer(s, np.uint8)
        text[at + len(s)] = 256 + k
        starts.append(at)
        at += len(s) + 1
    order = suffix_array(text, length)
    same = equal_prefix_groups(text, order, length)
    group = np.empty(total, np.int64)
    group[order] = np.concatenate(([0], np.cumsum(~same)))
    n = np.array(windows)
    mine = group[ranges(np.array(starts), n)]
    by = np.lexsort([rank, mine])
    again = np.zeros(len(mine), bool)
    again[by[1:]] = (mine[by[1:]] == mine[by[:-1]]) & (rank[by[1:]] > rank[by[:-1]])
    # more than two of a group: every one but the first has a smaller one before it
    hit = np.flatnonzero(again)
    owner = np.repeat(np.arange(len(n)), n)[hit]
    return list(zip(owner.tolist(), (hit - (np.cumsum(n) - n)[owner]).tolist(), strict=True))


_MARKS = "id long, mark long, start int, windows int"


def _places(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Ranks of all windows by (id, mark, start)."""
    of = np.repeat(np.arange(len(ids)), windows)
    start = ranges(starts, windows)
    by = np.lexsort([start, marks[of], ids[of]])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return rank


def _expand(segments: DataFrame, length: int, block: int) -> DataFrame:
    """Marks of the windows that other segments of their anchor hold earlier. Rows come sorted by anchor."""

    def solve(rows):
        ids, marks, starts, windows, data = ([r[k] for r in rows] for k in range(5))
        a = [np.array(x, np.int64) for x in (ids, marks, starts, windows)]
        found = repeated_windows(data, windows, _places(*a), length)
        if not found:
            return None
        seg = np.array([f[0] for f in found])
        first = np.array([f[1] for f in found]) + a[2][seg]
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (first[1:] != first[:-1] + 1)
        cut = np.flatnonzero(new)
        run = np.diff(np.append(cut, len(seg)))
        seg, first = seg[cut], first[cut]
        return pa.RecordBatch.from_arrays([pa.array(a[0][seg]), pa.array(a[1][seg]), pa.array(first.astype(np.int32)), pa.array(run.astype(np.int32))], names=["id", "mark", "start", "windows"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            anchor = batch.column(0).to_pylist()
            for key, row in zip(anchor, zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True), strict=True):
                # windows with different anchors differ, so several anchors may share a block
                if size > block // 4 and key != last:
                    if (out := solve(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = key
        if rows and (out := solve(rows)) is not None:
            yield out

    return segments.mapInArrow(run, _MARKS)


def _split(segments: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """Segments in pieces whose windows have the same minimizer of this level too; anchor is a hash of both."""

    def run(batches):
        names = ["anchor", "id", "mark", "start", "windows", "data"]
        for batch in batches:
            anchor, ids, marks, starts = (batch.column(k).to_numpy() for k in (0, 1, 2, 3))
            data, offsets = flat(batch.column(5))
            rows, out = [], ([], [], [], [])
            for k, (s, e) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                hashes, first, windows = anchors_of(data[s:e], length, gram, level)
                with np.errstate(over="ignore"):
                    mixed = (hashes ^ (anchor[k : k + 1].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _A
                rows += [k] * len(first)
                out[0].append((mixed ^ (mixed >> np.uint64(31))).view(np.int64))
                out[1].append(starts[k] + first)
                out[2].append(windows)
                out[3].extend(data[s + a : s + a + n + length - 1].tobytes() for a, n in zip(first.tolist(), windows.tolist(), strict=True))
            if rows:
                columns = [pa.array(np.concatenate(out[0])), pa.array(ids[rows]), pa.array(marks[rows]), pa.array(np.concatenate(out[1]).astype(np.int32)), pa.array(np.concatenate(out[2]).astype(np.int32)), pa.array(out[3], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return segments.select("anchor", "id", "mark", "start", "windows", "data").mapInArrow(run, "anchor long, id long, mark long, start int, windows int, data binary")


def _heavy(segments: DataFrame, block: int) -> DataFrame:
    """anchor: those with more bytes than a block."""
    return materialize(segments.groupBy("anchor").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > block).select("anchor"), "heavy")


def _large(segments: DataFrame, length: int, gram: int, block: int, buckets: int) -> DataFrame:
    """Marks in anchors with more segments than a block."""
    marks = segments.sparkSession.createDataFrame([], _MARKS)
    for level in range(1, LEVELS + 1):
        pieces = materialize(_split(segments, level, length, gram).withColumns({"a": F.xxhash64("data"), "b": F.xxhash64(F.lit(level), "data")}), "pieces")
        place = F.struct("id", "mark", "start")
        # written before it is joined, so that many equal pieces can be split over tasks
        first = materialize(pieces.groupBy("anchor", "a", "b").agg(F.min(place).alias("first")), "first")
        told = pieces.join(first, ["anchor", "a", "b"])
        marks = marks.unionByName(told.filter(place > F.col("first")).select("id", "mark", "start", "windows"))
        segments = materialize(told.filter(place == F.col("first")).select("anchor", "id", "mark", "start", "windows", "data"), "segments")
        heavy = _heavy(segments.withColumn("bytes", F.octet_length("data")), block)
        usual = segments.join(heavy, "anchor", "left_anti").repartition(buckets, "anchor").sortWithinPartitions("anchor", "id", "mark", "start")
        marks = marks.unionByName(_expand(usual, length, block))
        if heavy.isEmpty():
            return marks
        segments = segments.join(heavy, "anchor", "left_semi")
    return marks.unionByName(_spread(segments, length))


def _spread(segments: DataFrame, length: int) -> DataFrame:
    """The same for what no split makes small enough: every window by itself, least place by its bytes."""
    window = segments.select("id", "mark", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("k"), "start", "data")
    window = window.select("id", "mark", (F.col("start") + F.col("k")).alias("start"), F.substring("data", F.col("k") + 1, F.lit(length)).alias("bytes"))
    window = window.withColumn("digest", F.sha2("bytes", 256)).drop("bytes")
    place = F.struct("id", "mark", "start")
    first = window.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("digest", "first")
    return window.join(first, "digest").filter(place > F.col("first")).select("id", "mark", "start", F.lit(1).alias("windows"))


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and (keep_text) kept, the remaining bytes, added."""
    docs = cleared(docs, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "__id", "__mark", "__spans", "__own", "__own_mark"], keep=[text, doc_id])
    least = -(1 << 63)  # stands for a null doc_id
    # only where ids repeat do texts' hashes have to tell documents apart
    repeats = not docs.groupBy(doc_id).count().filter("count > 1").isEmpty()
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if repeats else F.lit(0).cast("long")
    own = docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(least)), "__mark": mark})
    buckets = partitions_for(docs, text)
    dealt = _anchors(own.select("__id", "__mark", text), buckets, length, gram).repartition(buckets, "key")
    met = materialize(_meet(dealt), "anchors")
    asked = met.filter("anchor is not null")
    # the bytes of each anchor's segments bound what is sorted together
    heavy = _heavy(asked.withColumn("bytes", F.col("windows") + F.lit(length - 1)), block)
    lists = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("asked"))
    texts = own.select("__id", "__mark", text).join(lists, (F.col("__id") == F.col("id")) & (F.col("__mark") == F.col("mark")))
    piece = texts.select("id", "mark", F.encode(F.col(text), "UTF-8").alias("utf8"), F.explode("asked").alias("a"))
    piece = piece.select(
        "a.anchor", "id", "mark", "a.start", "a.windows", F.substring("utf8", F.col("a.start") + 1, F.col("a.windows") + F.lit(length - 1)).alias("data")
    )
    segments = materialize(piece.dropDuplicates(["anchor", "id", "mark", "start"]) if repeats else piece, "segments")
    usual = segments.join(heavy, "anchor", "left_anti").repartition(buckets, "anchor").sortWithinPartitions("anchor", "id", "mark", "start")
    marks = met.filter("anchor is null").select("id", "mark", "start", "windows").unionByName(_expand(usual, length, block))
    if not heavy.isEmpty():
        marks = marks.unionByName(_large(segments.join(heavy, "anchor", "left_semi"), length, gram, block, buckets))
    spans = marks.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "windows"))).alias("__spans"))
    spans = spans.withColumnsRenamed({"id": "__own", "mark": "__own_mark"})
    joined = own.join(spans, (F.col("__id") == F.col("__own")) & (F.col("__mark") == F.col("__own_mark")), "left").drop("__own", "__own_mark", "__id", "__mark")
    return _cut(joined, text, length, keep_text)


def _cut(joined: DataFrame, text: str, length: int, keep_text: bool) -> DataFrame:
    schema = joined.schema
    names = schema.names
    at, spans = names.index(text), names.index("__spans")
    stay = [k for k in range(len(names)) if k != spans and (keep_text or k != at)]

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(at))
            lists = batch.column(spans)
            flat_spans, bounds = lists.flatten(), np.concatenate(([0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))))
            start, windows = flat_spans.field(0).to_numpy(), flat_spans.field(1).to_numpy()
            size, gone, runs, digest, kept = [], [], [], [], []
            for k, (s, e) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                own = data[s:e]
                a, b = bounds[k], bounds[k + 1]
                rest, n_spans = own, 0
                if b > a:
                    step = np.zeros(len(own) + 1, np.int64)
                    np.add.at(step, start[a:b], 1)
                    np.add.at(step, start[a:b] + windows[a:b] + length - 1, -1)
                    cover = np.cumsum(step[:-1]) > 0
                    rest = own[~cover]
                    n_spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                raw = rest.tobytes()
                size.append(len(own))
                gone.append(len(own) - len(raw))
                runs.append(n_spans)
                digest.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw if keep_text else None)
            columns = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), *columns], names=[*(names[k] for k in stay), *added])

    types = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType())] + [("kept", BinaryType())] * keep_text
    added = [a for a, _ in types]
    return joined.mapInArrow(run, StructType([*(schema.fields[k] for k in stay), *(StructField(a, t) for a, t in types)]))
