"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text, with a space put before it, is cut into units: a run of spaces with what follows up to the next space.
No piece reaches over such a cut. The different units of a block are searched, equal-length ones together: for
each end position, the hash of every substring that ends there is looked up among the sorted hashes of the
pieces, and the maximum over all lengths of (best score up to the substring's start + the piece's score) is kept
with the length that gave it. Following those lengths back from the end yields the pieces. A character that no
piece holds is given as its UTF-8 bytes.

The pieces come from a model file whose path is a parameter; it is read on the driver, and its table (bounded
by the vocabulary) goes to the executors. A file of merges has ranks for scores, not log probabilities: ranks
r = 1, 2, ... become log(1 / (r + 2.7)) less a constant so that all sum to one (the Zipf-Mandelbrot law), and the
search then gives the best segmentation under these. It isn't the one that replaying merges gives.

Decoding joins the pieces' bytes and takes the first space off; it restores every text exactly. U+2581, which
stands for a space inside pieces, is given as bytes where a text itself has it.

Edge cases: a null text has null ids and decodes to null; an empty text has no ids. Repeated rows are treated
alike. An empty table gives an empty result. Input columns with the names of added ones are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from reportloom.llm.runtime import as_bytes, cleared, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Bytes of text whose units are searched together.
BLOCK = 4 << 20
# Units whose ids a task remembers.
KNOWN = 60_000
# Longer units are searched one by one, by so many ends at a time.
LONG = 96
STEP = 1 << 16
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
_UNITS = re.compile("\x20+[^\x20▁\n]*|[^\x20▁\n]+|[▁\n]")


class Pieces:
    """The table of pieces: sorted hashes with scores and ids, and every id's bytes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, special: set[int]):
        known = [k for k in range(len(pieces)) if k not in special and k not in byte_ids.values()]
        for k in known:
            if "\n" in pieces[k] or "▁" in pieces[k].lstrip("▁"):
                raise ValueError(f"piece {pieces[k]!r} reaches over the end of a unit")
        text = {k: pieces[k].replace("▁", " ") for k in known}
        self.longest = max((len(t) for t in text.values()), default=1)
        keys = np.array([_hash(t) for t in text.values()], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(known, np.int32)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces are the same or have the same hash")
        self.scores = np.array([scores[k] for k in known], np.float32)[order]
        self.some = np.zeros(1 << _FILTER_BITS, bool)
        self.some[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.unknown, self.byte_ids = unknown, byte_ids
        self.unknown_score = np.float32((self.scores.min() if len(known) else 0.0) - UNKNOWN_PENALTY)
        own = [text[k].encode() if k in text else b"" for k in range(len(pieces))]
        for b, k in byte_ids.items():
            own[k] = bytes([b])
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.sizes = np.array([len(o) for o in own], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places in the table) of hashes; -inf where there is no such piece."""
        score, place = np.full(h.shape, -np.inf, np.float32), np.zeros(h.shape, np.int32)
        maybe = self.some[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        probe = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, probe), max(0, len(self.keys) - 1))
        hit = self.keys[at] == probe if len(self.keys) else np.zeros(len(probe), bool)
        where = np.flatnonzero(maybe)[hit]
        score[where], place[where] = self.scores[at[hit]], at[hit]
        return score, place

    def spelled(self, char: int) -> list[int]:
        """Ids of a character that no piece holds."""
        raw = chr(char).encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if all(b in self.byte_ids for b in raw) else [self.unknown]


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
    return h


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores = [model.id_to_piece(k) for k in range(n)], [model.get_score(k) for k in range(n)]
    bytes_ = {int(pieces[k][3:-1], 16): k for k in range(n) if model.is_byte(k)}
    special = {k for k in range(n) if model.is_control(k) or model.is_unknown(k) or model.is_unused(k)}
    normal = [k for k in range(n) if k not in special and not model.is_byte(k)]
    # ranks, not log probabilities: whole numbers that go down one by one
    if normal and sum(scores[a] - scores[b] == 1 for a, b in zip(normal, normal[1:], strict=False)) > 0.9 * (len(normal) - 1):
        total = np.log(sum(1 / (r + 2.7) for r in range(1, len(normal) + 1)))
        for r, k in enumerate(normal, 1):
            scores[k] = float(-np.log(r + 2.7) - total)
    return Pieces(pieces, scores, bytes_, model.unk_id(), special)


def _search(table: Pieces, points: np.ndarray) -> list[list[int]]:
    """Ids of equally long units; points: code points, a row for each unit."""
    n, length = points.shape
    with np.errstate(over="ignore"):
        sums = np.zeros((length + 1, n), np.uint64)
        powers = np.ones(length + 1, np.uint64)
        for k in range(length):
            sums[k + 1] = sums[k] * _BASE + points[:, k].astype(np.uint64) + np.uint64(1)
            powers[k + 1] = powers[k] * _BASE
        best = np.full((length + 1, n), -np.inf, np.float32)
        best[0] = 0
        back, piece = np.zeros((length + 1, n), np.int16), np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            for size in range(min(end, table.longest), 0, -1):
                score, place = table.find(sums[end] - sums[end - size] * powers[size])
                if size == 1:
                    none = np.isneginf(score)
                    score[none], place[none] = table.unknown_score, -1
                score = best[end - size] + score
                # of equal sums the longest piece stays
                more = score > best[end]
                best[end][more], back[end][more], piece[end][more] = score[more], size, place[more]
    at = np.full(n, length)
    rows, column = np.arange(n), []
    while (at > 0).any():
        live = at > 0
        column.append(np.where(live, piece[at, rows], -2))
        at = np.where(live, at - back[at, rows], 0)
    found = np.array(column[::-1]).T
    if (found == -1).any():
        return [_spell(table, found[k], points[k]) for k in range(n)]
    ids = np.where(found >= 0, table.ids[np.maximum(found, 0)], -1)
    return [r[r >= 0].tolist() for r in ids]


def _spell(table: Pieces, places: np.ndarray, points: np.ndarray) -> list[int]:
    out, at = [], 0
    for p in places.tolist():
        if p >= 0:
            out.append(int(table.ids[p]))
            at += int(len(bytes(table.bytes[table.starts[out[-1]] : table.starts[out[-1]] + table.sizes[out[-1]]]).decode()))
        elif p == -1:
            out += table.spelled(int(points[at]))
            at += 1
    return out


def _search_long(table: Pieces, points: np.ndarray) -> list[int]:
    """The same search for one long unit: the lookups of STEP ends at a time, then one step for each end. What stays of
    each end is the length and the place of its best piece."""
    length, longest = len(points), max(1, table.longest)
    back, piece = np.zeros(length + 1, np.int16), np.full(length + 1, -1, np.int32)
    # best scores of the last `longest` ends, the latest last
    tail = np.full(longest, -np.inf, np.float32)
    tail[-1] = 0
    for first in range(1, length + 1, STEP):
        count = min(STEP, length + 1 - first)
        # column j: the windows that end at first + j, a row for each size
        score, place = np.full((longest, count), -np.inf, np.float32), np.zeros((longest, count), np.int32)
        origin = max(0, first - longest)
        some = points[origin : first + count - 1].astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(some) + 1, np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, min(longest, len(some)) + 1):
                h = h[: len(some) - size + 1] * _BASE + some[size - 1 :]
                found, at = table.find(h)
                if size == 1:
                    none = np.isneginf(found)
                    found[none], at[none] = table.unknown_score, -1
                # h[k] is of the window from origin + k, which ends at origin + k + size
                skip = max(0, first - origin - size)
                n = len(found) - skip
                score[size - 1, count - n :], place[size - 1, count - n :] = found[skip:], at[skip:]
        best = np.concatenate([tail, np.empty(count, np.float32)])
        for j in range(count):
            sums = best[j : j + longest][::-1] + score[:, j]
            # of equal sums the longest piece stays
            size = longest - 1 - int(np.argmax(sums[::-1]))
            best[longest + j], back[first + j], piece[first + j] = sums[size], size + 1, place[size, j]
        tail = best[count:]
    places, at = [], length
    while at:
        places.append(piece[at])
        at -= int(back[at])
    return _spell(table, np.array(places[::-1]), points)


def encode_units(table: Pieces, units: list[str]) -> list[list[int]]:
    """Ids of each unit."""
    out: list[list[int]] = [[]] * len(units)
    by_length: dict[int, list[int]] = {}
    for k, u in enumerate(units):
        by_length.setdefault(len(u), []).append(k)
    for length, at in by_length.items():
        if length > LONG:
            for k in at:
                out[k] = _search_long(table, np.frombuffer(units[k].encode("utf-32-le", "surrogatepass"), np.uint32))
            continue
        for s in range(0, len(at), 1 << 15):
            some = at[s : s + (1 << 15)]
            points = np.frombuffer("".join([units[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length)
            for k, ids in zip(some, _search(table, points), strict=True):
                out[k] = ids
    return out


def encode_texts(table: Pieces, texts: list[bytes | None], known: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(all ids end to end, how many each text has). known: ids of units from earlier calls, at most KNOWN of them."""
    known = {} if known is None else known
    counts, units = [], []
    for raw in texts:
        own = _UNITS.findall(" " + raw.decode("utf-8", "surrogatepass")) if raw else []
        counts.append(len(own))
        units += own
    if not units:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    place: dict[str, int] = {}
    codes = np.fromiter((place.setdefault(u, len(place)) for u in units), np.int64, len(units))
    different = list(place)
    new = [u for u in different if u not in known]
    # U+2581 in a text is no space
    solved = {u: table.spelled(0x2581) for u in new if u == "▁"}
    plain = [u for u in new if u not in solved]
    solved.update(zip(plain, encode_units(table, plain), strict=True))
    found = [solved[u] if u in solved else known[u] for u in different]
    if len(known) + len(solved) > KNOWN:
        known.clear()
    known.update(solved if len(solved) <= KNOWN else {})
    sizes = np.array([len(f) for f in found], np.int64)
    flat_ids = np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    each = np.concatenate(([0], np.cumsum(sizes[codes])))
    ends = np.cumsum(counts)
    return flat_ids[ranges(starts[codes], sizes[codes])], each[ends] - each[ends - counts]


def decode_ids(table: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of ids end to end, counts for each text."""
    sizes = table.sizes[ids]
    data = table.bytes[ranges(table.starts[ids], sizes)].tobytes()
    ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [data[s + 1 : e] for s, e in zip(ends, ends[1:], strict=False)]


def _blocks(texts: Iterable[bytes | None]) -> Iterator[list[bytes | None]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or b"")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, keep_text: bool = True, check: bool = False) -> DataFrame:
    """docs with ids and n_tokens added, and (check) exact: do the ids decode to the text?"""
    docs = cleared(docs, ["ids", "n_tokens", "exact"], keep=[text])
    sent = docs.sparkSession.sparkContext.broadcast(load(path))  # bounded by the vocabulary
    schema = docs.schema
    at = schema.names.index(text)
    stay = [k for k in range(len(schema.names)) if keep_text or k != at]
    names = [*(schema.names[k] for k in stay), "ids", "n_tokens", *["exact"] * check]

    def run(batches):
        table, known = sent.value, {}
        for batch in batches:
            start = 0
            for block in _blocks(as_bytes(batch.column(at))):
                ids, counts = encode_texts(table, block, known)
                null = np.array([t is None for t in block])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids), mask=pa.array(null))
                columns = [*(batch.column(k).slice(start, len(block)) for k in stay), lists, pa.array(counts)]
                if check:
                    columns.append(pa.array([d == (t or b"") for d, t in zip(decode_ids(table, ids, counts), block, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                start += len(block)

    added = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())]
    if check:
        added.append(StructField("exact", BooleanType()))
    return docs.mapInArrow(run, StructType([*(schema.fields[k] for k in stay), *added]))


def decode(rows: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """rows with decoded, the text of ids, added. Bytes that are no UTF-8 (of ids that no text gives) become U+FFFD."""
    rows = cleared(rows, ["decoded"], keep=[ids])
    sent = rows.sparkSession.sparkContext.broadcast(load(path))
    schema = rows.schema
    at = schema.names.index(ids)

    def run(batches):
        table = sent.value
        for batch in batches:
            lists = batch.column(at)
            counts = np.array(lists.value_lengths().fill_null(0), np.int64)
            texts = decode_ids(table, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            out = [None if n is None else t.decode("utf-8", "replace") for n, t in zip(lists.is_valid().to_pylist(), texts, strict=True)]
            out = [t if ok else None for t, ok in zip(out, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*schema.fields, StructField("decoded", StringType())]))
