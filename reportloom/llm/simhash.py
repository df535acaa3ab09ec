"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits over word shingles. Every bit is given a nonzero vector of RADIUS+1 bits; each nonzero
vector v of as many bits makes a table whose key keeps the bits whose vector has an odd product with v. RADIUS
differing bits have RADIUS vectors, and some nonzero v is orthogonal to all of them, so the pair has the same
key in table v: no pair within the radius is missed.

Equal fingerprints are joined first, so copies never meet in a table. A table's bucket of up to BUCKET different
fingerprints is compared in memory. A larger bucket is never gathered: each of its fingerprints is dealt out to
the points within two differing bits among the bits that the bucket leaves free. Two fingerprints at distance 3
or less share a point that one of them reaches with one bit and the other with two, so linking everything at a
point to the smallest fingerprint within one bit of it keeps every component, in rows proportional to the bucket.

Edge cases: a null or empty text has fingerprint zero and links like any other. Repeated rows and equal texts
share a fingerprint. Rows with a null doc_id are linked, and do not name a component unless no other row does.
An empty table gives an empty result. Input columns with the names of added ones are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from reportloom.llm.components import connected_components
from reportloom.llm.runtime import as_bytes, materialize, ranges

RADIUS = 3
BITS = 64
BUCKET = 2048
SEED = 42
# Buckets of a node that are dealt out together.
PIECE = 8
# Texts, and shingles of all of them, whose sets are compared in one task's memory.
MOST_NODES = 4096
MOST_SHINGLES = 1 << 21
_SALTS = np.random.default_rng(13).integers(0, 1 << 63, 32).astype(np.uint64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of a UTF-8 text, A-Z lower-cased; repeats count."""
    words = text.lower().split() if text else []  # on bytes: A-Z, and splits at \x20 and \x09-\x0D, only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", drop_text: bool = False, shingle: int = 3) -> DataFrame:
    """docs with fp, the fingerprint as a signed 64-bit number."""
    schema = docs.schema
    at = schema.names.index(text)
    keep = [k for k in range(len(schema.names)) if not (drop_text and k == at)]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fps)], names=[*(schema.names[k] for k in keep), "fp"])

    return docs.mapInArrow(run, StructType([*(schema.fields[k] for k in keep), StructField("fp", LongType())]))


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The covering masks: 2**(radius+1) - 1 of them. Which bit gets which vector is a seeded shuffle."""
    vectors = 2 ** (radius + 1) - 1
    given = np.random.default_rng(seed).permutation(np.arange(BITS) % vectors + 1)
    return [sum(1 << i for i in range(BITS) if int(given[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links from each fingerprint to the smallest of its component within one bucket."""
    bits = fps.view(np.uint64)  # of signed numbers bitwise_count counts the absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(fps[k]), int(fps[r])) for k, r in enumerate(label) if k != r]


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fps (distinct fp) within the radius."""
    if radius != 3:
        raise ValueError("the way for large buckets is made for radius 3")
    tables = masks(radius)
    keys = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(tables)])
    dealt = fps.select("fp", F.explode(keys).alias("x")).select("x.v", "x.key", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "v", "key").sortWithinPartitions("v", "key", "fp")

    def run(batches):
        """Rows a, b, -1 are links; rows fp, null, v are members of a bucket over the limit."""
        held_v, held_key, held, over = -1, 0, np.empty(0, np.int64), False

        def flush(out):
            if over:
                out[2].append((held, held_v))
            elif len(held) > 1:
                for a, b in bucket_links(held, radius):
                    out[0].append(a)
                    out[1].append(b)

        def batch_of(out):
            a, b, v = np.array(out[0], np.int64), np.array(out[1], np.int64), np.full(len(out[0]), -1, np.int32)
            parts = [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v)], names=["a", "b", "v"])]
            for fp, t in out[2]:
                parts.append(pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), t, np.int32))], names=["a", "b", "v"]))
            return [p for p in parts if p.num_rows]

        for batch in batches:
            out = ([], [], [])
            v, key, fp = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((v[1:] != v[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)] if len(fp) else []
            for s, e in zip(bounds, bounds[1:], strict=False):
                if held_v == v[s] and held_key == key[s]:
                    held = np.concatenate([held, fp[s:e]])
                else:
                    flush(out)
                    held_v, held_key, held, over = v[s], key[s], fp[s:e], False
                if over or len(held) > bucket:
                    over = True
                    out[2].append((held, held_v))
                    held = held[:0]
            yield from batch_of(out)
        out = ([], [], [])
        flush(out)
        yield from batch_of(out)

    found = materialize(dealt.mapInArrow(run, "a long, b long, v int"), "buckets")
    near = found.filter("b is not null").select("a", "b")
    large = found.filter("b is null").select("v", F.col("a").alias("fp"))
    if not large.isEmpty():
        near = near.unionByName(_through_points(large.select("v", F.lit(0).alias("bucket"), F.col("fp").alias("node"), "fp").withColumn("bucket", F.xxhash64("v", _masked(tables))), tables))
    return near


def _masked(tables: list[int]):
    return F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)) for m in tables]), F.col("v") + 1))


def _flips(tables: list[int]):
    """What a member of a bucket of table v is changed by to reach all points within two bits that its key leaves free."""
    points = []
    for m in tables:
        free = [i for i in range(BITS) if not m >> i & 1]
        flips = [0, *(1 << i for i in free), *(1 << i | 1 << j for i in free for j in free if i < j)]
        points.append(F.array(*[F.lit(signed(x)) for x in flips]))
    return F.element_at(F.array(*points), F.col("v") + 1)


def components(fps: DataFrame) -> DataFrame:
    """(fp, first, component) for each different fp: its smallest doc_id and the smallest fp that links reach."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = connected_components(links(distinct.select("fp")))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, for every row of docs."""
    fps = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = materialize(add_fingerprints(fps, drop_text=True, shingle=shingle), "fingerprints")
    label = materialize(components(fps), "labels")
    least = label.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(label.join(least, "component").select("fp", "component_id"), "fp", "left")


def shingles_of(words: list[bytes], shingle: int) -> set[bytes]:
    """The different shingles of some words; fewer words than a shingle has are one."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    return {joined[i:j] for i, j in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)}


def sketch(text: bytes | None, shingle: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """count fingerprints of the set of words and count of the set of shingles, as uint64."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    return _majority(set(words), count), _majority(shingles_of(words, shingle), count)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    return np.unique(np.fromiter((xxh64_intdigest(x, SEED) for x in shingles_of(words, shingle)), np.uint64)).view(np.int64)


def _majority(features: set[bytes], count: int) -> np.ndarray:
    h = np.fromiter((xxh64_intdigest(f, SEED) for f in features), np.uint64, len(features))
    ones = np.zeros(BITS * count, np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), 1 << 11):
            x = (h[k : k + (1 << 11), None] ^ _SALTS[None, :count]) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def far_bits(similarity: float, count: int, deviations: float = 7) -> int:
    """Most differing bits by which count fingerprints of sets of at least this Jaccard similarity are looked at.

    The expected number and some standard deviations more: a share of .15 at 0.8 becomes .24. Sets of four and five
    shingles differ in .19 of the bits, more than the angle says, so that three deviations would not do.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(BITS * count * share + deviations * np.sqrt(BITS * count * share * (1 - share)))


def clumps(parts: np.ndarray, seen: np.ndarray, sketches: np.ndarray, most: int) -> list[np.ndarray]:
    """Components of the pairs of different parts and different seen whose sketches differ in at most `most` bits, as places."""
    n = len(parts)
    label = np.arange(n)
    near = np.zeros((n, n), bool)
    for k in range(0, n, 64):
        near[k : k + 64] = np.bitwise_count(sketches[k : k + 64, None, :] ^ sketches[None, :, :]).sum(axis=2, dtype=np.int64) <= most
        near[k : k + 64] &= (parts[k : k + 64, None] != parts[None, :]) & (seen[k : k + 64, None] != seen[None, :])
    np.fill_diagonal(near, True)
    while True:
        low = np.where(near, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    order = np.argsort(label, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(x) > 1]


def similar_pairs(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (places) of sets of different numbers whose Jaccard similarity is as large."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    all_owners = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    held = np.bincount(ids, minlength=len(values))
    by_id = np.repeat(np.arange(len(values)), held)
    owners, starts, rest = all_owners, np.cumsum(held) - held, n
    fresh, out = np.ones(n, bool), []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo and fresh.any():
            if 2 * (left := int(fresh.sum())) < rest:
                # only sets that have no link yet are looked for: the others leave the lists once they are the most
                live = fresh[all_owners]
                owners, held = all_owners[live], np.bincount(by_id[live], minlength=len(values))
                starts, rest = np.cumsum(held) - held, left
            k = todo.pop()
            own = ids[bounds[k] : bounds[k + 1]]
            common = np.bincount(owners[ranges(starts[own], held[own])], minlength=n)
            # sets without members are equal
            near = np.flatnonzero(fresh & (common >= similarity * (sizes + sizes[k] - common) - 1e-9))
            fresh[near] = False
            out += [(k, x) for x in near.tolist()]
            todo += near.tolist()
    return out


def _sketches(docs: DataFrame, shingle: int, count: int) -> DataFrame:
    """id, mark, words array<long>, shingles array<long>, size (an upper bound of the number of shingles)"""

    def run(batches):
        for batch in batches:
            both, sizes = [], []
            for t in as_bytes(batch.column(2)):
                both.append(sketch(t, shingle, count))
                sizes.append(len(t.split()) if t else 0)
            lists = []
            for k in range(2):
                values = np.concatenate([b[k] for b in both]).view(np.int64) if both else np.empty(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, count, dtype=np.int32)), pa.array(values)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(sizes, pa.int64())], names=["doc_id", "mark", "words", "shingles", "size"])

    return docs.mapInArrow(run, "doc_id long, mark long, words array<long>, shingles array<long>, size long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, set array<long>"""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in as_bytes(batch.column(1))]
            values = pa.array(np.concatenate([np.empty(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), values)], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set array<long>")


def _shared(nodes: DataFrame, radius: int, bucket: int, first: int, last: int) -> DataFrame:
    """(own, bucket, v, members): buckets of fingerprints first to last - 1 with nodes that may have a link to find (of
    several part and several seen), a row for each, equal ones once. v >= 0: parts of a bucket over the limit."""
    tables = masks(radius)
    keys = F.transform(
        F.slice("words", first + 1, last - first),
        lambda fp, j: F.array(*[F.struct((j * len(tables) + v).alias("v"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(tables)]),
    )
    dealt = nodes.select("node", "part", "seen", F.explode(F.flatten(keys)).alias("x")).select("x.v", "x.key", "node", "part", "seen")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "v", "key").sortWithinPartitions("v", "key", "node")

    def run(batches):
        none = np.empty(0, np.int64)
        held_v, held_key, held, parts, seen, over = -1, 0, none, none, none, False

        def several():
            return len(held) > 1 and all(bool((x != x[0]).any()) for x in (parts, seen))

        def row(node):
            own = xxh64_intdigest(node.tobytes())
            if not over:
                return own, own, -1, node
            return xxh64_intdigest(f"{held_v}:{held_key}:{own}"), xxh64_intdigest(f"{held_v}:{held_key}"), int(held_v), node

        def batch_of(out):
            own, name, v, node = zip(*out, strict=True) if out else [()] * 4
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, node)]).astype(np.int32)), pa.array(np.concatenate([none, *node])))
            ids = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (own, name)]
            return pa.RecordBatch.from_arrays([*ids, pa.array(v, pa.int32()), lists], names=["own", "bucket", "v", "members"])

        for batch in batches:
            out = []
            v, key, node, part, done = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((v[1:] != v[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(v)])) if len(v) else np.empty(0, np.int64)
            # buckets of one node inside the batch are passed over at once
            sizes = np.diff(bounds)
            wanted = np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)).tolist()
            for k in wanted:
                s, e = int(bounds[k]), int(bounds[k + 1])
                if held_v == v[s] and held_key == key[s]:
                    held, parts, seen = (np.concatenate([x, y[s:e]]) for x, y in ((held, node), (parts, part), (seen, done)))
                else:
                    if over and len(held) or several():
                        out.append(row(held))
                    held_v, held_key, held, parts, seen, over = v[s], key[s], node[s:e], part[s:e], done[s:e], False
                if over or len(held) > bucket:
                    over = True
                    out.append(row(held))
                    held, parts, seen = none, none, none
            yield batch_of(out)
        yield batch_of([row(held)] if over and len(held) or several() else [])

    return dealt.mapInArrow(run, "own long, bucket long, v int, members array<long>").dropDuplicates(["own"])


def similar_components(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, count: int, early: int = 3) -> DataFrame:
    """(node, component) of nodes (node, size, words, shingles) that have links: the tables of the first `early`
    fingerprints, then those of the others, where nodes that are one component by then, or were compared with each
    other by their sets, have nothing left to find. sets_of(nodes) gives (node, set), their shingle sets."""
    start = nodes.withColumns({"part": F.col("node"), "seen": F.col("node")})
    found, seen = similar_links(start, sets_of, similarity, count, 0, min(early, count))
    found = materialize(found, "similar")
    label = connected_components(found)
    if early >= count:
        return label
    rows = nodes.join(label, "node", "left").join(seen, "node", "left")
    rows = materialize(rows.select(*nodes.columns, F.coalesce("component", "node").alias("part"), F.coalesce("seen", "node").alias("seen")), "parts")
    more, _ = similar_links(rows, sets_of, similarity, count, early, count)
    return connected_components(found.unionByName(more))


def similar_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, count: int, first: int, last: int, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes (node, size, words, shingles, part, seen) that share a bucket of fingerprints first to
    last - 1 and have similar shingles; and (node, seen), nodes of which all with the same seen have been compared.

    A bucket's members are compared by all bits of their shingle fingerprints, whose differing share is the angle
    between the sets; those that may be similar by it are compared by the sets themselves. A bucket with more
    members than the limit goes through the same comparison in units: first in chunks that have some members in
    common, which joins large groups, then in pairs of blocks. Every two members that are not one component by then
    meet in a pair of blocks.
    """
    shared = materialize(_shared(nodes, radius, bucket, first, last), "shared")
    units = shared.filter("v < 0").select(F.col("bucket").alias("unit"), F.explode("members").alias("node"))
    large = shared.filter("v >= 0").select("bucket", F.explode("members").alias("node"))
    if large.isEmpty():
        return _compared(units, nodes, sets_of, similarity, count)
    large = materialize(_different(large), "large")
    found, seen = _compared(units.unionByName(_chunks(large, bucket)), nodes, sets_of, similarity, count)
    found = materialize(found, "found")
    known = found.unionByName(nodes.filter("node <> part").select(F.col("part").alias("a"), F.col("node").alias("b")))
    label = connected_components(known)
    part = materialize(nodes.drop("part").join(label, "node", "left").withColumn("part", F.coalesce("component", "node")).select(*nodes.columns), "parts")
    pairs = materialize(_block_pairs(large, part, bucket), "pairs")
    return found.unionByName(_compared(pairs, part, sets_of, similarity, count)[0]), seen


def _different(large: DataFrame) -> DataFrame:
    """(bucket, node, n): large buckets with the number of their members, those with the same members once."""
    sums = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    return large.join(sums.groupBy("n", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "bucket")


def _chunks(large: DataFrame, bucket: int) -> DataFrame:
    """(unit, node): the members dealt out to chunks of half the limit, about an eighth of the limit to all of them."""
    count = F.ceil(F.col("n") / max(bucket // 2, 1))
    in_all = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("n")) < max(bucket // 8, 1)
    chunk = F.when(in_all, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array(F.pmod(F.xxhash64(F.lit(6), "node"), count)))
    return large.select("bucket", "node", F.explode(chunk).alias("chunk")).select(F.xxhash64("bucket", F.lit(-1), "chunk").alias("unit"), "node")


def _block_pairs(large: DataFrame, nodes: DataFrame, bucket: int) -> DataFrame:
    """(unit, node): all pairs of blocks of half the limit, in order of component; none where a pair is one component."""
    rows = large.join(nodes.select("node", "part"), "node")
    several = rows.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("bucket")
    order = Window.partitionBy("bucket").orderBy("part", "node")
    block = F.floor((F.row_number().over(order) - 1) / max(bucket // 2, 1))
    rows = materialize(rows.join(several, "bucket").select("bucket", "node", "part", block.alias("block")), "blocks")
    blocks = rows.groupBy("bucket", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    x, y = (blocks.select("bucket", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi")]) for k in "xy")
    pairs = x.join(y, "bucket").filter("block_x < block_y and least(lo_x, lo_y) <> greatest(hi_x, hi_y)")
    pairs = pairs.select("bucket", F.xxhash64("bucket", "block_x", "block_y").alias("unit"), F.explode(F.array("block_x", "block_y")).alias("block"))
    return rows.join(pairs, ["bucket", "block"]).select("unit", "node")


def _compared(units: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, count: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the nodes of a unit (unit, node) that have similar shingle sets, and (node, seen).

    Clumps of all units that have nodes in common are one group, so that a node's set is read once, however many
    tables it was found in, and all pairs of a group are compared. A group beyond MOST_NODES or MOST_SHINGLES is
    compared clump by clump instead.
    """
    found = materialize(_clumps(units, nodes, far_bits(similarity, count)), "clumps")
    stars = found.select(F.get("members", F.lit(0)).alias("a"), F.explode(F.slice("members", F.lit(2), F.size("members"))).alias("b"))
    group = materialize(connected_components(stars).join(nodes.select("node", "size"), "node"), "groups")
    large = group.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    large = materialize(large.filter((F.col("n") > MOST_NODES) | (F.col("s") > MOST_SHINGLES)).select("component"), "large")
    each = group.join(large, "component", "left_anti").select(F.col("component").alias("own"), "node")
    seen = each.select("node", F.col("own").alias("seen"))
    if not large.isEmpty():
        inside = group.join(large, "component", "left_semi").select(F.col("node").alias("__first"))
        rest = found.join(inside, F.get("members", F.lit(0)) == F.col("__first"), "left_semi")
        each = each.unionByName(rest.select("own", F.explode("members").alias("node")))
    return _exact_links(each.join(sets_of(each.select("node").distinct()), "node"), similarity), seen


def _clumps(units: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(own, members): clumps of the nodes of each unit, equal ones once."""
    # a node's sketch meets its list of units, at most one for each table, in one row; lists are dealt out in pieces,
    # so that nodes with many units do not make one task's work
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = units.groupBy("node").agg(F.collect_list("unit").alias("units"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("units") - 1, F.lit(PIECE)), lambda i: F.slice("units", i + 1, F.lit(PIECE)))
    usual = lists.join(nodes.select("node", "part", "seen", "shingles"), "node").select("node", "part", "seen", "shingles", F.posexplode(pieces).alias("piece", "some"))
    usual = usual.repartition(n, "node", "piece").select(F.explode("some").alias("unit"), "node", "part", "seen", "shingles")
    usual = usual.repartition(n, "unit").sortWithinPartitions("unit", "node")

    def run(batches):
        now, members, parts, seen, sketches = None, [], [], [], []

        def solve():
            if len(members) < 2:
                return []
            nodes = np.array(members, np.int64)
            return [nodes[c] for c in clumps(np.array(parts, np.int64), np.array(seen, np.int64), np.array(sketches, np.int64).view(np.uint64).reshape(len(nodes), -1), most)]

        def batch_of(out):
            own = np.array([xxh64_intdigest(x.tobytes()) for x in out], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *out])))
            return pa.RecordBatch.from_arrays([pa.array(own), lists], names=["own", "members"])

        for batch in batches:
            out = []
            values = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
            for k, (u, node, part, done) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if u != now:
                    out += solve()
                    now, members, parts, seen, sketches = u, [], [], [], []
                members.append(node)
                parts.append(part)
                seen.append(done)
                sketches.append(values[k].copy())
            yield batch_of(out)
        yield batch_of(solve())

    return usual.mapInArrow(run, "own long, members array<long>").dropDuplicates(["own"])


def _exact_links(each: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of a clump (own, node, set) whose sets are similar."""
    n = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = each.select("own", "node", "set").repartition(n, "own").sortWithinPartitions("own", "node")

    def run(batches):
        now, members, sets = None, [], []

        def solve():
            return [(members[a], members[b]) for a, b in similar_pairs(sets, similarity)] if len(members) > 1 else []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            out = []
            values, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for k, (own, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != now:
                    out += solve()
                    now, members, sets = own, [], []
                members.append(node)
                sets.append(values[offsets[k] : offsets[k + 1]].copy())
            yield batch_of(out)
        yield batch_of(solve())

    return rows.mapInArrow(run, "a long, b long").distinct()


def _through_points(members: DataFrame, tables: list[int]) -> DataFrame:
    """Links (a, b) between nodes of a bucket whose fp is within 3 bits: everything at a point to one node close to it."""
    dealt = members.select("bucket", "node", "fp", F.explode(_flips(tables)).alias("flip"))
    dealt = dealt.select("bucket", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.bit_count("flip") <= 1).alias("close"))
    center = dealt.filter("close").groupBy("bucket", "point").agg(F.min("node").alias("c"))
    return dealt.join(center, ["bucket", "point"]).filter("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, count: int = 12) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, and of several such that of the
    smallest text hash. Near copies have shingle sets of the given Jaccard similarity.

    count fingerprints of each text's words, each with its own covering tables, bring near copies together: one
    of them alone misses those that differ by chance in more than RADIUS of its bits. Only texts that have a likely
    near copy by their fingerprints are read again for their shingle sets.
    """
    mark = F.xxhash64(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text).alias("text"))
    rows = materialize(_sketches(rows, shingle, count).withColumn("node", F.xxhash64("words", "shingles")), "sketches")
    nodes = materialize(rows.select("node", "size", "words", "shingles").dropDuplicates(["node"]), "nodes")
    texts = rows.groupBy("node").agg(F.min("mark").alias("mark"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        own = texts.join(wanted, "node").select("node", F.col("mark").alias("__mark"))
        return _sets(docs.select(F.col(text).alias("text"), mark.alias("__mark")).join(own, "__mark").select("node", "text"), shingle).dropDuplicates(["node"])

    label = similar_components(nodes, sets_of, similarity, count)
    rows = rows.groupBy("node", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    first = rows.groupBy("component").agg(F.min_by(F.struct("doc_id", "mark", "copies"), order).alias("x"))
    first = materialize(first.select(F.col("x.doc_id").alias("__id"), F.col("x.mark").alias("__mark"), F.col("x.copies").alias("__copies")), "kept")
    kept = docs.join(first.drop("__copies"), docs[doc_id].cast("long").eqNullSafe(first["__id"]) & (mark == first["__mark"]), "left_semi")
    if first.filter("__copies > 1").isEmpty():
        return kept
    # the same row several times: the copies meet by id and hash, of which each has few
    return kept.withColumn("__mark", mark).dropDuplicates([doc_id, "__mark"]).drop("__mark")
