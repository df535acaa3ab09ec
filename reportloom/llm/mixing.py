"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid end to end in a seeded order, up to MOST times over; its line of words is cut
into blocks of `block` words. Slot i of the schedule is the point frac((i + 1) * golden ratio), in whole numbers of
UNIT parts, mapped through the cumulative targets to a source; the slot with rank r of a source takes that source's
block r. Since ranks count up from 0, a source gives its first blocks; its last one is cut at the target. Points
spread evenly, so any stretch of the schedule holds each source near its share. Slots beyond a source's target are
left out, and the few that the points leave short are added at the end, the sources in turn.

The mix is that sequence of blocks: blocks() gives it, apply() gives whole documents in the order of their first
slots, report() says for each document what is taken of it, from which slot on and in how many.

Offsets and ranks are two-level prefix sums (sums of hash buckets or stretches of slots, then within each), so
a source with a third of all rows is spread over many tasks; sources, which may be many, are numbered by ranges.
Points meet sources through equal parts of the unit interval, four or more for each source, an equi-join.

Edge cases: a null or empty text has size 0 and is never taken. A null source is a source of its own, the
last. Repeated rows each have a place of their own. If all sizes are 0, all targets are. An empty table gives an
empty result. Only the columns named are read; blocks() and apply() keep other columns, but for those they add.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.runtime import TASK_BYTES, cleared, materialize, sums_before

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 256
SEED = 20260101
# Rows of a hash bucket of a source, slots in a stretch.
BUCKET_ROWS = 50_000
STRETCH = 1 << 16
# The unit interval, and the fractional part of the golden ratio, as whole numbers.
UNIT = 10**18
GOLDEN = 618033988749894848


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(source).alias("source"), size.alias("size"))
    return materialize(rows, "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sid (1, 2, ... by code point, null last), source, source_size, weight, target. A row for each source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sums_before(sources, [F.col("source").isNull(), F.col("source")], {"before": F.lit(1).cast("long")})
    sources = sources.withColumn("sid", F.col("before") + 1).drop("before")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    sources = materialize(sources, "sources")
    total, level = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = total or 0
    level = total / level if level else 0.0  # words for each unit of weight
    limit = F.col("source_size") * most
    capped = -1
    while True:
        over = limit < F.lit(level) * F.col("weight")
        n, full, free = sources.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not n or not free:
            break
        capped, level = n, (total - (full or 0)) / free
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def words_of(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources with words, the target in whole words."""
    return sources.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * most))


def placed(sizes: DataFrame, sources: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """sizes with sid and at, where the document starts on its source's line of words. The order is that of md5 of seed
    and doc_id; buckets are ranges of it."""
    known = sources.select("sid", F.col("source").alias("__source"))
    buckets = max(64, math.ceil(sizes.count() / bucket_rows))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = sizes.join(known, sizes["source"].eqNullSafe(known["__source"])).drop("__source").withColumn("order", order)
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets, 32))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")
    sums = sums.select("sid", "bucket", before.alias("before"))
    within = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("before") + F.sum("size").over(within) - F.col("size")
    return materialize(rows.join(sums, ["sid", "bucket"]).select("doc_id", "mark", "source", "sid", "size", at.alias("at")), "placed")


def schedule(sources: DataFrame, block: int = BLOCK, golden: int = GOLDEN) -> DataFrame:
    """slot, sid, rank: which source's block is next, in the order of slot. sources: sid, source_size, target."""
    spark = sources.sparkSession
    want = words_of(sources).select("sid", "words", F.ceil(F.col("words") / block).alias("blocks"))
    total, n, count = want.agg(F.sum("words"), F.sum("blocks"), F.count(F.lit(1))).first()
    total, n = int(total or 0), int(n or 0)
    width = UNIT // max(4096, 1 << (4 * count).bit_length())
    share = sums_before(want.filter("words > 0"), [F.col("sid")], {"before": F.col("words")})
    part = lambda c: F.expr(f"cast({c} as decimal(19,0)) * cast({UNIT} as decimal(19,0)) div cast({max(total, 1)} as decimal(19,0))")
    share = share.select("sid", "blocks", part("before").alias("lo"), part("before + words").alias("hi")).filter("lo < hi")
    share = materialize(share, "shares")
    share = share.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    u = F.expr(f"cast(cast(id + 1 as decimal(19,0)) * cast({golden} as decimal(19,0)) % cast({UNIT} as decimal(19,0)) as bigint)")
    slots = spark.range(n).select(F.col("id").alias("slot"), u.alias("u")).withColumn("cell", F.expr(f"u div {width}"))
    slots = slots.join(share, "cell").filter("u >= lo and u < hi").select("slot", "sid", "blocks", F.expr(f"slot div {STRETCH}").alias("stretch"))
    counts = materialize(slots.groupBy("sid", "stretch").agg(F.count(F.lit(1)).alias("n")), "stretches")
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    rank = F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("slot")) - 1
    ranked = slots.withColumn("r", rank).join(counts.select("sid", "stretch", before.alias("before")), ["sid", "stretch"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r")).filter("rank < blocks").select("slot", "sid", "rank")
    have = want.join(counts.groupBy("sid").agg(F.sum("n").alias("have")), "sid", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    short = have.filter("have < blocks").select("sid", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("rank"))
    late = F.lit(n).cast("long") + F.col("rank") * count + F.col("sid") - 1
    return ranked.unionByName(short.select(late.alias("slot"), "sid", "rank"))


def pieces(places: DataFrame, sources: DataFrame, block: int = BLOCK, most: int = MOST, golden: int = GOLDEN) -> DataFrame:
    """slot, sid, at, doc_id, mark, size, epoch, first, upto: words first (from 0) to upto of a document in each slot's block."""
    words = words_of(sources, most).select("sid", "source_size", "words")
    rows = places.filter("size > 0").join(words, "sid").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    rows = rows.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("b", F.least(F.col("a") + F.col("size"), "words")).filter("a < b")
    rows = rows.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    first = F.greatest(F.col("rank") * block, F.col("a")) - F.col("a")
    upto = F.least((F.col("rank") + 1) * block, F.col("b")) - F.col("a")
    return rows.select("sid", "rank", "at", "doc_id", "mark", "size", "epoch", first.alias("first"), upto.alias("upto")).join(schedule(sources, block, golden), ["sid", "rank"])


def report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", golden: int = GOLDEN) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (null if nothing is taken) and n_slots for every row of docs."""
    sizes = sized(docs, text, source, doc_id)
    sources = materialize(targets(sizes), "targets")
    places = placed(sizes, sources)
    taken = pieces(places, sources, golden=golden).groupBy("sid", "at")
    taken = taken.agg(F.sum(F.col("upto") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    # a document without words shares its place with the next one, and takes none
    taken = taken.withColumnsRenamed({"sid": "__sid", "at": "__at"})
    rows = places.join(taken, (F.col("sid") == F.col("__sid")) & (F.col("at") == F.col("__at")) & (F.col("size") > 0), "left")
    rows = rows.join(sources.select("sid", "source_size", "target"), "sid")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"))


def _with_parts(docs: DataFrame, parts: DataFrame, sizes: DataFrame, fields: list[str], text: str, doc_id: str) -> DataFrame:
    """docs with __part, a row for each of a document's parts (doc_id, mark, fields); text is the part's words, or all of
    the text where the part has all words."""
    lists = parts.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__parts"))
    lists = lists.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__parts")
    mark = F.xxhash64(F.col(text))
    if not sizes.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        docs = docs.withColumn("__mark", mark).dropDuplicates([doc_id, "__mark"]).drop("__mark")
    rows = docs.join(lists, docs[doc_id].eqNullSafe(lists["__id"]) & (mark == lists["__mark"])).drop("__id", "__mark").withColumn("__part", F.explode("__parts"))
    some = F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), F.col("__part.first").cast("int") + 1, (F.col("__part.upto") - F.col("__part.first")).cast("int"))
    whole = (F.col("__part.first") == 0) & (F.col("__part.upto") == F.col("__part.size"))
    return rows.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(some, " "))).drop("__parts")


def _in_order(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows sorted by slot, also from one partition to the next."""
    words, blocks = words_of(sources).agg(F.sum("words"), F.sum(F.ceil(F.col("words") / BLOCK))).first()
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((words or 0) * 8 / TASK_BYTES))
    # late slots, beyond the number of blocks, go last
    part = F.least(F.floor(F.col("slot") / F.lit(max(int(blocks or 0), 1)) * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions("slot")


def blocks(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix block by block, in the order of slot: a row for each document of a slot's block, with slot, epoch, first and
    upto (which of its words) added and text cut to these words."""
    added = ["slot", "epoch", "first", "upto"]
    docs = cleared(docs, [*added, "__part", "__parts", "__id", "__mark"], keep=[text, source, doc_id])
    sizes = sized(docs, text, source, doc_id)
    sources = materialize(targets(sizes), "targets")
    rows = _with_parts(docs, pieces(placed(sizes, sources), sources), sizes, ["epoch", "first", "upto", "size", "slot"], text, doc_id)
    return _in_order(rows.withColumns({c: F.col(f"__part.{c}") for c in added}).drop("__part"), sources)


def apply(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix as rows of docs, in the order of slot, the first slot of each: a document once for each time it is taken.
    One that is taken in part only has the words of that part, joined by single spaces; that is at most one document
    of each source."""
    docs = cleared(docs, ["slot", "__part", "__parts", "__id", "__mark"], keep=[text, source, doc_id])
    sizes = sized(docs, text, source, doc_id)
    sources = materialize(targets(sizes), "targets")
    parts = pieces(placed(sizes, sources), sources).groupBy("sid", "at", "doc_id", "mark", "size", "epoch")
    parts = parts.agg(F.min("first").alias("first"), F.max("upto").alias("upto"), F.min("slot").alias("slot"))
    rows = _with_parts(docs, parts, sizes, ["epoch", "first", "upto", "size", "slot"], text, doc_id)
    return _in_order(rows.withColumn("slot", F.col("__part.slot")).drop("__part"), sources)
