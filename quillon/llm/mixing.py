"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, stash

WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of a slot's number that are reversed to make its van der Corput point: slots are fewer than 2^40.
POINT_BITS = 40
#: Documents of one source that are laid out in one sorted run.
RUN_DOCS = 8192


def words_in(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """A fixed pseudo-random order of documents, the same in every run and engine."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|mix")))


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, source_size, docs, target) of each source of sizes (source, size).

    Sources in code-point order, null last, weigh as the repeating weights; they share `share` of all sizes. A
    target stops at `most` times its source's size, and the excess is shared anew by weight until none is above.
    In ascending order of limit over weight, what the limits before a source leave is a level for each weight from
    it on; the level rises while sources stop at their limits and falls after the last that does, so the highest
    one is the level at which sharing ends. The windows over sources, one row each, are one task's: fine up to some
    hundred thousand sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    per = per.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    target = F.least(F.col("limit"), F.col("weight") * F.max("level").over(whole))
    return per.select("source", "source_size", "docs", target.alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(source, slot, rank, slots): slot k of the mix goes to the source in whose share of all targets the k-th van
    der Corput point lies; rank numbers a source's slots in order, slots is their count. A source with a target but
    without a slot (a share below a block) gets one behind all others."""
    spark = targets.sparkSession
    live = targets.where("target >= 1")
    total, n_sources = live.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    n = max(1, math.ceil(total / block))
    up_to = Window.orderBy(F.col("source").asc_nulls_last())
    shares = live.withColumn("high", F.sum("target").over(up_to) / F.lit(max(total, 1.0)))
    shares = shares.select("source", (F.coalesce(F.lag("high").over(up_to), F.lit(0.0))).alias("low"), F.when(F.lead("high").over(up_to).isNull(), F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    cells = max(1024, 16 * n_sources)
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("long")
    shares = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0")), 2, 10).cast("double") / F.lit(float(1 << POINT_BITS))
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", cell(F.col("point")))
    found = slots.join(shares, "cell").where("point >= low and point < high").select("source", "slot")
    # A hot source's slots are ranked in runs of the schedule; a run's first rank is the sum of the counts before it.
    found = found.withColumn("run", F.floor(F.col("slot") / F.lit(1 << 16)).cast("long"))
    counts = found.groupBy("source", "run").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("run")
    base = counts.select("source", "run", (F.sum("n").over(w) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("source")).alias("slots"))
    right = base.select(F.col("source").alias("s"), F.col("run").alias("r"), "base", "slots")
    ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    ranked = ranked.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    ranked = ranked.select("source", "slot", (F.col("base") + F.col("at")).alias("rank"), "slots")
    missing = live.join(counts.select(F.col("source").alias("s")).distinct(), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    late = missing.select("source", (F.lit(n) + F.row_number().over(up_to) - 1).cast("long").alias("slot"), F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("slots"))
    return ranked.union(late)


def lay_out(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with start: where a document's words begin in its source's shuffled stream. A source is laid out in
    sorted runs of about RUN_DOCS documents, so a hot source is many tasks' work."""
    right = targets.select(F.col("source").alias("s"), "source_size", "docs", "target")
    held = sizes.join(F.broadcast(right) if _few(targets) else right, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    head = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    held = held.withColumn("order", shuffle_key(F.col("doc_id"))).withColumn("run", F.floor(head * F.ceil(F.col("docs") / F.lit(RUN_DOCS))).cast("long"))
    sums = held.groupBy("source", "run").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("run")
    base = sums.select(F.col("source").alias("s"), F.col("run").alias("r"), (F.sum("n").over(before) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "run").orderBy("order", F.col("doc_id").asc_nulls_last(), "size", "row")
    held = held.withColumn("in_run", F.sum("size").over(inside) - F.col("size"))
    held = held.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    return held.withColumn("start", F.col("base") + F.col("in_run")).drop("order", "run", "s", "r", "base", "in_run")


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """A table of at most so many sources is small enough to broadcast."""
    return targets.limit(most + 1).count() <= most


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, block: int = 256, numbered: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of docs by source: (documents, blocks).

    documents has a row for each row of docs: doc_id, size (words), source, source_size, target, start and taken.
    blocks has the mix itself: slot (its place), source, rank, doc_id, row, size, turn (0: a document's first use) and
    the piece's words [low, high) of that document.

    A source's shuffled stream of words, repeated as often as its target needs, is cut into as many equal blocks
    (to a word) as the schedule has slots for it, and its block of rank r goes to its slot of rank r. So a source's
    taken words are its target rounded down, and no document exceeds `most` times its size, rounded up, as no
    target exceeds that multiple of its source. Blocks have about `block` words.

    numbered: docs is a written table that has row numbers and sizes already, in these columns. Null text: size 0. Null source: a source of its
    own, last. Null doc_id: a document like any other. Repeated rows are laid out one after the other. A document
    of size 0 takes 0. No rows: none. Other columns don't matter.
    """
    sizes = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(numbered[1]) if numbered else words_in(F.col(text))).alias("size"), F.col(source).cast("string").alias("source"), (F.col(numbered[0]) if numbered else F.monotonically_increasing_id()).alias("row"))
    sizes = sizes if numbered else stash(sizes, "sizes")
    targets = stash(source_targets(sizes, share, weights, most), "targets")
    laid = stash(lay_out(sizes, targets), "laid")
    slots = stash(schedule(targets, block), "slots")
    counts = slots.groupBy("source").agg(F.max("slots").alias("slots"))
    right = counts.select(F.col("source").alias("s"), "slots")
    right = F.broadcast(right) if _few(targets) else right
    pieces = laid.where("size > 0").join(right, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    pieces = pieces.withColumn("words", F.floor("target").cast("long")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    pieces = pieces.withColumn("p0", F.col("start") + F.col("turn") * F.col("source_size"))
    pieces = pieces.withColumn("p1", F.least(F.col("p0") + F.col("size"), F.col("words"))).where("p0 < p1")
    # Block r of a source is [r * words div slots, (r + 1) * words div slots): the block of word x is exact in decimals.
    block_of = lambda x: F.expr(f"CAST(((CAST({x} + 1 AS DECIMAL(19,0)) * slots - 1) DIV words) AS BIGINT)")
    pieces = pieces.withColumn("rank", F.explode(F.sequence(block_of("p0"), block_of("p1 - 1"))))
    edge = lambda r: F.expr(f"CAST(((CAST({r} AS DECIMAL(19,0)) * words) DIV slots) AS BIGINT)")
    pieces = pieces.withColumn("low", F.greatest(F.col("p0"), edge("rank")) - F.col("p0")).withColumn("high", F.least(F.col("p1"), edge("rank + 1")) - F.col("p0"))
    left = pieces.select("source", "rank", "doc_id", "row", "size", "turn", "low", "high")
    right = slots.select(F.col("source").alias("s"), F.col("rank").alias("r"), "slot")
    blocks = left.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r"))).drop("s", "r").where("low < high")
    taken = blocks.groupBy("row").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    out = laid.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return out.select("doc_id", "row", "size", "source", "source_size", "target", "start", "taken"), blocks


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kind) -> DataFrame:
    """The mix as documents: docs' columns, a row for each use of a document. A use of all its words keeps the text
    as it is; one of some of them has these words, joined by single spaces (and by nothing else)."""
    names = docs.columns
    row, size, use = (fresh_name(n, docs) for n in ("row", "size", "use"))
    held = stash(docs.withColumns({row: F.monotonically_increasing_id(), size: words_in(F.col(text))}), "documents")
    blocks = mix(held, doc_id, text, source, numbered=(row, size), **kind)[1]
    uses = blocks.groupBy("row", "turn", "size").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    uses = uses.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("turn", "low", "high", "size")).alias(use))
    out = held.join(uses, row).withColumn(use, F.explode(use))
    of = F.col(use)
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), of["low"].cast("int") + 1, (of["high"] - of["low"]).cast("int")), " ")
    whole = (of["low"] == 0) & (of["high"] == of["size"])
    return out.withColumn(text, F.when(whole, F.col(text)).otherwise(part)).select(*names)
