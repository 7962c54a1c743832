"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are laid in a shuffled order on a line of words, which is cut into blocks of
equal length. The mix is a schedule of slots: the points k * phi mod 1 (golden-ratio points, in
exact integer form over a Fibonacci lattice) fall into the sources' shares of one unit, so that any
stretch of the schedule has the sources in proportion. A slot's rank within its source names the
block that it takes, in turn; once a source's blocks are used up they come round again, at most
`most_passes` times. A document is taken as far as its words lie in blocks that slots have taken.

Targets share a total by weight; a source whose share is above its cap gets the cap, and the excess
is shared by weight among the others until none is above.

Ranks and positions are sums over buckets of bounded size first, so that no source, however large,
meets in one task, nor do all sources, however many. A source has at most `most_blocks` blocks: those
of a large one are longer, so the schedule does not grow without end.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own,
last in order; null ids and repeated rows are rows like any other; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecrest.llm.common import fresh, partitions, ranked, running, settle, words

#: Consecutive Fibonacci numbers; their ratio is the golden ratio to 18 digits.
LATTICE, STEP = 1134903170, 701408733
ROWS_PER_BUCKET = 20_000
#: Consecutive slots that are ranked together; one source may own a large part of them.
SLOTS_PER_CHUNK = 4_000
#: Up to so many sources, with a few dozen bytes each, are broadcast.
FEW_SOURCES = 50_000


def unit_point(k: Column) -> Column:
    """The k-th point in [0, 1). After a whole lattice the next round is shifted inside its steps."""
    lattice = F.lit(LATTICE).cast("long")
    at = (k % lattice) * F.lit(STEP).cast("long") % lattice
    shift = F.floor(k / lattice) * 0.6180339887498949
    return (at + (shift - F.floor(shift))) / lattice


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_no, source_size, weight, target) from (source, source_size); sources are numbered in
    order from 1, null last, and weights go round in that order. Shares w * L up to the cap, with the L
    that spends the total: the sources in the order in which a growing L reaches their caps are capped
    up to the right one."""
    rows = running(sizes, [F.col("source").asc_nulls_last()], {}).withColumnRenamed("row", "source_no")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", w.cast("double")).withColumn("limit", cap * F.col("source_size"))
    rows = running(rows.withColumn("reached", F.col("limit") / F.col("weight")), [F.col("reached"), F.col("source_no")], {"spent": "limit", "taken": "weight"})
    whole, heavy = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(share * whole) - F.col("spent")) / (F.lit(heavy) - F.col("taken"))
    # The first one that its level does not fill sets the level for all after it.
    first = rows.withColumn("level", level).where("level * weight <= limit").agg(F.min(F.struct("reached", "source_no", "level"))["level"]).first()[0]
    target = F.least(F.col("limit"), F.col("weight") * F.lit(first)) if first is not None else F.col("limit")
    return rows.select("source", "source_no", "source_size", "weight", target.alias("target"))


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, source_size): words of each source, null texts of none."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.size(words(F.col(text))), F.lit(0)).cast("long")).alias("source_size"))


def schedule(sources: DataFrame, most_passes: int = 2) -> DataFrame:
    """(source_no, block, times): how often the slots take each block of each source.

    sources has source_no, n_blocks and quota, the number of blocks to take on average. A slot falls
    into the source whose share of the summed quotas holds its point.
    """
    spark = sources.sparkSession
    shares = running(sources, [F.col("source_no")], {"from": "quota"}).withColumn("to", F.col("from") + F.col("quota")).select("source_no", "n_blocks", "from", "to")
    total, many = shares.agg(F.coalesce(F.max("to"), F.lit(0.0)), F.count("*")).first()
    n = round(total)
    chunks = max(1, -(-n // SLOTS_PER_CHUNK))
    slots = spark.range(0, n, 1, max(1, min(chunks, 10 * partitions(spark)))).select("id", F.floor(F.col("id") / SLOTS_PER_CHUNK).alias("chunk"), (unit_point(F.col("id")) * total).alias("x"))
    inside = (F.col("x") >= F.col("from")) & (F.col("x") < F.col("to"))
    # As many cells as sources, each with the sources that reach into it: two a cell on average.
    width = total / max(1, many) or 1.0
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.col("to") / width))))
    cells = F.broadcast(cells) if many <= FEW_SOURCES else cells
    placed = slots.withColumn("cell", F.floor(F.col("x") / width)).join(cells, "cell").where(inside)
    placed = settle(placed.select("id", "chunk", "source_no", "n_blocks"))
    sums = placed.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = settle(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    own = Window.partitionBy("source_no", "chunk").orderBy("id")
    ranked = placed.withColumn("row", F.row_number().over(own) - 1).join(sums, ["source_no", "chunk"])
    rank = F.col("before") + F.col("row")
    ranked = ranked.select("source_no", (rank % F.col("n_blocks")).alias("block"), F.floor(rank / F.col("n_blocks")).alias("turn"))
    return ranked.where(F.col("turn") < most_passes).groupBy("source_no", "block").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, most_passes: int = 2, weights: tuple[int, ...] = (5, 2, 1), block_words: int = 64, most_blocks: int = 1 << 20, seed: int = 7) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken) of every row.

    A source's blocks have block_words words, fewer in a small source, and more where there would be
    over most_blocks of them; its words come within a block of its target. taken counts words; a document is taken whole taken // size times, and once more its first
    taken % size words if that is not zero.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.size(words(F.col(text))), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = settle(rows)
    n = rows.count()
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, float(most_passes), weights)
    # Small sources get shorter blocks, so that one block more or less matters little.
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / block_words)), F.ceil(F.col("source_size") / most_blocks)).cast("long")
    sources = sources.withColumn("block_size", length).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / length)).cast("long")).withColumn("quota", F.col("target") / length)
    sources = settle(sources)
    times = settle(schedule(sources.select("source_no", "n_blocks", "quota"), most_passes))

    buckets = max(64, n // ROWS_PER_BUCKET)
    order = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    keyed = rows.join(F.broadcast(sources) if sources.count() <= FEW_SOURCES else sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
    # The order within a source is by hash; a second number only tells equal rows apart.
    keyed = settle(keyed.withColumn("_order", order).withColumn("_copy", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.lit(buckets))))
    sums = keyed.groupBy("source_no", "_bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = settle(sums.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    own = Window.partitionBy("source_no", "_bucket").orderBy("_order", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    laid = keyed.withColumn("_in", F.coalesce(F.sum("size").over(own), F.lit(0))).join(sums, ["source_no", "_bucket"])
    laid = settle(laid.withColumn("start", F.col("_before") + F.col("_in")).select("_copy", "source_no", "doc_id", "text_hash", "source", "size", "source_size", "target", "block_size", "start"))

    # Block b is the words from b * block_size on; a document meets one or more blocks.
    low, high = F.expr("start div block_size"), F.expr("(start + size - 1) div block_size")
    spans = laid.where("size > 0").select("_copy", "source_no", "start", "size", "block_size", F.explode(F.sequence(low, high)).alias("block"))
    edge = lambda b: b * F.col("block_size")
    overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), edge(F.col("block") + 1)) - F.greatest(F.col("start"), edge(F.col("block"))))
    met = spans.withColumn("overlap", overlap).join(times, ["source_no", "block"])
    taken = met.groupBy("_copy").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    out = laid.join(settle(taken), "_copy", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?![\x20\x09-\x0D])")
    lead = F.rlike(text, F.lit(r"^[\x20\x09-\x0D]")).cast("int")
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), ""), r"[\x20\x09-\x0D]+\z", "")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole taking of a document and one
    with its first words where the mix takes a part. What rows equal in id, source and text take
    together is dealt out to them in whole takings, and one of them is cut for the rest."""
    plan = mix(docs, doc_id, source, text, **options)
    names = [fresh(docs, x) for x in ("mix_id", "mix_hash", "mix_source", "mix_size", "mix_taken", "mix_copies")]
    plan = plan.groupBy("doc_id", "text_hash", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("copies")).where("taken > 0")
    i, h, s, size, taken, copies = map(F.col, names)
    plan = settle(plan.toDF(*names))
    copy, number, part = (fresh(docs, x) for x in ("mix_copy", "mix_number", "mix_part"))

    def met(plan: DataFrame) -> DataFrame:
        return docs.join(plan, F.col(doc_id).eqNullSafe(i) & (F.xxhash64(text) == h) & F.col(source).eqNullSafe(s))

    rows = met(plan.where(copies == 1)).withColumn(copy, F.lit(0).cast("long"))
    if (many := plan.where(copies > 1).agg(F.sum(copies)).first()[0]) is not None:
        repeated = settle(met(plan.where(copies > 1)).withColumn(number, F.monotonically_increasing_id()))
        key = [names[0], names[1], names[2]]
        rows = rows.unionByName(ranked(repeated, key, F.xxhash64(number), max(1, many // ROWS_PER_BUCKET), [F.col(number)], copy).drop(number))
    n_whole = F.floor(taken / size)
    own = F.floor(n_whole / copies) + (F.col(copy) < n_whole % copies).cast("long")
    whole = F.array_repeat(size, own.cast("int"))
    rest = F.when((F.col(copy) == n_whole % copies) & (taken % size > 0), F.array(taken % size)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn(part, F.explode(F.concat(whole, rest)))
    cut = F.when(F.col(part) == size, F.col(text)).otherwise(first_words(F.col(text), F.col(part)))
    return rows.withColumn(text, cut).select(*docs.columns)
