"""Resharding by minimum-cost flow.

From the bytes that each old shard holds and the capacities of the new shards, the flow of least cost is
solved, where a byte that stays in its shard costs nothing and one that moves costs one. The flow is
then carried out in blocks, the rows of an old shard whose texts hash alike, so that equal texts move
together; a block goes where the middle of its bytes falls, so a plan is off the flow by less than
half a block for each part of it. Texts that fill over CUT of a new shard, in rows of less than half a
shard, are the only ones that are cut, by row, into pieces of 1/FINE of a shard, in as many shards as
that takes; other blocks that turn out large are dealt again by finer hashes of their texts. A text of over 1/LARGE of a shard, which may
not be cut, is placed before the flow. `least_moved` gives the bytes that no plan moves fewer than.

The plan has FINE blocks a shard, of the old or the new shards, whichever are more, and WHOLE at least.
`rewrite` writes the files of those shards only that gain or lose rows.

Defined results: a null text is its own group and counts one byte, like an empty one; null ids and
repeated rows are rows like any other; a null or negative old shard is one that all rows must leave; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecrest.llm.common import fresh, ranked, settle

#: Share of a new shard beyond which a single text is cut by row.
CUT = 0.9
#: A piece of what is cut has this part of a new shard, and so have blocks about.
FINE = 256
#: Blocks of a plan, at least.
WHOLE = 32_768
#: What may not be cut and has over this part of a new shard is placed by itself.
LARGE = 128


class Flow:
    """Minimum-cost flow by successive shortest paths: each path found is the cheapest left, by a queue
    of labels over the residual arcs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """Adds an arc and its way back, and gives its number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        while True:
            best, by = {source: 0}, {}
            queue, waiting = deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and best[a] + self.cost[e] < best.get(b, 1 << 62):
                        best[b], by[b] = best[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if sink not in best:
                return
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.to[by[at] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]


def least_cost_flow(supply: dict[int, int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to new shard j. All moves cost the same, so the network has one node that
    every move goes through, and its size is the number of shards, not of pairs of them."""
    if sum(supply.values()) > sum(capacity):
        raise ValueError("the new shards hold less than the old ones")
    olds, n = sorted(supply), len(capacity)
    first, source, hub, sink = n, n + len(olds), n + len(olds) + 1, n + len(olds) + 2
    net, total = Flow(sink + 1), sum(supply.values())
    stay = {i: net.arc(first + k, i, supply[i], 0) for k, i in enumerate(olds) if 0 <= i < n}
    leave = {i: net.arc(first + k, hub, supply[i], 1) for k, i in enumerate(olds)}
    enter = [net.arc(hub, j, total, 0) for j in range(n)]
    for k, i in enumerate(olds):
        net.arc(source, first + k, supply[i], 0)
    for j, c in enumerate(capacity):
        net.arc(j, sink, c, 0)
    net.solve(source, sink)
    out = {(i, i): f for i, e in stay.items() if (f := net.sent(e))}
    # What leaves meets what enters, in order; any pairing costs the same.
    gaps = deque((j, f) for j, e in enumerate(enter) if (f := net.sent(e)))
    for i in olds:
        left = net.sent(leave[i])
        while left:
            j, f = gaps.popleft()
            take = min(left, f)
            out[i, j] = out.get((i, j), 0) + take
            left -= take
            if f > take:
                gaps.appendleft((j, f - take))
    return out


def least_moved(supply: dict[int, int], capacity: list[int]) -> int:
    """Bytes that leave their shard in any plan within the capacities."""
    return sum(max(0, s - (capacity[i] if 0 <= i < len(capacity) else 0)) for i, s in supply.items())


def assign(blocks: list[tuple[int, int, int, bool]], capacity: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, cell, bytes, whether it is a piece of a cut text)."""
    load, out = [0] * len(capacity), {}
    small: dict[int, list[tuple[bool, int, int]]] = {}
    for shard, cell, size, piece in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        if size <= max(capacity) / LARGE:
            small.setdefault(shard, []).append((not piece, cell, size))
            continue
        # A large block stays if it fits, else goes where most room is.
        fits = 0 <= shard < len(load) and load[shard] + size <= capacity[shard]
        to = shard if fits else max(range(len(load)), key=lambda j: (capacity[j] - load[j], -j))
        out[shard, cell] = to
        load[to] += size
    left = [max(0, c - x) for c, x in zip(capacity, load)]
    supply = {i: sum(s for _, _, s in found) for i, found in small.items()}
    # A shard overfilled by a large block takes no more, so room elsewhere may fall short of the rest.
    if (short := sum(supply.values()) - sum(left)) > 0:
        left = [x + -(-short // len(left)) for x in left]
    flow = least_cost_flow(supply, left)
    parts: dict[int, list[tuple[int, int]]] = {}
    for (i, j), f in sorted(flow.items(), key=lambda x: (x[0][0] != x[0][1], x[0])):
        parts.setdefault(i, []).append((j, f))
    for i, found in small.items():
        # Pieces of cut texts come first, so that they lie in few shards; the rest in order of hash.
        at, k, end = 0, 0, parts[i][0][1]
        for _, cell, size in sorted(found):
            while k + 1 < len(parts[i]) and at + size / 2 > end:
                k += 1
                end += parts[i][k][1]
            out[i, cell] = parts[i][k][0]
            at += size
    return out


def reshard(docs: DataFrame, old_shard: Column, new_shards: int = 8, doc_id: str = "doc_id", text: str = "text", capacity: list[int] | None = None, fine: int = FINE) -> DataFrame:
    """(doc_id, text_hash, size, text_crc32, old_shard, shard, slot) of every row.

    capacity is in bytes for each new shard; without it all get an equal part. old_shard is a column of
    small whole numbers. slot numbers a shard's rows from 0.
    """
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    shard = F.coalesce(old_shard.cast("int"), F.lit(-1))
    # The row's number tells repeated rows apart; the table is written, so it stays.
    rows = settle(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), size.alias("size"), crc.alias("text_crc32"), shard.alias("old_shard"), F.monotonically_increasing_id().alias("row")))
    total, n, olds = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.count_distinct("old_shard")).first()
    capacity = capacity or [-(-total // new_shards)] * new_shards
    buckets = max(64, -(-max(WHOLE, fine * max(olds, len(capacity))) // max(1, olds)))
    piece = max(1.0, max(capacity) / fine)
    keyed = rows.withColumn("bucket", F.pmod("text_hash", F.lit(buckets)))
    sums = {(r[0], r[1]): r[2] for r in keyed.groupBy("old_shard", "bucket").agg(F.sum("size")).collect()}
    # Fewer blocks than LARGE for each new shard's worth of bytes are this large.
    wide = {k: s for k, s in sums.items() if s > max(capacity) / LARGE}
    cell = F.col("bucket")
    pieces: set[tuple[int, int]] = set()
    if wide:
        spark = docs.sparkSession
        finer = F.broadcast(spark.createDataFrame([(*k, int(s // piece) + 1) for k, s in wide.items()], "old_shard int, bucket long, parts long"))
        there = keyed.join(finer, ["old_shard", "bucket"])
        # At most one text for CUT of a shard's worth of bytes, and that in each old shard.
        hot = [(*r, int(r[2] // piece) + 1) for r in there.where(F.col("size") < max(capacity) / 2).groupBy("old_shard", "text_hash").agg(F.sum("size").alias("s")).where(F.col("s") > CUT * max(capacity)).collect()]
        starts, at = [], 0
        for i, h, _, parts in hot:
            starts.append((i, h, at, parts))
            pieces |= {(i, -1 - c) for c in range(at, at + parts)}
            at += parts
        cuts = F.broadcast(spark.createDataFrame(starts or [(None, None, None, None)], "old_shard int, text_hash long, first long, cuts long"))
        by_row = -1 - F.col("first") - F.pmod(F.xxhash64("doc_id", "row", F.lit(3)), F.col("cuts"))
        by_text = buckets + F.col("bucket") + buckets * F.pmod(F.xxhash64("text_hash", F.lit(9)), F.col("parts"))
        keyed = keyed.join(finer, ["old_shard", "bucket"], "left").join(cuts, ["old_shard", "text_hash"], "left")
        cell = F.when(F.col("cuts").isNotNull(), by_row).when(F.col("parts").isNotNull(), by_text).otherwise(cell)
    keyed = keyed.withColumn("cell", cell).select(*rows.columns, "cell")
    if wide:
        sums = {(r[0], r[1]): r[2] for r in keyed.groupBy("old_shard", "cell").agg(F.sum("size")).collect()}
    to = assign([(*k, s, k in pieces) for k, s in sums.items()], capacity)
    plan = F.broadcast(docs.sparkSession.createDataFrame([(*k, v) for k, v in to.items()], "old_shard int, cell long, shard int"))
    placed = settle(keyed.join(plan, ["old_shard", "cell"]).drop("cell"))
    spread = F.xxhash64("doc_id", "text_hash", "row", F.lit(5))
    slots = ranked(placed, ["shard"], spread, max(64, n // 50_000), [F.col("doc_id"), F.col("text_hash"), F.col("old_shard"), F.col("row")], "slot")
    return slots.select("doc_id", "text_hash", "size", "text_crc32", "old_shard", "shard", "slot")


def rewrite(docs: DataFrame, plan: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", untouched: bool = False) -> list[int]:
    """Writes docs under path in folders shard=<n>, of the shards that gain or lose rows only, unless
    untouched ones are wanted too; returns the shards written. plan is what reshard returns. A column
    of docs that is named shard is left out of the files, as the folder's name takes its place."""
    plan = settle(plan.select("doc_id", "text_hash", "old_shard", "shard"))
    moved = plan.where("old_shard <> shard")
    hit = sorted({r[0] for r in moved.select(F.explode(F.array("old_shard", "shard"))).distinct().collect()})
    docs = docs.drop("shard")
    h, i, c, g, m = (fresh(docs, x) for x in ("text_hash", "plan_id", "copy", "row_hash", "row_no"))
    # Rows equal in id and text are numbered on both sides, so that each goes to one place.
    many = max(64, plan.count() // 50_000)
    places = settle(plan.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), "shard", F.monotonically_increasing_id().alias(m)))
    places = ranked(places, [i, h], F.xxhash64(m), many, [F.col(m)], c).drop(m)
    places = places if untouched else places.where(F.col("shard").isin(hit))
    keys = settle(docs.withColumn(g, F.xxhash64(text)).withColumn(m, F.monotonically_increasing_id()))
    keys = ranked(keys, [doc_id, g], F.xxhash64(m), many, [F.col(m)], c).drop(m)
    rows = keys.withColumnRenamed(c, m).join(places, F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(g) == F.col(h)) & (F.col(m) == F.col(c))).drop(i, h, c, m, g)
    rows.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    wanted = plan if untouched else plan.where(F.col("shard").isin(hit))
    written = sorted(r[0] for r in wanted.select("shard").distinct().collect())
    # A shard that ends empty has no rows to overwrite its folder with.
    spark = docs.sparkSession
    for k in set(hit) - set(written):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return written
