"""Packing token sequences by best-fit decreasing.

Pieces of documents go, longest first, each into the open sequence with the least room that still
takes it. Lengths are whole numbers up to the capacity, so pieces of one length are
interchangeable: the plan is made from the number of pieces of each length, with a segment tree
over remaining capacities that finds the tightest open sequences in logarithmic time, and moves
whole runs of like sequences at once. The plan's size depends on the capacity alone, not on the
data; each piece then finds its run by its rank among the pieces of its length.

Defined results: null texts count as empty and pack as one end token; empty tables give no rows;
equal rows are packed each; ids may repeat or be null; columns named sequence_id or offset are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecrest.llm.bpe import load
from pagecrest.llm.common import fresh, ranked, settle

END_ID = 2


class OpenBins:
    """Segment tree over remaining capacities; a leaf has the open sequences with that room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]
        self.tree = [0] * (2 * self.leaves)

    def push(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        at = room + self.leaves
        while at:
            self.tree[at] += 1
            at >>= 1

    def pop(self, room: int) -> tuple[int, int]:
        at = room + self.leaves
        while at:
            self.tree[at] -= 1
            at >>= 1
        return self.runs[room].pop()

    def tightest(self, need: int) -> int | None:
        """Least room of at least `need` that some open sequence has."""
        at = need + self.leaves
        if self.tree[at]:
            return need
        while at > 1 and (at & 1 or not self.tree[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(lengths: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, first sequence, pieces a sequence, offset), by length and rank."""
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(lengths, reverse=True):
        done, n = 0, lengths[length]
        while done < n:
            room = bins.tightest(length)
            if room is None:
                room, first = capacity, opened
                count = -(-(n - done) // (capacity // length))
                opened += count
            else:
                first, count = bins.pop(room)
            each = room // length
            whole = min(count, (n - done) // each)
            rest = n - done - whole * each if whole < count else 0
            runs.append((length, done, first, each, capacity - room))
            used = whole + (rest > 0)
            for left, at, m in ((room - each * length, first, whole), (room - rest * length, first + whole, int(rest > 0)), (room, first + used, count - used)):
                if m and left:
                    bins.push(left, at, m)
            done += whole * each + rest
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        rows: list[tuple] = []
        tokens: list[np.ndarray] = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            seq = np.append(bpe.encode(text or ""), np.uint32(end_id)).astype("<u4")
            at, cut = 0, (len(seq) - 1) % capacity + 1
            piece = 0
            while at < len(seq):
                part = seq[at:cut]
                rows.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
                if ids:
                    tokens.append(part.astype(np.int32))
                at, cut, piece = cut, cut + capacity, piece + 1
        cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:
            cols.append(pa.array(tokens, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names)


def pieces(docs: DataFrame, path: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, the
    ids. Only documents over the capacity are cut; the first piece takes what is not a multiple."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _cut(it, path, capacity, end_id, ids), schema)


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """items with sequence_id and offset. items is a table with a length of 1 to capacity."""
    spark, columns = items.sparkSession, [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    items = items.select(*columns)
    row, rank, parts, at = (fresh(items, x) for x in ("row", "rank", "parts", "at"))
    items = settle(items.withColumn(row, F.monotonically_increasing_id()))
    # At most `capacity` rows.
    lengths = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = spark.sparkContext.broadcast(plan(lengths, capacity))
    # Many pieces may share one length, so ranks come from parts of it of about equal size.
    cut = spark.createDataFrame([(k, max(1, n // 50_000)) for k, n in lengths.items()], f"length long, {parts} long")
    dealt = items.join(F.broadcast(cut), "length")
    spread = F.pmod(F.xxhash64(row), F.col(parts))
    placed = ranked(dealt, ["length"], spread, max(lengths.values(), default=1), [F.col(row)], rank)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = found.value
        key = r[:, 0] << 44 | r[:, 1]
        size, at = length.to_numpy(), rank.to_numpy()
        run = r[np.searchsorted(key, size << 44 | at, side="right") - 1]
        k = at - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + k // run[:, 3], "offset": run[:, 4] + k % run[:, 3] * size})

    return placed.withColumn(at, place("length", rank)).select(*columns, f"{at}.sequence_id", f"{at}.offset")
