"""Near duplicates by SimHash fingerprints and BK-trees.

A text's fingerprint has 64 bits, each the majority among the XXH64 hashes of its word shingles.
Two texts are near duplicates if their fingerprints differ in few bits, or if a chain of such pairs
joins them.

Fingerprints are dealt into shards that agree in one of `radius + 1` blocks of bits: any two within
the radius agree in one block at least. A shard that is still large is dealt again by blocks of its
remaining bits; one that stays large even then is cut into tiles, so that each pair of its members
still meets in one tile. Each shard gets a BK-tree, whose nodes keep their children by Hamming
distance, and its fingerprints walk down only the edges within the radius. Only distinct
fingerprints take part, so that thousands of exact copies count once.

Defined results: null and empty texts have fingerprint zero and are linked like any other; texts
with fewer words than a shingle are one shingle; repeated rows and ids stay as they are; a null id
is never a component's name unless all of its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecrest.llm.common import components, fresh, join_one, partitions, settle

#: Shingles counted at a time, so that a text of any length needs bounded memory.
CHUNK = 1 << 15
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    join, n = b" ".join, len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    grams = zip(*(words[k:] for k in range(shingle)))
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        h = np.fromiter((digest(join(next(grams)), seed) for _ in range(m)), "<u8", m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """docs with its SimHash as a signed long; all other columns stay in the JVM."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text).cast("binary")))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances; a second axis has the words of a fingerprint."""
    d = np.bitwise_count(a ^ b).astype(np.int16)
    return d if d.ndim < 2 else d.sum(axis=1, dtype=np.int16)


class BkTree:
    """BK-tree over fingerprints of one or more words, searched for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.root = 0 if len(values) else -1
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [(0, np.arange(1, len(values)))] if len(values) else []
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            d = distance(values[below], values[node])
            order = np.argsort(d, kind="stable")
            d, below = d[order], below[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for part, edge in zip(np.split(below, cuts), d[np.r_[0, cuts]]):
                self.children[node].append((int(edge), int(part[0])))
                todo.append((int(part[0]), part[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it), for nodes that have any."""
        todo = [(self.root, np.arange(len(queries)))] if self.root >= 0 and len(queries) else []
        while todo:
            node, left = todo.pop()
            d = distance(queries[left], self.values[node])
            near = left[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                if len(down := left[np.abs(d - edge) <= radius]):
                    todo.append((child, down))


def star_edges(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among distinct fingerprints, as (member, head) pairs that join the same members."""
    head = list(range(len(values)))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for node, near in BkTree(values).search(values, radius):
        a = find(node)
        for b in near.tolist():
            if (b := find(b)) != a:
                a, b = min(a, b), max(a, b)
                head[b] = a
    return [(i, r) for i in range(len(values)) if (r := find(i)) != i]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of each shard; rows come sorted by shard."""

    def edges(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v = np.unique(np.concatenate(parts))
        pairs = np.array(star_edges(v, radius), np.int64).reshape(-1, 2)
        return v[pairs[:, 0]].view(np.int64), v[pairs[:, 1]].view(np.int64)

    held: list[np.ndarray] = []
    last = None
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []
    made = 0
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and key[a] != last:
                if sum(map(len, held)) > 1:
                    s, d = edges(held)
                    src.append(s)
                    dst.append(d)
                    made += len(s)
                held = []
            last = key[a]
            held.append(fp[a:b].copy())
        if made > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])
            src, dst, made = [], [], 0
    if held and sum(map(len, held)) > 1:
        s, d = edges(held)
        src.append(s)
        dst.append(d)
    if src:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])


def _blocks(fp: str, bits: list[int], parts: int) -> list[tuple[int, int, list[int]]]:
    """`bits`, most significant first, cut into runs: (shift, width, the other bits)."""
    out, at = [], 0
    for k in range(parts):
        width = len(bits) // parts + (k < len(bits) % parts)
        run = bits[at : at + width]
        out.append((run, [b for b in bits if b not in run]))
        at += width
    return out


def _value(fp: str, run: list[int]):
    """The bits of a run as one number; a run may have a gap where an earlier block was taken out."""
    groups: list[list[int]] = []
    for b in run:
        if groups and groups[-1][-1] - 1 == b:
            groups[-1].append(b)
        else:
            groups.append([b])
    value = F.lit(0).cast("long")
    for g in groups:
        piece = F.shiftrightunsigned(F.col(fp), g[-1]).bitwiseAND(F.lit((1 << len(g)) - 1).cast("long"))
        value = F.shiftleft(value, len(g)).bitwiseOR(piece)
    return value


def shards(fps: DataFrame, radius: int = 3, max_shard: int = 1024) -> DataFrame:
    """(key, fp): distinct fingerprints dealt so that any two within the radius share a key."""
    parts = radius + 1
    first = _blocks("fp", list(range(63, -1, -1)), parts)
    second = [_blocks("fp", rest, parts) for _, rest in first]
    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("b"), _value("fp", run).alias("v")) for k, (run, _) in enumerate(first)))).alias("s")).select("fp", "s.b", "s.v")
    # At most parts * 2**16 blocks exist, whatever the input.
    large = settle(dealt.groupBy("b", "v").count().where(F.col("count") > max_shard).select("b", "v", F.lit(True).alias("large")))
    dealt = dealt.join(F.broadcast(large), ["b", "v"], "left")
    small = dealt.where("large is null").select(F.xxhash64(F.lit(1), "b", "v").alias("key"), "fp")
    finer = F.lit(None).cast("array<struct<b2:int,v2:bigint>>")
    for k, runs in enumerate(second):
        finer = F.when(F.col("b") == k, F.array(*(F.struct(F.lit(j).alias("b2"), _value("fp", run).alias("v2")) for j, (run, _) in enumerate(runs)))).otherwise(finer)
    fine = settle(dealt.where("large").select("fp", "b", "v", F.explode(finer).alias("s")).select("fp", F.xxhash64(F.lit(2), "b", "v", "s.b2", "s.v2").alias("key")))
    sized = settle(fine.groupBy("key").count())
    tiles = F.ceil(F.col("count") / max_shard).cast("int")
    piece = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    tiled = (
        fine.join(sized, "key").select("key", "fp", tiles.alias("g"), piece.alias("p"))
        .select("key", "fp", "g", "p", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
        .select(F.when(F.col("g") == 1, F.col("key")).otherwise(F.xxhash64(F.lit(3), "key", F.least("p", "o"), F.greatest("p", "o"))).alias("key"), "fp")
    )
    return small.union(tiled)


def near_duplicates(fps: DataFrame, radius: int = 3, max_shard: int = 1024) -> DataFrame:
    """(fp, root): the smallest fingerprint linked with each one that has any link."""
    spark = fps.sparkSession
    dealt = shards(fps.select("fp").distinct(), radius, max_shard)
    dealt = dealt.repartition(partitions(spark), "key").sortWithinPartitions("key")
    edges = dealt.mapInArrow(lambda it: _links(it, radius), "src long, dst long")
    return components(settle(edges))


def dedup_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, max_shard: int = 1024) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row; text_hash tells rows of one id apart."""
    rows = settle(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle).select("doc_id", F.xxhash64("text").alias("text_hash"), "fp"))
    names = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = settle(near_duplicates(names, radius, max_shard))
    joined = names.join(linked, names.fp == linked.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    joined = settle(joined)
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = settle(joined.select("fp", "root").join(settle(least), "root").select("fp", "component_id", "root"))
    return join_one(rows, by_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest id stays, with all its
    columns; of rows equal in id and text one stays."""
    return keep_first(docs, dedup_groups(docs, doc_id, text, **options), doc_id, text)


def keep_first(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of each of the groups (doc_id, text_hash, root, component_id)."""
    keep = settle(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*"))
    h, a, b = (fresh(docs, x) for x in ("text_hash", "keep_id", "keep_hash"))
    keep = keep.toDF(a, b)
    rows = docs.withColumn(h, F.xxhash64(text))
    rows = rows.join(keep, F.col(doc_id).eqNullSafe(F.col(a)) & (F.col(h) == F.col(b)), "left_semi")
    key = [doc_id, h]
    return rows.dropDuplicates(key).drop(h)
