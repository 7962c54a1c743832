"""Near duplicates at a Jaccard similarity: SimHash fingerprints, BK-trees by shard, exact check.

At a similarity of 0.8 fingerprints differ in about 15 % of their bits, so no run of bits is sure to
agree and shards cannot be dealt by bits as for a small radius. A shard here has the texts that share
one of BANDS keys, each made of ROWS minima over the hashes of their word shingles: two texts at
similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS; at 0.8 one pair in 2 million
does not. Each shard gets a BK-tree over fingerprints of 2,048 bits, which its members walk down along
the edges within a radius: at 0.8 a pair is beyond it with a probability of less than one in a million,
while most pairs below 0.7 are. Texts of few shingles have a wider one, as their bits are fewer in
truth. What they find are candidates only; they are linked if their sets of shingles reach the least
similarity, and a chain of such pairs joins them too.

Three rounds keep the candidates few. The first takes a few keys, cut into shards of bounded size, and of
each shard the pairs of a shortest spanning tree: copies lie nearest to what they are copies of. The
second takes all keys whose texts are not yet one group, in tiles so that any two meet, and of each
tile a shortest tree between groups. The last takes every pair within the radius that is still in two
groups, in the first of the keys that the two share. So the groups are those of all candidate pairs, and no copies are compared all with all.

Defined results: null and empty texts count as one shingle of no words and are alike; texts with fewer
words than a shingle are one shingle; words are compared in lower case (ASCII), as by the fingerprint;
repeated rows and ids stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecrest.llm.common import components, join_one, partitions, settle
from pagecrest.llm.simhash import SEED, BkTree

BANDS, ROWS = 28, 4
#: Keys of the first round.
FIRST = 8
#: Words of a fingerprint, 64 bits each.
WIDTH = 32
#: Bits in which fingerprints may differ, and those of texts with fewer than FEW shingles.
RADIUS, RADIUS_OF_FEW, FEW = 388, 600, 32
#: Shingles mixed at a time.
CHUNK = 512
_random = np.random.default_rng(SEED)
FLIPS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
ODDS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
BITS = _random.integers(0, 1 << 64, (WIDTH, 1), np.uint64) | np.uint64(1)


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    words = (text or b"").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([digest(join(words), SEED)], np.uint64)
    grams = zip(*(words[k:] for k in range(shingle)))
    return np.unique(np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, len(words) - shingle + 1))


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes; those of different bands are different."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        low = np.minimum(low, ((found[None, at : at + CHUNK] ^ FLIPS) * ODDS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of WIDTH words of a set of shingle hashes."""
    ones = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(found), CHUNK):
        mixed = found[None, at : at + CHUNK] * BITS
        mixed = (mixed ^ (mixed >> np.uint64(32))) * BITS
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(np.ascontiguousarray(mixed.T).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")


def near_pairs(fps: np.ndarray, sizes: np.ndarray, roots: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of members of a shard, i < j, within the radius, of sizes that allow the similarity,
    and in two groups."""
    radius = RADIUS_OF_FEW if (sizes < FEW).any() else RADIUS
    if len(fps) == 2:  # most shards
        i, j = np.array([0]), np.array([1])
        d = np.bitwise_count(fps[:1] ^ fps[1:]).sum(axis=1)
    else:
        hits = list(BkTree(fps).search(fps, radius))
        i = np.repeat(np.array([n for n, _ in hits], np.int64), [len(q) for _, q in hits])
        j = np.concatenate([q for _, q in hits]) if hits else i
        i, j = i[i < j], j[i < j]
        d = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1)
    a, b = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = (d <= np.where(a < FEW, RADIUS_OF_FEW, RADIUS)) & (a * least[1] >= b * least[0]) & (roots[i] != roots[j])
    return i[keep], j[keep], d[keep]


def shortest_tree(i: np.ndarray, j: np.ndarray, d: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Positions of the pairs that join the groups among them, nearest first."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := head.get(x, x)) != x:
            head[x] = head.get(up, up)
            x = up
        return x

    out = []
    for k in np.argsort(d, kind="stable").tolist():
        a, b = find(int(roots[i[k]])), find(int(roots[j[k]]))
        if a != b:
            head[b] = a
            out.append(k)
    return np.array(out, np.int64)


def _candidates(batches: Iterator[pa.RecordBatch], least: tuple[int, int], whole: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the shards, whose rows (key, node, root, n, fp) come one after the other. Rows for
    whole shards have more: the key's band, the row's piece and the one that the tile pairs it with, and
    all keys of the node, by which a pair that shares several is told in its first one only."""
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []

    def batch() -> pa.RecordBatch:
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (src, dst))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def shard(parts: list[tuple[np.ndarray, ...]]) -> None:
        node, root, n, fp, *more = (np.concatenate(x) for x in zip(*parts))
        if len(node) < 2 or (root == root[0]).all():
            return
        i, j, d = near_pairs(fp, n, root, least)
        if whole:
            band, piece, other, keys = more
            chosen = ((keys[i] == keys[j]).argmax(axis=1) == band[i]) & ((piece[i] != piece[j]) | (piece[i] == other[i]))
            i, j = i[chosen], j[chosen]
        elif len(i) > 1:
            chosen = shortest_tree(i, j, d, root)
            i, j = i[chosen], j[chosen]
        src.append(node[i])
        dst.append(node[j])

    held: list[tuple[np.ndarray, ...]] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key, node, root, n = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
        fp = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u8").reshape(-1, WIDTH)
        columns = [node, root, n, fp]
        if whole:
            columns += [c.to_numpy(zero_copy_only=False) for c in b.columns[5:8]]
            columns.append(b.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS))
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if held and key[x] != last:
                shard(held)
                held = []
            last = key[x]
            held.append(tuple(c[x:y] for c in columns))
        if sum(map(len, src)) > 100_000:
            yield batch()
            src, dst = [], []
    if held:
        shard(held)
    yield batch()


def _pairs(rows: DataFrame, sets: DataFrame, least: tuple[int, int], whole: bool = False) -> DataFrame:
    """Candidate pairs (a, b), each once, of rows (key, node, root, n)."""
    more = ["band", "piece", "other", "keys"] if whole else []
    rows = rows.join(sets.select("node", "fp", *more[3:]), "node").select("key", "node", "root", "n", "fp", *more).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return settle(rows.mapInArrow(lambda it: _candidates(it, least, whole), "a long, b long").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose similarity is least[0] / least[1] or more."""
    one = settle(join_one(pairs, sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a", least=10_000))
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    met = join_one(one, sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b", least=10_000)
    return settle(met.where(both * least[1] >= either * least[0]).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def dedup_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: tuple[int, int] = (4, 5), max_shard: int = 1024) -> DataFrame:
    """(doc_id, text_hash, root, component_id) of every row, as simhash.dedup_groups has them. least is
    the least similarity, as a fraction; the radius is for 0.8."""

    @F.pandas_udf("struct<keys:array<long>,n:long>")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            found = [shingles(t, shingle) for t in part]
            yield pd.DataFrame({"keys": [band_keys(f) for f in found], "n": [len(f) for f in found]})

    @F.pandas_udf("struct<found:array<long>,fp:binary>")
    def shingle_set(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            found = [shingles(t, shingle) for t in part]
            yield pd.DataFrame({"found": [f.view(np.int64) for f in found], "fp": [fingerprint(f).tobytes() for f in found]})

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    rows = settle(texts.select("doc_id", "text_hash", signed("text").alias("s")).select("doc_id", "text_hash", "s.*"))
    first = F.min(F.struct("n", "keys")).alias("s")
    names = settle(rows.groupBy("text_hash").agg(F.min("doc_id").alias("low"), first).select("text_hash", "low", "s.*"))
    dealt = names.select(F.col("text_hash").alias("node"), "n", F.posexplode("keys").alias("band", "key"))
    shared = settle(dealt.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    met = settle(join_one(dealt, shared, "key", names.count() * BANDS).select("key", "band", "node", "n", "c"))
    used = settle(met.select(F.col("node").alias("text_hash")).distinct())
    one_each = texts.join(used, "text_hash", "left_semi").select("text_hash", "text").dropDuplicates(["text_hash"])
    sets = one_each.select(F.col("text_hash").alias("node"), shingle_set("text").alias("s")).select("node", "s.*")
    sets = settle(sets.join(names.select(F.col("text_hash").alias("node"), "keys"), "node"))

    cut = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("c") / max_shard))
    few = met.where(F.col("band") < FIRST).select(F.xxhash64("key", cut).alias("key"), "node", F.col("node").alias("root"), "n")
    edges = _verified(_pairs(few, sets, least), sets, least)
    joined = settle(components(edges))
    for whole in (False, True):
        # Only keys whose texts are in several groups, and of these any two in one tile.
        placed = settle(met.join(joined, "node", "left").select("key", "band", "node", "n", "c", F.coalesce("root", "node").alias("root")))
        mixed = settle(placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key"))
        tiles = F.ceil(F.col("c") / max_shard).cast("int")
        p, o = F.pmod(F.xxhash64("node"), tiles).cast("int"), F.explode(F.sequence(F.lit(0), tiles - 1))
        tiled = placed.join(mixed, "key", "left_semi").select("*", p.alias("piece"), o.alias("other"))
        tiled = tiled.withColumn("key", F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")))
        pairs = _pairs(tiled, sets, least, whole)
        more = _verified(pairs, sets, least)
        if more.take(1):
            edges = edges.union(more)
            joined = settle(components(edges))

    linked = settle(names.join(joined, names.text_hash == joined.node, "left").select("text_hash", "low", F.coalesce("root", "text_hash").alias("root")))
    least_id = settle(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    by_hash = settle(join_one(linked, least_id, "root").select("text_hash", "root", "component_id"))
    return join_one(rows.select("doc_id", "text_hash"), by_hash, "text_hash").select("doc_id", "text_hash", "root", "component_id")
