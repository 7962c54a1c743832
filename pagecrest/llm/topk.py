"""Exact top-k search by inner product with cover trees over data and queries.

A node of a cover tree has a centre and covers its points within a radius; its children cover them
within half of that, and there are as many of them as it takes. The search goes down a tree of queries
and a tree of data together. For a pair of nodes the inner product is at most
<q, r> + rq |r| + rr |q| + rq rr, with the centres q, r and the radii rq, rr; a pair whose bound is
below the worst k-th score among the node's queries is left out.

Over many machines the top of the trees is one level of cells: centres from the cover tree of a sample
of at most `sample_rows` rows, to which every row of the table goes by distance, each cell with the
exact radius of what it holds. Cells are the blocks that tasks search, cut by hash where they hold more
than `block_rows`. A first pass takes each query to one piece of the data cell that promises most and
gives it a k-th score to beat. The second pass takes a group of queries, with those scores, to the
cells only whose bound is not below the worst of them, and there down both trees.

Vectors are scaled and rounded down to whole numbers, so that scores are exact and ties are real;
ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; rows with the query's own id are no candidates; vectors meet those of their own
length only; an empty table gives an empty result; repeated query rows with one id and one vector
are answered once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecrest.llm.common import settle

#: A node of no more points is a leaf: they are compared at once.
LEAF = 16
NONE = np.iinfo(np.int64).min
#: Points whose distances are computed at a time.
BATCH = 512
#: Rows of queries that are compared with a list of data points at a time.
ROWS = 256


@dataclass
class Node:
    """Points are a range of the tree's order. Of the children there are arrays: the order's range of
    each, centres, their lengths and radii."""

    start: int
    end: int
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    norms: np.ndarray | None = None
    radii: np.ndarray | None = None
    starts: np.ndarray | None = None


@dataclass
class Tree:
    root: Node
    order: np.ndarray

    def nodes(self) -> Iterator[tuple[int, Node]]:
        """(depth, node) of all nodes."""
        todo = [(0, self.root)]
        while todo:
            depth, node = todo.pop()
            yield depth, node
            todo += [(depth + 1, c) for c in node.children]


def _distances(x: np.ndarray, squares: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances from each of the centres c to each row of x."""
    return np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] - 2 * (c @ x.T) + squares, 0))


def cover_tree(x: np.ndarray) -> Tree:
    """Cover tree of the rows of x. A child's centre is the first point not yet covered, so a node's own
    centre is its first child's. Nodes of few points or of equal ones are leaves."""
    squares = (x * x).sum(axis=1)
    order = np.arange(len(x))
    root = Node(0, len(x), x[0], float(_distances(x, squares, x[:1]).max()))
    todo = [root]
    while todo:
        node = todo.pop()
        if node.end - node.start <= LEAF or node.radius == 0:
            continue
        points = order[node.start : node.end]
        xs, sq = x[points], squares[points]
        owner, far = np.full(len(points), -1), np.zeros(len(points))
        centres: list[int] = []
        for first in range(0, len(points), BATCH):
            open_ = first + np.flatnonzero(owner[first : first + BATCH] < 0)
            d = _distances(xs, sq, xs[open_])
            near = d <= node.radius / 2
            alone = near.sum(axis=1) <= 1
            for k, at in enumerate(open_.tolist()):
                if owner[at] >= 0:
                    continue
                if not alone[k]:
                    mine = np.flatnonzero(near[k] & (owner < 0))
                    owner[mine], far[mine] = len(centres), d[k, mine]
                owner[at], far[at] = len(centres), 0.0
                centres.append(at)
        by = np.argsort(owner, kind="stable")
        order[node.start : node.end] = points[by]
        cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(centres)))]
        node.centres, node.starts = xs[centres], node.start + cuts[:-1]
        # Rounding in the distances must not shrink a ball.
        node.radii = np.maximum.reduceat(far[by], cuts[:-1])
        node.radii = np.where(np.diff(cuts) > 1, node.radii * (1 + 1e-9) + 1e-6, 0.0)
        node.norms = np.sqrt(squares[points][centres])
        for k, c in enumerate(centres):
            a, b = node.start + cuts[k], node.start + cuts[k + 1]
            equal = b - a == 1 or bool((xs[by[cuts[k] : cuts[k + 1]]] == xs[c]).all())
            node.radii[k] = 0.0 if equal else node.radii[k]
            child = Node(int(a), int(b), xs[c], float(node.radii[k]))
            node.children.append(child)
            todo.append(child)
    return Tree(root, order)


def search(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, known: np.ndarray | None = None, stats: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, data position, score) of each query's best k in data, rows with the query's
    id left out. data and queries hold whole numbers. known are scores that each query reaches k times
    elsewhere: what is below them is left out. stats counts what was compared and what was not."""
    stats = Counter() if stats is None else stats
    width = max(1, data.shape[1])
    most = max([1.0, *(float(np.abs(a).max(initial=0)) for a in (data, queries))])
    exact = width * most * most < 1 << 53
    product = (lambda a, b: (a @ b.T).astype(np.int64)) if exact else (lambda a, b: a.astype(np.int64) @ b.astype(np.int64).T)
    tree, heads = cover_tree(data), cover_tree(queries)
    # From here on both sides are in their trees' order.
    data, queries = data[tree.order], queries[heads.order]
    ids, query_ids = ids[tree.order], query_ids[heads.order]
    seed = np.full(len(queries), NONE) if known is None else known[heads.order]
    best = np.repeat(seed[:, None], k, axis=1)
    place = np.full((len(queries), k), len(data))
    name = np.append(ids, np.iinfo(np.int64).max)  # of no row: after all others at a tie

    def meet(rows: np.ndarray, cols: np.ndarray) -> None:
        """Compares query rows with data columns, and keeps each row's best."""
        for at in range(0, len(rows), ROWS):
            r = rows[at : at + ROWS]
            score = product(queries[r], data[cols])
            stats["compared"] += score.size
            own = query_ids[r][:, None] == ids[cols][None, :]
            hit = (score >= best[r, -1:]) & ~own
            if score.shape[1] > k:  # nor can what is worse than the k-th here
                kept = np.where(own, NONE, score)
                hit &= score >= np.partition(kept, -k, axis=1)[:, -k][:, None]
            live = np.flatnonzero(hit.any(axis=1))
            if not len(live):
                continue
            r, score, hit = r[live], score[live], hit[live]
            m = min(score.shape[1], int(hit.sum(axis=1).max()))
            col = np.argsort(~hit, axis=1, kind="stable")[:, :m]  # only as many columns as some row has
            taken = np.take_along_axis(hit, col, 1)
            s = np.concatenate([best[r], np.where(taken, np.take_along_axis(score, col, 1), NONE)], 1)
            p = np.concatenate([place[r], np.where(taken, cols[col], len(data))], 1)
            by = np.lexsort((name[p], -np.maximum(s, NONE + 1)), axis=1)[:, :k]
            best[r], place[r] = np.take_along_axis(s, by, 1), np.take_along_axis(p, by, 1)

    def parts(node: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Node]]:
        """Children, or the node itself if it is a leaf: centres, norms, radii, starts, nodes."""
        if node.children:
            return node.centres, node.norms, node.radii, node.starts, node.children
        return node.centre[None], np.sqrt([node.centre @ node.centre]), np.array([node.radius]), np.array([node.start]), [node]

    def spread(nodes: list[Node], chosen: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(nodes[j].start, nodes[j].end) for j in chosen])

    todo: list[tuple[float, Node, Node]] = [(np.inf, heads.root, tree.root)]
    while todo:
        limit, q, r = todo.pop()
        if limit < best[q.start : q.end, -1].min():
            stats["pairs pruned"] += 1
            stats["left out"] += (q.end - q.start) * (r.end - r.start)
            continue
        qc, qn, qr, qs, q_nodes = parts(q)
        rc, rn, rr, _, r_nodes = parts(r)
        bound = qc @ rc.T + np.outer(qr, rn) + np.outer(qn, rr) + np.outer(qr, rr)
        bound += 1e-6 * np.abs(bound) + 1e-6
        worst = np.minimum.reduceat(best[q.start : q.end, -1], qs - q.start)
        open_ = bound >= worst[:, None]
        q_size, r_size = (np.array([n.end - n.start for n in nodes]) for nodes in (q_nodes, r_nodes))
        stats["pairs bounded"] += open_.size
        stats["pairs pruned"] += int((~open_).sum())
        stats["left out"] += int(q_size @ ~open_ @ r_size)
        q_leaf, r_leaf = (np.array([not n.children for n in nodes]) for nodes in (q_nodes, r_nodes))
        # Leaves meet at once, a stretch of queries with all that is open to any of them.
        leaves = np.flatnonzero(q_leaf)
        cuts = np.flatnonzero(np.diff(np.cumsum(q_size[leaves]) // ROWS)) + 1
        for group in np.split(leaves, cuts) if len(leaves) else ():
            cols = np.flatnonzero(open_[group].any(axis=0) & r_leaf)
            rows = group[open_[group][:, cols].any(axis=1)] if len(cols) else cols
            if len(rows):
                both, open_here = spread(q_nodes, rows), open_[np.ix_(rows, cols)]
                stats["left out"] -= int(q_size[rows] @ ~open_here @ r_size[cols])
                meet(both, spread(r_nodes, cols))
        inner = open_ & ~(q_leaf[:, None] & r_leaf[None, :])
        a, b = np.nonzero(inner)
        by = np.argsort(bound[a, b], kind="stable")  # the most promising pair comes next
        todo += [(float(bound[a[i], b[i]]), q_nodes[a[i]], r_nodes[b[i]]) for i in by]
    stats["pairs of points"] += len(data) * len(queries)
    for side, t in (("data", tree), ("query", heads)):
        depths = [d for d, _ in t.nodes()]
        stats[f"{side} nodes"] += len(depths)
        stats[f"{side} depth"] = max(stats[f"{side} depth"], max(depths))
    got = place < len(data)
    row = np.broadcast_to(np.arange(len(queries))[:, None], got.shape)[got]
    return heads.order[row], tree.order[place[got]], best[got]


def _matrix(column: pa.ChunkedArray | pa.Array, scale: float | None) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(scale * flat) if scale else flat).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


FOUND = "query_id long, query_hash long, vec_id long, score long"


def _pair(data: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    names = ["query_id", "query_hash", "vec_id", "score"]
    if not len(data) or not len(queries):
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    ids, query_ids, query_hash, known = (t.column(c).to_numpy() for t, c in ((data, "vec_id"), (queries, "vec_id"), (queries, "hash"), (queries, "known")))
    row, at, score = search(_matrix(data.column("v"), None), ids, _matrix(queries.column("v"), None), query_ids, k, known)
    return pa.table(dict(zip(names, (query_ids[row], query_hash[row], ids[at], score))))


def cell_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of at most `cells` nodes that together cover a sample: those of the cover tree's top, the
    node of most points opened as long as its children still fit, and as many of the next one's largest."""
    nodes = [cover_tree(x).root]
    while True:
        wide = max(nodes, key=lambda n: (n.end - n.start) * bool(n.children))
        if not wide.children or len(nodes) >= cells:
            break
        nodes.remove(wide)
        room = cells - len(nodes)
        nodes += sorted(wide.children, key=lambda n: n.start - n.end)[:room]
    return np.unique(np.array([n.centre for n in nodes]), axis=0)


def _dealt(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows with the nearest centre's number among those of their length, and the distance to it. Where the
    sample had no such length, the one cell's centre is zero."""

    @F.pandas_udf("struct<cell:int,far:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        sizes = vectors.map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = np.array([vectors.iloc[i] for i in at], float).reshape(len(at), d)
            c = centres.get(int(d), np.zeros((1, d)))
            gap = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]
            cell[at] = gap.argmin(axis=1)
            far[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell, "far": far})

    return rows.withColumn("n", nearest("v")).select("*", "n.*").drop("n")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, block_rows: int = 4096, query_rows: int = 1024, cells: int = 256, sample_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of the whole table.

    There are at most `cells` cells for each length of vectors, and one for block_rows of them; a pair of a
    query group and a data block is one task's search.
    """
    spark = vectors.sparkSession
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.size(vector).alias("d"))
    rows = settle(rows.withColumn("hash", F.xxhash64("v")))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id", "hash"), "vec_id").limit(sample_rows).select("d", "v").toArrow()
    sizes = sample.column("d").to_numpy()
    most = min(cells, -(-n // block_rows))
    centres = {int(d): cell_centres(_matrix(sample.filter(pa.array(sizes == d)).column("v"), None), most) for d in np.unique(sizes)}
    dealt = settle(_dealt(rows, centres))
    # A row a length and cell: at most `cells` for each length in the sample, and one for any other.
    balls = dealt.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.sum(F.col("q").cast("int")).alias("nq"), F.max(F.when(F.col("q"), F.col("far"))).alias("rq")).collect()
    pieces = {(b["d"], b["cell"]): -(-b["n"] // block_rows) for b in balls}
    groups = {(b["d"], b["cell"]): -(-b["nq"] // query_rows) for b in balls if b["nq"]}
    centre = lambda b: centres[b["d"]][b["cell"]] if b["d"] in centres else np.zeros(b["d"])
    limits, first = [], []
    for d in {b["d"] for b in balls}:
        cell = [b for b in balls if b["d"] == d]
        c = np.array([centre(b) for b in cell]).reshape(len(cell), -1)
        norm, r = np.sqrt((c * c).sum(axis=1)), np.array([b["r"] for b in cell])
        for i, b in enumerate(cell):
            if b["nq"]:
                product, rq = c @ c[i], b["rq"]
                bound = product + rq * norm + r * norm[i] + rq * r
                limits += [(d, b["cell"], o["cell"], float(x + 1e-6 * abs(x) + 1e-6), pieces[d, o["cell"]]) for o, x in zip(cell, bound)]
                # The first cell to try has more than k rows if any has, and the centre that promises most.
                first.append((d, b["cell"], groups[d, b["cell"]], cell[int(np.lexsort((-product, [o["n"] <= k for o in cell]))[0])]["cell"], 0))
    held = lambda data, schema: F.broadcast(spark.createDataFrame(data, schema))
    piece = F.pmod(F.xxhash64("vec_id", "hash"), F.col("pieces")).cast("int")
    data = dealt.join(held([(*key, p) for key, p in pieces.items()], "d int, cell int, pieces int"), ["d", "cell"]).select("d", "cell", "vec_id", "v", piece.alias("piece"))
    group = F.pmod(F.xxhash64("hash", "vec_id", F.lit(1)), F.col("groups")).cast("int")
    queries = dealt.where("q").dropDuplicates(["vec_id", "hash"]).join(held([(*key, g) for key, g in groups.items()], "d int, cell int, groups int"), ["d", "cell"])
    queries = settle(queries.select("d", F.col("cell").alias("q_cell"), group.alias("q_group"), "vec_id", "hash", "v"))

    def searched(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Best rows of each pair (d, q_cell, q_group, cell, piece); asked has queries with scores known.
        Groups that meet the same data are searched together, up to about query_rows queries at a time."""
        key = ["d", "cell", "piece", "bundle"]
        sizes = asked.groupBy("d", "q_cell", "q_group").agg(F.count("*").alias("size"))
        before = Window.partitionBy("d", "cell", "piece").orderBy("q_cell", "q_group").rowsBetween(Window.unboundedPreceding, -1)
        bundle = F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / query_rows).cast("int")
        pairs = settle(pairs.join(sizes, ["d", "q_cell", "q_group"]).withColumn("bundle", bundle))
        left = data.join(pairs.select(*key).distinct(), key[:3]).select(*key, "vec_id", "v")
        own = [F.col(c).alias(f"q_{c}") for c in key]
        right = asked.join(pairs, ["d", "q_cell", "q_group"]).withColumnRenamed("q_cell", "from_cell").select(*own, "vec_id", "hash", "v", "known")
        return left.groupBy(*key).cogroup(right.groupBy(*(f"q_{c}" for c in key))).applyInArrow(lambda a, b: _pair(a, b, k), FOUND)

    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    tried = spark.createDataFrame(first, "d int, q_cell int, groups int, cell int, piece int").withColumn("q_group", each("groups")).drop("groups")
    seeds = searched(tried, queries.withColumn("known", F.lit(NONE)))
    kth = seeds.groupBy("query_id", "query_hash").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") >= k)
    on = (F.col("vec_id") == F.col("query_id")) & (F.col("hash") == F.col("query_hash"))
    asked = settle(queries.join(kth, on, "left").select(*queries.columns, F.coalesce("least", F.lit(NONE)).alias("known")))
    worst = asked.groupBy("d", "q_cell", "q_group").agg(F.min("known").alias("worst"))
    open_ = worst.join(held(limits, "d int, q_cell int, cell int, most double, pieces int"), ["d", "q_cell"]).where("most >= worst")
    found = searched(open_.select("d", "q_cell", "q_group", "cell", each("pieces").alias("piece")), asked)
    by = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
