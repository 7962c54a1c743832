"""What the operators share: reading tables, cutting lineage, words, components of a graph."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Staging folder of each application of this process.
_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: in spark.checkpoint.dir, which every machine of a cluster
    sees. Where that is unset, a temporary folder takes its place if all of Spark runs in this process;
    on a cluster that would scatter the rows over the machines, so there it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="pagecrest-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        _roots[app] = f"{shared.rstrip('/')}/pagecrest-{app}"
        atexit.register(clear_staging, spark)
    return _roots[app]


def clear_staging(spark: SparkSession) -> None:
    """Removes this application's intermediate tables; nothing that reads them may still be in use.
    Once Spark has stopped, only those in a folder that this machine sees can go."""
    for app, root in list(_roots.items()):
        if spark.sparkContext._jsc is None:
            shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        elif app == spark.sparkContext.applicationId:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        else:
            continue
        del _roots[app]


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, nothing is computed twice,
    and a lost executor takes no rows with it."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for df in settled:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def release() -> None:
    """Gives freed memory of this Python worker back to the system, between large blocks of work."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def bucket_of_id(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Keys that may be broadcast because each has more than this part of all rows.
HOT_KEYS = 1000


def join_one(many: DataFrame, one: DataFrame, key: str, n: int | None = None, least: int = 100_000) -> DataFrame:
    """many joined with one, a settled table with one row a key. Keys with over `least` rows of many and over
    a HOT_KEYS-th part of all of them do not gather in one task: there are fewer than HOT_KEYS of them,
    so their rows of one are broadcast. many is read twice and should be settled."""
    n = many.count() if n is None else n
    if n <= least:
        return many.join(one, key)
    counts = many.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max(least, n // HOT_KEYS))
    hot = settle(one.join(F.broadcast(counts), key, "left_semi"))
    if not hot.take(1):
        return many.join(one, key)
    cool = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one, key)
    return many.join(F.broadcast(hot), key).unionByName(cool)


def ranked(rows: DataFrame, by: list[str], spread: Column, pieces: int, order: list[Column], out: str) -> DataFrame:
    """rows, which are settled, with `out`: each row's number among those alike in `by`, from 0. They are
    dealt into pieces by the hash `spread`, so that no group, however large, is numbered in one task: a
    piece's rows are counted first, then numbered from the sum of the counts before it."""
    piece, before, row = (fresh(rows, x) for x in ("piece", "before", "row"))
    dealt = rows.withColumn(piece, F.pmod(spread, F.lit(pieces)))
    counts = dealt.groupBy(*by, piece).agg(F.count("*").alias(before))
    sums = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumn(before, F.coalesce(F.sum(before).over(sums), F.lit(0))))
    own = Window.partitionBy(*by, piece).orderBy(*order)
    numbered = dealt.withColumn(row, F.row_number().over(own) - 1)
    same = [fresh(numbered, f"same_{k}") for k in range(len(by) + 1)]
    counts = counts.select(*(F.col(c).alias(s) for c, s in zip([*by, piece], same)), before)
    on = [F.col(c).eqNullSafe(F.col(s)) for c, s in zip([*by, piece], same)]
    return numbered.join(counts, on).withColumn(out, (F.col(before) + F.col(row)).cast("long")).drop(piece, before, row, *same)


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with `row`, each one's number in the order from 1, and the sum of columns over the rows before it:
    sums names the new columns and those summed. Rows are dealt by ranges of the order, so none of this
    happens in one task; the order should leave few ties."""
    part = fresh(rows, "part")
    n = partitions(rows.sparkSession)
    dealt = settle(rows.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    # One row a partition.
    ends = dealt.groupBy(part).agg(F.count("*").alias("row"), *(F.sum(c).alias(k) for k, c in sums.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = {k: fresh(rows, f"{k}_before") for k in ("row", *sums)}
    ends = ends.select(part, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(v) for k, v in names.items()))
    own = Window.partitionBy(part).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({"row": F.row_number().over(own)} | {k: F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()})
    out = out.join(F.broadcast(ends), part).withColumns({k: F.col(k) + F.col(v) for k, v in names.items()})
    return settle(out.drop(part, *names.values()))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest node reachable from each node that has an edge: (node, root), longs.

    Alternating large-star and small-star steps: each step points neighbours at the smallest one
    known, so paths of any length halve, and no node's neighbours are ever gathered in one place:
    minima are aggregates, partly done before the shuffle, and a hub's edges meet its minimum by a
    broadcast. What a step replaces is removed.
    """
    stars = settle(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u <> v").distinct()
    )
    seen, n = None, stars.count()
    while True:
        both = stars.union(stars.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = join_one(both.where("v > u"), low, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct())
        discard(low, stars)
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = join_one(large, low, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = settle(small.where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(low, large)
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    roots = stars.select("v").distinct().select(F.col("v").alias("u"), "v")
    return stars.union(roots).toDF("node", "root")
