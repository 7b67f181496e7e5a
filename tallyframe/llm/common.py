"""What the corpus operators share: scratch tables, joins that stand skew, and the word pattern."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, for Java's, DuckDB's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes of their columns as stored or estimated, up to which a lookup table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20

#: A key is hot if it holds more than one row in so many; there are at most this many hot keys.
HOT_SHARE = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables; one of our own only where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else ""
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} shares: intermediate tables are written there")
        found = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Places in scratch folders that this process has named and not discarded.
_places: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared scratch folder. What is written there stays until discard() or discard_all()."""
    path = f"{scratch_dir(spark)}/tallyframe/{name}-{uuid.uuid4().hex}"
    _places.add(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared scratch folder and reads it back, which cuts the lineage.

    Lost executors cost nothing that has been saved, and each reader sees the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> None:
    """Gives native memory that the driver's JVM has freed back to the machine, of which malloc keeps hundreds of MB over many queries.

    Only HotSpot on glibc knows how, from Java 17.0.9 on; any other JVM keeps it.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, values = new_array(jvm.java.lang.Class, len(kinds)), new_array(jvm.java.lang.Object, len(kinds))
    for i, kind in enumerate(kinds):
        types[i] = named(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by the interface's method, as the server's own class is closed to callers
        named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries, which it does when the driver collects its garbage, else half-hourly.

    The driver's heap shrinks to what it holds, and with trim_driver() its native memory.
    """
    gc.collect()
    spark._jvm.System.gc()
    trim_driver(spark)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a place in the scratch folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _places.discard(path)


def places_of(df: DataFrame) -> set[str]:
    """The places in the scratch folder that df reads."""
    names = set(re.findall(r"/tallyframe/([^/]+)/", "\n".join(df.inputFiles())))
    return {p for p in _places if p.rsplit("/", 1)[1] in names}


def discard_read(df: DataFrame) -> None:
    """Deletes the saved tables that df reads, once nothing else will."""
    for path in places_of(df):
        discard(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what has been saved in it, but for what is read by the DataFrames that the given function has got."""
    before, kept = set(_places), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(places_of(df))
        return df

    yield keep
    for path in _places - before - kept:
        discard(spark, path)


def discard_all(spark: SparkSession) -> None:
    """Deletes all that this process has saved, once the results that read it have been written."""
    for path in list(_places):
        discard(spark, path)


#: Bytes of an Arrow batch that goes to a Python worker: rows hold whole texts, and a task holds a few batches.
BATCH_BYTES = 4 << 20


def _hand_back() -> None:
    """Gives memory that is free in this process back to the machine: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow() in batches of at most BATCH_BYTES, or one row; the session keeps that bound, or a lower one that it has."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    found = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not found or not 0 < int(found[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _hand_back()

    return df.mapInArrow(tidy, schema)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df is small enough for a broadcast: by what the plan says of its bytes, and then by a count of at most rows + 1 rows.

    Of a table from saved() the plan knows the bytes of its files; of what follows from it by joins it may say too much.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size and df.limit(rows + 1).count() <= rows


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def nested(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name in them can clash with a work column's."""
    return F.struct(*[quoted(c).alias(c) for c in df.columns])


def of_row(name: str) -> Column:
    """A column of the struct column `row`."""
    return F.col("row").getField(name)


def unnested(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of the struct column `row`, some of them changed."""
    return df.select(*[(changed or {}).get(c, of_row(c)).alias(c) for c in columns])


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 64) -> DataFrame:
    """Joins big to small, which has one row a key, nulls matching nulls.

    small is broadcast if it fits(). Otherwise each of its rows is
    repeated for `salts` salts and big is dealt by key and salt, so that a hot key meets many tasks.
    """
    right = small.select([F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in small.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    gone = [f"__k_{c}" for c in keys]
    if how in ("left_semi", "left_anti"):
        gone = []
    if fits(small):
        return big.join(F.broadcast(right), on, how).drop(*gone)
    right = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__salt_l", F.pmod(F.xxhash64(*[F.col(f.name) for f in big.schema.fields if f.dataType.typeName() not in ("map", "struct", "array", "variant")]), F.lit(salts)).cast("int"))
    return left.join(right, [*on, F.col("__salt_l") == F.col("__salt_r")], how).drop(*gone, "__salt_l", "__salt_r")


def hot_split_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows to keyed (one row a key, `count` rows of it in `rows`, none of them null).

    Keys with over total / HOT_SHARE rows number fewer than HOT_SHARE, whatever the data: those are broadcast.
    The others are joined by shuffle, from which the rows of hot keys are left out, so no key is hot there. Of a thousand
    rows no key is hot.
    """
    if total <= 1_000:
        return rows.join(keyed, keys)
    limit = max(100, total // HOT_SHARE)
    hot, cold = keyed.filter(F.col(count) > limit), keyed.filter(F.col(count) <= limit)
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(cold, keys))


def hot_fetch(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the columns of values, which has one row a key, for the keys that both have; any key may be hot in rows, a saved table."""
    asked = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__asked"))
    return hot_split_join(rows, values.join(asked, key), [key], "__asked", rows.count()).drop("__asked")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether the id's remainder is `rest`; a null id is not held out."""
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))
