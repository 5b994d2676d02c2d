"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java / RE2 class of the word separators used by the word-based operators.
WS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names; only where that is unset and the
    master is local (tests) a folder of the driver's own is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        named = spark.sparkContext.getCheckpointDir()
    # with its scheme, so that Python workers reach the same store as Spark does
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.startswith("file:/") and not whole.startswith("file://"):
        whole = "file://" + whole[len("file:") :]
    return whole.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; a stopped session is left alone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone, so is the need
        return


def materialize(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage,
    computes once, and survives the loss of any executor.  At most ``tasks`` files are written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def return_heap(spark: SparkSession) -> None:
    """Executors collect their garbage, so that the heap that finished work filled goes
    back to the system before other work (Python workers, say) needs the memory.

    A JVM keeps a heap that it once grew until a full collection, which may never come.
    A short task a core asks for one; those that an executor runs at once share it.  It
    has no bearing on results; a JVM told to ignore such requests keeps its heap.
    """
    cores = spark.sparkContext.defaultParallelism
    asked = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("asked"))
    asked.write.format("noop").mode("overwrite").save()


#: Bytes of input for each task that writes rows of about that size, and the most tasks that Spark can be asked for.
TASK_BYTES, MOST_TASKS = 8 << 20, (1 << 31) - 1


def tasks_for(df: DataFrame, times: int = 1) -> int:
    """``times`` a task for each ``TASK_BYTES`` of ``df`` by Spark's estimate, one a core at least.

    For ``coalesce``, which never raises a number: where the session asks for many more
    partitions than the rows fill, each would be a file, and an executor starts
    processes (``chmod``) for every file that it writes to a local disk.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, times * -(-size // TASK_BYTES)), MOST_TASKS)


#: A join sends at most so many hot keys to every task.
HOT_KEYS = 10_000


def hot_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined to ``few``, one row a key with the number ``n`` of rows it meets.

    Keys that meet over one in ``HOT_KEYS`` rows (so fewer than ``HOT_KEYS`` of them)
    are broadcast, and their rows stay where they are; the other keys, of which none
    is hot, are joined by a shuffle.  Give tables that are cheap to read twice.
    """
    total, most = few.agg(F.sum("n"), F.max("n")).first()
    least = max(1000, (total or 0) // HOT_KEYS + 1)
    if (most or 0) < least:
        return rows.join(few.drop("n"), keys, how)
    cold = few.filter(F.col("n") < least).drop("n")
    hot = F.broadcast(few.filter(F.col("n") >= least).drop("n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys, how))


#: Bits of a bitmap for each key in it, and the most bits of one (16 MB, the bound of its broadcast).
BITS_A_KEY, MOST_BITS = 16, 1 << 27


def maybe_in(rows: DataFrame, some: DataFrame, keys: list[str], hit: str) -> DataFrame:
    """``rows`` with a boolean ``hit``: false only where ``keys`` are not in ``some``.

    A bitmap of the hashed keys is built in the executors and broadcast, so that of
    rows with long texts only those that may be wanted are shuffled by an exact join
    behind it.  One in ``BITS_A_KEY`` others hits too; beyond ``MOST_BITS`` bits more
    do, which costs shuffle but never a row.
    """
    size = 1 << 15
    wanted = BITS_A_KEY * some.count()
    while size < min(wanted, MOST_BITS):
        size *= 2

    def place(table: DataFrame) -> DataFrame:
        return table.withColumn("__at", F.pmod(F.xxhash64(*keys), F.lit(size)) + 1)

    bits = place(some).groupBy(F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits"))
    placed = place(rows).withColumn("__bucket", F.bitmap_bucket_number("__at")).withColumn("__bit", F.bitmap_bit_position("__at").cast("int"))
    byte = F.expr("cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)")
    found = F.coalesce(F.getbit(byte, F.col("__bit") % 8) == 1, F.lit(False))
    return placed.join(F.broadcast(bits), "__bucket", "left").withColumn(hit, found).drop("__at", "__bucket", "__bit", "__bits")


def keep_named(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all columns of ``docs``.

    ``marked(doc_id, k, component_id, component_k)`` tells each row's group and the
    group's chosen (doc_id, MD5 of the text).  Only keys are shuffled to find what
    goes, and of the texts only those that may go; rows of one (doc_id, text) become
    one, rows without a doc_id stay.
    """
    names = ["__doc", "__key"]
    ours = docs.select("*", F.col("doc_id").cast("long").alias("__doc"), text_key(F.col("text")).alias("__key"))
    keys = marked.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__doc"), F.col("k").alias("__key"))
    known = materialize(
        keys.agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("c"), F.first("component_k").alias("ck"))
        .select("__doc", "__key", "n", ((F.col("__doc") == F.col("c")) & (F.col("__key") == F.col("ck"))).alias("chosen"))
        .filter(~F.col("chosen") | (F.col("n") > 1)),
        "decided",
    )
    told = maybe_in(ours, known, names, "__hit")
    maybe = told.filter("__hit")
    other = maybe.join(known.select(*names), names, "left_anti")
    repeated = maybe.join(known.filter("chosen").select(*names), names, "left_semi").dropDuplicates(names)
    kept = [found.select(*docs.columns) for found in (told.filter("not __hit"), other, repeated)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of some ``BATCH_BYTES``, so that executor and worker
    hold megabytes of texts of any length.  The session's setting is read when the plan
    runs, so it is changed and stays so; one that isn't Spark's default is left alone."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def text_key(text: Column) -> Column:
    """MD5 of a text's bytes; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A higher-order function re-evaluates what its lambda captures for every
    element; binding the value to a lambda variable prevents that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of ``text`` (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != F.lit(""))


def worker_state(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks.

    A worker keeps the state of one owner at a time, so the caches of one
    operator don't burden the next one that the worker runs.
    """
    name = "_scriptorium_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    held = sys.modules[name].__dict__
    if held.get("owner") != owner:
        held.pop("state", None)
        held["owner"] = owner
    return held.setdefault("state", {})
