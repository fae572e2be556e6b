"""Shared folders, materialised steps, row numbers and size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Joins broadcast a side only when its rows take at most this many bytes in memory.
BROADCAST_LIMIT = 4 << 20
#: Up to this many files get their numbers from a literal map; more from a joined table.
LITERAL_FILES = 4096
#: Bits of a row number that count the rows of one file.
ROW_BITS = 40

#: Rows of documents and pages are large, so that Spark's default of 10000 rows in an
#: Arrow batch would make tens of MB at once in every Python worker.
BATCH_ROWS = "1000"
#: Plans that hold literal tables print as many MB of text, which the driver would build
#: for every event of a query.
PLAN_CHARS = "262144"


def bound_session(spark: SparkSession) -> None:
    """Smaller Arrow batches and plan texts, unless the session has sizes of its own."""
    for key, default, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.maxPlanStringLength", str(2**31 - 16), PLAN_CHARS)):
        if spark.conf.get(key).removesuffix("b") == default:
            spark.conf.set(key, bound)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a local session
    gets a temporary folder of its own and a cluster gets one in the warehouse.
    """
    bound_session(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="scoremap-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scoremap/{uuid.uuid4().hex}"


def _row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row in memory: a word per field and what strings and lists hold."""
    total = F.lit(8 * (len(schema) + 1)).cast("long")
    for f in schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            total = total + F.coalesce(F.length(F.to_json(F.struct(col))), F.lit(0))
    return total


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps
    start from files that survive the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    flat = all(isinstance(f.dataType, T.AtomicType) for f in df.schema)
    seen = Observation()
    (df.observe(seen, F.sum(_row_bytes(df.schema)).alias("bytes")) if flat else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._materialized_path, out._row_bytes = path, (seen.get.get("bytes") or 0) if flat else None
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of finished steps: it removes those
    only after the driver has collected its garbage, which may take hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame, collect: bool = False) -> None:
    """Delete the files of materialised frames that nothing reads any more, and with
    ``collect`` release shuffle files too."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._materialized_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if collect:
        release(frames[0].sparkSession)


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A materialised frame with a broadcast hint if its rows took at most ``limit``
    bytes when it was written; beyond that, and for nested columns, Spark chooses."""
    size = df._row_bytes
    return F.broadcast(df) if size is not None and size <= limit else df


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a file that is read, projected or
    filtered at most, so that file and place name it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    try:
        return plan.nodeName() == "LogicalRelation" and "row_index" in df.select(df.metadataColumn("_metadata").alias("m")).schema["m"].dataType.names
    except AnalysisException:
        return False


def row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows, the same in every job and for every way that Spark splits the
    files: number of the file in the order of paths, then place in it (so numbers of
    differently filtered frames over many files do not compare). A frame that is
    no plain read of Parquet files is numbered by partition instead, and has to give
    the same partitions each time (else pass it through ``materialize`` first)."""
    if not _is_scan(df):
        return df.withColumn(name, F.monotonically_increasing_id())
    meta, n = df.metadataColumn("_metadata"), len(df.inputFiles())
    path, place = meta["file_path"], meta["row_index"]
    if n <= 1:
        return df.withColumn(name, place)
    paths = df.select(path.alias("path")).distinct()
    if n <= LITERAL_FILES:
        buckets: list[list[tuple[str, int]]] = [[] for _ in range(n)]
        found = paths.select("path", F.pmod(F.crc32("path"), F.lit(n)).cast("int").alias("bucket")).collect()
        for k, r in enumerate(sorted(found, key=lambda r: r["path"])):
            buckets[r["bucket"]].append((r["path"], k))
        maps = F.array(*[F.create_map(*[F.lit(x) for pair in b for x in pair]) if b else F.create_map().cast("map<string,int>") for b in buckets])
        number = F.get(maps, F.pmod(F.crc32(path), F.lit(n)).cast("int"))[path]
        return df.withColumn(name, F.shiftleft(number.cast("long"), ROW_BITS) + place)
    known = materialize(paths.withColumn("_file", F.row_number().over(Window.orderBy("path")).cast("long")), "files")
    at = free_name(df, "_path")
    return df.withColumns({at: path, name: place}).join(small_side(known).withColumnRenamed("path", at), at).withColumn(name, F.shiftleft("_file", ROW_BITS) + F.col(name)).drop(at, "_file")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have (names differ by case at least)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def without_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``row_id`` is in the materialised ``_rid``."""
    name = free_name(df, "_rid")
    return row_id(df, name).join(small_side(dropped).withColumnRenamed("_rid", name), name, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
