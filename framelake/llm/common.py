"""Shared pieces of the training-data operators.

Conventions used by every operator in this subpackage:

* a *word* is a maximal run of characters other than U+0020 and U+0009 to U+000D;
* a null text is an empty text;
* input columns that an operator does not use are ignored, or travel in one struct
  (``packed``), so extra columns and clashing names never reach its internal joins;
  where an operator adds columns, an input column of the same name gives way;
* broadcast values are plain arrays, lists and dicts, so executors need no library;
* intermediate tables that cut lineage are written below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class (fixed value).
SPACE = r"[\x20\x09-\x0D]"
#: One word, as a regular expression (fixed value).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of text in an Arrow batch.
ARROW_ROWS = 500

#: The folder of each local application without a setting.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on this machine alone (a local test) may leave it unset; it then
    gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # the setting is fixed once a session runs, so the folder is remembered here
        app = spark.sparkContext.applicationId
        found = _local_dirs.get(app) or "file://" + tempfile.mkdtemp(prefix="framelake-")
        _local_dirs[app] = found
    return found.rstrip("/")


def staged(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs only the tasks that read it next."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, file: str, text: str) -> None:
    """A small file in the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode()))
    out.close()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, and what is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table made by ``staged`` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(root) or root.removeprefix("file://") in folder:
            delete_folder(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, name: str, value) -> Iterator[None]:
    """A session setting for the queries that run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers a few hundred at a time: rows here are texts of
    kilobytes, and Spark's default of 10,000 rows makes batches of tens of megabytes
    on both sides. The setting is read when the query runs, so it stays set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **named: str | Column) -> DataFrame:
    """Each row as one struct ``_doc``, beside the named columns, so that no column of
    ``df`` meets a name that an operator uses."""
    more = [(F.col(quoted(c)) if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    return df.select(F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns]).alias("_doc"), *more)


def unpacked(df: DataFrame, own: list[str], added: list[str]) -> DataFrame:
    """The columns of ``_doc`` and the added ones; an own column of an added one's name gives way."""
    return df.select(*[F.col("_doc." + quoted(c)).alias(c) for c in own if c not in added], *added)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column = "text") -> Column:
    """Number of words (long)."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_safe(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def uniform(seed: int, *cols: Column) -> Column:
    """A reproducible number in [0, 1) from the first 52 bits of an MD5 digest."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def ranked(df: DataFrame, order: list[Column], name: str, out: str = "rank") -> DataFrame:
    """``df`` with a global row number from 0 in the given order.

    No task holds all rows: rows are dealt by range, each part is numbered by
    itself, and the parts' row counts (one number a part) give the offsets.
    """
    # without a number of parts, small tables come in few parts and files
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, name)
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    from pyspark.sql import Window

    window = Window.partitionBy("_part").orderBy(*order)
    local = dealt.withColumn(out, F.row_number().over(window).cast("long") - 1)
    if not offsets:
        return local.drop("_part")
    base = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
    return local.withColumn(out, F.col(out) + base[F.col("_part")]).drop("_part")
