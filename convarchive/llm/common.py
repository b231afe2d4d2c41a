"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as a Java character class: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas inside ``body`` use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one is set in local mode only."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: lineage ends here, any executor may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``kept``, as Parquet: smaller for wide rows, and read with column pruning."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, row: str = "__row") -> DataFrame:
    """``df`` with a number for each row, written once to the shared folder and dealt by that number.

    A number that is taken anew in each job may move to another row when executors come or go; this one is
    read from the files. Joins on it need no further shuffle of ``df``. Reading happens through a table name of
    this session, without which Spark doesn't use how the files are dealt.
    """
    spark, name = df.sparkSession, f"numbered_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(row, F.monotonically_increasing_id()).repartition(n, row)
    dealt.write.format("parquet").bucketBy(n, row).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def give_back() -> None:
    """Gives free memory of this Python process back to the system, where the C library knows how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _aside(columns: list[str], names: tuple[str, ...]) -> dict[str, str]:
    """What columns called like one of ``names`` (in any case) are called instead."""
    wanted = {n.lower() for n in names}
    taken, out = {c.lower() for c in columns} | wanted, {}
    for column in columns:
        if column.lower() in wanted:
            to = column + "_input"
            while to.lower() in taken:
                to += "_input"
            taken.add(to.lower())
            out[column] = to
    return out


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its columns that are called like one of ``names`` kept under that name and ``_input`` (as often as needed)."""
    return df.withColumnsRenamed(_aside(df.columns, names))


def put_back(df: DataFrame, before: DataFrame, names: tuple[str, ...], inner: tuple[str, ...]) -> DataFrame:
    """Columns that ``set_aside(before, *names)`` renamed for ``inner`` ones of these names, under their own name again."""
    wanted = {n.lower() for n in inner}
    return df.withColumnsRenamed({to: c for c, to in _aside(before.columns, names).items() if c.lower() in wanted})


def inputs(df: DataFrame, before: DataFrame, *names: str) -> DataFrame:
    """The columns of ``before`` under their own names, out of a result for which ``names`` were set aside."""
    to = _aside(before.columns, names)
    return df.select(*[F.col(f"`{to.get(c, c)}`").alias(c) for c in before.columns])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
