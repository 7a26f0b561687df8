"""Helpers shared by the training-data operators.

Intermediate tables go below the folder named by ``spark.checkpoint.dir``:
every executor can read it, so a lost executor never takes results along.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest table, in rows, that is broadcast; callers count before they do.
BROADCAST_ROWS = 50_000
#: Keys that are told by broadcast, at most, for each shuffle partition.
HOT = 4

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is named, one in the warehouse, or a temporary one in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        found = "file://" + tempfile.mkdtemp(prefix="paperloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/paperloom-staged"
        if not local and re.match(r"file:|/", found):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}/{name}"
    _left.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that no later plan reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _left[:] = [x for x in _left if x[1] != path]


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@atexit.register
def _drop_left() -> None:
    for spark, path in list(_left):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver collects garbage; ask for it between rounds."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` does just that on pure ASCII and is far cheaper than ``translate``."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """All words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def join_by_key(rows: DataFrame, known: DataFrame, key: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` beside ``known``, which has one row of each ``key`` and in ``_n`` how many of ``rows`` have it.

    A key of more than 1 / (HOT x partitions) of all rows is told by broadcast, so its
    rows stay where they are; there are at most HOT x partitions such keys, whatever
    the size of the input.  The rest meet by shuffle.
    """
    many = F.lit(n_rows / (HOT * shuffle_partitions(rows.sparkSession)))
    hot, cool = known.where(F.col("_n") > many).drop("_n"), known.where(F.col("_n") <= many).drop("_n")
    # A null key is in neither table: the anti join leaves it to the second branch.
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool.hint("merge"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
