"""Shared-folder scratch space, size-checked broadcasts, joins with hot keys, and column-name hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables that this driver has written and not yet removed, oldest first.
_written: list[str] = []
#: A key of a join is hot with more rows than HOT_ROWS, or than all rows by HOT_KEYS: so there are at most HOT_KEYS such.
HOT_KEYS, HOT_ROWS = 50_000, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, it is a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint. For narrow, small results."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Write a compressed scratch table into the shared folder and read it back. For wider intermediate results.

    The folder is named ``docloom-<uuid>`` below the checkpoint folder and stays until ``clear``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point from which ``clear`` may remove scratch tables."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the scratch tables written since ``mark()``, but for the last ``keep``.

    To be called when what was built on them has been written: a DataFrame that still reads them fails afterwards.
    """
    last = len(_written) - keep
    for path in _written[since:last]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del _written[since:last]


def small(df: DataFrame, max_rows: int, array: str | None = None, max_items: int = 0) -> DataFrame:
    """Hint a broadcast of ``df`` if it is proven to have at most ``max_rows`` rows; else leave the join to a shuffle.

    With ``array``, the items of that column are counted too and may be ``max_items`` in all. ``df`` should be cut or
    written already, as it is counted.
    """
    if array is None:
        return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
    rows, items = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(array)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and items <= max_items else df


def hot_limit(rows: int) -> int:
    """From how many rows on a key is hot, where there are ``rows`` in all."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def salted_join(rows: DataFrame, side: DataFrame, on: list[str], by: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows.join(side, on, how)``, inner or left, with the hot keys of ``rows`` dealt over several tasks.

    A hot key's rows are spread by a hash of ``by`` (which should differ among them), its rows of ``side`` repeated for
    each part: at most HOT_KEYS repeats in all, so ``side`` may be wide. ``counts(on…, n)``, if it is known already, tells
    the rows of each key. The keys must not be null.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = hot_limit(total or 0)
    if (most or 0) <= limit:
        return rows.join(side, on, how)
    hot = cut(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    hot = F.broadcast(hot)
    part = F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("_salt", part).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    side = side.join(hot, on, "left").withColumn("_salt", F.explode(parts)).drop("_parts")
    return dealt.join(side, [*on, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever extra columns it carries."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of text in one Arrow batch, where the session leaves Spark's default.
BATCH_ROWS = "1000"


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold few enough rows of text for small executors.

    Only Spark's default of 10,000 rows, meant for narrow rows, is replaced; a value that the session has set stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df
