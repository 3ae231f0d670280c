"""Session defaults and the one place that decides where checkpoints live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "petrichor", master: str | None = None) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in DEFAULTS.items():
        b = b.config(key, value)
    return b


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A private folder is only made for local masters (tests): executors of a real cluster could not
    read it, and a lost executor would take the checkpoint with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def estimated_bytes(df: DataFrame) -> int:
    """Size of a materialised table: eight bytes a column and row, and the text of what has no fixed width."""
    loose = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct", "variant")]
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in loose]))) if loose else F.lit(0)
    return int(df.agg(F.coalesce(F.sum(text + 8 * len(df.columns)), F.lit(0)).alias("n")).first()["n"])


def small_side(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint behind a check: the table is materialised and measured, and past ``max_bytes`` it stays a plain side.

    Used where a wide row table meets one row per channel, lead or cell: without the hint the wide side would be shuffled
    on a handful of hot keys. A table past the bound has as many keys as its size implies; the shuffle join that it
    then gets is one that adaptive execution splits at hot keys (``DEFAULTS`` turns that on).
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if estimated_bytes(kept) <= max_bytes else kept


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes row placement for later passes."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, keep: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder, in folders of the columns ``by``, and read again.

    For loops: a checkpointed frame keeps the size that the optimizer estimated for it, and an estimate that goes through a join
    in each round is multiplied each time, until planning takes longer than the work. A table read from files is as large as its
    files. ``keep`` gets the path, for ``dropped`` once a later table stands.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
