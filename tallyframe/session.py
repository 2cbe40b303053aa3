"""Session helpers: local sessions for tests, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size (bytes) of a side that may be broadcast by `small`; beyond it the join shuffles.
BROADCAST_LIMIT = 48 << 20
#: An estimate beyond this (bytes) is a product of estimates, not a size.
UNREAL_SIZE = 1 << 50


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; only where it is unset and all runs on one machine (tests) take a temporary one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallyframe-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written copy.

    The copy would keep the size the optimizer estimated for `df` and the constraints it derived. In a loop of joins both
    grow with every round (the size to numbers of thousands of digits), until planning takes longer than the work. So
    no constraints are derived here, and an estimate beyond any real size is forgotten.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get("spark.sql.constraintPropagation.enabled")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    try:
        out = df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.constraintPropagation.enabled", before)
    if estimated_bytes(out) > UNREAL_SIZE:
        j = out._jdf
        bare = j.sparkSession().internalCreateDataFrame(j.queryExecution().toRdd(), j.schema(), False)
        return DataFrame(bare, spark)
    return out


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast of `df` if its estimated size is within `limit`; otherwise leave the join to shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def gathered(df: DataFrame) -> DataFrame:
    """`df` in at most as many partitions as a shuffle makes: a union that grows by a part per round would double its tasks in every round."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
