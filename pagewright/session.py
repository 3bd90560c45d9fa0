"""Session helpers: defaults, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays below this.
BROADCAST_LIMIT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (a single small file) dealt out to all cores; any other as it is.

    Large tables have more splits than cores and are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def local_session(app: str = "pagewright", cpus: str | int | None = None) -> SparkSession:
    """A single-machine session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a folder of our own only on one machine.

    On a cluster the folder must be one that all machines share, so without
    the setting this fails.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagewright-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_round(df: DataFrame) -> DataFrame:
    """Checkpoint for tables that are joined with themselves round by round.

    A checkpoint keeps the planner's estimate of its size.  A join's estimate
    is the product of its sides, so over rounds its digits double each time
    until they fill the driver; here nothing is carried on.
    """
    kept, spark = checkpoint(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` when ``rows`` (measured by the caller) times ``row_bytes`` is small,
    else leave the choice of a shuffle join to the planner."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


#: Parts into which a key's rows are split where a side is too large to be broadcast.
JOIN_SALTS = 16


def keyed_join(large: DataFrame, small: DataFrame, key: str, row_bytes: int, how: str = "inner", salt_by: str = "result_id") -> DataFrame:
    """Join with one row per key of ``small``, which must be cheap to count.

    ``small`` is broadcast if its measured size allows; else every key's rows
    are split by ``salt_by`` over JOIN_SALTS tasks, so that no hot key meets
    in one.
    """
    if small.count() * row_bytes <= BROADCAST_LIMIT_BYTES:
        return large.join(F.broadcast(small), key, how)
    salted = small.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return large.withColumn("join_salt", F.pmod(F.xxhash64(salt_by), F.lit(JOIN_SALTS)).cast("int")).join(salted, [key, "join_salt"], how).drop("join_salt")


def site_of(url):
    """Host of a URL column: lower-cased, without user, port and a leading ``www.`` or ``m.``.

    A null URL or one without a host gives null.
    """
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.when(F.length(host) > 0, F.lower(F.trim(host)))
    return F.regexp_replace(host, r"^(?:www\.|m\.)", "")
