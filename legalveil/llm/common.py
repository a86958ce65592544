"""What the operators share: words, folds, scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BITMAP = 24  # log2 of the bits of among()


_local: dict[str, str] = {}  # by application, where no folder is named


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a local one serves a
    session of one machine, as in tests; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="legalveil-")
        found = _local[app]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost
    executor loses nothing. The table goes when the session's process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/legalveil/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(dropped, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._legalveil_path = path
    return out


def dropped(spark: SparkSession, table: DataFrame | str) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = table if isinstance(table, str) else table._legalveil_path
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is over: its folder is the cluster's to clean
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(id_col.cast("string")) % F.lit(divisor)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def among(docs: DataFrame, keyed: DataFrame, bits: int = BITMAP) -> DataFrame:
    """docs with ``maybe``: whether k may be in keyed. The bitmap has 2 ** bits bits, whatever the
    input, so it may be broadcast; texts without a repeat then need no shuffle."""
    word = lambda c: F.pmod(F.shiftrightunsigned(c, 6), F.lit(1 << (bits - 6)))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    table = keyed.groupBy(word(F.col("k")).alias("__lv_word")).agg(F.bit_or(bit("k")).alias("__lv_bits"))
    d = docs.withColumn("__lv_word", word(F.col("k"))).join(F.broadcast(table), "__lv_word", "left")
    return d.withColumn("maybe", F.coalesce(F.col("__lv_bits").bitwiseAND(bit("k")) != 0, F.lit(False))).drop("__lv_word", "__lv_bits")
