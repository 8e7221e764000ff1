"""Tables written on the way, in the folder that driver and executors share, and column names that nobody uses."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of one row of bits in a mask, which is for eight times as many numbers, and most bytes of a mask that goes to all tasks.
MASK_ROW, MASK_BYTES = 4096, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session (tests) may leave it unset; a cluster that does is an error, as a
    machine-local folder would lose rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{LOCAL_CHECKPOINTS}/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that ran on it, and what was
    costly or drawn from a sample is never computed a second time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "codeloom-" in folder.getName():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that no DataFrame needs any more: its cleaner acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def bucketed(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write df to a path in as many buckets of a column as there are shuffle partitions and read it back, so that a join by this
    column moves only the other side. The name in the catalog that this takes is given up at once; the files stay."""
    spark, name = df.sparkSession, f"spark_catalog.default.codeloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)  # a table's relative path would be one below the warehouse
    try:
        df.write.format("parquet").bucketBy(buckets, by).option("path", at.toString()).option("compression", "zstd").saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def chosen(rows: DataFrame, number: str, keys: DataFrame) -> DataFrame:
    """The rows whose number is one of those in keys (in a column of that name). Wide rows aren't moved for it: keys go to all tasks,
    a bit for each number, if that is within MASK_BYTES (checked), as it is for numbers that count up from 0."""
    bucket, bits, place = unused(rows, "bucket", "bits", "place")
    of = lambda df: df.withColumn(bucket, F.bitmap_bucket_number(number)).withColumn(place, F.bitmap_bit_position(number))
    mask = materialize(of(keys.select(number)).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bits)), "mask")
    if mask.count() * MASK_ROW > MASK_BYTES:
        return rows.join(keys.select(number).distinct(), number, "left_semi").select(*rows.columns)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(F.col(place), F.lit(8)))), F.lit(2))
    return of(rows).join(F.broadcast(mask), bucket).where(bit == 1).select(*rows.columns)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of df has them in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
