"""Files that a library keeps beside its tables: listings, keyed reads, publishing what changed, diagnostics, block codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.sources.shared import removed

#: Schema of blocks as they are written and read as JSON.
BLOCK_SCHEMA = "struct<id:bigint,ord:int,kind:string,level:int,text:string,links:bigint,node:string>"


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the JSON files of a folder, each once, in order; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name")).distinct().orderBy("name")


def keyed(table: DataFrame, **keys: object) -> DataFrame:
    """Rows of the given keys; the conditions reach the scan."""
    for name, value in keys.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def digest(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order."""
    one = df.select(F.xxhash64(*df.columns).alias("h"))
    n, total, mixed = one.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return f"{n}:{total or 0}:{mixed or 0}"


def write_if_changed(df: DataFrame, folder: str) -> bool:
    """Write df as Parquet below the folder unless what stands there has the same rows: whether it was written.

    The marker with the digest goes before the rows are touched and is written again after them, so a run that breaks off
    anywhere in between leaves none, and the next one writes.
    """
    spark, now = df.sparkSession, digest(df)
    marker = f"{folder.rstrip('/')}/_digest"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{marker}/_SUCCESS")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) and spark.read.text(marker).first()[0] == now:
        return False
    removed(spark, marker)
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/rows")
    mark(spark, marker, now)
    return True


def mark(spark: SparkSession, marker: str, value: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(marker)


def log_events(events: DataFrame, folder: str, day: Column) -> None:
    """Append diagnostics as JSON lines, a folder for each day."""
    events.withColumn("day", day).write.mode("append").partitionBy("day").json(folder)


def recent_log(spark: SparkSession, folder: str, since: str, schema: str) -> DataFrame:
    """Diagnostics from a day on; older folders are not read."""
    return spark.read.schema(f"{schema}, day string").json(folder).where(F.col("day") >= since)


def encoded_blocks(blocks: DataFrame) -> DataFrame:
    """id, ord and the block as one JSON text."""
    names = [f.split(":")[0] for f in BLOCK_SCHEMA[7:-1].split(",")]
    return blocks.select("id", "ord", F.to_json(F.struct(*names)).alias("json"))


def decoded_blocks(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.inline(F.array(F.from_json("json", BLOCK_SCHEMA))))
