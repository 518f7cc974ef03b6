"""Links in JSON of any shape, taken apart level by level as VARIANT values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from lectern.sources.shared import stored

# Depth to which links are sought, links taken from one text, and the keys that name a link and its title.
DEEPEST, MOST_LINKS = 24, 30
LINK_KEYS, TITLE_KEYS = ("url", "uri"), ("title", "name")


def links(rows: DataFrame, key: str, json: str = "json", most: int = MOST_LINKS, deepest: int = DEEPEST) -> DataFrame:
    """key, ord (from 0), url, title: the web addresses that LINK_KEYS name anywhere in a JSON text, each once, the first `most`.

    title is that of the object around the address. Order is that of the text's arrays and, within an object, of its names.
    Text that is no JSON, and null, give none. Each level is written before the next is made from what it holds, so the passes
    are as many as the deepest text needs (at most `deepest`), over ever fewer rows. Keys must be unique.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key), F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    found = []
    for _ in range(deepest + 1):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        title = F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("v", f"$.{k}", "string")) for k in TITLE_KEYS])
        text = F.when(F.col("key").isin(*LINK_KEYS) & (F.schema_of_variant("value") == "STRING"), F.try_variant_get("value", "$", "string"))
        url = F.when(text.rlike("(?i)^https?://."), text)
        made = inner.select(F.col(key), F.array_append("path", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("path"), F.col("value").alias("v"), url.alias("url"), F.when(F.col("key").isNotNull() & url.isNotNull(), title).alias("title"))
        made = stored(made, "json-level")
        found.append(made.where("url is not null").select(key, "path", "url", "title"))
        level = made.where("url is null").select(key, "path", "v")
        if level.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    once = every.groupBy(key, "url").agg(F.min("path").alias("path"), F.min_by("title", "path").alias("title"))
    place = F.row_number().over(W.partitionBy(key).orderBy("path")) - 1
    return once.withColumn("ord", place).where(F.col("ord") < most).select(key, "ord", "url", "title")
