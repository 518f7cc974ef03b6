"""Groups of blocks that are read together: headings with what follows, lists with their introduction, pictures with captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.arrays import scanned
from lectern.functions.text import bound

# Blocks that belong to no group, blocks of text, and what the node of a translation ends with.
APART = ("page break", "line break", "separator")
TEXTS = ("heading", "paragraph", "item", "caption", "quote", "attribution", "pre", "note")
COMPANION = "@translation"
STATE = "struct<group:int,headings:boolean,depth:int,kind:string,node:string,body:string,list:int,picture:boolean,mine:int,ord:int>"


def focus_groups(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, ord, kind, node, depth and list of an item, picture: whether a text holds one, boundary: whether a new part
    begins) as key, ord, group: the ord of the block that begins the group. Blocks that stand apart have none and do not end one.
    """
    features = F.struct("ord", "kind", "node", "depth", "list", F.coalesce("picture", F.lit(False)).alias("picture"), F.coalesce("boundary", F.lit(False)).alias("boundary"))
    sections = blocks.groupBy(key).agg(F.sort_array(F.collect_list(features)).alias("b"))
    null, no = lambda kind: F.lit(None).cast(kind), F.lit(False)
    zero = F.struct(null("int").alias("group"), no.alias("headings"), null("int").alias("depth"), null("string").alias("kind"), null("string").alias("node"), null("string").alias("body"), null("int").alias("list"), no.alias("picture"), null("int").alias("mine"), F.lit(-1).alias("ord"))

    def step(before: Column, x: Column) -> Column:
        def of(s: Column) -> Column:
            text, heading, item = x["kind"].isin(*TEXTS), x["kind"] == "heading", x["kind"] == "item"
            companion = F.coalesce(text & s["kind"].isin(*TEXTS) & (x["node"] == F.concat(s["node"], F.lit(COMPANION))), no)
            caption = F.coalesce((x["kind"] == "caption") & (s["kind"] == "image"), no)
            inside = F.coalesce(item & s["depth"].isNotNull() & (x["depth"] >= s["depth"]) & x["list"].eqNullSafe(s["list"]), no)
            led = F.coalesce(item & s["depth"].isNull() & (s["body"] == "paragraph") & ~s["picture"], no)
            joins = s["group"].isNotNull() & (s["headings"] | companion | caption | inside | led)
            own = text & ~F.coalesce(x["node"].endswith(COMPANION), no)
            kept = lambda new, old, kind: F.when(own, new).when(joins, old).otherwise(null(kind))
            group, depth = F.when(joins, s["group"]).otherwise(x["ord"]), F.when(joins, s["depth"])
            attached = F.struct(
                group.alias("group"), (F.when(joins, s["headings"]).otherwise(heading) & (heading | companion)).alias("headings"), F.when(item, F.coalesce(depth, x["depth"])).when(companion, depth).alias("depth"), x["kind"].alias("kind"), x["node"].alias("node"),
                kept(x["kind"], s["body"], "string").alias("body"), kept(x["list"], s["list"], "int").alias("list"), F.when(own, x["picture"]).otherwise(joins & s["picture"]).alias("picture"), group.alias("mine"), x["ord"].alias("ord"))
            return F.when(x["kind"].isin(*APART), s.withField("mine", null("int")).withField("ord", x["ord"]).cast(STATE)).otherwise(attached.cast(STATE))

        return bound(F.when(x["boundary"], zero.cast(STATE)).otherwise(before), of)

    found = scanned(F.col("b"), zero, step, STATE, lambda s: F.when(s["mine"].isNotNull(), F.struct(s["ord"].alias("ord"), s["mine"].alias("group"))), "struct<ord:int,group:int>")
    return sections.select(key, F.inline_outer(found)).where("ord is not null")
