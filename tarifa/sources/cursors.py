"""Page lists that are linked by cursors: each landed page names the next one, and the list is found by doubling.

A walk's page of rank r is found from its first: after k rounds the pages of ranks below 2**k are known, and each page's jump leads 2**k pages on;
a round joins the known pages to their jumps, and the jumps to themselves. So a list of n pages takes log(n) rounds, each written to the shared
folder. A list that comes back to a page of its own ends there, as does one that names a page which has not landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.session import cut
from tarifa.sources.landed import enveloped


def next_address(first: Column, cursor: Column) -> Column:
    """A cursor as it can be read: shops leave out the language that the first address had."""
    return F.when(first.contains("/en/api/") & ~cursor.contains("/en/api/"), F.regexp_replace(cursor, "^([^?]*?)/api/", "$1/en/api/")).otherwise(cursor)


def linked(pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """walk, rank (from 1), url of the pages that each walk reaches, and on its last page `stop`, else null.

    pages: url, status, payload, one row a url (of several, the one with the least status and payload); firsts: walk, url. stop: http_<status>, page_error (no list of products), empty_page, missing_page
    (the next one has not landed), cycle (the next one is of the walk already), or exhausted. A page that fails is of the walk; a first page that has not landed is rank 1 with missing_page.
    """
    landed = pages.groupBy("url").agg(F.min_by(F.struct("status", "payload"), F.struct("status", "payload")).alias("p")).select("url", "p.*")
    items = enveloped(F.col("payload"))
    fails = F.when(F.col("status") != 200, F.concat(F.lit("http_"), F.col("status").cast("string"))).when(items.isNull(), "page_error").when(F.size(items) == 0, "empty_page")
    cursor = F.nullif(F.coalesce(F.get_json_object("payload", "$.cursor.next"), F.get_json_object("payload", "$.next_cursor")), F.lit(""))
    steps = cut(landed.select("url", fails.alias("fails"), F.when(fails.isNull(), next_address(F.col("url"), cursor)).alias("next")))
    jumps = steps.where("next IS NOT NULL").select(F.col("url").alias("at"), F.col("next").alias("to"))
    known = cut(firsts.select("walk", "url", F.lit(1).cast("long").alias("rank")))
    width = 1
    while True:
        found = known.join(jumps, F.col("url") == F.col("at")).select("walk", F.col("to").alias("url"), (F.col("rank") + width).alias("rank"))
        fresh = cut(found.join(known, ["walk", "url"], "left_anti").groupBy("walk", "url").agg(F.min("rank").alias("rank")))
        if not fresh.limit(1).count():
            break
        known = cut(known.unionByName(fresh))
        second = jumps.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = cut(jumps.join(second, "to").select("at", F.col("beyond").alias("to")))
        width *= 2
    rows = known.join(steps, "url", "left").join(known.select("walk", F.col("url").alias("next"), F.col("rank").alias("again")), ["walk", "next"], "left")
    gone = steps.select(F.col("url").alias("next"), F.lit(True).alias("there"))
    rows = rows.join(steps.select("url", F.lit(True).alias("landed")), "url", "left").join(gone, "next", "left")
    stop = (
        F.when(F.col("landed").isNull(), "missing_page").when(F.col("fails").isNotNull(), F.col("fails")).when(F.col("next").isNull(), "exhausted").when(F.col("again") <= F.col("rank"), "cycle")
    )
    return rows.select("walk", "rank", "url", stop.alias("stop"), F.col("landed").isNotNull().alias("landed")).where("landed OR rank = 1 OR stop = 'missing_page'").drop("landed")


def listed(pages: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and outcome of cursor walks. Items: walk, rank, id, name, price, one row an id of a walk, from its earliest page. Outcome: walk, pages, stop; pages that have not landed or failed count in neither."""
    chain = cut(linked(pages, firsts))
    bodies = pages.groupBy("url").agg(F.min_by(F.struct("status", "payload"), F.struct("status", "payload")).alias("p")).select("url", F.col("p.payload").alias("payload"))
    good = chain.where("stop IS NULL OR stop IN ('exhausted', 'cycle')")
    rows = good.join(bodies, "url").select("walk", "rank", F.explode(enveloped(F.col("payload"))).alias("p")).select("walk", "rank", "p.*").where("id IS NOT NULL")
    items = rows.groupBy("walk", "id").agg(F.min_by(F.struct("rank", "name", "price"), F.struct("rank", "name", "price")).alias("r")).select("walk", "r.rank", "id", "r.name", "r.price")
    outcome = chain.groupBy("walk").agg(F.count_if(F.col("stop").isNull() | F.col("stop").isin("exhausted", "cycle")).alias("pages"), F.max("stop").alias("stop"))
    return items, outcome
