"""Links in folder pages, and the items below a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import urls
from corpusloom.functions.text import strip
from corpusloom.operators.sizing import best, cut_lineage

ANCHOR = r'(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'


def anchors(pages: DataFrame, base: Column) -> DataFrame:
    """(page_id, place, url, label) of every anchor; relative addresses are joined to ``base``."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("raw"),
    )
    rows = pages.select("page_id", base.alias("base"), F.posexplode(found).alias("place", "a")).select(
        "page_id", "place", "base", urls.unescaped(F.col("a.href")).alias("href"), urls.unescaped(F.col("a.raw")).alias("raw")
    )
    url = (
        F.when(F.col("href").rlike("^https?://"), F.col("href"))
        .when(F.col("href").startswith("/"), F.concat("base", "href"))
        .otherwise(F.concat("base", F.lit("/"), "href"))
    )
    return rows.select("page_id", "place", url.alias("url"), strip(F.regexp_replace("raw", "<[^>]+>", "")).alias("label"))


def folder_items(links: DataFrame, file_id: Column, folder_id: Column, noun: str = "item") -> DataFrame:
    """Files and folders of every page: first occurrence of an id wins; unnamed ones get a running number.

    The number of an unnamed item counts the kept items of its kind on the page;
    that window holds the links of one page.
    """
    kind = F.when(file_id.isNotNull(), "file").when(folder_id.isNotNull(), "folder")
    typed = links.withColumn("item_type", kind).withColumn("id", F.coalesce(file_id, folder_id)).filter(F.col("item_type").isNotNull())
    first = typed.groupBy("page_id", "item_type", "id").agg(
        F.min_by(F.struct("url", "label"), "place").alias("x"), F.min("place").alias("place")
    ).select("page_id", "item_type", "id", "place", "x.url", "x.label")
    counted = best(first, ["page_id", "item_type"], [F.asc("place")], 2**31 - 1, rank="n")
    name = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit(f"{noun} "), "item_type", F.lit(" "), F.col("n").cast("string")))
    return counted.select("page_id", "item_type", "id", name.alias("name"), "url")


def below(roots: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """Everything reachable from each root: (root, id, item_type, name, depth), breadth first.

    edges (parent, id, item_type, name).  Folders are opened down to ``max_depth``
    (0 to 10) levels and only once per root.
    """
    depth = max(0, min(max_depth, 10))
    frontier = roots.select("root", F.col("root").alias("id"))
    seen = frontier
    found = None
    for level in range(depth + 1):
        hits = (
            frontier.withColumnRenamed("id", "parent").join(edges, "parent")
            .groupBy("root", "id").agg(F.min(F.struct("item_type", "name")).alias("x"))
            .select("root", "id", "x.*")
            .join(seen, ["root", "id"], "left_anti")
            .withColumn("depth", F.lit(level + 1))
        )
        hits = cut_lineage(hits)
        if hits.isEmpty():
            break
        found = hits if found is None else found.unionByName(hits)
        seen = seen.unionByName(hits.select("root", "id"))
        frontier = hits.filter(F.col("item_type") == "folder").select("root", "id")
    if found is None:
        return hits
    return found


def wanted_files(items: DataFrame, suffixes=(".pdf", ".txt", ".md", ".log")) -> DataFrame:
    low = F.lower("name")
    test = F.lit(False)
    for suffix in suffixes:
        test = test | low.endswith(suffix)
    return items.filter((F.col("item_type") == "file") & test)
