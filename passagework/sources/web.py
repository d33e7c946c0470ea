"""Stored web pages: metadata, links, and reachability from root URLs."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.config import PAGE_OVERLAP, PAGE_SIZE, copy_id, ensure_checkpoint_dir, stable_id, written
from passagework.functions import html as H
from passagework.functions.chunking import explode_chunks
from passagework.operators.positions import dense_positions


def load_web(stored: DataFrame, collection: str, ingest_date: int, reached: DataFrame | None = None) -> DataFrame:
    """Page rows of web documents: doc_id, type, doc_source, ingest_date, page_no, title, language,
    source, content. ``stored`` has url and html, and ``copy`` where URLs come more than once (``with_copies``).

    Without ``reached`` every stored page is a document of its own. With it (root, url, depth from
    ``crawl``) a document is a root and its pages are all pages reached from it. Raw HTML is the
    content, long pages are split in parts.
    """
    copy = F.col("copy") if "copy" in stored.columns and reached is None else F.lit(None).cast("string")
    if reached is None:
        rows = stored.select(F.col("url").alias("root"), F.lit(0).alias("depth"), "url", "html", copy.alias("copy"))
    else:
        rows = stored.select("url", "html").join(written(reached), "url").select(
            "root", "depth", "url", "html", copy.alias("copy"))
    described = rows.select(
        "root", "depth", "copy", F.col("url").alias("source"),
        H.title(F.col("html")).alias("title"), H.language(F.col("html")).alias("language"), "html",
    )
    parts = explode_chunks(described, "html", size=PAGE_SIZE, overlap=PAGE_OVERLAP, out_col="content", pos_col="part")
    if reached is None:
        parts = parts.withColumn("page_no", F.col("part"))
    else:
        parts = dense_positions(parts, ["root"], ["depth", "source", "part"], "page_no")
    date = F.lit(ingest_date).cast("bigint")
    return parts.select(
        copy_id(_web_id(collection, F.col("root"), date), F.col("copy")).alias("doc_id"),
        F.lit("web").alias("type"), F.col("root").alias("doc_source"), date.alias("ingest_date"),
        "page_no", "title", "language", "source", "content",
    )


def web_documents(roots: Column, collection: str, ingest_date: int) -> list[Column]:
    """Document columns of a table of root URLs."""
    date = F.lit(ingest_date).cast("bigint")
    none = F.lit(None).cast("string")
    return [
        _web_id(collection, roots, date).alias("doc_id"), F.lit("web").alias("type"), roots.alias("source"),
        date.alias("ingest_date"), none.alias("filename"), none.alias("media_type"), none.alias("extension"),
    ]


def _web_id(collection: str, root: Column, date: Column) -> Column:
    return stable_id(F.lit(collection), F.lit("web"), root, date)


def url_list(urls: DataFrame) -> DataFrame:
    """The non-empty URLs of a list, one per entry."""
    return urls.filter(F.col("url") != "")


def page_links(stored: DataFrame) -> DataFrame:
    """Edges (url, target) of a stored page table, each once, also where a URL is stored more than once; only edges are
    shuffled."""
    targets = F.transform(H.links(F.col("html")), lambda link: H.resolve(F.col("url"), link))
    return stored.select("url", F.explode(F.array_distinct(targets)).alias("target")).distinct()


def crawl(stored: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, url, depth): stored pages reachable from each root by links that stay under it.
    Rounds go on until one finds nothing new, or up to ``max_depth`` if the caller sets it.

    A breadth-first frontier. Edges are written once as a table bucketed by URL, visited pages as one bucketed by root and
    URL to which every round adds, so a round shuffles its frontier and what that leads to, never edges or visited pages.
    """
    spark = stored.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/crawl-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges, seen = (f"crawl_{kind}_{uuid.uuid4().hex}" for kind in ("edges", "seen"))
    known = stored.select("url")
    inside = page_links(stored).join(known.withColumnRenamed("url", "target"), "target", "left_semi").select("url", "target")
    try:
        _add_bucketed(inside, edges, f"{folder}/edges", ["url"], n)
        frontier = written(
            roots.select(F.col("url").alias("root")).distinct()
            .join(known.withColumnRenamed("url", "root"), "root", "left_semi")
            .select("root", F.col("root").alias("url"), F.lit(0).alias("depth")))
        _add_bucketed(frontier, seen, f"{folder}/seen", ["root", "url"], n)
        for depth in itertools.count(1) if max_depth is None else range(1, max_depth):
            found = written(crawl_round(frontier, spark.table(edges), spark.table(seen), n).withColumn("depth", F.lit(depth)))
            if found.isEmpty():
                break
            _add_bucketed(found, seen, f"{folder}/seen", ["root", "url"], n)
            frontier = found
        return spark.read.schema("root string, url string, depth int").parquet(f"{folder}/seen")
    finally:
        # the files stay, only the names go
        for name in (edges, seen):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def crawl_round(frontier: DataFrame, edges: DataFrame, seen: DataFrame, buckets: int) -> DataFrame:
    """(root, url) that the frontier links to and that was not seen."""
    led_to = frontier.join(edges, "url").filter(F.col("target").startswith(F.col("root"))).select(
        "root", F.col("target").alias("url"))
    return led_to.repartition(buckets, "root", "url").distinct().join(seen.select("root", "url"), ["root", "url"], "left_anti")


def _add_bucketed(rows: DataFrame, table: str, path: str, by: list[str], buckets: int) -> None:
    """One file per bucket and call."""
    (rows.repartition(buckets, *by).write.mode("append").format("parquet").option("path", path)
     .bucketBy(buckets, *by).sortBy(*by).saveAsTable(table))
