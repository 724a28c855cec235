"""Stored responses and pages: decoding, rendered pages, snapshot tables and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.xmlfeeds import feed_kind
from feedlake.session import checkpointed

# Body size limit, and the charsets the JVM decoder takes.
MAX_BODY_BYTES = 20 * 1024 * 1024
CHARSETS = ["US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"]


def _charset(content_type: Column) -> Column:
    tokens = F.transform(F.split(content_type, ";"), lambda x: F.trim(x))
    token = F.get(F.filter(tokens, lambda x: F.lower(x).startswith("charset")), F.lit(0))
    named = F.upper(F.trim(F.substring_index(token, "=", -1)))
    return F.when(token.isNull(), "UTF-8").when(named == "UTF8", "UTF-8").otherwise(named)


def decode_responses(responses: DataFrame) -> DataFrame:
    """Usable contents of stored responses ``(start_link_id, fetch_url, code, content_type, body)``.

    Adds ``media_type, charset, content, kind, reject``: html pages, feeds, else rejected (``status``, ``too_big``,
    ``charset``, ``media_type``).
    """
    typed = responses.withColumns({
        "media_type": F.trim(F.substring_index("content_type", ";", 1)), "charset": _charset(F.col("content_type"))})
    early = (
        F.when(F.col("code") != "200", "status").when(F.octet_length("body") > MAX_BODY_BYTES, "too_big")
        .when(~F.col("charset").isin(CHARSETS), "charset")
    )
    checked = typed.withColumn("_early", early)
    safe_charset = F.when(F.col("charset").isin(CHARSETS), F.col("charset")).otherwise("UTF-8")
    decoded = checked.withColumn("content", F.when(F.col("_early").isNull(), F.call_function("decode", F.col("body"), safe_charset)))
    kind = F.when(F.col("media_type") == "text/html", "page").when(feed_kind(F.col("content")).isNotNull(), "feed")
    kinded = decoded.withColumn("kind", F.when(F.col("_early").isNull(), kind))
    return kinded.withColumn("reject", F.coalesce("_early", F.when(F.col("kind").isNull(), F.lit("media_type")))).drop("_early", "body")


def prefer_rendered(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Page contents, the browser-rendered one first where both exist. ``rendered(start_link_id, fetch_url, body)``."""
    joined = pages.join(rendered.withColumnRenamed("body", "_rendered"), ["start_link_id", "fetch_url"], "left")
    return joined.withColumns({
        "content": F.coalesce("_rendered", "content"), "is_rendered": F.col("_rendered").isNotNull()}).drop("_rendered")


def link_dataset(links: DataFrame) -> DataFrame:
    """JSON lines ``{fetch_url, url}`` of page links; rows without both are dropped."""
    kept = links.where((F.coalesce("fetch_url", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""))
    return kept.select(F.to_json(F.struct("fetch_url", "url")).alias("value"))


def export_link_dataset(links: DataFrame, path: str) -> None:
    link_dataset(links).write.mode("overwrite").text(path)


def split_feed_csv(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for an unquoted CSV, and those holding a comma in ``url`` or ``feed_url``."""
    bad = F.col("url").contains(",") | F.col("feed_url").contains(",")
    return df.where(~bad), df.where(bad)


def write_feed_csv(df: DataFrame, path: str) -> DataFrame:
    """Write the fit rows and give back the rejected ones."""
    good, bad = split_feed_csv(df)
    good.write.mode("overwrite").csv(path, header=True)
    return bad


def upsert_by_key(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of ``fresh`` put in place of their keys."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def write_rss(bodies: DataFrame, key: str, path: str, buckets: int = 256) -> None:
    """Replace the feed texts of one run: only buckets of the written keys are rewritten.

    ``path`` is a parquet folder partitioned by bucket; existing keys of touched buckets are merged before writing.
    """
    spark = bodies.sparkSession
    bucketed = bodies.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if exists:
        touched = bucketed.select("bucket").distinct()
        stored = spark.read.parquet(path).join(touched, "bucket", "left_semi")
        # The merge reads the folder it replaces, so it is cut off from it first.
        bucketed = checkpointed(upsert_by_key(stored.select(*bucketed.columns), bucketed, key))
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def classify_feed_status(rows: DataFrame) -> DataFrame:
    """Comments of scraped membership rows ``(rss_url, posts_count, status)``: short feeds and those not active."""
    short = F.when(F.col("posts_count") < 10, F.concat(F.col("posts_count").cast("string"), F.lit(" posts")))
    inactive = F.when(F.col("status") != "Active", F.col("status"))
    return rows.withColumns({
        "comment": F.nullif(F.concat_ws(", ", short, inactive), F.lit("")),
        "is_short": F.col("posts_count") < 10, "is_active": F.col("status") == "Active"})


def membership_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(rss_url, posts_count, status)`` out of html table rows: link and bracketed count, then the status cell."""
    pattern = (r'(?s)<tr>\s*<td>\s*<a href="([^"]*)"[^>]*>.*?</a>\s*<span>\((\d+) posts\)</span>\s*</td>'
               r"\s*<td>\s*<span>([^<]*)</span>")
    groups = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(pattern), g).alias(n) for g, n in ((1, "u"), (2, "n"), (3, "s"))])
    exploded = pages.select("*", F.explode(groups).alias("_row"))
    return exploded.select(
        *[c for c in pages.columns if c != html], F.col("_row.u").alias("rss_url"), F.col("_row.n").cast("int").alias("posts_count"),
        F.col("_row.s").alias("status"))


def load_jdbc(spark: SparkSession, options: dict[str, str], table: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """Snapshot of one relational table, read in parallel over ranges of its numeric key."""
    return (spark.read.format("jdbc").options(**options).option("dbtable", table).option("partitionColumn", key)
            .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts).load())
