"""Adapters that present the star-schema, event, page and document tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import xmlfeeds as X


def page_hrefs(pages: DataFrame) -> DataFrame:
    """``(page_id, page_url, pos, href)`` of every anchor with a target, in document order, however its tag is written."""
    tags = X.start_tags(X.live_markup(F.col("html")), "a")
    hrefs = F.filter(F.transform(tags, lambda tag: X.attribute(tag, "href")), lambda href: href.isNotNull())
    return pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(hrefs).alias("pos", "href"))


def order_urls(orders: DataFrame) -> DataFrame:
    """``(url_id, site_id, base_url, raw_url, score)``: twelve shapes of typed and linked urls, one per order."""
    k = F.col("o_orderkey").cast("string")
    host = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".example.com"))
    pick = F.col("o_orderkey") % 12

    def number(n: Column) -> Column:
        return n.cast("string")

    raw = (
        F.when(pick == 0, F.concat(F.lit("http://"), host, F.lit("/posts//"), k, F.lit("/?page="),
                                   number(F.col("o_orderkey") % 7), F.lit("&ref="), number(F.col("o_custkey"))))
        .when(pick == 1, F.concat(F.lit(" https://www."), host, F.lit("/2021/"),
                                  F.lpad(number(F.col("o_orderkey") % 14), 2, "0"), F.lit("/"),
                                  F.lpad(number(F.col("o_orderkey") % 31 + 1), 2, "0"), F.lit("/post-"), k, F.lit("/ ")))
        .when(pick == 2, F.lit("/archive"))
        .when(pick == 3, F.concat(F.lit("//other.example.org/p/"), k, F.lit("?m=1+2#frag")))
        .when(pick == 4, F.concat(F.lit("../"), k, F.lit("/./a b")))
        .when(pick == 5, F.concat(F.lit("https://"), host, F.lit(":444/essays/"), k, F.lit("/")))
        .when(pick == 6, F.concat(F.lit("mailto:c"), number(F.col("o_custkey")), F.lit("@example.com")))
        .when(pick == 7, F.concat(F.lit("ftp://"), host, F.lit("/"), k))
        .when(pick == 8, F.concat(F.lit(":"), k))
        .when(pick == 9, F.concat(F.lit("http://user@"), host, F.lit("/"), k))
        .when(pick == 10, F.concat(F.lit("http:"), host, F.lit("/x")))
        .otherwise(F.concat(F.lit("https://"), host, F.lit(":443/post/"), k, F.lit("/sl%C3%BCg?a=1&a=2&updated-max="), k))
    )
    base = F.concat(F.lit("https://"), host, F.lit("/blog/"), number(F.col("o_custkey") % 5), F.lit("/index.html"))
    return orders.select(F.col("o_orderkey").alias("url_id"), F.col("o_custkey").alias("site_id"), base.alias("base_url"),
                         raw.alias("raw_url"), F.floor("o_totalprice").cast("long").alias("score"),
                         F.year("o_orderdate").alias("year"))


# The same shapes in SQL: ``src`` are the raw urls, ``links`` what canonicalisation must give.
ORDER_URLS_SQL = r"""
src AS (
  SELECT o_orderkey AS url_id, o_custkey AS site_id, floor(o_totalprice)::BIGINT AS score, year(o_orderdate)::INT AS year,
         o_orderkey % 12 AS pick, 'c' || o_custkey || '.example.com' AS host, o_orderkey AS k,
         'https://c' || o_custkey || '.example.com/blog/' || (o_custkey % 5) || '/index.html' AS base_url
  FROM orders),
shaped AS (
  SELECT *,
    CASE pick
      WHEN 0 THEN 'http://' || host || '/posts//' || k || '/?page=' || (k % 7) || '&ref=' || site_id
      WHEN 1 THEN ' https://www.' || host || '/2021/' || lpad((k % 14)::VARCHAR, 2, '0') || '/' || lpad((k % 31 + 1)::VARCHAR, 2, '0') || '/post-' || k || '/ '
      WHEN 2 THEN '/archive'
      WHEN 3 THEN '//other.example.org/p/' || k || '?m=1+2#frag'
      WHEN 4 THEN '../' || k || '/./a b'
      WHEN 5 THEN 'https://' || host || ':444/essays/' || k || '/'
      WHEN 6 THEN 'mailto:c' || site_id || '@example.com'
      WHEN 7 THEN 'ftp://' || host || '/' || k
      WHEN 8 THEN ':' || k
      WHEN 9 THEN 'http://user@' || host || '/' || k
      WHEN 10 THEN 'http:' || host || '/x'
      ELSE 'https://' || host || ':443/post/' || k || '/sl%C3%BCg?a=1&a=2&updated-max=' || k END AS raw_url,
    CASE pick WHEN 6 THEN 'mailto' WHEN 7 THEN 'not_http' WHEN 8 THEN 'colon' WHEN 9 THEN 'userinfo' WHEN 10 THEN 'opaque' END AS reject,
    CASE WHEN pick = 0 THEN 'http' ELSE 'https' END AS scheme,
    CASE WHEN pick = 1 THEN 'www.' || host ELSE host END AS chost,
    CASE WHEN pick = 5 THEN ':444' ELSE '' END AS port,
    CASE pick
      WHEN 0 THEN '/posts/' || k || '/'
      WHEN 1 THEN '/2021/' || lpad((k % 14)::VARCHAR, 2, '0') || '/' || lpad((k % 31 + 1)::VARCHAR, 2, '0') || '/post-' || k || '/'
      WHEN 2 THEN '/archive' WHEN 3 THEN '/p/' || k WHEN 4 THEN '/blog/' || k || '/a%20b'
      WHEN 5 THEN '/essays/' || k || '/' WHEN 11 THEN '/post/' || k || '/sl%C3%BCg' END AS path,
    CASE pick WHEN 0 THEN '?page=' || (k % 7) || '&ref=' || site_id WHEN 3 THEN '?m=1%2B2'
      WHEN 11 THEN '?a=1&a=2&updated-max=' || k ELSE '' END AS full_query,
    CASE pick WHEN 0 THEN '?page=' || (k % 7) WHEN 3 THEN '?m=1%2B2' WHEN 11 THEN '?updated-max=' || k ELSE '' END AS query
  FROM src),
links AS (
  SELECT url_id, site_id, score, year, base_url, raw_url, reject,
    CASE WHEN reject IS NULL THEN scheme || '://' || chost || port || path || full_query END AS link_url,
    CASE WHEN reject IS NULL THEN chost END AS host, CASE WHEN reject IS NULL THEN port END AS port,
    CASE WHEN reject IS NULL THEN path END AS path, CASE WHEN reject IS NULL THEN rtrim(path, '/') END AS trimmed_path,
    CASE WHEN reject IS NULL THEN query END AS query,
    CASE WHEN reject IS NULL THEN chost || port || path || query END AS canonical,
    CASE WHEN reject IS NULL THEN chost || port || '/' || rtrim(path, '/') || '?' || query END AS key
  FROM shaped)
"""


# Subscriptions, posts, schedules and users out of orders, line items and customers.

# Time zones and delivery channels handed out by nation and customer.
TIMEZONES = ["America/Los_Angeles", "Europe/Berlin", "Asia/Tokyo", "Pacific/Auckland", "America/Sao_Paulo", "UTC"]
CHANNELS = ["email", "single_feed", "multiple_feeds"]


def subscriptions(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    live = k % 5 != 0
    return orders.select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 100).alias("blog_id"),
        F.concat(F.lit("Blog <"), k.cast("string"), F.lit("> & more")).alias("name"),
        F.when(live, "live").otherwise("setup").alias("status"), (F.col("o_orderstatus") == "P").alias("is_paused"),
        F.when(live, F.col("o_orderdate")).alias("finished_setup_at"),
        F.date_sub("o_orderdate", 1).cast("timestamp").alias("created_at"),
        F.when(k % 7 == 0, F.date_add("o_orderdate", 90).cast("timestamp")).alias("final_item_published_at"),
        F.when(k % 11 == 0, F.col("o_orderdate")).alias("discarded_at"), (k % 4).cast("int").alias("schedule_version"))


def subscription_posts(lineitem: DataFrame) -> DataFrame:
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    sent = F.col("l_linestatus") == "F"
    return lineitem.select(
        key.alias("id"), F.col("l_orderkey").alias("subscription_id"), F.col("l_partkey").alias("blog_post_id"),
        F.col("l_linenumber").alias("index"),
        F.concat(F.lit("Post #"), F.col("l_partkey").cast("string"), F.lit(" Part & "), F.col("l_suppkey").cast("string")).alias("title"),
        F.concat(F.lit("https://blog.example.com/"), F.col("l_partkey").cast("string")).alias("url"),
        F.left(F.md5(key.cast("string")), F.lit(16)).alias("random_id"),
        F.when(sent, F.col("l_shipdate")).alias("published_at"),
        F.when(sent, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("published_at_local_date"))


def schedules(orders: DataFrame) -> DataFrame:
    days = F.array(*[F.lit(d) for d in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")])
    exploded = orders.select("o_orderkey", F.posexplode(days).alias("_d", "day_of_week"))
    return exploded.select(F.col("o_orderkey").alias("subscription_id"), "day_of_week",
                           ((F.col("o_orderkey") + F.col("_d")) % 3).cast("int").alias("count"))


def users(customer: DataFrame) -> DataFrame:
    zones = F.array(*[F.lit(z) for z in TIMEZONES])
    channels = F.array(*[F.lit(c) for c in CHANNELS])
    return customer.select(
        F.col("c_custkey").alias("user_id"), F.element_at(zones, (F.col("c_nationkey") % 6 + 1).cast("int")).alias("timezone"),
        F.element_at(channels, (F.col("c_custkey") % 3 + 1).cast("int")).alias("delivery_channel"))


SUBSCRIPTIONS_SQL = """
subs AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey % 100 AS blog_id, 'Blog <' || o_orderkey || '> & more' AS name,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'live' ELSE 'setup' END AS status, o_orderstatus = 'P' AS is_paused,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS finished_setup_at, o_orderdate - INTERVAL 1 DAY AS created_at,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS final_item_published_at,
  CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS discarded_at, (o_orderkey % 4)::INT AS schedule_version FROM orders),
posts AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 100000 + l_suppkey AS id, l_orderkey AS subscription_id,
  l_partkey AS blog_post_id, l_linenumber AS index, 'Post #' || l_partkey || ' Part & ' || l_suppkey AS title,
  'https://blog.example.com/' || l_partkey AS url,
  left(md5(((l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 100000 + l_suppkey)::VARCHAR), 16) AS random_id,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS published_at,
  CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS published_at_local_date FROM lineitem),
schedules AS (SELECT o_orderkey AS subscription_id, day_of_week, ((o_orderkey + d) % 3)::INT AS count FROM orders,
  (VALUES (0, 'sun'), (1, 'mon'), (2, 'tue'), (3, 'wed'), (4, 'thu'), (5, 'fri'), (6, 'sat')) AS days(d, day_of_week)),
users AS (SELECT c_custkey AS user_id,
  ['America/Los_Angeles', 'Europe/Berlin', 'Asia/Tokyo', 'Pacific/Auckland', 'America/Sao_Paulo', 'UTC'][(c_nationkey % 6 + 1)::INT] AS timezone,
  ['email', 'single_feed', 'multiple_feeds'][(c_custkey % 3 + 1)::INT] AS delivery_channel FROM customer),
counts AS (SELECT subscription_id, count(published_at) AS published_count, count(*) AS total_count FROM posts GROUP BY 1)
"""
