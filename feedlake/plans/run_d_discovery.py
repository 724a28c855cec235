"""Feed discovery queries over pages that Spark renders from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.urls import with_canonical
from feedlake.operators import discovery as D
from feedlake.operators import pages as P
from feedlake.plans.registry import query
from feedlake.session import spread
from feedlake.sources.adapters import ORDER_URLS_SQL, order_urls

c = F.col


def text(col):
    return col.cast("string")


@query("d01_normalize_start_urls", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'https://c' || o_custkey || '.example.com/x' WHEN 1 THEN 'http://c' || o_custkey || '.example.com' WHEN 2 THEN 'https://n' || o_custkey || '.letters.example/feed' END AS start_url,
    CASE o_orderkey % 5 WHEN 3 THEN 'not_a_url' WHEN 4 THEN 'could_not_reach' END AS outcome FROM orders""")
def _(t):
    pick, n = c("o_orderkey") % 5, text(c("o_custkey"))
    typed = F.when(pick == 0, F.concat(F.lit("https://c"), n, F.lit(".example.com/x#top"))).when(pick == 1, F.concat(F.lit("c"), n, F.lit(".example.com"))).when(
        pick == 2, F.concat(F.lit("https://n"), n, F.lit(".letters.example/"))).when(pick == 3, F.lit("just words")).otherwise(F.concat(F.lit("http://me@c"), n, F.lit(".example.com")))
    return D.normalize_start_urls(t.orders.select("o_orderkey", typed.alias("typed")), "typed", "letters.example").select("o_orderkey", "start_url", "outcome")


def site_pages(t):
    """One page per customer: advertised feeds of several shapes by customer number."""
    k = c("c_custkey")
    rss = '<link rel="alternate" type="application/rss+xml" title="RSS" href="/feed.rss">'
    atom = '<link rel="alternate" type="application/atom+xml" title="Atom" href="/feed.atom">'
    comments = '<link rel="alternate" type="application/rss+xml" title="Comments &amp; more" href="/comments/feed/">'
    second = '<a rel="alternate" type="application/rss+xml" href="/news/feed.xml">News &amp; views</a>'
    html = F.concat(
        F.lit("<html><head><title>Site "), text(k), F.lit("</title>"), F.lit(comments), F.when(k % 4 > 0, rss).otherwise(""), F.when(k % 4 > 1, atom).otherwise(""),
        F.lit("</head><body>"), F.when(k % 4 == 3, second).otherwise(""), F.lit('<a href="/about">About</a></body></html>'))
    # The keys are dealt out, not the pages.
    return spread(t.customer.select("c_custkey")).select(
        k.alias("page_id"), F.concat(F.lit("https://c"), text(k), F.lit(".example.com/start")).alias("url"), html.alias("html"))


SITES_SQL = """sites AS (SELECT c_custkey AS page_id, 'https://c' || c_custkey || '.example.com' AS root, c_custkey % 4 AS pick FROM customer),
feeds AS (SELECT page_id, root || '/feed.rss' AS feed_url, 'RSS' AS title, 'Site ' || page_id AS full_title FROM sites WHERE pick > 0
  UNION ALL SELECT page_id, root || '/news/feed.xml', 'News & views', 'News & views' FROM sites WHERE pick = 3),
all_feeds AS (SELECT page_id, feed_url, title FROM feeds UNION ALL SELECT page_id, root || '/feed.atom', 'Atom' FROM sites WHERE pick > 1)"""


@query("d02_advertised_feeds", f"WITH {SITES_SQL} SELECT page_id, feed_url, title FROM all_feeds")
def _(t):
    return D.advertised_feeds(site_pages(t)).select("page_id", "feed_url", "title")


@query("d03_dedup_feed_variants", f"WITH {SITES_SQL} SELECT page_id, feed_url, title FROM feeds")
def _(t):
    return D.dedup_feed_variants(D.advertised_feeds(site_pages(t))).select("page_id", "feed_url", "title")


@query("d04_fill_feed_titles", f"WITH {SITES_SQL} SELECT page_id, feed_url, full_title AS title FROM feeds")
def _(t):
    pages = site_pages(t)
    return D.fill_feed_titles(D.dedup_feed_variants(D.advertised_feeds(pages)), P.page_titles(pages)).select("page_id", "feed_url", "title")


@query("d05_discovery_outcome", f"""WITH {SITES_SQL} SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'could_not_reach' WHEN page_id % 7 = 0 AND page_id % 2 = 0 THEN 'bad_feed' WHEN page_id % 7 = 0 THEN 'feed'
    WHEN pick = 0 THEN 'no_feeds' WHEN pick < 3 THEN 'single_feed' ELSE 'multiple_feeds' END AS outcome FROM sites""")
def _(t):
    pages = site_pages(t)
    k = c("page_id")
    starts = pages.select(k, F.when(k % 11 != 0, "200").alias("status"), (k % 7 == 0).alias("is_feed"), (k % 2 == 0).alias("feed_error"))
    return D.discovery_outcome(starts, D.dedup_feed_variants(D.advertised_feeds(pages))).select("page_id", "outcome")


@query("d06_triage_seed_feeds", f"""WITH {SITES_SQL} SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'override' WHEN pick = 0 THEN 'none' WHEN pick = 1 THEN 'one' ELSE 'many' END AS triage,
    CASE WHEN page_id % 13 = 0 THEN 'https://manual/' || page_id WHEN pick = 1 THEN root || '/feed.rss' END AS rss_url FROM sites""")
def _(t):
    pages = site_pages(t)
    k = c("page_id")
    overrides = pages.where("page_id % 13 = 0").select(k, F.explode(F.array(F.lit(1), F.lit(2))).alias("priority")).withColumn(
        "rss_url", F.concat(F.when(c("priority") == 1, "https://manual/").otherwise("https://a-later/"), text(k)))
    return D.triage_seed_feeds(pages.select(k), D.advertised_feeds(pages), overrides)


@query("d07_probable_feeds", f"WITH {SITES_SQL} SELECT page_id, feed_url FROM all_feeds WHERE page_id % 3 <> 0 AND feed_url NOT LIKE '%.atom'")
def _(t):
    pages = site_pages(t)
    feeds = D.advertised_feeds(pages)
    links = P.page_links(pages)
    docs = feeds.where("page_id % 3 <> 0").select(c("feed_url").alias("url"), F.when(c("feed_url").endswith(".atom"), "<html></html>").otherwise(
        "<rss><channel></channel></rss>").alias("content"))
    return D.probable_feeds(feeds, links, docs)


@query("d08_validate_feeds", """WITH f AS (SELECT l_orderkey AS feed_id, min_by(l_partkey, (-epoch_us(CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN TIMESTAMP '1900-01-01' ELSE l_shipdate END), l_linenumber, l_partkey, l_suppkey)) AS part FROM lineitem GROUP BY 1)
    SELECT feed_id, CASE WHEN feed_id % 8 = 0 THEN 'bad_status' WHEN feed_id % 17 = 0 THEN 'not_a_feed' END AS reason,
      CASE WHEN feed_id % 8 <> 0 AND feed_id % 17 <> 0 THEN 'https://f' || (feed_id % 97) || '.example.com/p/' || part END AS latest_url FROM f""")
def _(t):
    from feedlake.plans.run_c_feeds import feed_docs

    docs = feed_docs(t).withColumn("code", F.when(c("feed_id") % 8 == 0, "500").otherwise("200"))
    # The oracle states the rule for undated entries: they count as older than all dated ones.
    return D.validate_feeds(docs).select("feed_id", "reason", "latest_url")


@query("d09_start_page_for_feed", """SELECT c_custkey AS feed_id, 'https://c' || c_custkey || '.example.com' || CASE c_custkey % 3 WHEN 0 THEN '/home' WHEN 1 THEN '/blog/' ELSE '/' END AS start_url, c_custkey % 3 = 0 AS from_root FROM customer""")
def _(t):
    k = c("c_custkey")
    root = F.concat(F.lit("https://c"), text(k), F.lit(".example.com"))
    feeds = t.customer.select(k.alias("feed_id"), F.concat(root, F.lit("/blog/en/feed.xml?x=1")).alias("feed_url"), F.when(k % 3 == 0, F.concat(root, F.lit("/home/"))).when(
        k % 3 == 1, F.concat(root, F.lit("/gone"))).alias("root_url"))
    pages = t.customer.select(F.explode(F.array(F.concat(root, F.lit("/")), F.concat(root, F.when(k % 3 == 0, "/home").when(k % 3 == 1, "/blog/").otherwise("/other")))).alias("url"))
    return D.start_page_for_feed(feeds, pages)


@query("d10_detect_platform", """SELECT page_id, page_id % 4 = 0 AS has_load_more, page_id % 4 = 1 AS is_article_list, page_id % 4 = 2 AS is_newsletter_archive, page_id % 4 = 3 AS is_newsletter FROM pages""")
def _(t):
    k = c("page_id")
    # The pages have one article each; nine more make the list of ten.
    extra = F.when(k % 4 == 0, '<button class="btn load-more">More</button>').when(
        k % 4 == 1, '<link rel="alternate" type="application/rss+xml" href="https://medium.com/feed">' + "<article></article>" * 9).when(
        k % 4 == 2, '<div class="x footer-substack"></div>').otherwise('<meta name="twitter:site" content="@buttondown">')
    url = F.when(k % 4 == 2, "https://x.example.com/archive/").otherwise(c("url"))
    return D.detect_platform(t.pages.select(k, url.alias("url"), F.concat("html", extra).alias("html")))


@query("d11_non_post_report", f"""WITH {ORDER_URLS_SQL}, s AS (SELECT site_id AS feed_id, regexp_extract(trimmed_path, '^(/[^/]*)', 1) AS step, count(*) AS n FROM links WHERE reject IS NULL GROUP BY 1, 2)
    SELECT feed_id, sum(n)::BIGINT AS n_entries, max_by(step, (n, step)) AS main_step, max(n) AS n_main, (sum(n) - max(n))::BIGINT AS n_other FROM s GROUP BY 1""")
def _(t):
    links = with_canonical(order_urls(t.orders), "raw_url", "base_url").where("reject is null").withColumnRenamed("site_id", "feed_id")
    return D.non_post_report(links)
