"""Url queries over page links and order-derived urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.operators import urls as O
from feedlake.plans.registry import query
from feedlake.sources.adapters import ORDER_URLS_SQL, order_urls, page_hrefs

# Page links in SQL: hrefs are root-relative, so only the path needs escaping.
PAGE_LINKS_SQL = r"""
hrefs AS (
  SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1))))::INT AS pos FROM pages),
page_links AS (
  SELECT *, regexp_extract(page_url, '^(https?://[^/]*)', 1) AS server, regexp_extract(page_url, '^https?://([^/]*)', 1) AS host,
         replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS path FROM hrefs)
"""


def links(t):
    return O.canonicalize_urls(order_urls(t.orders), "raw_url", "base_url")


def good_links(t):
    return links(t).where("reject is null")


@query("b01_canonicalize_urls", f"WITH {ORDER_URLS_SQL} SELECT url_id, reject, link_url, canonical FROM links")
def _(t):
    return links(t).select("url_id", "reject", "link_url", "canonical")


@query("b01_canonicalize_page_links",
       f"WITH {PAGE_LINKS_SQL} SELECT page_id, pos, server || path AS link_url, host || path AS canonical FROM page_links")
def _(t):
    linked = O.canonicalize_urls(page_hrefs(t.pages), "href", "page_url")
    return linked.select("page_id", "pos", "link_url", "canonical")


@query("b02_canonical_parts", f"WITH {ORDER_URLS_SQL} SELECT url_id, host, port, path, trimmed_path, query FROM links WHERE reject IS NULL")
def _(t):
    return good_links(t).select("url_id", "parts.*")


def rules(t):
    """Per-site rules: the site's two hosts are one group on even sites; post paths collapse on multiples of three."""
    host = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.com"))
    return t.customer.select(
        F.col("c_custkey").alias("site_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(host, F.concat(F.lit("www."), host))).otherwise(
            F.array().cast("array<string>")).alias("same_hosts"),
        (F.col("c_custkey") % 3 == 0).alias("expect_post_paths"))


RULED_SQL = f"""{ORDER_URLS_SQL},
ruled AS (SELECT *,
  CASE WHEN site_id % 2 = 0 AND port = '' THEN ':same_hosts' ELSE host || port END AS server,
  CASE WHEN site_id % 2 = 0 THEN ':same_hosts' ELSE host END AS eq_host,
  CASE WHEN site_id % 3 = 0 THEN coalesce(nullif(regexp_extract(path, '^(/post/[0-9]+)(?:/[^/]+)?/?$', 1), ''), trimmed_path) ELSE trimmed_path END AS kpath,
  site_id % 3 = 0 AND regexp_matches(path, '^(/post/[0-9]+)(?:/[^/]+)?/?$') AS is_post
  FROM links WHERE reject IS NULL),
keyed AS (SELECT *, server || '/' || kpath || '?' || query AS rule_key,
  eq_host || '/' || kpath || '?' || CASE WHEN is_post THEN '' ELSE query END AS eq_key FROM ruled)"""


@query("b03_canonical_key", f"WITH {RULED_SQL} SELECT url_id, rule_key AS key FROM keyed")
def _(t):
    return O.canonical_key(good_links(t), rules(t), "site_id").select("url_id", "key")


@query("b04_canonical_equal_join", f"""WITH {RULED_SQL},
    other AS (SELECT site_id, eq_key, count(*) AS n FROM keyed GROUP BY 1, 2)
    SELECT url_id, n FROM keyed JOIN other USING (site_id, eq_key)""")
def _(t):
    # The right side is first counted per equality key, so a key shared by many links never multiplies rows.
    left = O.with_equality_key(good_links(t), rules(t), "site_id")
    return left.join(left.groupBy("site_id", "eq_key").agg(F.count("*").alias("n")), ["site_id", "eq_key"]).select("url_id", "n")


@query("b05_dedup_by_key", f"""WITH {ORDER_URLS_SQL}
    SELECT site_id, key, min(url_id) AS url_id FROM links WHERE reject IS NULL GROUP BY 1, 2""")
def _(t):
    return O.dedup_by_key(good_links(t), ["site_id", "key"], ["url_id"]).select("site_id", "key", "url_id")


@query("b06_dedup_keep_last", f"""WITH {ORDER_URLS_SQL}
    SELECT site_id, key, max(url_id) AS url_id FROM links WHERE reject IS NULL GROUP BY 1, 2""")
def _(t):
    return O.dedup_keep_last(good_links(t), ["site_id", "key"], "url_id").select("site_id", "key", "url_id")


@query("b07_rekey", f"WITH {RULED_SQL} SELECT site_id, rule_key AS key, min(url_id) AS url_id FROM keyed GROUP BY 1, 2")
def _(t):
    return O.rekey(good_links(t), rules(t), "url_id", "site_id").select("site_id", "key", "url_id")


@query("b08_membership", f"""WITH {ORDER_URLS_SQL},
    good AS (SELECT * FROM links WHERE reject IS NULL),
    members AS (SELECT DISTINCT site_id, key FROM good WHERE score > 250000)
    SELECT site_id, count(*) AS n_links, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM members m WHERE m.site_id = good.site_id AND m.key = good.key)) AS n_included
    FROM good GROUP BY 1""")
def _(t):
    found = good_links(t)
    members = found.where("score > 250000").select("site_id", "key")
    included = O.semi_by_key(found, members, ["site_id", "key"]).select("site_id", F.lit(1).alias("yes"))
    missing = O.anti_by_key(found, members, ["site_id", "key"]).select("site_id", F.lit(0).alias("yes"))
    return included.unionByName(missing).groupBy("site_id").agg(
        F.count("*").alias("n_links"), F.sum("yes").alias("n_included"))


@query("b09_dedup_queryless", f"""WITH {ORDER_URLS_SQL}
    SELECT site_id, host || port || '/' || trimmed_path || '?' AS queryless_key, min(url_id) AS url_id FROM links WHERE reject IS NULL GROUP BY 1, 2""")
def _(t):
    return O.dedup_queryless(good_links(t), ["site_id"], ["url_id"]).select("site_id", "queryless_key", "url_id")


@query("b10_resolve_redirects", """WITH RECURSIVE edges AS (
      SELECT c_custkey AS source, CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 WHEN c_custkey % 50 = 48 THEN c_custkey + 1
        WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey // 2 END AS target FROM customer WHERE c_custkey > 0),
    walk AS (SELECT source, target, 1 AS n FROM edges
      UNION ALL SELECT w.source, e.target, w.n + 1 FROM walk w JOIN edges e ON e.source = w.target WHERE w.n < 64),
    ended AS (SELECT source, max_by(target, n) AS target, max(n) AS n FROM walk GROUP BY 1)
    SELECT source, CASE WHEN n < 64 THEN target END AS target, CASE WHEN n < 64 THEN 'resolved' ELSE 'cycle' END AS status FROM ended""")
def _(t):
    c = F.col("c_custkey")
    edges = t.customer.where(c > 0).select(
        c.alias("source"), F.when(c % 50 == 49, c - 1).when(c % 50 == 48, c + 1).when(c % 3 == 0, -c).otherwise(
            F.floor(c / 2)).alias("target"))
    return O.resolve_redirects(edges)


RESPONSES_SQL = """responses AS (
  SELECT o_orderkey, 'https://c' || o_custkey || '.example.com/a/' || o_orderkey AS fetch_url,
    CASE o_orderkey % 5 WHEN 0 THEN '301' WHEN 1 THEN '200' WHEN 2 THEN '302' WHEN 3 THEN '200' ELSE '404' END AS code,
    CASE WHEN o_orderkey % 5 = 0 THEN '/b/' || o_orderkey WHEN o_orderkey % 5 = 2 THEN 'mailto:x@example.com' END AS location,
    o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 AS has_meta FROM orders)"""


def responses(t):
    k = F.col("o_orderkey")
    text = k.cast("string")
    pick = k % 5
    return t.orders.select(
        k, F.col("o_custkey").alias("crawl_id"),
        F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.com/a/"), text).alias("fetch_url"),
        F.when(pick == 0, "301").when(pick == 1, "200").when(pick == 2, "302").when(pick == 3, "200").otherwise("404").alias("code"),
        F.when(pick == 0, F.concat(F.lit("/b/"), text)).when(pick == 2, F.lit("mailto:x@example.com")).alias("location"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when((pick == 1) & (k % 2 == 0), F.concat(
            F.lit('<html><head><meta http-equiv="refresh" content="0; url=../c/'), text, F.lit('"></head></html>'))).otherwise(
            F.lit("<html></html>")).alias("body"))


@query("b11_redirect_edges", f"""WITH {RESPONSES_SQL}
    SELECT fetch_url, 'location' AS kind, location AS raw_target,
      CASE WHEN location LIKE '/%' THEN regexp_extract(fetch_url, '^(https://[^/]*)', 1) || location END AS target,
      location NOT LIKE '/%' AS bad_target FROM responses WHERE code LIKE '3%'
    UNION ALL
    SELECT fetch_url, 'meta_refresh', '../c/' || o_orderkey, regexp_extract(fetch_url, '^(https://[^/]*)', 1) || '/c/' || o_orderkey, false
    FROM responses WHERE has_meta""")
def _(t):
    return O.redirect_edges(responses(t))


@query("b12_classify_responses", """WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS attempt,
      'https://' || CASE WHEN o_orderkey % 2 = 0 THEN 'www.' ELSE '' END || 'c' || o_custkey || '.example.com/' AS fetch_url,
      CASE o_orderkey % 7 WHEN 0 THEN '200' WHEN 1 THEN '301' WHEN 2 THEN 'SSLError' WHEN 3 THEN '404' WHEN 4 THEN '503' WHEN 5 THEN 'ResponseBodyTooBig' ELSE 'Timeout' END AS code FROM orders)
    SELECT o_orderkey, CASE WHEN code = '200' THEN 'success' WHEN code = '301' THEN 'redirect'
      WHEN code = 'SSLError' AND o_orderkey % 2 = 0 THEN 'retry_without_www' WHEN code = 'SSLError' THEN 'tls_error'
      WHEN code IN ('404', 'ResponseBodyTooBig') OR attempt >= 3 THEN 'permanent_error' ELSE 'transient_error' END AS outcome,
      CASE WHEN code = 'SSLError' AND o_orderkey % 2 = 0 THEN replace(fetch_url, 'www.', '') END AS retry_url FROM r""")
def _(t):
    k = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in ("200", "301", "SSLError", "404", "503", "ResponseBodyTooBig", "Timeout")])
    df = t.orders.select(
        k, (k % 4).alias("attempt"), F.element_at(codes, (k % 7 + 1).cast("int")).alias("code"),
        F.concat(F.lit("https://"), F.when(k % 2 == 0, "www.").otherwise(""), F.lit("c"), F.col("o_custkey").cast("string"),
                 F.lit(".example.com/")).alias("fetch_url"))
    return O.classify_responses(df).select("o_orderkey", "outcome", "retry_url")


@query("b13_crawl_counters", f"""WITH {ORDER_URLS_SQL}
    SELECT site_id AS crawl_id, count(*) AS requests, count(DISTINCT key) AS pages, count(*) - count(DISTINCT key) AS duplicate_fetches
    FROM links WHERE reject IS NULL GROUP BY 1""")
def _(t):
    return O.crawl_counters(good_links(t).withColumnRenamed("site_id", "crawl_id"))


@query("b14_url_dates", f"""WITH {ORDER_URLS_SQL}
    SELECT url_id, strftime(CASE WHEN regexp_matches(path, '/[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}/') THEN
      try_cast(replace(regexp_extract(path, '/([0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}})/', 1), '/', '-') AS DATE) END, '%Y-%m-%d') AS url_date
    FROM links WHERE reject IS NULL""")
def _(t):
    dated = O.url_dates(good_links(t), F.col("parts.path"))
    return dated.select("url_id", F.date_format("url_date", "yyyy-MM-dd").alias("url_date"))


PREFIX_SQL = f"""{ORDER_URLS_SQL},
good AS (SELECT url_id, link_url, len(link_url) - len(replace(link_url, '/', '')) AS slashes FROM links WHERE reject IS NULL),
steps AS (SELECT url_id, link_url, slashes, unnest(range(slashes - 1)) AS depth FROM good),
prefixes AS (SELECT url_id, depth, array_to_string(string_split(link_url, '/')[1:(slashes + 1 - depth)::INT], '/') AS prefix_url FROM steps)"""


@query("b15_url_prefixes", f"""WITH {PREFIX_SQL}
    SELECT url_id, depth::INT AS depth, prefix_url, regexp_replace(prefix_url, '^https?://', '') AS prefix_key FROM prefixes""")
def _(t):
    return O.url_prefixes(good_links(t).select("url_id", "link_url"), "link_url").select(
        "url_id", "depth", "prefix_url", "prefix_key")


@query("b16_first_feed_prefix", f"""WITH {PREFIX_SQL},
    keyed AS (SELECT url_id, depth, regexp_replace(prefix_url, '^https?://', '') AS prefix_key FROM prefixes),
    feeds AS (SELECT 'c' || c_custkey || '.example.com' || suffix AS prefix_key, c_custkey || suffix || '.xml' AS feed_url
      FROM customer, (VALUES (''), ('/blog'), ('/essays'), ('/posts')) AS s(suffix) WHERE c_custkey % 2 = 0)
    SELECT url_id, min_by(feed_url, depth) AS feed_url, min(depth)::INT AS depth FROM keyed JOIN feeds USING (prefix_key) GROUP BY 1""")
def _(t):
    prefixes = O.url_prefixes(good_links(t).select("url_id", "link_url"), "link_url").select("url_id", "depth", "prefix_key")
    suffixes = F.array(*[F.lit(s) for s in ("", "/blog", "/essays", "/posts")])
    feeds = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.explode(suffixes).alias("suffix")).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.com"), F.col("suffix")).alias("prefix_key"),
        F.concat(F.col("c_custkey").cast("string"), F.col("suffix"), F.lit(".xml")).alias("feed_url"))
    return O.first_feed_prefix(prefixes, feeds, ["url_id"]).select("url_id", "feed_url", "depth")


@query("b17_rollup_parent_urls", f"""WITH {ORDER_URLS_SQL},
    up AS (SELECT regexp_replace(link_url, '(/[0-9]+)*/[^/]+/?$', '') AS up_url, score FROM links
      WHERE link_url IS NOT NULL AND link_url NOT LIKE '%jobs' AND link_url NOT LIKE '%careers'
        AND (len(string_split(link_url, '/')) > 4 OR (len(string_split(link_url, '/')) = 4 AND NOT ends_with(link_url, '/'))))
    SELECT regexp_replace(up_url, '^https?://', '') AS up_key, max(up_url) AS up_url, sum(score)::BIGINT AS sum_score, count(*) AS n
    FROM up GROUP BY 1""")
def _(t):
    return O.rollup_parent_urls(good_links(t).select(F.col("link_url").alias("url"), "score"))


@query("b18_rollup_newsletter_roots", f"""WITH {ORDER_URLS_SQL}
    SELECT split_part(link_url, '/p/', 1) AS root_url, sum(score)::BIGINT AS sum_score FROM links
    WHERE reject IS NULL AND year >= 1999 AND score > 100000 AND contains(link_url, '/p/') AND NOT contains(link_url, 'c1.example')
      AND site_id % 4 <> 0 GROUP BY 1""")
def _(t):
    urls = good_links(t).select(F.col("link_url").alias("url"), "score", "year")
    marked = t.customer.where("c_custkey % 4 <> 0").select(
        F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example.com")).alias("root_url"))
    return O.rollup_newsletter_roots(urls, marked, "c1.example", 1999, 100000)


@query("b19_query_param_profile", f"""WITH {ORDER_URLS_SQL},
    q AS (SELECT site_id, link_url, unnest(string_split(regexp_extract(link_url, '\\?([^#]*)', 1), '&')) AS kv FROM links WHERE contains(link_url, '?')),
    p AS (SELECT split_part(kv, '=', 1) AS param, count(DISTINCT link_url) AS n_urls, count(DISTINCT site_id) AS n_sites,
      count(DISTINCT coalesce(CASE WHEN contains(kv, '=') THEN kv[strpos(kv, '=') + 1:] END, '-')) AS n_values FROM q GROUP BY 1)
    SELECT *, n_urls = max(n_urls) OVER () AS most_urls, n_sites = max(n_sites) OVER () AS most_sites, n_values = max(n_values) OVER () AS most_values FROM p""")
def _(t):
    return O.query_param_profile(good_links(t).select("site_id", F.col("link_url").alias("url")))


@query("b19_repeated_param_urls", f"WITH {ORDER_URLS_SQL} SELECT url_id, link_url AS url FROM links WHERE contains(link_url, '?a=1&a=2')")
def _(t):
    return O.repeated_param_urls(good_links(t).select("url_id", F.col("link_url").alias("url")))


@query("b20_top_hosts", """WITH u AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host,
      regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', '') AS c, url FROM pages),
    k AS (SELECT DISTINCT host, rtrim(split_part(c, '?', 1), '/') || CASE WHEN contains(c, '?page=2') THEN '?page=2' ELSE '' END AS key FROM u)
    SELECT host, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, host LIMIT 50""")
def _(t):
    pages = O.canonicalize_urls(t.pages.select("page_id", "url"), "url")
    return O.top_hosts(O.dedup_by_key(pages, ["key"], ["page_id"]), "canonical", 50)


@query("b20_path_token_hist", f"""WITH {ORDER_URLS_SQL},
    tokens AS (SELECT string_split(regexp_replace(canonical, '/$', ''), '/')[-1] AS token FROM links WHERE reject IS NULL)
    SELECT CASE WHEN regexp_matches(token, '{O.ARCHIVE_TOKEN_PATTERN}') THEN '{O.ARCHIVE_TOKEN_PATTERN}' ELSE token END AS token, count(*) AS n FROM tokens GROUP BY 1""")
def _(t):
    return O.path_token_hist(good_links(t), "canonical")


@query("b21_classify_link_role", f"""WITH {ORDER_URLS_SQL}
    SELECT url_id, CASE WHEN regexp_matches(trimmed_path, '{U.ARCHIVES_PATTERN}') THEN 'archives'
      WHEN regexp_matches(trimmed_path, '{U.MAIN_PAGE_PATTERN}') THEN 'main_page' ELSE 'other' END AS role FROM links WHERE reject IS NULL""")
def _(t):
    return O.classify_link_role(good_links(t)).select("url_id", "role")


@query("b23_audit_urls", f"WITH {ORDER_URLS_SQL} SELECT coalesce(reject, 'ok') AS outcome, count(*) AS n FROM links GROUP BY 1")
def _(t):
    return O.audit_urls(links(t))
