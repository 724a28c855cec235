"""Finding the feeds of sites: typed urls, advertised feeds, probable feed links, start pages, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions import xmlfeeds as X
from feedlake.functions.ordered import first_per_key
from feedlake.operators.feeds import classify_feeds, parse_feeds
from feedlake.operators.urls import url_prefixes

# Media types of feeds, path shapes of probable feeds, a host that serves feeds only, the most candidates.
FEED_TYPES = ["application/rss+xml", "application/atom+xml"]
PROBABLE_PATHS = [r"/[^/]+\.(?:xml|rss|atom)$", r"/(?:feed|rss|atom)$", r"/(?:feeds?|rss|atom)/"]
FEED_HOST = "feeds.feedburner.com"
MAX_PROBABLE = 10


def normalize_start_urls(df: DataFrame, url: str, hosted_domain: str) -> DataFrame:
    """Start link of typed urls: adds ``start_url`` and ``outcome`` (null, ``not_a_url``, ``could_not_reach``).

    A text without scheme needs a dot. The bare root of a hosted newsletter goes to its feed.
    """
    raw = F.col(url)
    full = F.when(raw.rlike("^https?://"), raw).when(raw.contains("."), F.concat(F.lit("http://"), raw))
    linked = U.with_canonical(df.withColumn("_full", full), "_full", prefix="_s_")
    root = F.col("_s_parts.host").endswith(hosted_domain) & F.col("_s_parts.path").isin("", "/")
    to_feed = F.concat(F.regexp_replace("_s_link_url", "/$", ""), F.lit("/feed"))
    outcome = F.when(F.col("_full").isNull(), "not_a_url").when(
        F.col("_s_link_url").isNull(), F.when(F.col("_full") == raw, "could_not_reach").otherwise("not_a_url"))
    start = F.when(root, to_feed).otherwise(F.col("_s_link_url"))
    named = linked.withColumns({"outcome": outcome, "start_url": start})
    return named.drop("_full", "_s_reject", "_s_link_url", "_s_parts", "_s_canonical", "_s_key")


def advertised_feeds(pages: DataFrame) -> DataFrame:
    """Feeds that pages ``(page_id, url, html)`` announce with ``rel=alternate``: ``(page_id, pos, title, feed_url)``."""
    tag = F.regexp_extract_all(X.live_markup(F.col("html")), F.lit(r"(?is)<(?:a|area|link)\s[^>]*>(?:[^<]*</a>)?"), 0)
    tags = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(tag).alias("pos", "_tag"))
    head = F.regexp_extract("_tag", "(?s)^<[^>]*>", 0)
    found = tags.where((X.raw_attribute(head, "rel") == "alternate") & X.raw_attribute(head, "type").isin(FEED_TYPES))
    name = F.lower(F.regexp_extract("_tag", r"^<(\w+)", 1))
    title = F.when(name == "a", X.inner_text(F.col("_tag"))).when(name == "area", X.attribute(head, "alt")).otherwise(X.attribute(head, "title"))
    rows = found.select("page_id", "page_url", "pos", title.alias("title"), X.attribute(head, "href").alias("_href"))
    linked = U.with_canonical(rows, "_href", "page_url").where("reject is null")
    kept = linked.where(~F.col("link_url").endswith("?alt=rss") & ~F.col("parts.path").rlike("/comments/(feed|default)/?$"))
    return kept.select("page_id", "page_url", "pos", "title", F.col("link_url").alias("feed_url"))


def dedup_feed_variants(feeds: DataFrame) -> DataFrame:
    """Drop repeated feeds and rss / atom twins of each page, in document order.

    Twins have urls that differ in the last ``atom`` or ``rss``, or the bare titles ``rss`` and ``atom``. What a feed is
    compared with depends on the ones kept before it, so the page's few feeds are folded in order.
    """
    entry = F.struct("pos", "feed_url", F.lower("feed_url").alias("lower_url"), F.lower("title").alias("lower_title"), "title")
    grouped = feeds.groupBy("page_id", "page_url").agg(F.array_sort(F.collect_list(entry)).alias("_all"))

    def keep(acc: Column, feed: Column) -> Column:
        def url_seen(text: Column) -> Column:
            return F.exists(acc, lambda k: k["lower_url"] == text)

        def title_seen(text: str) -> Column:
            return F.exists(acc, lambda k: k["lower_title"] == text)

        lower, title = feed["lower_url"], F.coalesce(feed["lower_title"], F.lit(""))
        drop = (
            url_seen(feed["feed_url"])
            | (lower.contains("atom") & url_seen(F.regexp_replace(lower, "^(.+)atom(.*)$", "$1rss$2")))
            | (lower.contains("rss") & url_seen(F.regexp_replace(lower, "^(.+)rss(.*)$", "$1atom$2")))
            | ((title == "atom") & title_seen("rss")) | ((title == "rss") & title_seen("atom"))
        )
        return F.when(drop, acc).otherwise(F.concat(acc, F.array(feed)))

    folded = F.aggregate("_all", F.filter("_all", lambda x: F.lit(False)), keep)
    return grouped.select("page_id", "page_url", F.inline(folded)).drop("lower_url", "lower_title")


def fill_feed_titles(feeds: DataFrame, page_titles: DataFrame) -> DataFrame:
    """Feeds titled nothing, ``rss`` or ``atom`` take the page title, else the page's host."""
    joined = feeds.join(page_titles.select("page_id", F.col("title").alias("_page")), "page_id", "left")
    bare = F.col("title").isNull() | F.lower("title").isin("rss", "atom")
    return joined.withColumn("title", F.when(bare, F.coalesce("_page", U.url_host(F.col("page_url")))).otherwise(F.col("title"))).drop("_page")


def discovery_outcome(starts: DataFrame, feeds: DataFrame) -> DataFrame:
    """Outcome per start url ``(page_id, status, is_feed, feed_error)``: ``could_not_reach``, ``feed``, ``bad_feed``, ``no_feeds``,
    ``single_feed`` or ``multiple_feeds``. ``status`` is null when no page came back."""
    counts = feeds.groupBy("page_id").agg(F.count("*").alias("n_feeds"))
    joined = starts.join(counts, "page_id", "left").fillna(0, ["n_feeds"])
    outcome = (
        F.when(F.col("status").isNull(), "could_not_reach").when(F.col("is_feed") & F.col("feed_error"), "bad_feed")
        .when(F.col("is_feed"), "feed").when(F.col("n_feeds") == 0, "no_feeds").when(F.col("n_feeds") == 1, "single_feed")
        .otherwise("multiple_feeds")
    )
    return joined.withColumn("outcome", outcome)


def triage_seed_feeds(seeds: DataFrame, feeds: DataFrame, overrides: DataFrame) -> DataFrame:
    """Feed url of each seed: by hand, the only advertised one, or the only one left without comment feeds.

    ``overrides(page_id, priority, rss_url)``: recovered and manual urls, lower priority number first.
    """
    posts = ~F.lower("feed_url").contains("comments")
    counts = feeds.groupBy("page_id").agg(
        F.count("*").alias("n_feeds"), F.count_if(posts).alias("n_posts"), F.min("feed_url").alias("_only"),
        F.min(F.when(posts, F.col("feed_url"))).alias("_post"))
    manual = first_per_key(overrides, ["page_id"], ["priority", "rss_url"]).select("page_id", F.col("rss_url").alias("_manual"))
    joined = seeds.join(counts, "page_id", "left").join(manual, "page_id", "left").fillna(0, ["n_feeds", "n_posts"])
    group = F.when(F.col("_manual").isNotNull(), "override").when(F.col("n_feeds") == 0, "none").when(F.col("n_feeds") == 1, "one").when(
        F.col("n_posts") == 1, "reduced").otherwise("many")
    url = F.when(group == "override", F.col("_manual")).when(group == "one", F.col("_only")).when(group == "reduced", F.col("_post"))
    return joined.select(*seeds.columns, group.alias("triage"), url.alias("rss_url"))


def probable_feeds(advertised: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """Feed links of pages, anchors shaped like feeds included, whose document is a feed. More than ten candidates are none.

    ``advertised(page_id, feed_url)``, ``links(page_id, link_url, parts)``, ``docs(url, content)``.
    """
    path = F.coalesce("parts.trimmed_path", F.lit(""))
    shaped = F.col("parts.host") == FEED_HOST
    for pattern in PROBABLE_PATHS:
        shaped = shaped | path.rlike(pattern)
    candidates = advertised.select("page_id", "feed_url").unionByName(
        links.where(shaped).select("page_id", F.col("link_url").alias("feed_url"))).distinct()
    crowds = candidates.groupBy("page_id").agg(F.count("*").alias("_n")).where(F.col("_n") <= MAX_PROBABLE)
    known = classify_feeds(docs).where("feed_kind is not null").select(F.col("url").alias("feed_url"))
    return candidates.join(crowds.select("page_id"), "page_id", "left_semi").join(known, "feed_url", "left_semi")


def validate_feeds(docs: DataFrame) -> DataFrame:
    """Latest post link of stored feed responses ``(feed_id, fetch_url, code, content)`` or why there is none."""
    parsed = parse_feeds(docs.where("code = '200'"))
    latest = parsed.groupBy("feed_id").agg(
        F.first("feed_kind").alias("feed_kind"), F.bool_or("feed_error").alias("feed_error"), F.count("pos").alias("n_entries"),
        F.min_by("url", F.struct(-F.unix_micros(F.coalesce("date", F.lit("1900-01-01").cast("timestamp"))), F.col("pos"))).alias("latest_url"))
    joined = docs.select("feed_id", "code").join(latest, "feed_id", "left")
    reason = F.when(F.col("code") != "200", "bad_status").when(F.col("feed_kind").isNull(), "not_a_feed").when(
        F.col("n_entries") == 0, "empty").when(F.col("feed_error"), "bad_xml")
    return joined.select("feed_id", reason.alias("reason"), F.when(reason.isNull(), F.col("latest_url")).alias("latest_url"))


def start_page_for_feed(feeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Start page of feeds ``(feed_id, feed_url, root_url)``: the root link if stored, else the nearest parent that is.

    ``pages(url)`` are the usable stored pages; where one is stored with and without a slash at its end, that without counts.
    """
    stored = pages.groupBy(F.regexp_replace("url", "/$", "").alias("_key")).agg(F.min("url").alias("url"))
    root = feeds.where("root_url is not null").select("feed_id", F.lit(-1).alias("depth"), F.col("root_url").alias("_url"))
    parents = url_prefixes(feeds.select("feed_id", F.regexp_replace("feed_url", r"[?#].*$", "").alias("_feed")), "_feed").where("depth > 0").select(
        "feed_id", "depth", F.col("prefix_url").alias("_url"))
    candidates = root.unionByName(parents).withColumn("_key", F.regexp_replace("_url", "/$", ""))
    found = candidates.join(stored, "_key")
    return first_per_key(found, ["feed_id"], ["depth"]).select("feed_id", F.col("url").alias("start_url"), (F.col("depth") < 0).alias("from_root"))


def detect_platform(pages: DataFrame) -> DataFrame:
    """Platform markers of pages ``(page_id, url, html)``."""
    live = pages.select("page_id", "url", X.live_markup(F.col("html")).alias("html"))
    html = F.col("html")

    def value(tag: Column, name: str) -> Column:
        return F.coalesce(X.raw_attribute(tag, name), F.lit(""))

    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    rss_link = F.exists(X.start_tags(html, "link"), lambda t: (value(t, "type") == "application/rss+xml") & value(t, "href").startswith("https://medium."))
    site = F.exists(X.start_tags(html, "meta"), lambda t: (value(t, "name") == "twitter:site") & (value(t, "content") == "@buttondown"))
    # Texts that lack the word at all need no look at their tags.
    return live.select(
        "page_id",
        (html.contains("load-more") & F.exists(X.start_tags(html, "a|button"), lambda t: value(t, "class").contains("load-more"))).alias("has_load_more"),
        (html.contains("https://medium.") & rss_link & (F.size(X.start_tags(html, "article")) == 10)).alias("is_article_list"),
        (path.rlike("/archive/*$") & html.contains("footer-substack") & F.exists(
            X.start_tags(html, r"\w+"), lambda t: value(t, "class").contains("footer-substack"))).alias("is_newsletter_archive"),
        (html.contains("@buttondown") & site).alias("is_newsletter"))


def non_post_report(entries: DataFrame) -> DataFrame:
    """Entries of each feed under its most common first path step against the others; shortest feeds first."""
    step = F.regexp_extract(F.coalesce("parts.trimmed_path", F.lit("")), "^(/[^/]*)", 1)
    groups = entries.groupBy("feed_id", step.alias("path_step")).agg(F.count("*").alias("n"))
    sizes = groups.groupBy("feed_id").agg(F.sum("n").alias("n_entries"), F.max_by("path_step", F.struct("n", "path_step")).alias("main_step"), F.max("n").alias("n_main"))
    return sizes.withColumn("n_other", F.col("n_entries") - F.col("n_main")).orderBy("n_entries", "feed_id")
