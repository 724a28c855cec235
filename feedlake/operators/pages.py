"""Page snapshots to link, text and title tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions import xmlfeeds as X
from feedlake.functions.dates import text_date
from feedlake.functions.dom import NODE_SCHEMA, page_link_nodes, page_nodes
from feedlake.functions.ordered import first_per_key
from feedlake.functions.text import equalized_title, normalized_title

# Fixed value: a path that ends like a year, month or day archive.
YEAR_ARCHIVE_PATTERN = r"/\d\d\d\d(/\d\d)?(/\d\d)?$"


def nodes(pages: DataFrame) -> DataFrame:
    """Positions of links, texts, times and meta tags of ``pages(page_id, url, html)``."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(page_nodes, NODE_SCHEMA)


def link_nodes(pages: DataFrame) -> DataFrame:
    """The ``nodes`` that can become links; no others leave Python."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(page_link_nodes, NODE_SCHEMA)


def canonical_xpath(path: Column) -> Column:
    """Give every step without an index the index 1."""
    return F.regexp_replace(path, r"(/[^/\[\]]+)(?=/|$)", "$1[1]")


def class_token(classes: Column) -> Column:
    """Class attribute as it enters a position: sorted names without post ids, brackets and slashes escaped."""
    names = F.filter(F.split(F.trim(classes), r"\s+"), lambda n: (n != "") & ~n.rlike(r"^post-\d+$"))

    def escaped(name: Column) -> Column:
        for raw, code in (("/", "%2F"), ("[", "%5B"), ("]", "%5D"), ("(", "%28"), (")", "%29")):
            name = F.replace(name, F.lit(raw), F.lit(code))
        return name

    return F.array_join(F.array_sort(F.transform(names, escaped)), ",")


def page_links(pages: DataFrame, redirects: DataFrame | None = None, hosts: list[str] | None = None) -> DataFrame:
    """Links of pages in order: anchors, ``rel=next``, ``rel=prev``, areas; document order inside.

    Empty anchors without a label are left out. ``redirects(source, target)`` (resolved) replace link targets; ``hosts``
    keeps links to these hosts only. The order column ``pos`` has gaps.
    """
    return links_of_nodes(link_nodes(pages), redirects, hosts)


def links_of_nodes(found: DataFrame, redirects: DataFrame | None = None, hosts: list[str] | None = None) -> DataFrame:
    kind = (
        F.when(F.col("kind") == "a", 0).when((F.col("kind") == "link") & (F.col("rel") == "next"), 1)
        .when((F.col("kind") == "link") & (F.col("rel") == "prev"), 2).when(F.col("kind") == "area", 3)
    )
    hidden = (F.col("kind") == "a") & F.col("is_empty") & (F.coalesce("label", F.lit("")) == "")
    rows = found.where(kind.isNotNull() & F.col("href").isNotNull() & ~hidden).select(
        "page_id", "page_url", (kind.cast("long") * 1_000_000_000 + F.col("seq")).alias("pos"), "xpath", "class_xpath", "href", F.col("value").alias("text"))
    links = U.with_canonical(rows, "href", "page_url").where("reject is null")
    if redirects is not None:
        moved = redirects.select(F.col("source").alias("link_url"), F.col("target").alias("_target"))
        joined = links.join(moved, "link_url", "left").drop("reject", "parts", "canonical", "key")
        joined = joined.withColumn("_final", F.coalesce("_target", "link_url")).drop("link_url", "_target")
        links = U.with_canonical(joined, "_final").drop("_final")
    return links if hosts is None else links.where(F.col("parts.host").isin(hosts))


def text_dates(df: DataFrame, text: str, guess_year: Column | None = None) -> DataFrame:
    return df.withColumn("text_date", text_date(F.col(text), guess_year))


def dated_nodes(found: DataFrame) -> DataFrame:
    """Text and time nodes that state a date: ``(page_id, seq, xpath, source, date)``."""
    rows = found.where("kind in ('text', 'time')").withColumn("date", text_date(F.col("value")))
    return rows.where("date is not null").select("page_id", "seq", "xpath", "class_xpath", F.col("kind").alias("source"), "date")


def page_titles(pages: DataFrame, prefer_og: Column | None = None) -> DataFrame:
    """Title per page: ``og:title`` where present and preferred, else the title element."""
    prefer = F.lit(True) if prefer_og is None else prefer_og
    live = pages.withColumns({"_live": X.live_markup(F.col("html")), "_prefer": prefer})
    metas = F.filter(X.start_tags(F.col("_live"), "meta"), lambda tag: X.raw_attribute(tag, "property") == "og:title")
    read = live.select("page_id", "_prefer", F.coalesce(X.attribute(F.get(metas, F.lit(0)), "content"), F.lit("")).alias("_og"),
                       F.regexp_extract("_live", r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1).alias("_title"))
    use_og = (F.col("_og") != "") & F.col("_prefer")
    return read.select("page_id", normalized_title(F.when(use_og, F.col("_og")).otherwise(F.col("_title"))).alias("title"))


def _common_prefix(a: Column, b: Column) -> Column:
    return F.regexp_extract(F.concat(a, F.lit("\0"), b), r"(?s)^([^\x00]*)[^\x00]*\x00\1", 1)


def common_affixes(titles: DataFrame) -> DataFrame:
    """Common prefix and suffix of each blog's page titles ``(blog_id, title)``.

    The common prefix of a set is that of its least and greatest member, so two aggregates are enough. A suffix does not
    begin with an ellipsis; both are void when they would use up the shortest title.
    """
    ends = titles.groupBy("blog_id").agg(
        F.min("title").alias("_a"), F.max("title").alias("_b"), F.min(F.reverse("title")).alias("_c"),
        F.max(F.reverse("title")).alias("_d"), F.min(F.length("title")).alias("_shortest"), F.count("*").alias("n_titles"))
    found = ends.select("blog_id", "n_titles", "_shortest", _common_prefix(F.col("_a"), F.col("_b")).alias("_p"),
                        F.reverse(_common_prefix(F.col("_c"), F.col("_d"))).alias("_s"))
    cut = found.withColumn("_s", F.regexp_replace("_s", r"^(?:\.\.\.|…)", ""))
    void = F.length("_p") + F.length("_s") >= F.col("_shortest")
    return cut.select("blog_id", "n_titles", F.when(void, "").otherwise(F.col("_p")).alias("prefix"),
                      F.when(void, "").otherwise(F.col("_s")).alias("suffix"))


def strip_common_affixes(titles: DataFrame, list_sizes: DataFrame, first_titles: DataFrame) -> DataFrame:
    """Page titles without their blog's common prefix and suffix.

    They are cut only when all titles of the list come from pages, or the page title of the first link, whose own title is
    known to be clean (``first_titles(blog_id, page_title)``), has them too. ``list_sizes(blog_id, n_links)``.
    """
    affixes = common_affixes(titles).join(list_sizes, "blog_id").join(first_titles, "blog_id", "left")
    fits = F.col("page_title").startswith(F.col("prefix")) & F.col("page_title").endswith(F.col("suffix"))
    valid = (F.col("n_titles") == F.col("n_links")) | F.coalesce(fits, F.lit(False))
    used = affixes.select("blog_id", F.when(valid, F.col("prefix")).otherwise("").alias("prefix"),
                          F.when(valid, F.col("suffix")).otherwise("").alias("suffix"))
    joined = titles.join(used, "blog_id")
    middle = F.substring("title", F.length("prefix") + 1, F.length("title") - F.length("prefix") - F.length("suffix"))
    return joined.withColumn("title", middle)


def fill_titles(links: DataFrame, entries: DataFrame, page_title_rows: DataFrame) -> DataFrame:
    """Titles by priority: own, feed (only for lists not longer than the feed), page, url; with their source.

    ``links(blog_id, key, url, title, source)``, ``entries(blog_id, key, title)``, ``page_title_rows(url, title)``.
    """
    feed_titles = first_per_key(entries, ["blog_id", "key"], ["title"]).select("blog_id", "key", F.col("title").alias("_feed"))
    sizes = entries.groupBy("blog_id").agg(F.count("*").alias("_n_feed"))
    lists = links.groupBy("blog_id").agg(F.count("*").alias("_n_list"))
    joined = (
        links.join(lists, "blog_id").join(sizes, "blog_id", "left").join(feed_titles, ["blog_id", "key"], "left")
        .join(page_title_rows.select("url", F.col("title").alias("_page")), "url", "left")
    )
    feed = F.when(F.col("_n_list") <= F.col("_n_feed"), F.col("_feed"))
    source = F.when(F.col("title").isNotNull(), F.col("source")).when(feed.isNotNull(), "feed").when(
        F.col("_page").isNotNull(), "page_title").otherwise("page_url")
    return joined.withColumns({"source": source, "title": F.coalesce("title", feed, "_page", "url")}).drop(
        "_n_list", "_n_feed", "_feed", "_page")


def title_source_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("blog_id", "source").agg(F.count("*").alias("n"))


def common_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links that two posts of a blog share, in the order of the second. ``pairs(blog_id, page_a, page_b)``."""
    second = pairs.select("blog_id", F.col("page_a").alias("_a"), F.col("page_b").alias("page_id"))
    firsts = first_per_key(links.join(second, "page_id"), ["page_id", "key"], ["pos"])
    other = links.select(F.col("page_id").alias("_a"), "key").distinct()
    return firsts.join(other, ["_a", "key"], "left_semi").drop("_a")


def candidate_pages(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages worth fetching per blog, with their role; ``links(blog_id, source, pos, parts, key)``.

    ``source`` is ``start_page`` or ``two_entries``. Archive and main pages come first. Others must not be feed entries;
    from two entries they must not look like year archives when there are more than ten; from the start page they must be
    at most one level deep and no year archive, and are skipped when feed entries are top level themselves.
    """
    path = F.coalesce(F.col("parts.trimmed_path"), F.lit(""))
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    roled = links.withColumns({
        "role": U.link_role(path), "_depth": depth, "_yearly": path.rlike(YEAR_ARCHIVE_PATTERN),
        "queryless_key": U.canonical_key(U.without_query(F.col("parts"))),
    })
    in_feed = entries.select("blog_id", "key").distinct().withColumn("_feed", F.lit(True))
    tops = entries.groupBy("blog_id").agg(F.bool_or(F.coalesce("depth", F.lit(0)) <= 1).alias("_top_entries"))
    flagged = roled.join(in_feed, ["blog_id", "key"], "left").join(tops, "blog_id", "left")
    other = (F.col("role") == "other") & (F.col("source") == "two_entries") & F.col("_feed").isNull()
    crowds = flagged.where(other).groupBy("blog_id").agg(F.count("*").alias("_crowd"))
    joined = flagged.join(crowds, "blog_id", "left")
    keep = (
        F.when(F.col("role") != "other", True)
        .when(F.col("source") == "two_entries", F.col("_feed").isNull() & (~F.col("_yearly") | (F.col("_crowd") <= 10)))
        .otherwise((F.col("_depth") <= 1) & ~F.col("_yearly") & ~F.coalesce("_top_entries", F.lit(False)))
    )
    kept = joined.where(keep).drop("_depth", "_yearly", "_feed", "_top_entries", "_crowd")
    rank = F.when(F.col("role") == "archives", 0).when(F.col("role") == "main_page", 1).otherwise(2)
    return first_per_key(kept, ["blog_id", "queryless_key"], [rank, F.col("source"), F.col("pos")])


def equalize_titles(df: DataFrame, title: str = "title") -> DataFrame:
    return df.withColumn("equalized", equalized_title(F.col(title)))
