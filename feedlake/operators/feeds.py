"""Feed documents to entry tables: parsing, metadata, order and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions import xmlfeeds as X
from feedlake.functions.ordered import position_chunk, with_previous, with_row_number, with_running_sum
from feedlake.functions.text import equalized_title, normalized_title

STAMP_CHUNK_SECONDS = 30 * 86_400


def classify_feeds(docs: DataFrame) -> DataFrame:
    """Add ``feed_kind`` (rss, rdf, atom, null) to ``docs(content)``."""
    return docs.withColumn("feed_kind", X.feed_kind(F.col("content")))


def _parsed(docs: DataFrame) -> DataFrame:
    flat = classify_feeds(docs).withColumn("_flat", X.flattened(F.col("content")))
    flat = flat.withColumn("_burner", X.root_element(F.col("content")).contains("xmlns:feedburner="))
    kind, text = F.col("feed_kind"), F.col("_flat")
    heads = F.when(kind == "atom", X.without_elements(text, ["entry", "author"])).otherwise(
        X.without_elements(text, ["item", "image", "textInput", "textinput"]))
    return flat.withColumns({
        "_head": heads,
        "_items": F.when(kind == "atom", X.elements(text, "entry")).when(kind.isNotNull(), X.elements(text, "item")),
    })


def parse_feeds(docs: DataFrame) -> DataFrame:
    """Entries of feed documents ``(feed_id, fetch_url, content)``: ``(feed_id, pos, title, date, url, feed_error)``.

    Every feed gives at least one row; ``pos`` is null for a feed without entries. ``feed_error`` holds for all rows of a
    feed in which any entry has no url, or an Atom element has several candidate links.
    """
    parsed = _parsed(docs)
    item = F.col("_item")
    exploded = parsed.select(
        "feed_id", "fetch_url", "feed_kind", "_burner", X.atom_link(F.col("_head")).alias("_root"),
        F.posexplode_outer("_items").alias("pos", "_raw"))
    exploded = exploded.withColumn("_item", F.when(F.col("feed_kind") == "atom", X.without_elements(
        F.col("_raw"), ["source", "author", "contributor"])).otherwise(F.col("_raw")))
    atom, rss = F.col("feed_kind") == "atom", F.col("feed_kind") == "rss"
    dates = {name: X.elements(item, name) for name in ("pubDate", "published", "updated", "dc:date")}
    # Texts first, then what is read from them: each text is computed once.
    texts = exploded.withColumns({
        "_orig": F.when(F.col("_burner") & (F.col("feed_kind") != "rdf"), X.first_markup(item, "feedburner:origLink")),
        "_atom": F.when(atom, X.atom_link(item)),
        "_url": F.when(~atom, F.coalesce(X.first_markup(item, "link"), F.when(rss, F.nullif(F.regexp_extract(
            item, r"(?s)<guid\s[^>]*isPermaLink\s*=\s*[\"']true[\"'][^>]*>(.*?)</", 1), F.lit(""))))),
        "_title": X.first_markup(item, "title"),
        "_dates": F.when(rss, dates["pubDate"]).when(
            atom, F.when(F.size(dates["published"]) == 0, dates["updated"]).otherwise(dates["published"])).otherwise(dates["dc:date"]),
    })
    single = texts.withColumn("_date", F.when(F.size("_dates") == 1, F.trim(F.element_at("_dates", 1))))
    rows = single.select(
        "feed_id", "fetch_url", "feed_kind", F.col("pos").cast("long").alias("pos"),
        F.trim(X.inner_text(F.col("_title"))).alias("raw_title"),
        F.when(rss, X.rfc822_date(F.col("_date"))).otherwise(X.iso_date(F.col("_date"))).alias("date"),
        F.coalesce(X.inner_text(F.coalesce("_orig", "_url")), F.col("_atom.href")).alias("url"),
        (atom & (F.coalesce(F.col("_atom.count"), F.lit(0)) > 1) & F.col("_orig").isNull()).alias("_ambiguous"),
        (atom & (F.col("_root.count") > 1)).alias("_bad_root"))
    decoded = rows.withColumn("_decoded", X.decoded_title(F.col("raw_title")))
    titled = decoded.withColumn("title", normalized_title(F.col("_decoded"))).drop("_decoded")
    # A window and not a join with the aggregate, which would parse every document twice; it holds one feed's items.
    bad = ((F.col("pos").isNotNull() & F.col("url").isNull()) | F.col("_ambiguous") | F.col("_bad_root") | F.col("feed_kind").isNull())
    flagged = titled.withColumn("feed_error", F.bool_or(bad).over(Window.partitionBy("feed_id")))
    return flagged.select("feed_id", "fetch_url", "feed_kind", "pos", "date", "url", "title", "feed_error")


def feed_metadata(docs: DataFrame) -> DataFrame:
    """Title (or host), canonical root link and generator class of each feed document."""
    parsed = _parsed(docs)
    atom = F.col("feed_kind") == "atom"
    head = F.col("_head")
    texts = parsed.select(
        "feed_id", "fetch_url", "feed_kind", F.trim(X.first_text(head, "title")).alias("_title"),
        F.lower(X.first_text(head, "generator")).alias("_generator"),
        F.when(atom, X.atom_link(head)["href"]).otherwise(X.first_text(head, "link")).alias("_root"))
    decoded = texts.withColumn("_decoded", X.decoded_title(F.col("_title")))
    generator = F.col("_generator")
    classed = F.when((F.col("feed_kind") == "rss") & generator.startswith("tumblr"), "tumblr").when(
        F.col("feed_kind").isin("rss", "atom") & (generator == "blogger"), "blogger").when(
        (F.col("feed_kind") == "rss") & (generator == "medium"), "medium")
    rows = decoded.select(
        "feed_id", "fetch_url", "feed_kind", classed.alias("generator"), "_root",
        F.when(F.coalesce("_title", F.lit("")) == "", U.url_host(F.col("fetch_url"))).otherwise(
            normalized_title(F.col("_decoded"))).alias("title"))
    linked = U.with_canonical(rows, "_root", "fetch_url", "root_")
    return linked.select("feed_id", "fetch_url", "feed_kind", "title", "generator",
                         F.when(F.col("_root").isNotNull(), F.col("root_link_url")).alias("root_url"))


def decode_titles(df: DataFrame, title: str = "title") -> DataFrame:
    return df.withColumn(title, X.decoded_title(F.col(title)))


def link_entries(entries: DataFrame) -> DataFrame:
    """Canonical links of parsed entries, resolved against the feed's url."""
    return U.with_canonical(entries.where("pos is not null and not feed_error"), "url", "fetch_url")


def infer_feed_order(entries: DataFrame) -> DataFrame:
    """Newest-first order of feed entries ``(feed_id, pos, date)``: adds ``order_certain`` and the new ``pos``.

    A missing date or fewer than two entries leave the order as it is. Ascending dates (all equal included) are reversed,
    unsorted ones sorted down with ties in document order.
    """
    chunk = position_chunk(F.col("pos"))
    stepped = with_previous(entries, ["feed_id"], ["pos"], {"_prev": "date"}, chunk)
    shape = stepped.groupBy("feed_id").agg(
        F.count("*").alias("_n"), F.bool_or(F.col("date").isNull()).alias("_missing"),
        F.coalesce(F.bool_or(F.col("_prev") < F.col("date")), F.lit(False)).alias("_rises"),
        F.coalesce(F.bool_or(F.col("_prev") > F.col("date")), F.lit(False)).alias("_falls"))
    mode = (
        F.when(F.col("_missing") | (F.col("_n") < 2), "keep")
        .when(F.col("_rises") & F.col("_falls"), "sort").when(~F.col("_falls"), "reverse").otherwise("descending")
    )
    joined = entries.join(shape, "feed_id").withColumn("_mode", mode)
    straight = joined.where("_mode <> 'sort'").withColumn(
        "_new", F.when(F.col("_mode") == "reverse", F.col("_n") - 1 - F.col("pos")).otherwise(F.col("pos")))
    seconds = F.unix_timestamp("date")
    by_age = joined.where("_mode = 'sort'").withColumn("_age", -seconds)
    ranked = with_row_number(by_age, ["feed_id"], [F.col("date").desc(), F.col("pos")], "_rank",
                             F.floor(F.col("_age") / STAMP_CHUNK_SECONDS))
    shuffled = ranked.withColumn("_new", F.col("_rank") - 1).drop("_rank", "_age")
    merged = straight.unionByName(shuffled)
    return merged.withColumns({"pos": F.col("_new").cast("long"), "order_certain": F.col("_mode") != "keep"}).drop(
        "_new", "_mode", "_n", "_missing", "_rises", "_falls")


def bucket_entries(entries: DataFrame) -> DataFrame:
    """Number the runs of equal dates along ``pos``; without a certain order every entry is its own bucket."""
    chunk = position_chunk(F.col("pos"))
    stepped = with_previous(entries, ["feed_id"], ["pos"], {"_prev": "date"}, chunk)
    starts = (~F.col("order_certain") | F.col("_prev").isNull() | (F.col("_prev") != F.col("date"))).cast("long")
    return with_running_sum(stepped, ["feed_id"], ["pos"], starts, "bucket", chunk).drop("_prev")


def route_feeds(entries: DataFrame) -> DataFrame:
    """What to do with a feed by its length: ``empty``, ``single``, ``long_feed`` (is the whole list) or ``mine_pages``."""
    sizes = entries.groupBy("feed_id").agg(F.count("pos").alias("n_entries"))
    n = F.col("n_entries")
    route = F.when(n == 0, "empty").when(n == 1, "single").when((n > 50) & (n % 100 != 0), "long_feed").otherwise("mine_pages")
    return sizes.withColumn("route", route)


def discarded_entries(entries: DataFrame, posts: DataFrame) -> DataFrame:
    """Feed entries missing from the discovered list (matched by ``feed_id`` and ``key``)."""
    return entries.join(posts.select("feed_id", "key"), ["feed_id", "key"], "left_anti")


def missing_from_feed(posts: DataFrame, entries: DataFrame) -> DataFrame:
    """Posts from the feed's last entry onward in the list ``(feed_id, pos, key)`` that the feed lacks.

    The list is searched from the post of the feed's last entry to its end.
    """
    lasts = entries.groupBy("feed_id").agg(F.max_by("key", "pos").alias("key"))
    starts = posts.join(lasts, ["feed_id", "key"]).groupBy("feed_id").agg(F.min("pos").alias("_start"))
    tail = posts.join(starts, "feed_id").where(F.col("pos") >= F.col("_start")).drop("_start")
    return tail.join(entries.select("feed_id", "key"), ["feed_id", "key"], "left_anti")


def infer_same_hosts(entries: DataFrame, redirects: DataFrame, entry_targets: DataFrame, largest_group: bool = False) -> DataFrame:
    """Hosts that count as one per feed: ``(feed_id, host)``.

    ``entries(feed_id, pos, link_url, host)``; ``redirects(feed_id, host, path, final_host, final_path)`` of the start page and
    the feed; ``entry_targets(link_url, final_host, same_path)`` for entries that were fetched. A redirect between equal
    paths counts when one of its hosts occurs among the entries. When that yields none of the entries' hosts, one entry of
    the smallest host group (``largest_group`` picks the largest) and its target are used.
    """
    groups = entries.groupBy("feed_id", "host").agg(
        F.count("*").alias("_n"), F.min("pos").alias("_first"), F.min_by("link_url", "pos").alias("link_url"))
    moved = redirects.where(F.col("path").eqNullSafe(F.col("final_path")))
    sides = moved.select("feed_id", F.explode(F.array("host", "final_host")).alias("_side"), "host", "final_host")
    seen = groups.select("feed_id", F.col("host").alias("_side"))
    confirmed = sides.join(seen, ["feed_id", "_side"], "left_semi")
    direct = confirmed.select("feed_id", F.explode(F.array("host", "final_host")).alias("host")).distinct()
    covered = groups.select("feed_id", "host").join(direct, ["feed_id", "host"], "left_semi").select("feed_id").distinct()
    size = -F.col("_n") if largest_group else F.col("_n")
    picked = groups.join(covered, "feed_id", "left_anti").groupBy("feed_id").agg(
        F.min_by(F.struct("host", "link_url"), F.struct(size, F.col("_first"))).alias("_g"))
    fetched = picked.select("feed_id", F.col("_g.host").alias("host"), F.col("_g.link_url").alias("link_url")).join(
        entry_targets.where("same_path"), "link_url")
    fallback = fetched.select("feed_id", F.explode(F.array("host", "final_host")).alias("host"))
    return direct.unionByName(fallback).distinct()


def title_agreement(posts: DataFrame, entries: DataFrame, matched: DataFrame) -> DataFrame:
    """Do list and feed agree on titles? ``success``, ``failure`` or ``neutral`` per feed.

    ``posts(feed_id, pos, eq_key, title)``, ``entries(feed_id, pos, bucket, eq_key, title)``, ``matched(feed_id, is_match)``
    from the sequence match. Neutral when the sequence does not match or the feed lacks a title. Each list position is
    compared with the first entry of its bucket that has its key.
    """
    firsts = entries.groupBy("feed_id", "bucket", "eq_key").agg(F.min_by("title", "pos").alias("feed_title"))
    slots = entries.select("feed_id", "pos", "bucket")
    pairs = posts.join(slots, ["feed_id", "pos"]).join(firsts, ["feed_id", "bucket", "eq_key"])
    same = equalized_title(F.col("title")).eqNullSafe(equalized_title(F.col("feed_title")))
    counts = pairs.groupBy("feed_id").agg(F.count("*").alias("n_compared"), F.count_if(same).alias("n_equal"))
    titled = entries.groupBy("feed_id").agg(F.bool_and(F.col("title").isNotNull()).alias("_titled"))
    joined = titled.join(matched.select("feed_id", "is_match"), "feed_id", "left").join(counts, "feed_id", "left")
    comparable = F.coalesce("is_match", F.lit(False)) & F.col("_titled")
    status = F.when(~comparable, "neutral").when(
        F.coalesce("n_equal", F.lit(0)) == F.coalesce("n_compared", F.lit(0)), "success").otherwise("failure")
    return joined.select("feed_id", status.alias("status"), F.when(comparable, F.coalesce("n_equal", F.lit(0))).alias("n_equal"),
                         F.when(comparable, F.coalesce("n_compared", F.lit(0))).alias("n_compared"))


API_SCHEMA = ("response struct<blog struct<url string, title string, posts int>, "
              "posts array<struct<post_url string, title string, summary string, timestamp long>>>")


def api_posts(pages: DataFrame) -> DataFrame:
    """Posts out of stored API pages ``(blog_id, page, body)``, newest first, with ``is_sorted`` per blog.

    Pages of one blog are read in order; timestamps must fall strictly all the way.
    """
    parsed = pages.withColumn("_r", F.from_json("body", API_SCHEMA)["response"])
    titles = parsed.groupBy("blog_id").agg(F.min_by(F.struct(
        F.col("_r.blog.title").alias("title"), F.col("_r.blog.posts").alias("expected")), "page").alias("_blog"))
    sized = parsed.withColumn("_size", F.size("_r.posts").cast("long"))
    offset = with_running_sum(sized.select("blog_id", "page", "_size"), ["blog_id"], ["page"], F.col("_size"), "_end",
                              position_chunk(F.col("page")))
    placed = parsed.join(offset, ["blog_id", "page"]).select(
        "blog_id", (F.col("_end") - F.col("_size")).alias("_start"), F.posexplode("_r.posts").alias("_i", "_p"))
    posts = placed.join(titles, "blog_id").select(
        "blog_id", (F.col("_start") + F.col("_i")).alias("pos"), F.col("_p.post_url").alias("url"),
        F.coalesce(normalized_title(F.coalesce(F.col("_p.title"), F.col("_p.summary"))), normalized_title(F.col("_blog.title"))).alias("title"),
        F.col("_p.timestamp").alias("timestamp"))
    stepped = with_previous(posts, ["blog_id"], ["pos"], {"_prev": "timestamp"}, position_chunk(F.col("pos")))
    checks = stepped.groupBy("blog_id").agg(
        F.coalesce(F.bool_and(F.col("_prev") > F.col("timestamp")), F.lit(True)).alias("is_sorted"))
    return posts.join(checks, "blog_id")
