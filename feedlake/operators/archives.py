"""Archive detectors: candidate post lists out of mask groups, over all pages at once.

``groups(page_id, mask, stars, pos, key, url_date, date)`` are mask members; ``entries(page_id, pos, bucket, key)`` is the feed of the
page's blog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.dates import text_date
from feedlake.functions.ordered import first_per_key, position_chunk, with_row_number
from feedlake.operators.seqmatch import filter_included, match_except_first, sequence_match
from feedlake.session import checkpointed, checkpointed_pages


# How many entries of a feed a page or list must share with it to count as an almost full match.
def almost_threshold(n: Column) -> Column:
    return F.when(n <= 3, n).when(n <= 7, n - 1).when(n <= 25, n - 2).when(n <= 62, n - 3).otherwise(n - 7)


def category_threshold(n: Column) -> Column:
    return F.when(n <= 9, n).when(n <= 19, n - 1).otherwise(n - 2)


def archive_gate(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages holding enough of their feed: ``(page_id, n_entries, n_included, threshold)``."""
    on_page = links.select("page_id", "key").distinct().withColumn("_in", F.lit(1))
    counts = entries.join(on_page, ["page_id", "key"], "left").groupBy("page_id").agg(
        F.count("*").alias("n_entries"), F.count("_in").alias("n_included"))
    return counts.withColumn("threshold", almost_threshold(F.col("n_entries"))).where("n_included >= threshold")


def _group_id() -> Column:
    return F.concat_ws("|", F.col("page_id").cast("string"), F.col("stars").cast("string"), "mask")


def _shapes(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Per group: links, distinct links, feed entries it holds."""
    sizes = groups.groupBy("page_id", "stars", "mask").agg(F.count("*").alias("n_links"), F.count_distinct("key").alias("n_distinct"))
    feed = entries.groupBy("page_id").agg(F.count("*").alias("n_feed"))
    held = groups.select("page_id", "stars", "mask", "key").distinct().join(entries.select("page_id", "key").distinct(), ["page_id", "key"]).groupBy(
        "page_id", "stars", "mask").agg(F.count("*").alias("n_held"))
    keys = ["page_id", "stars", "mask"]
    return sizes.join(feed, "page_id").join(held, keys, "left").fillna(0, ["n_held"]).withColumn("group_id", _group_id())


def _lists_of(groups: DataFrame, shapes: DataFrame) -> DataFrame:
    """Links of the groups in ``shapes (group_id)``, stored: ``feed_id`` (the group), ``page_id, pos, key``."""
    ids = shapes.select(F.col("group_id").alias("feed_id"))
    return checkpointed(groups.withColumn("feed_id", _group_id()).join(ids, "feed_id", "left_semi").select("feed_id", "page_id", "pos", "key"))


def _feeds_of(lists: DataFrame, entries: DataFrame) -> DataFrame:
    """The feed of each group's page, stored."""
    return checkpointed(lists.select("feed_id", "page_id").distinct().join(entries, "page_id").select("feed_id", "pos", "bucket", "key"))


def _matches(lists: DataFrame, per_group: DataFrame, reverse: bool) -> DataFrame:
    """Groups whose list, read down or up the page, follows the feed from its start."""
    turned = lists.select("feed_id", (-F.col("pos") if reverse else F.col("pos")).alias("_at"), "key")
    seq = with_row_number(turned, ["feed_id"], ["_at"], "_n", position_chunk(F.col("_at")))
    return sequence_match(per_group, seq.select("feed_id", (F.col("_n") - 1).alias("seq_pos"), "key")).where("is_match").select(
        F.col("feed_id").alias("group_id"))


def detect_sorted(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Groups that are the full list in order: at least as long as the feed, no link twice, following the feed down or up.

    Only groups of that length meet the feed.
    """
    shapes = checkpointed(_shapes(groups, entries).where("n_links >= n_feed and n_links = n_distinct"))
    lists = _lists_of(groups, shapes)
    per_group = _feeds_of(lists, entries)
    down = _matches(lists, per_group, False).withColumn("is_reversed", F.lit(False))
    up = _matches(lists, per_group, True).withColumn("is_reversed", F.lit(True))
    found = shapes.join(first_per_key(down.unionByName(up), ["group_id"], ["is_reversed"]), "group_id")
    return found.select("page_id", "stars", "mask", "n_links", "is_reversed", F.lit("archives").alias("pattern"))


def detect_almost_feed(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Groups shorter than the feed and made of its entries only, nearly all of them: the feed itself is the list."""
    shapes = _shapes(groups, entries)
    least = almost_threshold(F.col("n_feed"))
    close = (F.col("n_links") < F.col("n_feed")) & (F.col("n_held") == F.col("n_distinct")) & (F.col("n_links") >= least) & (F.col("n_held") >= least)
    return shapes.where(close).select("page_id", "stars", "mask", F.col("n_feed").alias("n_links"), F.lit("feed").alias("pattern"))


def detect_shuffled(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Groups that hold the whole feed (or almost) and more, in any order; ``has_dates`` when every link can be dated."""
    shapes = _shapes(groups, entries)
    fit = shapes.where((F.col("n_distinct") >= F.col("n_feed")) & (F.col("n_held") >= almost_threshold(F.col("n_feed"))))
    dated = groups.groupBy("page_id", "stars", "mask").agg(F.bool_and(F.coalesce("url_date", "date").isNotNull()).alias("has_dates"))
    joined = fit.join(dated, ["page_id", "stars", "mask"])
    pattern = F.when(F.col("n_held") == F.col("n_feed"), "shuffled").otherwise("shuffled_almost")
    return joined.select("page_id", "stars", "mask", F.col("n_distinct").alias("n_links"), "has_dates", pattern.alias("pattern"))


def detect_pinned(groups: DataFrame, entries: DataFrame, page_keys: DataFrame, generators: DataFrame) -> DataFrame:
    """Groups of one star that hold all feed entries but one, which stands elsewhere on the page; all their links are dated.

    Only pages whose feed ``generators(page_id, generator)`` names as ``medium`` are judged. ``page_keys(page_id, key)``
    holds all links of a page; ``pinned_key`` is the entry that stands apart.
    """
    keys = ["page_id", "stars", "mask"]
    medium = generators.where("generator = 'medium'").select("page_id").distinct()
    own = groups.where("stars = 1").join(medium, "page_id", "left_semi")
    shapes = _shapes(own, entries).where("n_distinct >= n_feed - 1 and n_held = n_feed - 1 and n_feed >= 2")
    dated = own.groupBy(*keys).agg(F.bool_and(F.coalesce("url_date", "date").isNotNull()).alias("_dated")).where("_dated")
    fit = shapes.join(dated, keys)
    # The one entry of the feed that the group lacks: all pairs here are entries of one feed.
    lacking = fit.select(*keys, "n_distinct").join(entries.select("page_id", "key").distinct(), "page_id").join(
        own.select(*keys, "key").distinct(), [*keys, "key"], "left_anti")
    found = lacking.join(page_keys.select("page_id", "key").distinct(), ["page_id", "key"], "left_semi")
    return found.select(*keys, (F.col("n_distinct") + 1).alias("n_links"), F.col("key").alias("pinned_key"), F.lit("pinned").alias("pattern"))


def detect_long_feed(page_keys: DataFrame, entries: DataFrame, best: DataFrame) -> DataFrame:
    """Pages holding every entry of a feed of 31 or more that beats the page's best list. ``best(page_id, n_links)``."""
    held = entries.join(page_keys.select("page_id", "key").distinct().withColumn("_in", F.lit(1)), ["page_id", "key"], "left")
    counts = held.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count("_in").alias("_held"))
    tops = best.groupBy("page_id").agg(F.max("n_links").alias("_best"))
    joined = counts.join(tops, "page_id", "left")
    fits = (F.col("n_links") >= 31) & (F.col("n_links") == F.col("_held")) & (F.col("n_links") > F.coalesce("_best", F.lit(0)))
    return joined.where(fits).select("page_id", "n_links", F.lit("long_feed").alias("pattern"))


# The order in which detectors are asked on one page, each with one, two and three stars in turn.
STAGES = ["archives", "archives_first", "pinned", "two_masks", "feed", "shuffled", "shuffled_two_masks", "archives_almost", "shuffled_almost", "long_feed"]
SHUFFLED = ["shuffled", "shuffled_two_masks", "shuffled_almost"]

_CANDIDATE = "struct<stage:int,stars:int,n_links:long,has_dates:boolean,pattern:string,mask:string>"


def archive_candidates(*detected: DataFrame) -> DataFrame:
    """Results of the detector cascade of each page: at most one main list, and one bundle of shuffled ones.

    Detectors are asked in the order of ``STAGES``; of one stage and number of stars the longest list counts, then the
    first mask. A list is accepted if it is longer than all accepted before. A pinned list that is accepted ends the
    cascade and stands alone. Shuffled lists are not asked for once the main list is sorted and dated; accepted ones form
    the bundle, except that a shuffled list in which ``is_sorted`` holds becomes the main list. Any other accepted list
    replaces the main list. ``bundle_links`` is the length of the longest list of the bundle.
    """
    optional = {"has_dates": "boolean", "is_sorted": "boolean", "mask": "string", "stars": "int"}
    columns = ["page_id", "n_links", "pattern", *optional]
    rows = reduce(DataFrame.unionByName, [d.withColumns({
        k: F.lit(None).cast(t) for k, t in optional.items() if k not in d.columns}).select(*columns) for d in detected])
    stage = F.coalesce(*[F.when(F.col("pattern") == p, i) for i, p in enumerate(STAGES)])
    staged = rows.withColumn("stage", stage).where("stage is not null")
    best = first_per_key(staged, ["page_id", "stage", "stars"], [F.col("n_links").desc(), "mask"])
    # At most one row per detector and number of stars is left for a page.
    order = F.struct("stage", F.coalesce("stars", F.lit(0)).alias("order"), F.struct(
        "stage", "stars", F.col("n_links").cast("long").alias("n_links"), F.coalesce("has_dates", F.lit(False)).alias("has_dates"),
        "pattern", "mask").cast(_CANDIDATE).alias("c"), F.coalesce("is_sorted", F.lit(False)).alias("is_sorted"))
    grouped = best.groupBy("page_id").agg(F.array_sort(F.collect_list(order)).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("least"), F.lit(False).alias("over"), F.lit(None).cast(_CANDIDATE).alias("main"),
                     F.array().cast(f"array<{_CANDIDATE}>").alias("bundle"))

    def ask(acc: Column, item: Column) -> Column:
        c = item["c"]
        shuffled = c["pattern"].isin(SHUFFLED)
        dated_main = F.coalesce(acc["main"]["has_dates"] & acc["main"]["pattern"].isin("archives", "archives_almost", *SHUFFLED), F.lit(False))
        taken = ~acc["over"] & (c["n_links"] >= acc["least"]) & ~(shuffled & dated_main)
        pinned = c["pattern"] == "pinned"
        into_bundle = shuffled & ~item["is_sorted"]
        return F.when(taken, F.struct(
            (c["n_links"] + 1).alias("least"), pinned.alias("over"), F.when(into_bundle, acc["main"]).otherwise(c).alias("main"),
            F.when(into_bundle, F.concat(acc["bundle"], F.array(c))).otherwise(acc["bundle"]).alias("bundle"))).otherwise(acc)

    folded = grouped.select("page_id", F.aggregate("_all", start, ask).alias("r"))
    main = F.when(F.col("r.main").isNotNull(), F.array(F.struct(F.lit("main").alias("part"), F.col("r.main").alias("c")))).otherwise(
        F.array().cast(f"array<struct<part:string,c:{_CANDIDATE}>>"))
    bundle = F.transform("r.bundle", lambda c: F.struct(F.lit("bundle").alias("part"), c.alias("c")))
    longest = F.array_max(F.transform("r.bundle", lambda c: c["n_links"]))
    return folded.select("page_id", longest.alias("_longest"), F.explode(F.concat(main, bundle)).alias("x")).select(
        "page_id", "x.part", "x.c.pattern", "x.c.stars", "x.c.mask", "x.c.n_links",
        F.when(F.col("x.part") == "bundle", F.col("_longest")).alias("bundle_links"))


# Paging.

def page2_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Link from a page to page two, with the template of its page numbers.

    ``links(page_id, host, trimmed_path, query, raw_query, key, link_url)``, ``pages(page_id, page_host, generator)``. Rules go by rank: date
    cursors of one platform, numbered path, ``page=2`` query, path ending in ``/2`` (uncertain). More than one distinct
    target is none.
    """
    joined = links.join(pages, "page_id")
    path, query = F.coalesce("trimmed_path", F.lit("")), F.coalesce("query", F.lit(""))
    same = F.col("host") == F.col("page_host")
    cursor = (F.col("generator") == "blogger") & (path == "/search") & F.coalesce("raw_query", F.lit("")).rlike("updated-max=([^&]+)")
    rule = (
        F.when(F.coalesce(cursor, F.lit(False)), 0).when(same & path.rlike(r"/(?:index-?2|page/?2)[^/^\d]*$"), 1)
        .when(same & query.rlike(r"([^?^&]*page=)2(?:&|$)"), 2).when(same & path.rlike("/2$"), 3)
    )
    ruled = joined.withColumn("rule", rule).where("rule is not null")
    firsts = ruled.groupBy("page_id", "rule").agg(
        F.min("key").alias("_a"), F.max("key").alias("_b"), F.min_by(F.struct("link_url", "host", "trimmed_path", "query"), "link_url").alias("_l"))
    chosen = first_per_key(firsts, ["page_id"], ["rule"]).where("_a = _b")
    link_path = F.col("_l.trimmed_path")
    at = F.length(link_path) - F.instr(F.reverse(link_path), "2") + 1
    return chosen.select(
        "page_id", F.col("_l.link_url").alias("link_url"), F.col("_l.host").alias("host"), (F.col("rule") != 3).alias("is_certain"),
        F.when(F.col("rule").isin(1, 3), F.concat(F.expr("left(_l.trimmed_path, length(_l.trimmed_path) - instr(reverse(_l.trimmed_path), '2'))"), F.lit("%d"),
                                                   F.substring(link_path, at + 1, F.length(link_path)))).alias("path_template"),
        F.when(F.col("rule") == 2, F.concat(F.regexp_extract(F.col("_l.query"), r"([^?^&]*page=)2(?:&|$)", 1), F.lit("%d"))).alias("query_template"))


def next_page_links(links: DataFrame, templates: DataFrame) -> DataFrame:
    """Link to page ``number`` of a paging template: ``(page_id, status, link_url)``, status ``none``, ``one`` or ``multiple``.

    ``templates(page_id, host, path_template, query_template, number)``.
    """
    want = templates.select(
        "page_id", "host", F.replace("path_template", F.lit("%d"), F.col("number").cast("string")).alias("_path"),
        F.replace("query_template", F.lit("%d"), F.col("number").cast("string")).alias("_query"))
    joined = links.join(want, ["page_id", "host"]).where(
        F.when(F.col("_path").isNotNull(), F.col("trimmed_path") == F.col("_path")).otherwise(F.col("query").contains(F.col("_query"))))
    found = joined.groupBy("page_id").agg(F.min("key").alias("_a"), F.max("key").alias("_b"), F.min("link_url").alias("link_url"))
    status = F.when(F.col("_a").isNull(), "none").when(F.col("_a") == F.col("_b"), "one").otherwise("multiple")
    return templates.select("page_id").join(found, "page_id", "left").select(
        "page_id", status.alias("status"), F.when(status == "one", F.col("link_url")).alias("link_url"))


def assemble_paged(pages: DataFrame) -> DataFrame:
    """Join fetched pages of a blog to one list: ``pages(blog_id, number, links array<struct<pos, key>>)`` numbered from 1.

    The chain ends at the first missing number and before the first page that repeats an earlier link. Gives
    ``(blog_id, index, key, number)``; index 0 is the newest.
    """
    numbered = with_row_number(pages.select("blog_id", "number"), ["blog_id"], ["number"], "_n", position_chunk(F.col("number")))
    gaps = numbered.groupBy("blog_id").agg(F.min(F.when(F.col("_n") != F.col("number"), F.col("number"))).alias("_gap"))
    rows = pages.select("blog_id", "number", F.inline("links")).join(gaps, "blog_id").where("_gap is null or number < _gap").drop("_gap")
    homes = rows.groupBy("blog_id", "key").agg(F.min("number").alias("_home"), F.count("*").alias("_k"))
    repeats = rows.join(homes, ["blog_id", "key"]).where("number > _home").groupBy("blog_id").agg(F.min("number").alias("_stop"))
    kept = rows.join(repeats, "blog_id", "left").where("_stop is null or number < _stop").drop("_stop")
    ordered = with_row_number(kept, ["blog_id"], ["number", "pos"], "_i", position_chunk(F.col("number")))
    return ordered.select("blog_id", (F.col("_i") - 1).alias("index"), "key", "number")


def page_size_histogram(listed: DataFrame) -> DataFrame:
    sizes = listed.groupBy("blog_id", "number").agg(F.count("*").alias("page_size"))
    return sizes.groupBy("blog_id", "page_size").agg(F.count("*").alias("n_pages"))


# Dates, order, choice.

def sort_by_page_dates(lists: DataFrame, dates: DataFrame) -> DataFrame:
    """Order undated lists ``(blog_id, pos, page_id)`` by a date position common to all their post pages.

    ``dates(page_id, xpath, source, date)``, with ``meta`` as a source. The position must be the only common one, else the
    only common ``meta``, else the only common ``time`` one. Newest first, list order inside a day.
    """
    sizes = lists.groupBy("blog_id").agg(F.count_distinct("page_id").alias("_n"))
    single = dates.groupBy("page_id", "xpath", "source").agg(F.min("date").alias("date"))
    joined = lists.join(single, "page_id")
    common = joined.groupBy("blog_id", "xpath", "source").agg(F.count_distinct("page_id").alias("_k")).join(sizes, "blog_id").where("_k = _n")
    counts = common.groupBy("blog_id").agg(F.count("*").alias("_all"), *[F.count_if(F.col("source") == s).alias(f"_{s}") for s in ("meta", "time")])
    fits = (F.col("_all") == 1) | (F.when(F.col("_meta") == 1, F.col("source") == "meta").otherwise((F.col("_time") == 1) & (F.col("source") == "time")))
    chosen = common.join(counts, "blog_id").where(fits).select("blog_id", "xpath", "source")
    dated = joined.join(chosen, ["blog_id", "xpath", "source"])
    ranked = with_row_number(dated.withColumn("_age", -F.unix_date("date")), ["blog_id"], ["_age", "pos"], "_i", F.floor(F.col("_age") / 365))
    return ranked.select("blog_id", (F.col("_i") - 1).alias("index"), "page_id", "date", F.col("source").alias("date_source"))


def agrees_with_feed(lists: DataFrame, entries: DataFrame) -> DataFrame:
    """Does a sorted list ``(feed_id, seq_pos, key)`` keep the order of the feed entries it holds? True for uncertain feeds."""
    present = checkpointed(filter_included(entries, lists))
    matched = sequence_match(present, lists)
    certain = entries.groupBy("feed_id").agg(F.bool_or("order_certain").alias("_certain"))
    joined = certain.join(matched, "feed_id", "left")
    return joined.select("feed_id", (~F.col("_certain") | F.coalesce("is_match", F.lit(True))).alias("is_matching_feed"))


def choose_candidate(candidates: DataFrame) -> DataFrame:
    """Best candidate per blog: ``candidates(blog_id, arrival, matches_feed, speculative, validated, ...)``.

    Those matching the feed go first, then size: for matching ones the smaller of promised and validated size, else the
    validated one; earlier arrivals win ties. Candidates without a validated size are out.
    """
    size = F.when(F.col("matches_feed"), F.least("speculative", "validated")).otherwise(F.col("validated"))
    valid = candidates.where("validated is not null").withColumn("size_key", size)
    return first_per_key(valid, ["blog_id"], [F.col("matches_feed").desc(), F.col("size_key").desc(), "arrival"])


def accepted(chosen: DataFrame, min_count: int = 11) -> DataFrame:
    """Is the list long enough to stop the search in this phase?"""
    return chosen.withColumn("is_enough", F.col("validated") >= min_count)


def apply_curated_categories(posts: DataFrame, curated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand-kept categories ``curated(site, category, is_top, url)`` joined to posts ``(site, url)``, and urls not found."""
    keyed_posts = U.with_canonical(posts, "url").select("site", "url", "key")
    keyed = U.with_canonical(curated, "url").select("site", "category", "is_top", F.col("url").alias("curated_url"), "key")
    assigned = keyed.join(keyed_posts, ["site", "key"]).select("site", "category", "is_top", "url")
    unknown = keyed.join(keyed_posts, ["site", "key"], "left_anti").select("site", "category", F.col("curated_url").alias("url"))
    return assigned, unknown


def detect_page1(groups: DataFrame, entries: DataFrame, page2: DataFrame) -> DataFrame:
    """Groups of a first page that open the feed, or open it after one leading entry: ``page_size`` and the page's promise.

    ``page2(page_id, key)`` is the link to page two, without which a page is no first page; a group must not hold it, nor any
    link twice. The promised size of the whole list is twice the largest page plus one.
    """
    shapes = _shapes(groups, entries).where("n_links = n_distinct")
    holding = groups.join(page2, ["page_id", "key"], "left_semi").withColumn("group_id", _group_id()).select("group_id").distinct()
    open_groups = checkpointed(shapes.join(page2.select("page_id"), "page_id", "left_semi").join(holding, "group_id", "left_anti"))
    lists = _lists_of(groups, open_groups)
    seq = with_row_number(lists.select("feed_id", "pos", "key"), ["feed_id"], ["pos"], "_n", position_chunk(F.col("pos")))
    seq = checkpointed(seq.select("feed_id", (F.col("_n") - 1).alias("seq_pos"), "key"))
    per_group = _feeds_of(lists, entries)
    full = sequence_match(per_group, seq).where("is_match").select(F.col("feed_id").alias("group_id"), F.lit(True).alias("includes_newest"))
    partial = match_except_first(per_group, seq).where("is_match and first_key is not null").select(
        F.col("feed_id").alias("group_id"), F.lit(False).alias("includes_newest"))
    both = full.unionByName(partial).groupBy("group_id").agg(F.bool_or("includes_newest").alias("includes_newest"))
    found = open_groups.join(both, "group_id").withColumn("page_size", F.col("n_links") + (~F.col("includes_newest")).cast("int"))
    tops = found.groupBy("page_id").agg((F.max("page_size") * 2 + 1).alias("speculative"))
    return found.join(tops, "page_id").select("page_id", "stars", "mask", "page_size", "includes_newest", "speculative")


def sort_with_pinned(lists: DataFrame, pinned: DataFrame, guess_year: Column) -> DataFrame:
    """Put the pinned entry of a dated list in its place: ``lists(blog_id, pos, key, date)``, ``pinned(blog_id, key, text)``.

    The pinned entry's date is read from its text, the year guessed where it is missing; undatable ones are left out.
    """
    placed = pinned.select("blog_id", F.lit(-1).cast("long").alias("pos"), "key", text_date(F.col("text"), guess_year).alias("date"))
    merged = lists.select("blog_id", "pos", "key", "date").unionByName(placed.where("date is not null"))
    ranked = with_row_number(merged.withColumn("_age", -F.unix_date("date")), ["blog_id"], ["_age", "pos"], "_i", F.floor(F.col("_age") / 365))
    return ranked.select("blog_id", (F.col("_i") - 1).alias("index"), "key", "date")


def detect_page2(page1: DataFrame, page2: DataFrame, entries: DataFrame) -> DataFrame:
    """Second pages that go on where the first page ends: ``page1`` and ``page2`` hold ``(feed_id, mask, pos, key)``.

    The same mask must be on both pages. Page two repeats no link, neither its own nor one of page one, and follows the feed
    from the end of page one. Gives the size of both pages.
    """
    def ided(df: DataFrame) -> DataFrame:
        return df.withColumn("group_id", F.concat_ws("|", F.col("feed_id").cast("string"), "mask"))

    # Everything meets by the feed and the group, so that tables stored by feed stay in their buckets.
    keys = ["feed_id", "group_id"]
    first, second = ided(page1), ided(page2)
    sizes = first.groupBy(*keys).agg(F.count("*").alias("size1"))
    seconds = second.groupBy(*keys, "mask").agg(F.count("*").alias("size2"), F.count_distinct("key").alias("_d"))
    shared = second.join(first.select(*keys, "key"), [*keys, "key"], "left_semi").select(*keys).distinct()
    open_groups = seconds.where("size2 = _d").join(sizes, keys).join(shared, keys, "left_anti")
    seq = with_row_number(second.select(*keys, "pos", "key"), keys, ["pos"], "_n", position_chunk(F.col("pos")))
    seq = seq.join(sizes, keys).select(*keys, (F.col("_n") - 1).alias("seq_pos"), "key", "size1")
    per_group = open_groups.select(*keys).join(entries, "feed_id").select(*keys, "pos", "bucket", "key")
    stored = [checkpointed_pages(x, "feed_id", dealt=True) for x in (per_group, seq)]
    follows = sequence_match(*stored, F.col("size1"), keys).where("is_match").select(*keys)
    return open_groups.join(follows, keys, "left_semi").select("feed_id", "mask", "size1", "size2")


def detect_sorted_first(groups: DataFrame, entries: DataFrame, page_keys: DataFrame) -> DataFrame:
    """Groups that are the list without its newest entry, which stands out elsewhere on the page: ``page_keys(page_id, key)``.

    Of repeated links the last one counts. Feeds of fewer than three entries are not judged.
    """
    # Groups are told apart by the page and their id, so that tables stored by page stay in their buckets.
    keys = ["page_id", "feed_id"]
    ided = groups.withColumn("feed_id", _group_id())
    single = first_per_key(ided, [*keys, "key"], [F.col("pos").desc()])
    seq = with_row_number(single.select(*keys, "pos", "key"), keys, ["pos"], "_n", position_chunk(F.col("pos")))
    seq = checkpointed_pages(seq.select(*keys, (F.col("_n") - 1).alias("seq_pos"), "key"), dealt=True)
    per_group = checkpointed_pages(ided.select(*keys).distinct().join(entries, "page_id").select(*keys, "pos", "bucket", "key"), dealt=True)
    matched = match_except_first(per_group, seq, keys).where("is_match and first_key is not null")
    sizes = single.groupBy(*keys, "stars", "mask").agg((F.count("*") + 1).alias("n_links"))
    feed = entries.groupBy("page_id").agg(F.count("*").alias("_n_feed")).where("_n_feed >= 3")
    found = sizes.join(matched, keys).join(feed, "page_id").where("n_links >= _n_feed").withColumn("key", F.col("first_key"))
    return found.join(page_keys, ["page_id", "key"], "left_semi").select(
        "page_id", "stars", "mask", "n_links", "first_key", F.lit("archives_first").alias("pattern"))
