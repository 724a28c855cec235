"""Post lists that need more than one look at a page: exact, almost and dated orders, two masks of one page, and
categories spread over several pages.

``groups(page_id, mask, stars, pos, key, url_date, date)`` are mask members, ``entries(page_id, pos, bucket, key)`` the feed of the page's
blog, its positions from 0 without gaps. Lists meet feeds in equi-joins on (page, position) and (page, bucket, key): a feed
is not copied for each group, and no two lists of a page are compared link by link unless a key joined them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.ordered import first_per_key, position_chunk, with_row_number
from feedlake.operators.archives import almost_threshold, category_threshold
from feedlake.session import checkpointed, checkpointed_pages

GROUP = ["page_id", "stars", "mask"]
#: Forms of a list: as on the page, from the bottom up, by dates.
DOWN, UP, DATED = "down", "up", "dated"


def list_shapes(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Per group: links, distinct links, whether all are dated; size of the feed and how much of it the group holds."""
    sizes = groups.groupBy(*GROUP).agg(
        F.count("*").alias("n_links"), F.count_distinct("key").alias("n_distinct"), F.bool_and(F.col("date").isNotNull()).alias("has_dates"),
        F.bool_and(F.coalesce("url_date", "date").isNotNull()).alias("all_dated"), F.min("pos").alias("first_pos"))
    held = groups.select(*GROUP, "key").distinct().join(entries.select("page_id", "key"), ["page_id", "key"]).groupBy(*GROUP).agg(F.count("*").alias("n_held"))
    feeds = entries.groupBy("page_id").agg(F.count("*").alias("n_feed"))
    return sizes.join(held, GROUP, "left").join(feeds, "page_id").fillna(0, ["n_held"])


def with_list_dates(groups: DataFrame, positions: DataFrame, entries: DataFrame) -> DataFrame:
    """What the markup dates of a group mean for its list. ``positions(page_id, mask)`` are the masks that have a date position.

    A group that holds enough of its feed (``almost_threshold``) loses its undated links, so that its list is dated
    throughout; any other keeps its dates only if none is absent.
    """
    keys = ["page_id", "mask"]
    feeds = entries.groupBy("page_id").agg(F.count("*").alias("_n_feed"))
    held = groups.join(entries.select("page_id", "key").distinct(), ["page_id", "key"], "left_semi").groupBy(*keys).agg(F.count_distinct("key").alias("_held"))
    whole = groups.groupBy(*keys).agg(F.bool_and(F.col("date").isNotNull()).alias("_whole"))
    facts = whole.join(positions.select(*keys).distinct().withColumn("_has", F.lit(True)), keys, "left").join(held, keys, "left").join(
        feeds, "page_id", "left")
    filters = F.coalesce(F.col("_has") & (F.col("_held") >= almost_threshold(F.col("_n_feed"))), F.lit(False))
    facts = facts.select(*keys, filters.alias("_filters"), "_whole")
    kept = groups.join(facts, keys).where("not _filters or date is not null")
    return kept.withColumn("date", F.when(F.col("_filters") | F.col("_whole"), F.col("date"))).drop("_filters", "_whole")


def numbered(groups: DataFrame) -> DataFrame:
    """Links of each group with their place in the list, ``seq_pos`` from 0."""
    ranked = with_row_number(groups, GROUP, ["pos"], "_n", position_chunk(F.col("pos")))
    return ranked.withColumn("seq_pos", F.col("_n") - 1).drop("_n")


def follows_feed(lists: DataFrame, entries: DataFrame, by: list[str], offset: Column | None = None) -> DataFrame:
    """``by`` and ``n_off``: how many links of each list are not in the bucket of their feed position.

    ``lists(*by, page_id, seq_pos, key)``; positions beyond the feed are free. Lists that do not reach the feed are absent.
    """
    at = F.col("seq_pos") if offset is None else F.col("seq_pos") + offset
    slots = entries.select("page_id", F.col("pos").alias("_at"), "bucket")
    members = entries.select("page_id", "bucket", "key").distinct().withColumn("_hit", F.lit(1))
    placed = lists.withColumn("_at", at).join(slots, ["page_id", "_at"]).join(members, ["page_id", "bucket", "key"], "left")
    return placed.groupBy(*by).agg(F.count_if(F.col("_hit").isNull()).alias("n_off"))


def _follows_held(lists: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """Like ``follows_feed``, against the feed without the entries that the group lacks."""
    pairs = lists.select(*GROUP, "key").distinct().join(entries, ["page_id", "key"])
    target = with_row_number(pairs, GROUP, ["pos"], "_n", position_chunk(F.col("pos"))).select(*GROUP, (F.col("_n") - 1).alias("seq_pos"), "bucket")
    members = entries.select("page_id", "bucket", "key").distinct().withColumn("_hit", F.lit(1))
    placed = lists.join(target, [*GROUP, "seq_pos"]).join(members, ["page_id", "bucket", "key"], "left")
    return placed.groupBy(*by).agg(F.count_if(F.col("_hit").isNull()).alias("n_off"))


def _date_order(lists: DataFrame) -> DataFrame:
    """Per group: do the dates never rise, never fall along the list? Null for one star, whose order counts more than dates."""
    nxt = lists.select(*GROUP, (F.col("seq_pos") - 1).alias("seq_pos"), F.col("date").alias("_next"))
    steps = lists.where("stars > 1 and date is not null").select(*GROUP, "seq_pos", "date").join(nxt, [*GROUP, "seq_pos"])
    return steps.groupBy(*GROUP).agg(F.bool_and(F.col("date") >= F.col("_next")).alias("falls"), F.bool_and(F.col("date") <= F.col("_next")).alias("rises"))


def _by_dates(lists: DataFrame) -> DataFrame:
    """Lists of dated groups, newest first, links of one day in page order; repeats of one link on one day are one.

    Groups in which one link has several dates are out. ``lists`` must be dated throughout.
    """
    single = first_per_key(lists, [*GROUP, "key", "date"], ["seq_pos"])
    torn = single.groupBy(*GROUP, "key").agg(F.count("*").alias("_k")).where("_k > 1").select(*GROUP).distinct()
    fit = single.join(torn, GROUP, "left_anti").withColumn("_age", -F.unix_date("date"))
    ranked = with_row_number(fit, GROUP, ["_age", "seq_pos"], "_n", F.floor(F.col("_age") / 365))
    return ranked.withColumn("seq_pos", F.col("_n") - 1).drop("_n", "_age")


def _longest(found: DataFrame) -> DataFrame:
    return first_per_key(found, ["page_id"], [F.col("n_links").desc(), "first_pos", "mask", "rank"])


def _extends(lists: DataFrame, base: DataFrame) -> DataFrame:
    """Does a list begin (or end) with the list of fewer stars that its page already has?

    ``lists(GROUP, form, seq_pos, key, n_links)``, ``base(page_id, seq_pos, key)``. Gives ``GROUP, form, starts, ends``; pages
    without a base are absent.
    """
    sizes = base.groupBy("page_id").agg(F.count("*").alias("_size"))
    sized = lists.join(sizes, "page_id")
    known = base.select("page_id", F.col("seq_pos").alias("_at"), F.col("key").alias("_key"))
    def hits(at: Column, name: str) -> DataFrame:
        met = sized.withColumn("_at", at).join(known, ["page_id", "_at"]).where(F.col("key") == F.col("_key"))
        return met.groupBy(*GROUP, "form").agg(F.count("*").alias(name))
    whole = sized.select(*GROUP, "form", "_size").distinct()
    counted = whole.join(hits(F.col("seq_pos"), "_a"), [*GROUP, "form"], "left").join(
        hits(F.col("seq_pos") - F.col("n_links") + F.col("_size"), "_b"), [*GROUP, "form"], "left")
    return counted.select(*GROUP, "form", F.coalesce(F.col("_a") == F.col("_size"), F.lit(False)).alias("starts"),
                          F.coalesce(F.col("_b") == F.col("_size"), F.lit(False)).alias("ends"))


def sorted_lists(groups: DataFrame, entries: DataFrame, almost: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best sorted list of each page and number of stars, and its links.

    A group must be as long as the feed and hold all of it, or with ``almost`` nearly all (``almost_threshold``) but not all;
    entries that it lacks are left out of the comparison. It counts in the first form that fits: down the page, up the page
    (each without repeated links and, from two stars on, not against the order of its dates), or ordered by its dates. With more
    stars, a list must be longer than the page's list with fewer, extend it (unless ordered by dates), and be dated if that one
    is. Of one number of stars the longest list wins, then the first on the page.

    Results: ``(page_id, stars, mask, n_links, form, has_dates, pattern)`` and ``(page_id, stars, seq_pos, key)``.
    """
    n_held, n_feed = F.col("n_held"), F.col("n_feed")
    enough = (n_held < n_feed) & (n_held >= almost_threshold(n_feed)) if almost else n_held == n_feed
    shapes = checkpointed_pages(list_shapes(groups, entries).where((F.col("n_links") >= n_feed) & enough))
    lists = checkpointed_pages(numbered(groups.join(shapes.select(*GROUP), GROUP, "left_semi")))
    sized = lists.join(shapes.select(*GROUP, "n_links", "has_dates"), GROUP)
    columns = [*GROUP, "seq_pos", "key"]
    down = sized.select(*columns, F.lit(DOWN).alias("form"))
    up = sized.select(*GROUP, (F.col("n_links") - 1 - F.col("seq_pos")).alias("seq_pos"), "key", F.lit(UP).alias("form"))
    dated = _by_dates(sized.where("has_dates")).select(*columns, F.lit(DATED).alias("form"))
    forms = checkpointed_pages(down.unionByName(up).unionByName(dated), dealt=True)
    by = [*GROUP, "form"]
    off = _follows_held(forms, entries, by) if almost else follows_feed(forms, entries, by)
    lengths = forms.groupBy(*by).agg(F.count("*").alias("n_links"))
    order = _date_order(lists)
    judged = off.where("n_off = 0").join(lengths, by).join(
        shapes.select(*GROUP, "n_distinct", "has_dates", "first_pos", F.col("n_links").alias("_whole")), GROUP).join(order, GROUP, "left")
    single = F.col("_whole") == F.col("n_distinct")
    form = F.col("form")
    fits = (form == DATED) | (single & F.when(form == DOWN, F.coalesce("falls", F.lit(True))).otherwise(F.coalesce("rises", F.lit(True))))
    rank = F.when(form == DOWN, 0).when(form == UP, 1).otherwise(2)
    fit = checkpointed_pages(judged.where(fits).withColumn("rank", rank).select(*by, "n_links", "has_dates", "first_pos", "rank"))
    results, base = [], None
    for stars in (1, 2, 3):
        own = fit.where(F.col("stars") == stars)
        if base is not None:
            found, links = base
            longer = own.join(found.select("page_id", F.col("n_links").alias("_least"), F.col("has_dates").alias("_dated")), "page_id", "left")
            longer = longer.where("_least is null or n_links > _least").where("not coalesce(_dated, false) or has_dates").drop("_dated")
            met = _extends(forms.join(own.select(*by, "n_links"), by), links)
            joined = longer.join(met, by, "left")
            own = joined.where((F.col("form") == DATED) | F.col("_least").isNull() | F.col("starts") | ((F.col("form") == UP) & F.col("ends"))).drop(
                "_least", "starts", "ends")
        # A group counts in its first form only.
        best = checkpointed_pages(_longest(first_per_key(own, GROUP, ["rank"])))
        results.append(best)
        if base is not None:
            best = best.unionByName(found.join(best.select("page_id"), "page_id", "left_anti"))
        base = best, forms.join(best.select(*by), by, "left_semi").select("page_id", "seq_pos", "key")
    found = reduce(DataFrame.unionByName, results)
    pattern = F.lit("archives_almost" if almost else "archives")
    links = forms.join(found.select(*by), by, "left_semi").select("page_id", "stars", "seq_pos", "key")
    return found.select(*GROUP, "n_links", "form", "has_dates", pattern.alias("pattern")), links


# Two masks of one page.

def _opening_groups(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """One-star groups shorter than the feed that follow it from its start: ``page_id, mask, n_links, first_pos, last_pos``."""
    own = groups.where("stars = 1")
    sizes = own.groupBy(*GROUP).agg(F.count("*").alias("n_links"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    feeds = entries.groupBy("page_id").agg(F.count("*").alias("_n_feed"))
    short = sizes.join(feeds, "page_id").where("n_links < _n_feed").drop("_n_feed")
    off = follows_feed(numbered(own.join(short.select(*GROUP), GROUP, "left_semi")), entries, GROUP)
    return short.join(off.where("n_off = 0"), GROUP).drop("n_off", "stars")


def _continuing_groups(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Groups that go on with the feed from some position to its end (or theirs): ``GROUP, n_links, skipped``.

    The bucket of the first link names the place: links are taken from it as long as they belong to it, and the others must
    follow from the next bucket on. ``skipped`` is how many entries come before.
    """
    lists = numbered(groups)
    heads = lists.where("seq_pos = 0").join(entries.select("page_id", "key", "bucket"), ["page_id", "key"]).groupBy(*GROUP).agg(
        F.min("bucket").alias("bucket"))
    ends = entries.groupBy("page_id", "bucket").agg((F.max("pos") + 1).alias("_next"))
    members = entries.select("page_id", "bucket", "key").distinct().withColumn("_in", F.lit(True))
    starts = heads.join(ends, ["page_id", "bucket"])
    listed = lists.join(starts, GROUP).join(members, ["page_id", "bucket", "key"], "left")
    runs = listed.groupBy(*GROUP, "_next").agg(
        F.coalesce(F.min(F.when(F.col("_in").isNull(), F.col("seq_pos"))), F.count("*")).alias("_run"), F.count("*").alias("n_links"),
        F.min("pos").alias("first_pos"))
    skipped = runs.withColumn("skipped", F.col("_next") - F.col("_run"))
    rest = lists.join(skipped.select(*GROUP, "_run", "skipped"), GROUP).where("seq_pos >= _run")
    off = follows_feed(rest, entries, GROUP, F.col("skipped"))
    joined = skipped.where("skipped >= 0").join(off, GROUP, "left").where("coalesce(n_off, 0) = 0")
    return joined.select(*GROUP, "n_links", "skipped", "first_pos")


def _glued(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Links of two masks one after the other: ``GROUP`` of the second mask, ``seq_pos, key, url_date, date``."""
    columns = ["pos", "key", "url_date", "date"]
    first = groups.where("stars = 1").select("page_id", F.col("mask").alias("prefix_mask"), *columns)
    head = pairs.select(*GROUP, "prefix_mask").join(first, ["page_id", "prefix_mask"]).select(*GROUP, F.lit(0).alias("part"), *columns)
    tail = pairs.select(*GROUP).join(groups.select(*GROUP, *columns), GROUP).select(*GROUP, F.lit(1).alias("part"), *columns)
    both = head.unionByName(tail).withColumn("_at", F.shiftleft(F.col("part").cast("long"), 40) + F.col("pos"))
    ranked = with_row_number(both, GROUP, ["_at"], "_n", position_chunk(F.col("_at")))
    return ranked.withColumn("seq_pos", F.col("_n") - 1).drop("_n", "_at", "part")


def two_mask_lists(groups: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A one-star group that opens the feed and a group that goes on where it ends, as one list.

    The two meet by an equi-join on (page, split position); of several openings of one length the first on the page counts. The
    list must reach the end of the feed, repeat no link, and its second part must stand below the first: after the seam. More stars must be longer
    and begin with the list of fewer. Results as ``sorted_lists``, with ``prefix_mask`` and ``n_prefix``.
    """
    openings = first_per_key(_opening_groups(groups, entries), ["page_id", "n_links"], ["first_pos", "mask"]).select(
        "page_id", F.col("mask").alias("prefix_mask"), F.col("n_links").alias("skipped"), "last_pos")
    feeds = entries.groupBy("page_id").agg(F.count("*").alias("_n_feed"))
    rest = _continuing_groups(groups, entries).withColumnRenamed("n_links", "_rest").join(feeds, "page_id").where("skipped + _rest >= _n_feed")
    pairs = checkpointed_pages(rest.join(openings, ["page_id", "skipped"]).where("last_pos < first_pos").withColumn("n_links", F.col("skipped") + F.col("_rest")))
    lists = checkpointed_pages(_glued(pairs, groups))
    single = lists.groupBy(*GROUP).agg(F.count("*").alias("_k"), F.count_distinct("key").alias("_d")).where("_k = _d").select(*GROUP)
    fit = pairs.join(single, GROUP, "left_semi").select(
        *GROUP, "n_links", "prefix_mask", F.col("skipped").alias("n_prefix"), "first_pos", F.lit(0).alias("rank"), F.lit(DOWN).alias("form"))
    results, base = [], None
    for stars in (1, 2, 3):
        own = fit.where(F.col("stars") == stars)
        if base is not None:
            found, links = base
            longer = own.join(found.select("page_id", F.col("n_links").alias("_least")), "page_id", "left").where("_least is null or n_links > _least")
            met = _extends(lists.join(own.select(*GROUP, "form", "n_links"), GROUP), links)
            own = longer.join(met, [*GROUP, "form"], "left").where("_least is null or starts").drop("_least", "starts", "ends")
        best = checkpointed_pages(_longest(own))
        results.append(best)
        if base is not None:
            best = best.unionByName(found.join(best.select("page_id"), "page_id", "left_anti"))
        base = best, lists.join(best.select(*GROUP), GROUP, "left_semi").select("page_id", "seq_pos", "key")
    found = reduce(DataFrame.unionByName, results)
    links = lists.join(found.select(*GROUP), GROUP, "left_semi").select("page_id", "stars", "seq_pos", "key")
    return found.select(*GROUP, "n_links", "prefix_mask", "n_prefix", F.lit(False).alias("has_dates"), F.lit("two_masks").alias("pattern")), links


def shuffled_two_mask_lists(groups: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The longest one-star group that opens the feed, and the longest group that holds all other entries in any order.

    The second group must be as long as the feed. Repeated links count once. A list whose links all have dates (from the url,
    else the markup) is put in their order and ``is_sorted``. One result for each page and number of stars; the links have
    ``seq_pos`` and ``date``.
    """
    opening = first_per_key(_opening_groups(groups, entries), ["page_id"], [F.col("n_links").desc(), "first_pos", "mask"]).select(
        "page_id", F.col("mask").alias("prefix_mask"), F.col("n_links").alias("n_prefix"))
    opening = checkpointed_pages(opening)
    covered = groups.where("stars = 1").join(opening.select("page_id", F.col("prefix_mask").alias("mask")), ["page_id", "mask"], "left_semi")
    open_entries = entries.join(covered.select("page_id", "key").distinct(), ["page_id", "key"], "left_anti").join(opening.select("page_id"), "page_id", "left_semi")
    open_sizes = opening.select("page_id").join(open_entries.groupBy("page_id").agg(F.count("*").alias("_open")), "page_id", "left").fillna(0, ["_open"])
    held = groups.select(*GROUP, "key").distinct().join(open_entries.select("page_id", "key"), ["page_id", "key"]).groupBy(*GROUP).agg(F.count("*").alias("_held"))
    shapes = list_shapes(groups, entries).where("n_links >= n_feed").select(*GROUP, F.col("n_links").alias("_rest"), "first_pos")
    full = shapes.join(open_sizes, "page_id").join(held, GROUP, "left").where("coalesce(_held, 0) = _open")
    best = first_per_key(full, ["page_id", "stars"], [F.col("_rest").desc(), "first_pos", "mask"]).select(*GROUP)
    pairs = checkpointed_pages(best.join(opening, "page_id"))
    glued = checkpointed_pages(first_per_key(_glued(pairs, groups), [*GROUP, "key"], ["seq_pos"]).withColumn("date", F.coalesce("url_date", "date")))
    sizes = glued.groupBy(*GROUP).agg(F.count("*").alias("n_links"), F.bool_and(F.col("date").isNotNull()).alias("is_sorted"))
    age = F.when(F.col("is_sorted"), -F.unix_date("date")).otherwise(0)
    aged = glued.join(sizes.select(*GROUP, "is_sorted"), GROUP).withColumn("_age", age)
    ranked = with_row_number(aged, GROUP, ["_age", "seq_pos"], "_n", F.when(F.col("is_sorted"), F.floor(F.col("_age") / 365)).otherwise(F.floor(F.col("seq_pos") / 65536)))
    found = pairs.join(sizes, GROUP).select(*GROUP, "n_links", "prefix_mask", "n_prefix", F.lit(False).alias("has_dates"), "is_sorted",
                                            F.lit("shuffled_two_masks").alias("pattern"))
    return found, ranked.select("page_id", "stars", (F.col("_n") - 1).alias("seq_pos"), "key", "date")


# Categories of a blog.

def page_categories(groups: DataFrame, entries: DataFrame, pages: DataFrame) -> DataFrame:
    """What each page can give to a list by categories: its longest group that holds two entries of the feed and lacks two.

    ``pages(page_id, blog_id, level, arrival)``: level is the depth of the page's path, arrival its order in the crawl, unique in a blog.
    ``entries(blog_id, pos, key)``. Pages that hold the same entries are one category: it has the arrival of the first and
    the longest of their lists. Feeds that name a link twice are out. ``held`` and ``lacks`` are positions in one feed.
    """
    feeds = entries.groupBy("blog_id").agg(F.count("*").alias("n_feed"), F.count_distinct("key").alias("_d")).where("n_feed = _d").drop("_d")
    sizes = groups.groupBy(*GROUP).agg(F.count("*").alias("n_links"), F.min("pos").alias("first_pos"))
    keyed = groups.select(*GROUP, "key").distinct().join(pages.select("page_id", "blog_id"), "page_id")
    held = keyed.join(entries.select("blog_id", "key", F.col("pos").cast("int").alias("at")), ["blog_id", "key"]).groupBy(*GROUP).agg(
        F.array_sort(F.collect_list("at")).alias("held"))
    fit = sizes.join(held, GROUP).join(pages, "page_id").join(feeds, "blog_id").where("n_links >= 2 and size(held) >= 2 and size(held) <= n_feed - 2")
    best = first_per_key(fit, ["page_id"], [F.col("n_links").desc(), "stars", "first_pos", "mask"])
    one = best.groupBy("blog_id", "held", "n_feed").agg(
        F.min("arrival").alias("arrival"), F.max_by(F.struct("page_id", "stars", "mask", "level", "n_links"), F.struct("n_links", -F.col("arrival"))).alias("c"))
    lacks = F.array_except(F.sequence(F.lit(0), (F.col("n_feed") - 1).cast("int")), "held")
    return one.select("blog_id", "arrival", "c.*", "n_feed", "held", lacks.alias("lacks"), category_threshold(F.col("n_feed")).alias("threshold"))


def category_archives(groups: DataFrame, entries: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two or three pages of one level that together hold the feed, or all but the allowed number of entries.

    Of a blog the combination counts that is complete first in the order of arrival, pairs before triples, then the earliest
    pages. A combination that is complete must hold one of the first ``slack + 1`` entries that its first page lacks, ``slack`` being
    the allowed number: partners are found by an equi-join on (blog, level, entry), and the third page by one on what the pair lacks. A page
    that lacks no more than that alone goes with the next page of its level.

    Results: ``(blog_id, pattern, n_pages, pages, n_missing, n_links)``, and the merged list ``(blog_id, index, key, date, page_id)``, first
    page first, without repeated links; missing entries follow in feed order, without page.
    """
    cats = checkpointed(page_categories(groups, entries, pages))
    slack = (F.col("n_feed") - F.col("threshold")).cast("int")
    held_by = checkpointed(cats.select("blog_id", "level", F.explode("held").alias("entry"), F.col("arrival").alias("other"), F.col("held").alias("other_held")))
    largest = cats.groupBy("blog_id", "level").agg(F.max(F.size("held")).alias("_largest"))
    mine = cats.join(largest, ["blog_id", "level"]).select(
        "blog_id", "level", "n_feed", "threshold", "_largest", F.col("arrival").alias("i"), F.col("held").alias("union"), "lacks")
    following = F.lead("i").over(Window.partitionBy("blog_id", "level").orderBy("i"))
    alone = mine.withColumn("j", following).where(F.size("union") >= F.col("threshold")).where("j is not null").select(
        "blog_id", "i", "j", F.lit(None).cast("long").alias("k"))

    def partners(rows: DataFrame) -> DataFrame:
        """Rows with each later page that holds one of the first entries that they lack."""
        want = rows.withColumn("entry", F.explode(F.slice("lacks", 1, slack + 1)))
        met = want.join(held_by, ["blog_id", "level", "entry"]).where("other > i")
        return met.drop("entry").dropDuplicates([c for c in ("blog_id", "level", "i", "j", "other") if c in met.columns])

    pairs = partners(mine.where(F.size("union") < F.col("threshold"))).select(
        "blog_id", "level", "n_feed", "threshold", "_largest", "i", F.col("other").alias("j"), F.array_union("union", "other_held").alias("union"),
        F.array_except("lacks", "other_held").alias("lacks"))
    pairs = checkpointed(pairs)
    full = F.size("union") >= F.col("threshold")
    twos = pairs.where(full).select("blog_id", "i", "j", F.lit(None).cast("long").alias("k"))
    near = pairs.where(~full & (F.size("union") + F.col("_largest") >= F.col("threshold")))
    third = partners(near).where("other <> j").withColumn("union", F.array_union("union", "other_held")).where(full)
    threes = third.select("blog_id", "i", F.least("j", "other").alias("j"), F.greatest("j", "other").alias("k"))
    combos = alone.unionByName(twos).unionByName(threes)
    order = F.struct(F.coalesce("k", "j").alias("last"), F.col("k").isNotNull().alias("three"), "i", "j", "k")
    chosen = checkpointed(combos.groupBy("blog_id").agg(F.min(order).alias("b")).select(
        "blog_id", F.posexplode(F.filter(F.array("b.i", "b.j", "b.k"), lambda x: x.isNotNull())).alias("part", "arrival")).join(
        cats, ["blog_id", "arrival"]))
    members = chosen.select("blog_id", "part", *GROUP).join(groups, GROUP).select(
        "blog_id", "part", "pos", "key", F.coalesce("url_date", "date").alias("date"), "page_id")
    held = chosen.select("blog_id", F.explode("held").alias("pos")).distinct()
    missing = entries.join(chosen.select("blog_id").distinct(), "blog_id", "left_semi").join(held, ["blog_id", "pos"], "left_anti").select(
        "blog_id", F.lit(3).alias("part"), "pos", "key", F.lit(None).cast("date").alias("date"), F.lit(None).cast("long").alias("page_id"))
    rows = members.unionByName(missing)
    single = first_per_key(rows, ["blog_id", "key"], ["part", "pos"]).withColumn("_at", F.shiftleft(F.col("part").cast("long"), 40) + F.col("pos"))
    listed = checkpointed(with_row_number(single, ["blog_id"], ["_at"], "_n", position_chunk(F.col("_at"))).select(
        "blog_id", (F.col("_n") - 1).alias("index"), "key", "date", "page_id", "part"))
    sizes = listed.groupBy("blog_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("part") == 3).alias("n_missing"))
    names = chosen.groupBy("blog_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "page_id"))), lambda x: x["page_id"]).alias("pages"))
    found = sizes.join(names, "blog_id").select(
        "blog_id", F.concat(F.lit("categories"), F.when(F.col("n_missing") > 0, "_almost").otherwise("")).alias("pattern"),
        F.size("pages").alias("n_pages"), "pages", "n_missing", "n_links")
    return found, listed.drop("part")
