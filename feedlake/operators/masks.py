"""Position masks: groups of links that sit at the same place of a page up to one, two or three indexes.

``links(page_id, pos, xpath, class_xpath, key, text, is_feed)``: the page's links, those of feed entries flagged. One star uses
plain positions, two and three use positions with classes. Masks grow out of feed links; other links meet them by equality, so no
two links are ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.ordered import first_per_key, position_chunk, with_previous, with_running_sum
from feedlake.functions.text import equalized_title, normalized_title
# All that is stored here belongs to pages.
from feedlake.session import checkpointed_pages as checkpointed

PATH_OF_STARS = {1: "xpath", 2: "class_xpath", 3: "class_xpath"}


def flag_feed_links(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Mark links whose key is an entry of the page's feed. ``entries(page_id, key, title)``."""
    firsts = first_per_key(entries, ["page_id", "key"], ["title"]).select("page_id", "key", F.col("title").alias("feed_title"), F.lit(True).alias("_f"))
    joined = links.join(firsts, ["page_id", "key"], "left")
    return joined.withColumn("is_feed", F.coalesce("_f", F.lit(False))).drop("_f")


def _stepped(links: DataFrame, path: str) -> DataFrame:
    """Links with the steps of their path, and its shape: the path without indexes, which all links of one mask share."""
    return links.withColumns({"_segs": path_steps(F.col(path)), "_shape": F.regexp_replace(path, r"\[\d+\](?=/|$)", "")})


def path_steps(path: Column) -> Column:
    """Steps of a position, without their slashes."""
    return F.array_remove(F.split(path, "/"), "")


def joined_steps(steps: Column) -> Column:
    return F.when(F.size(steps) > 0, F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise("")


def _mask(starred: Column) -> Column:
    """The path with a star for the index of each starred step."""
    return joined_steps(F.transform("_segs", lambda s, i: F.when(F.array_contains(starred, i + 1), F.regexp_replace(s, r"\[\d+\]$", "[*]")).otherwise(s)))


def _bearing(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """All links of the pages with each mask in ``seeds (page_id, _shape, _at, mask)`` that fits them.

    A link is masked only at the steps that a seed of its shape has starred, and meets the seeds by equality.
    """
    places = seeds.select("page_id", "_shape", "_at").distinct()
    masked = links.join(places, ["page_id", "_shape"]).withColumn("mask", _mask(F.col("_at")))
    return masked.join(seeds.select("page_id", "mask").distinct(), ["page_id", "mask"], "left_semi")


def mask_groups(links: DataFrame, stars: int) -> DataFrame:
    """Members of all masks with ``stars`` stars: link columns, ``mask, stars, item`` (position of the lowest starred step).

    Masks grow level by level from feed links only: one star at a step whose index differs among the links of one shape, then
    a further star above those of a mask that is still alive. A mask is alive if another link stands under its topmost star. So the
    number of masks follows what lives and not the number of combinations, however deep a page is. Other links join what the feed
    links have left. A mask counts if it holds more than one distinct link.
    """
    useful = _stepped(links, PATH_OF_STARS[stars])
    # A step has several indexes in a shape if two neighbours in some order differ there.
    neighbor = F.lag("_segs").over(Window.partitionBy("page_id", "_shape").orderBy("_segs"))
    differs = F.filter(F.sequence(F.lit(1), F.size("_segs")), lambda i: F.get("_segs", i - 1) != F.get("_before", i - 1))
    stepped = useful.where("page_id is not null and _shape is not null").select("page_id", "_shape", "_segs").withColumn("_before", neighbor)
    indexes = checkpointed(stepped.where("_segs <> _before").select("page_id", "_shape", F.explode(differs).alias("_step")).distinct())
    fed = useful.where("is_feed").select("page_id", "_shape", "_segs").distinct()
    seeds = fed.join(indexes, ["page_id", "_shape"]).withColumn("_at", F.array("_step"))
    alive = None
    for level in range(1, stars + 1):
        if level > 1:
            grown = seeds.drop("_step").join(alive, ["page_id", "mask"], "left_semi").join(indexes, ["page_id", "_shape"])
            seeds = grown.where(F.col("_step") < F.element_at("_at", 1)).withColumn("_at", F.concat(F.array("_step"), "_at"))
        seeds = seeds.withColumn("mask", _mask(F.col("_at")))
        seeds = checkpointed(seeds if level < stars else seeds.select("page_id", "_shape", "_at", "mask").distinct())
        rows = _bearing(useful, seeds)
        seg = F.get("_segs", F.element_at("_at", 1) - 1)
        if level < stars:
            alive = checkpointed(rows.groupBy("page_id", "mask").agg(F.min(seg).alias("_a"), F.max(seg).alias("_b")).where("_a <> _b").select("page_id", "mask"))
    # The links of one mask of one page: they met its seeds by these columns and are not shuffled again.
    whole = Window.partitionBy("page_id", "mask")
    several = (F.min(seg).over(whole) != F.max(seg).over(whole)) & (F.min("key").over(whole) != F.max("key").over(whole))
    item = joined_steps(F.slice(path_steps(F.col("xpath")), 1, F.element_at("_at", -1)))
    return rows.withColumn("_several", several).where("_several").select(*links.columns, "mask", item.alias("item"), F.lit(stars).alias("stars"))


def all_mask_groups(links: DataFrame) -> DataFrame:
    return mask_groups(links, 1).unionByName(mask_groups(links, 2)).unionByName(mask_groups(links, 3))


def order_masks(groups: DataFrame) -> DataFrame:
    """``mask_rank`` of each mask on its page, per number of stars: most links whose own text is the feed title, then most
    whose inferred ``title`` is (the own text where no title column is given), then the first on the page."""
    feed_title = equalized_title(F.col("feed_title"))
    inferred = F.col("title") if "title" in groups.columns else F.col("text")
    counts = groups.groupBy("page_id", "stars", "mask").agg(
        F.count_if(F.col("is_feed") & (equalized_title(F.col("text")) == feed_title)).alias("n_own"),
        F.count_if(F.col("is_feed") & (equalized_title(inferred) == feed_title)).alias("n_inferred"),
        F.count("*").alias("n_links"), F.min("pos").alias("first_pos"))
    order = [F.col("n_own").desc(), F.col("n_inferred").desc(), "first_pos", "mask"]
    return counts.withColumn("mask_rank", F.row_number().over(Window.partitionBy("page_id", "stars").orderBy(*order)))


def collapse_runs(groups: DataFrame) -> DataFrame:
    """Merge neighbouring links with one key inside a group: titles run together, ``n_merged`` counts them.

    ``groups(group_id, pos, key, title, source)``; a run with different sources gets the source ``collapsed``.
    """
    chunk = position_chunk(F.col("pos"))
    stepped = with_previous(groups, ["group_id"], ["pos"], {"_before": "key"}, chunk)
    starts = (F.col("_before").isNull() | (F.col("_before") != F.col("key"))).cast("long")
    runs = with_running_sum(stepped, ["group_id"], ["pos"], starts, "_run", chunk)
    # A run is a handful of links around one post.
    titled = F.filter(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"].isNotNull())
    merged = runs.groupBy("group_id", "_run", "key").agg(
        F.min("pos").alias("pos"), F.count("*").alias("n_merged"), titled.alias("_t"),
        F.min(F.when(F.col("title").isNotNull(), F.col("source"))).alias("_s1"),
        F.max(F.when(F.col("title").isNotNull(), F.col("source"))).alias("_s2"))
    return merged.select(
        "group_id", "pos", "key", "n_merged",
        F.when(F.size("_t") > 0, F.array_join(F.transform("_t", lambda s: s["title"]), "")).alias("title"),
        F.when(F.col("_s1") == F.col("_s2"), F.col("_s1")).when(F.col("_s1").isNotNull(), "collapsed").alias("source"))


def item_nodes(groups: DataFrame, nodes: DataFrame, value: str, extra: list[str]) -> DataFrame:
    """Nodes inside the item of each group link: ``rel`` is the node's position below the item.

    Every node offers itself under those of its ancestors that are as deep as an item of its page, and meets the items by equality.
    """
    depths = groups.select("page_id", F.size(path_steps(F.col("item"))).alias("_d")).distinct()
    placed = nodes.select("page_id", F.col("seq").alias("node_seq"), value, *extra, path_steps(F.col("xpath")).alias("_segs"))
    offered = placed.join(depths, "page_id").where("_d between 1 and size(_segs)").select(
        "page_id", "node_seq", value, *extra, joined_steps(F.slice("_segs", 1, F.col("_d"))).alias("item"),
        joined_steps(F.slice("_segs", F.col("_d") + 1, F.size("_segs"))).alias("rel"))
    return groups.join(offered, ["page_id", "item"])


# Title mismatches tolerated by number of distinct links.
def title_tolerance(n_links: Column) -> Column:
    return F.when(n_links <= 8, 0).when(n_links <= 52, 2).otherwise(3)


def _element_texts(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text of every element (and text node) inside the items of group links: link columns, ``rel``, ``seq`` (of its first text), ``depth``,
    ``text`` (equalized).

    An element's text is that of all text nodes below it, in document order; blanks that stand alone between elements do
    not count. Each text node offers itself to the elements that contain it, up to the item.
    """
    texts = item_nodes(groups, nodes.where("kind = 'text'"), "value", []).where("rel <> ''")
    steps = texts.withColumn("_steps", path_steps(F.col("rel"))).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("_steps"))))
    offered = steps.withColumn("rel", joined_steps(F.slice("_steps", 1, F.col("depth"))))
    # The text nodes of one element of one post.
    parts = F.array_sort(F.collect_list(F.struct("node_seq", "value")))
    return offered.groupBy("page_id", "mask", "pos", "rel", "depth").agg(
        F.min("node_seq").alias("seq"), F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value")).withColumn(
        "text", equalized_title(normalized_title(F.col("value"))))


def infer_title_position(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where the titles of a mask's items stand: ``(page_id, mask, kind, rel, rank)``.

    ``self`` is the link's own text, ``child`` an element inside the link, ``neighbor`` another element of the item; ``rel`` is its position
    below the item. The link's own text counts if it is the feed title for all feed links but a few. Else the feed title must be
    part of all links' texts but a few; of each link the outermost first element with the feed title is tried as
    child, and the first one (in the order of links) that carries it for all links but a few counts. Else the outermost first elements
    of the item that are not the link itself are tried as neighbours: those that carry the feed title wherever they exist are all good, and ``rank`` tells their order.
    ``groups`` are one-star groups. A mask without any position is absent.
    """
    keys = ["page_id", "mask"]
    title = equalized_title(normalized_title(F.col("feed_title")))
    own = equalized_title(normalized_title(F.coalesce("text", F.lit(""))))
    fed = groups.where("is_feed").withColumns({
        "_title": title, "_own": own, "_link": F.expr("substring(xpath, length(item) + 1)")}).select(*keys, "pos", "key", "item", "_title", "_own", "_link")
    fed = checkpointed(fed)
    wrong = ~F.coalesce(F.col("_own") == F.col("_title"), F.lit(False))
    without = ~F.coalesce(F.col("_own").contains(F.col("_title")), F.lit(False))
    sizes = fed.groupBy(*keys).agg(
        F.count("*").alias("_links"), F.count_distinct("key").alias("_n"), F.count_distinct(F.when(wrong, F.col("key"))).alias("_wrong"),
        F.count_distinct(F.when(without, F.col("key"))).alias("_without"))
    sizes = checkpointed(sizes.withColumn("_allowed", title_tolerance(F.col("_n"))))
    itself = sizes.where("_wrong <= _allowed").select(*keys, F.lit("self").alias("kind"), F.lit(None).cast("string").alias("rel"), F.lit(0).alias("rank"))
    rest = fed.join(sizes.where("_wrong > _allowed").select(*keys, "_links", "_allowed", (F.col("_without") <= F.col("_allowed")).alias("_inside")), keys)
    texts = _element_texts(rest, nodes).join(rest.select(*keys, "pos", "_title", "_link", "_links", "_allowed", "_inside"), [*keys, "pos"])
    hit = F.coalesce(F.col("text") == F.col("_title"), F.lit(False))
    within = (F.col("_link") == "") | F.startswith(F.col("rel"), F.concat("_link", F.lit("/")))
    beside = F.col("rel") != F.col("_link")
    kinds = F.filter(F.array(F.when(within & F.col("_inside"), "child"), F.when(beside, "neighbor")), lambda k: k.isNotNull())
    told = checkpointed(texts.withColumns({"_hit": hit, "kind": F.explode(kinds)}))
    # The outermost first element of each link, then the judgement of its position over all links.
    tried = first_per_key(told.where("_hit"), [*keys, "kind", "pos"], ["seq", "depth"]).groupBy(*keys, "kind", "rel").agg(F.min("pos").alias("_first"))
    judged = told.join(tried, [*keys, "kind", "rel"]).groupBy(*keys, "kind", "rel", "_first", "_links", "_allowed").agg(
        F.count("*").alias("_there"), F.count_if("_hit").alias("_hits"))
    child = (F.col("kind") == "child") & (F.col("_links") - F.col("_hits") <= F.col("_allowed"))
    good = judged.where(child | ((F.col("kind") == "neighbor") & (F.col("_hits") == F.col("_there"))))
    order = Window.partitionBy(*keys).orderBy("kind", "_first", "rel")
    ranked = good.withColumns({"rank": F.row_number().over(order) - 1, "_lead": F.first("kind").over(order)})
    chosen = ranked.where((F.col("kind") == F.col("_lead")) & ((F.col("kind") == "neighbor") | (F.col("rank") == 0)))
    return itself.unionByName(chosen.select(*keys, "kind", "rel", "rank"))


def apply_title_position(groups: DataFrame, positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Title of each group link from its mask's title positions: the first that exists; ``alternatives`` are the texts of the others.

    ``title_kind`` tells where the title comes from. Links of masks without a position have neither.
    """
    keys = ["page_id", "mask"]
    own = groups.join(positions.where("kind = 'self'").select(*keys, F.lit("self").alias("_kind")), keys)
    itself = own.select(*keys, "pos", normalized_title(F.col("text")).alias("title"), F.array().cast("array<string>").alias("alternatives"), "_kind")
    placed = positions.where("kind <> 'self'").select(*keys, "rel", "kind", "rank")
    inside = groups.join(placed.select(*keys).distinct(), keys, "left_semi")
    found = _element_texts(inside, nodes).join(placed, [*keys, "rel"]).withColumn("title", normalized_title(F.col("value")))
    # A mask has few title positions.
    listed = found.where("title is not null").groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "title"))).alias("_all")).select(
        *keys, "pos", F.get("_all", 0)["title"].alias("title"), F.transform(F.slice("_all", 2, 1000), lambda x: x["title"]).alias("alternatives"),
        F.get("_all", 0)["kind"].alias("_kind"))
    return groups.join(itself.unionByName(listed), [*keys, "pos"], "left").withColumnRenamed("_kind", "title_kind")


def infer_date_position(groups: DataFrame, dates: DataFrame) -> DataFrame:
    """Position below the item that dates all feed links of a mask: the only one, else the only ``time`` element."""
    fed = groups.where("is_feed")
    sizes = fed.groupBy("page_id", "mask").agg(F.count_distinct("pos").alias("_n"))
    found = item_nodes(fed, dates, "date", ["source"])
    per_rel = found.groupBy("page_id", "mask", "rel", "source").agg(F.count_distinct("pos").alias("_hits"))
    full = per_rel.join(sizes, ["page_id", "mask"]).where("_hits = _n")
    counts = full.groupBy("page_id", "mask").agg(F.count("*").alias("_all"), F.count_if(F.col("source") == "time").alias("_times"))
    sole = (F.col("_all") == 1) | ((F.col("_times") == 1) & (F.col("source") == "time"))
    return full.join(counts, ["page_id", "mask"]).where(sole).select("page_id", "mask", "rel", "source")


def assign_markup_dates(groups: DataFrame, positions: DataFrame, dates: DataFrame) -> DataFrame:
    """Date of each group link at its mask's date position; null unless there is exactly one."""
    placed = groups.join(positions.select("page_id", "mask", F.col("rel").alias("_rel"), F.col("source").alias("_source")), ["page_id", "mask"])
    found = item_nodes(placed, dates, "date", ["source"]).where("rel = _rel and source = _source")
    single = found.groupBy("page_id", "mask", "pos").agg(F.min("date").alias("date"), F.count("*").alias("_k")).where("_k = 1").drop("_k")
    return groups.join(single, ["page_id", "mask", "pos"], "left")


def date_order(groups: DataFrame) -> DataFrame:
    """Do the dates of a group's links fall or rise along the page? ``is_sorted`` (newest first), ``is_reverse_sorted``."""
    ided = groups.withColumn("_g", F.concat_ws("|", F.col("page_id").cast("string"), "mask"))
    stepped = with_previous(ided, ["_g"], ["pos"], {"_before": "date"}, position_chunk(F.col("pos")))
    return stepped.groupBy("page_id", "mask").agg(
        F.bool_and(F.col("date").isNotNull()).alias("all_dated"),
        F.coalesce(F.bool_and(F.col("_before") >= F.col("date")), F.lit(True)).alias("is_sorted"),
        F.coalesce(F.bool_and(F.col("_before") <= F.col("date")), F.lit(True)).alias("is_reverse_sorted"))


def post_categories(links: DataFrame) -> DataFrame:
    """Categories of posts from ``links(blog_id, key, pos, name)`` of category links near them.

    Names differing in case are one, spelled as first seen; posts without any (``name`` null) are ``Uncategorized``. Ordered by
    size.
    """
    named = links.withColumn("name", F.coalesce("name", F.lit("Uncategorized")))
    spelled = named.groupBy("blog_id", F.lower("name").alias("_lower")).agg(F.min_by("name", "pos").alias("category"))
    sizes = named.select("blog_id", F.lower("name").alias("_lower"), "key").distinct().groupBy("blog_id", "_lower").agg(F.count("*").alias("n_posts"))
    return spelled.join(sizes, ["blog_id", "_lower"]).drop("_lower").orderBy("blog_id", F.col("n_posts").desc(), "category")
