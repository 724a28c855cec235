"""Lists of posts that go on over numbered pages: page one by its masks, page two by the same or a moved mask, the others by the
mask of page two without classes.

``groups(blog_id, mask, stars, pos, key, page_size, includes_newest)`` are the mask members of page one that ``detect_page1`` accepts, with its
columns. ``links(blog_id, number, pos, xpath, class_xpath, key)`` are the links of the pages from number two on, ``entries(blog_id, pos, bucket, key)``
the feeds. ``steps(blog_id, number, status, key)`` tells for every page whether it links to the next (``none``, ``one``, ``multiple``) and to which key,
``jumps(blog_id, number)`` which numbers page one links to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.ordered import first_per_key, position_chunk, with_row_number, with_running_sum
from feedlake.operators.archive_lists import follows_feed
from feedlake.operators.masks import PATH_OF_STARS
from feedlake.session import checkpointed

MASK = ["blog_id", "stars", "mask"]


def _steps(path) -> Column:
    return F.regexp_extract_all(path, F.lit("/[^/]+"), F.lit(0))


def _without_classes(path: Column) -> Column:
    return F.regexp_replace(path, r"\([^)]*\)", "")


def _shape(path: Column) -> Column:
    """A path without the numbers or stars of its steps."""
    return F.regexp_replace(path, r"\[(\d+|\*)\](?=/|$)", "")


def _starred(path: Column, mask: Column) -> Column:
    """The path with stars where the mask has them; both have the same number of steps."""
    steps = F.zip_with(_steps(path), _steps(mask),
                       lambda s, m: F.when(m.endswith("[*]"), F.regexp_replace(s, r"\[\d+\]$", "[*]")).otherwise(s))
    return F.array_join(steps, "")


def _bearing(links: DataFrame, masks: DataFrame, path: Column) -> DataFrame:
    """Links with the masks of their blog that fit their path: they meet by shape and then by the starred path."""
    shaped = links.withColumns({"_path": path, "_shape": _shape(path)})
    met = shaped.join(masks.withColumn("_shape", _shape(F.col("mask"))), ["blog_id", "_shape"])
    return met.where(_starred(F.col("_path"), F.col("mask")) == F.col("mask")).drop("_path", "_shape")


def _lists(rows: DataFrame, by: list[str]) -> DataFrame:
    ranked = with_row_number(rows, by, ["pos"], "_n", position_chunk(F.col("pos")))
    return ranked.withColumn("seq_pos", F.col("_n") - 1).drop("_n")


def _fitting(rows: DataFrame, groups: DataFrame, steps: DataFrame, entries: DataFrame) -> DataFrame:
    """Masks whose links on page two repeat none of page one, are no paging links, and follow the feed where page one ends.

    ``rows(MASK, pos, key)``; gives ``MASK, size``.
    """
    sizes = rows.groupBy(*MASK).agg(F.count("*").alias("size"))
    repeats = rows.join(groups.select(*MASK, "key"), [*MASK, "key"], "left_semi").select(*MASK)
    paging = rows.join(steps.where("number <= 2").select("blog_id", "key"), ["blog_id", "key"], "left_semi").select(*MASK)
    offsets = groups.select(*MASK, F.col("page_size").alias("_offset")).distinct()
    lists = _lists(rows, MASK).join(offsets, MASK).withColumnRenamed("blog_id", "page_id")
    off = follows_feed(lists, entries.withColumnRenamed("blog_id", "page_id"), ["page_id", "stars", "mask"], F.col("_offset")).withColumnRenamed(
        "page_id", "blog_id").where("n_off > 0").select(*MASK)
    return sizes.join(repeats.unionByName(paging).unionByName(off).distinct(), MASK, "left_anti")


def _moved(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Links of page two under the inner part of a mask of page one that has moved to exactly one other place: ``MASK, pos, key, moved``.

    The inner part starts with the topmost starred step. Where the inner part stands is told by the path before it; its first
    link there must have the classes of the mask. ``moved`` is the mask at the new place.
    """
    before = "substring_index(mask, '[*]', 1)"
    inner = F.expr(f"substring(mask, length({before}) - instr(reverse({before}), '/') + 1)")
    masks = groups.select(*MASK).distinct().withColumn("_inner", inner)
    masks = masks.withColumns({"_depth": F.size(_steps("_inner")), "_tail": _shape(_without_classes(F.col("_inner")))})
    found = []
    for name, stars in (("xpath", [1]), ("class_xpath", [2, 3])):
        own = masks.where(F.col("stars").isin(stars))
        depths = own.select("blog_id", "_depth").distinct()
        steps = _steps(name)
        cut = F.size(steps) - F.col("_depth")
        placed = links.where("number = 2").join(depths, "blog_id").where(cut > 0).withColumns({
            "_before": F.array_join(F.slice(steps, 1, cut), ""), "_after": F.array_join(F.slice(steps, cut + 1, F.col("_depth")), "")})
        met = placed.withColumn("_tail", _shape(_without_classes(F.col("_after")))).join(own, ["blog_id", "_depth", "_tail"])
        same = _starred(_without_classes(F.col("_after")), _without_classes(F.col("_inner"))) == _without_classes(F.col("_inner"))
        found.append(met.where(same).select(*MASK, "pos", "key", "_before", "_inner", "_after"))
    rows = found[0].unionByName(found[1])
    leads = first_per_key(rows, [*MASK, "_before"], ["pos"]).where(_starred(F.col("_after"), F.col("_inner")) == F.col("_inner"))
    places = leads.groupBy(*MASK).agg(F.count("*").alias("_k"), F.min("_before").alias("_before")).where("_k = 1").drop("_k")
    return rows.join(places, [*MASK, "_before"]).where(_starred(F.col("_after"), F.col("_inner")) == F.col("_inner")).select(
        *MASK, "pos", "key", F.concat("_before", "_inner").alias("moved"))


def paged_lists(groups: DataFrame, links: DataFrame, entries: DataFrame, steps: DataFrame, jumps: DataFrame,
                certain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list of each blog whose pages go on to a page without a next one.

    Page two takes the mask of page one whose two pages hold the most links, then the first on page one; if none fits and
    the paging is ``certain(blog_id)``, a mask whose inner part moved to one other place. Every later page takes all links
    under that mask without classes; its place in the feed is the sum of the pages before it. A page that is absent or empty,
    repeats a link of an earlier page, does not follow the feed or has several next links ends the blog without result.

    Results: ``(blog_id, pattern, mask, n_pages, n_links)``, pattern ``paged_last`` if page one links to the last page or there are only two, else
    ``paged_next``; and ``(blog_id, index, number, key)``.
    """
    groups, links = checkpointed(groups), checkpointed(links)
    masks = groups.groupBy(*MASK, "page_size", "includes_newest").agg(F.min("pos").alias("first_pos"))
    second = links.where("number = 2").select("blog_id", "pos", "xpath", "class_xpath", "key")
    plain = _bearing(second, masks.where("stars = 1").select(*MASK), F.col(PATH_OF_STARS[1]))
    classed = _bearing(second, masks.where("stars > 1").select(*MASK), F.col(PATH_OF_STARS[2]))
    kept = checkpointed(plain.unionByName(classed).select(*MASK, "pos", "key"))
    same = _fitting(kept, groups, steps, entries).join(masks, MASK).withColumn("_all", F.col("size") + F.col("page_size"))
    best = first_per_key(same, ["blog_id"], [F.col("_all").desc(), "first_pos", "stars", "mask"]).select(*MASK, F.col("mask").alias("mask2"))
    best = checkpointed(best)
    open_masks = groups.join(certain.select("blog_id"), "blog_id", "left_semi").join(best.select("blog_id"), "blog_id", "left_anti")
    moved = checkpointed(_moved(links, open_masks))
    later = _fitting(moved.select(*MASK, "pos", "key"), groups, steps, entries).join(masks, MASK)
    shifted = first_per_key(later, ["blog_id"], ["first_pos", "stars", "mask"]).select(*MASK).join(moved.groupBy(*MASK).agg(F.first("moved").alias("mask2")), MASK)
    chosen = checkpointed(best.unionByName(shifted))
    # Page one, with the entry that stands apart where the mask lacks it.
    ones = chosen.join(groups, MASK).select("blog_id", F.lit(1).cast("long").alias("number"), "pos", "key")
    lacking = chosen.join(masks.where("not includes_newest").select(*MASK), MASK).select("blog_id")
    heads = entries.join(lacking, "blog_id", "left_semi").join(ones.select("blog_id", "key"), ["blog_id", "key"], "left_anti")
    extra = first_per_key(heads, ["blog_id"], ["pos"]).select("blog_id", F.lit(1).cast("long").alias("number"), F.lit(-1).cast("long").alias("pos"), "key")
    two = kept.unionByName(moved.select(*MASK, "pos", "key")).join(chosen.select(*MASK), MASK, "left_semi").select(
        "blog_id", F.lit(2).cast("long").alias("number"), "pos", "key").distinct()
    bare = chosen.select("blog_id", _without_classes(F.col("mask2")).alias("mask"))
    rest = _bearing(links.where("number > 2"), bare, F.col("xpath")).select("blog_id", "number", "pos", "key")
    # The last page is the first without a next link.
    last = steps.where("status = 'none' and number > 1").groupBy("blog_id").agg(F.min("number").alias("last"))
    rows = checkpointed(ones.unionByName(extra).unionByName(two).unionByName(rest).join(last.join(chosen.select("blog_id"), "blog_id", "left_semi"), "blog_id").where("number <= last"))
    sizes = rows.groupBy("blog_id", "number", "last").agg(F.count("*").alias("size"))
    running = with_running_sum(sizes, ["blog_id"], ["number"], F.col("size"), "_upto", position_chunk(F.col("number")))
    offsets = checkpointed(running.select("blog_id", "number", "last", (F.col("_upto") - F.col("size")).alias("_offset")))
    absent = offsets.groupBy("blog_id", "last").agg(F.count("*").alias("_k")).where("_k < last").select("blog_id")
    torn = steps.join(last, "blog_id").where("status = 'multiple' and number > 1 and number < last").select("blog_id")
    repeated = rows.groupBy("blog_id", "key").agg(F.min("number").alias("_a"), F.max("number").alias("_b")).where("_a < _b").select("blog_id")
    lists = _lists(rows.where("number > 2").select("blog_id", "number", "pos", "key"), ["blog_id", "number"]).join(
        offsets.select("blog_id", "number", "_offset"), ["blog_id", "number"]).withColumnRenamed("blog_id", "page_id")
    off = follows_feed(lists, entries.withColumnRenamed("blog_id", "page_id"), ["page_id", "number"], F.col("_offset")).where("n_off > 0").select(
        F.col("page_id").alias("blog_id"))
    bad = absent.unionByName(torn).unionByName(repeated).unionByName(off).distinct()
    good = checkpointed(rows.join(bad, "blog_id", "left_anti"))
    order = F.shiftleft(F.col("number"), 34) + F.col("pos") + 1
    ranked = with_row_number(good.withColumn("_at", order), ["blog_id"], ["_at"], "_n", F.shiftright("_at", 16))
    shown = jumps.withColumn("_jump", F.lit(True)).withColumnRenamed("number", "last").distinct()
    found = good.groupBy("blog_id", "last").agg(F.count("*").alias("n_links")).join(shown, ["blog_id", "last"], "left").join(
        chosen.select("blog_id", "mask"), "blog_id")
    pattern = F.when((F.col("last") == 2) | F.col("_jump"), "paged_last").otherwise("paged_next")
    return (found.select("blog_id", pattern.alias("pattern"), "mask", F.col("last").alias("n_pages"), "n_links"),
            ranked.select("blog_id", (F.col("_n") - 1).alias("index"), "number", "key"))
