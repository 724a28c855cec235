"""Blog versions and post lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.ordered import first_per_key, position_chunk, with_row_number
from feedlake.sources.lines import parse_url_labels

# The version number of the current blog of a feed, and the statuses that count as failed.
LATEST_VERSION = 1_000_000
FAILED_STATUSES = ["crawl_failed", "update_from_feed_failed", "crawled_looks_wrong"]
EVERYTHING = "Everything"


def latest_blogs(blogs: DataFrame) -> DataFrame:
    return blogs.where(F.col("version") == LATEST_VERSION)


def next_version(blogs: DataFrame) -> DataFrame:
    """Number a feed's current blog gets when it is replaced: one above its other versions."""
    other = F.max(F.when(F.col("version") != LATEST_VERSION, F.col("version")))
    return blogs.groupBy("feed_url").agg((F.coalesce(other, F.lit(0)) + 1).alias("next_version"))


def reset_failed(blogs: DataFrame, cutoff: Column) -> DataFrame:
    """Current blogs that failed before ``cutoff``, with the version they move to."""
    failed = latest_blogs(blogs).where(F.col("status").isin(FAILED_STATUSES) & (F.col("status_updated_at") < cutoff))
    ranked = with_row_number(failed, ["feed_url"], ["id"], "_n", position_chunk(F.col("id")))
    return ranked.join(next_version(blogs), "feed_url").withColumn(
        "new_version", F.col("next_version") + F.col("_n") - 1).drop("_n", "next_version")


def blog_posts(found: DataFrame) -> DataFrame:
    """Posts of discovered lists ``(blog_id, position, url, title)``, newest first, to ``index`` 0 = oldest."""
    sizes = found.groupBy("blog_id").agg(F.count("*").alias("_n"))
    return found.join(sizes, "blog_id").withColumn("index", F.col("_n") - 1 - F.col("position")).drop("_n")


def blog_categories(found: DataFrame, categories: DataFrame) -> DataFrame:
    """Numbered categories of each blog; those without a listed post are dropped, ``Everything`` closes the list.

    ``categories(blog_id, category, is_top, category_position, key)`` hold one row per categorised post.
    """
    used = categories.join(found.select("blog_id", "key"), ["blog_id", "key"], "left_semi")
    named = used.groupBy("blog_id", "category").agg(
        F.min("category_position").alias("category_position"), F.bool_or("is_top").alias("is_top"))
    last = found.select("blog_id").distinct().select(
        "blog_id", F.lit(EVERYTHING).alias("category"), F.lit(None).cast("int").alias("category_position"), F.lit(True).alias("is_top"))
    order = Window.partitionBy("blog_id").orderBy(F.col("category_position").asc_nulls_last(), "category")
    return named.unionByName(last).select(
        "blog_id", "category", "is_top", (F.row_number().over(order) - 1).alias("index"))


def category_posts(found: DataFrame, categories: DataFrame) -> DataFrame:
    """Bridge of posts and categories, ``Everything`` included."""
    tagged = categories.select("blog_id", "category", "key").distinct().join(found.select("blog_id", "key"), ["blog_id", "key"], "left_semi")
    everything = found.select("blog_id", F.lit(EVERYTHING).alias("category"), "key")
    return tagged.select("blog_id", "category", "key").unionByName(everything)


def update_plan(blogs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What to do with each blog given the feed comparison ``outcomes(blog_id, outcome)``.

    Outcomes: ``no_new``, ``new``, ``mismatch``. Blogs still crawling or failed stay as they are.
    """
    action = F.col("update_action")
    skip = F.col("status").isin("crawl_in_progress", "crawl_failed", "crawled_looks_wrong") | (F.col("outcome") == "no_new")
    decision = (
        F.when(skip, "keep").when(action == "recrawl", "recrawl")
        .when((action == "update_from_feed_or_fail") & (F.col("outcome") == "new"), "append")
        .when(action.isin("update_from_feed_or_fail", "fail"), "mark_failed").otherwise("keep")
    )
    planned = blogs.join(outcomes, "blog_id").withColumn("decision", decision)
    return planned.withColumn("status", F.when(F.col("decision") == "mark_failed", "update_from_feed_failed").otherwise(F.col("status")))


def append_new_posts(plan: DataFrame, posts: DataFrame, new_posts: DataFrame) -> DataFrame:
    """Rows to add: ``new_posts(blog_id, position, url, title)`` (newest first) get indexes above the blog's last."""
    appended = new_posts.join(plan.where("decision = 'append'").select("blog_id"), "blog_id", "left_semi")
    tops = posts.groupBy("blog_id").agg(F.max("index").alias("_top"))
    sizes = appended.groupBy("blog_id").agg(F.count("*").alias("_n"))
    placed = appended.join(sizes, "blog_id").join(tops, "blog_id")
    return placed.withColumn("index", F.col("_top") + F.col("_n") - F.col("position")).select("blog_id", "index", "url", "title")


def load_manual_posts(lines: DataFrame, newest_first: bool) -> DataFrame:
    """Posts of hand-kept lists ``lines(blog_id, line_no, line)``; ``index`` 0 = oldest."""
    parsed = parse_url_labels(lines).where("reject is null")
    numbered = with_row_number(parsed, ["blog_id"], ["line_no"], "_rank", position_chunk(F.col("line_no")))
    sizes = parsed.groupBy("blog_id").agg(F.count("*").alias("_n"))
    index = F.col("_n") - F.col("_rank") if newest_first else F.col("_rank") - 1
    return numbered.join(sizes, "blog_id").withColumn("index", index).drop("_rank", "_n", "reject")


def load_manual_categories(posts: DataFrame, lines: DataFrame, top_categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category list and rejected lines of hand-kept blogs.

    Order: the given top categories, the others as they first occur, ``Everything``. ``top_categories(blog_id, category,
    position)``. Lines with an unknown url are rejected.
    """
    parsed = parse_url_labels(lines)
    known = parsed.where("reject is null").join(posts.select("blog_id", "url"), ["blog_id", "url"], "left_semi")
    unknown = parsed.join(posts.select("blog_id", "url"), ["blog_id", "url"], "left_anti").withColumn(
        "reject", F.coalesce("reject", F.lit("unknown categorized url")))
    used = known.groupBy("blog_id", F.col("label").alias("category")).agg(F.min("line_no").alias("position")).withColumn("grp", F.lit(1))
    tops = top_categories.select("blog_id", "category", F.col("position").cast("long").alias("position"), F.lit(0).alias("grp"))
    last = posts.select("blog_id").distinct().select(
        "blog_id", F.lit(EVERYTHING).alias("category"), F.lit(0).cast("long").alias("position"), F.lit(2).alias("grp"))
    merged = first_per_key(tops.unionByName(used).unionByName(last), ["blog_id", "category"], ["grp", "position"])
    order = Window.partitionBy("blog_id").orderBy("grp", "position", "category")
    categories = merged.select("blog_id", "category", (F.col("grp") != 1).alias("is_top"),
                               (F.row_number().over(order) - 1).alias("index"))
    return categories, unknown


def category_overview(categories: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per category: post count and how many of its posts are in the blog's first top category.

    ``categories(blog_id, category_id, name, index, is_top)``, ``assignments(category_id, blog_post_id)``.
    """
    first = first_per_key(categories.where("is_top"), ["blog_id"], ["index"]).select("blog_id", F.col("category_id").alias("first_id"))
    sized = categories.join(first, "blog_id").join(assignments, "category_id")
    checked = assignments.select(F.col("category_id").alias("first_id"), "blog_post_id", F.lit(True).alias("_checked"))
    joined = sized.join(checked, ["first_id", "blog_post_id"], "left")
    counts = joined.groupBy("category_id").agg(F.count("*").alias("post_count"), F.count("_checked").alias("checked_count"))
    return categories.join(counts, "category_id", "left").fillna(0, ["post_count", "checked_count"])


def vote_counts(votes: DataFrame) -> DataFrame:
    """Votes per blog, one column per value."""
    return votes.groupBy("blog_id").pivot("value", ["confirmed", "looks_wrong"]).agg(F.count("value")).fillna(0)


def dependents(owners: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Number of rows per owner in each child table that would go with it. ``children`` carry the owner's key."""
    counts = [child.join(owners.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n")).select(
        F.lit(name).alias("table_name"), key, "n") for name, child in children.items()]
    return reduce(DataFrame.unionByName, counts)
