"""Matching candidate lists against feeds whose equal-dated entries may come in any order.

``entries(feed_id, pos, bucket, key)``: positions from 0 without gaps, a bucket covers neighbouring positions. ``seq(feed_id,
seq_pos, key)``: candidate list from 0. All matches are equi-joins on (feed, bucket, key); nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.ordered import position_chunk, with_row_number
from feedlake.operators.urls import canonical_key, with_equality_key
from feedlake.session import checkpointed

#: What tells feeds apart. Lists of one feed may name it and their own id, so that all of them stay where the feed is.
LIST = ["feed_id"]


def densified(entries: DataFrame) -> DataFrame:
    """Close the gaps in ``pos`` after rows were taken out; buckets keep their numbers."""
    ranked = with_row_number(entries, LIST, ["pos"], "_rank", position_chunk(F.col("pos")))
    return ranked.withColumn("pos", F.col("_rank") - 1).drop("_rank")


def filter_included(entries: DataFrame, members: DataFrame) -> DataFrame:
    return densified(entries.join(members.select("feed_id", "key"), ["feed_id", "key"], "left_semi"))


def except_keys(entries: DataFrame, members: DataFrame) -> DataFrame:
    return densified(entries.join(members.select("feed_id", "key"), ["feed_id", "key"], "left_anti"))


def _flagged(entries: DataFrame, members: DataFrame) -> DataFrame:
    known = members.select("feed_id", "key").distinct().withColumn("_in", F.lit(1))
    return entries.join(known, ["feed_id", "key"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))


def count_included(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Per feed: entries, entries in the set, and whether all are."""
    counts = _flagged(entries, members).groupBy("feed_id").agg(F.count("*").alias("n_entries"), F.sum("_in").alias("n_included"))
    return counts.withColumn("all_included", F.col("n_entries") == F.col("n_included"))


def included_prefix_length(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Entries in the set up to and including the first bucket that is not complete."""
    buckets = _flagged(entries, members).groupBy("feed_id", "bucket").agg(F.count("*").alias("_n"), F.sum("_in").alias("_in"))
    stops = buckets.groupBy("feed_id").agg(F.min(F.when(F.col("_in") < F.col("_n"), F.col("bucket"))).alias("_stop"))
    inside = buckets.join(stops, "feed_id").where(F.col("_stop").isNull() | (F.col("bucket") <= F.col("_stop")))
    return inside.groupBy("feed_id").agg(F.sum("_in").alias("prefix_length"))


def _placed(entries: DataFrame, seq: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence rows with their feed position ``pos`` joined to the bucket there and checked for membership."""
    slots = entries.select(*keys, "pos", "bucket")
    members = entries.select(*keys, "bucket", "key").distinct().withColumn("_hit", F.lit(True))
    return seq.join(slots, [*keys, "pos"]).join(members, [*keys, "bucket", "key"], "left")


def sequence_match(entries: DataFrame, seq: DataFrame, offset: Column | int = 0, keys: list[str] = LIST) -> DataFrame:
    """Per feed: does the list follow the feed from position ``offset`` on, as far as both reach?

    ``offset`` may be a column of ``seq``. A bucket member may match more than once.
    """
    offset = F.lit(offset) if isinstance(offset, int) else offset
    checked = _placed(entries, seq.withColumn("pos", F.col("seq_pos") + offset), keys)
    counts = checked.groupBy(*keys).agg(F.count("*").alias("_n"), F.count("_hit").alias("_hits"))
    feeds = entries.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["_n", "_hits"])
    return feeds.select(*keys, (F.col("_n") == F.col("_hits")).alias("is_match"), F.col("_hits").alias("n_matched"))


def _sizes(entries: DataFrame, seq: DataFrame, keys: list[str]) -> DataFrame:
    """Per feed: entry count, bucket and size of the first bucket, list length."""
    heads = entries.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("bucket").alias("_first"))
    first = entries.join(heads, keys).where("bucket = _first").groupBy(*keys).agg(F.count("*").alias("_b"))
    lengths = seq.groupBy(*keys).agg(F.count("*").alias("_len"))
    return heads.join(first, keys).join(lengths, keys, "left").fillna(0, ["_len"])


def match_except_first(entries: DataFrame, seq: DataFrame, keys: list[str] = LIST) -> DataFrame:
    """Does the list follow the feed when exactly one leading entry is left out? Gives that entry's key.

    Where the first bucket holds several entries, the list must use up all but one of them, each once; the rest follows
    from the next bucket on.
    """
    sizes = _sizes(entries, seq, keys)
    size_cols = sizes.select(*keys, F.col("_b").alias("_skip"))
    order = position_chunk(F.col("seq_pos"))
    lead = seq.join(size_cols, keys).where("seq_pos < _skip - 1")
    lead = with_row_number(lead, [*keys, "key"], ["seq_pos"], "_occ", order)
    first = entries.join(sizes.select(*keys, F.col("_first").alias("bucket")), [*keys, "bucket"])
    first = with_row_number(first.select(*keys, "key", "pos"), [*keys, "key"], ["pos"], "_occ", position_chunk(F.col("pos")))
    unmatched = lead.join(first, [*keys, "key", "_occ"], "left_anti").groupBy(*keys).agg(F.count("*").alias("_wrong"))
    left_over = first.join(lead, [*keys, "key", "_occ"], "left_anti").groupBy(*keys).agg(F.min_by("key", "pos").alias("first_key"))
    tail = seq.join(size_cols, keys).where("seq_pos >= _skip - 1")
    follow = sequence_match(entries, tail, 1, keys)
    joined = sizes.join(unmatched, keys, "left").join(left_over, keys, "left").join(follow, keys, "left")
    ok = (
        F.when(F.col("_n") == 1, F.lit(True)).when(F.col("_len") < F.col("_b") - 1, F.lit(False))
        .otherwise(F.col("_wrong").isNull() & F.coalesce("is_match", F.lit(True)))
    )
    return joined.select(*keys, ok.alias("is_match"), F.when(ok & (F.col("_n") > 1), F.col("first_key")).alias("first_key"))


def sequence_is_suffix(entries: DataFrame, seq: DataFrame) -> DataFrame:
    """Does the list continue the feed to its end (or to the list's)? ``is_suffix, n_matched, prefix_length``.

    The first candidate names the bucket to start in; candidates are taken from that bucket as long as they are members,
    then the list must follow the next buckets.
    """
    heads = seq.where("seq_pos = 0").select("feed_id", "key")
    starts = entries.join(heads, ["feed_id", "key"]).groupBy("feed_id").agg(F.min("bucket").alias("_start"))
    bounds = entries.join(starts, "feed_id").groupBy("feed_id").agg(
        F.count_if(F.col("bucket") <= F.col("_start")).alias("_next"), F.first("_start").alias("_start"))
    members = entries.join(starts, "feed_id").where("bucket = _start").select("feed_id", "key").distinct().withColumn("_in", F.lit(True))
    listed = seq.join(starts.select("feed_id"), "feed_id", "left_semi").join(members, ["feed_id", "key"], "left")
    runs = listed.groupBy("feed_id").agg(
        F.coalesce(F.min(F.when(F.col("_in").isNull(), F.col("seq_pos"))), F.count("*")).alias("_run"))
    shape = bounds.join(runs, "feed_id")
    tail = seq.join(shape.select("feed_id", "_run", "_next"), "feed_id").where("seq_pos >= _run")
    follow = sequence_match(entries, tail, F.col("_next") - F.col("_run"))
    joined = entries.select("feed_id").distinct().join(shape, "feed_id", "left").join(follow, "feed_id", "left")
    ok = F.col("_start").isNotNull() & F.coalesce("is_match", F.lit(True))
    return joined.select(
        "feed_id", ok.alias("is_suffix"), F.when(ok, F.col("_run") + F.coalesce("n_matched", F.lit(0))).alias("n_matched"),
        F.when(ok, F.col("_next") - F.col("_run")).alias("prefix_length"))


def _keyed(df: DataFrame, eq_cfg: DataFrame) -> DataFrame:
    return with_equality_key(canonical_key(df, eq_cfg, "feed_id"), eq_cfg, "feed_id")


def new_posts_from_feeds(entries: DataFrame, posts: DataFrame, discarded: DataFrame, missing: DataFrame,
                         eq_cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare fresh feeds with stored post lists: outcome per feed, and the new posts of those that can be updated.

    ``entries(feed_id, pos, bucket, title, link_url, parts)``; ``posts``, ``discarded`` and ``missing`` hold ``(feed_id, pos, url)`` of the
    stored list (newest first), the entries known to be no posts, and the posts known to be absent from the feed.
    Outcomes: ``no_new``, ``new`` or ``mismatch`` (overlap below three, or the stored posts do not continue the feed).
    """

    def linked(df: DataFrame) -> DataFrame:
        return _keyed(U.with_canonical(df, "url"), eq_cfg)

    gone = linked(missing).select("feed_id", "key")
    expected = linked(posts).join(gone, ["feed_id", "key"], "left_anti")
    expected = with_row_number(expected, LIST, ["pos"], "_rank", position_chunk(F.col("pos"))).withColumn("seq_pos", F.col("_rank") - 1)
    # Both sides are read several times below.
    expected = checkpointed(expected)
    feed = checkpointed(except_keys(_keyed(entries, eq_cfg), linked(discarded)))
    counts = count_included(feed, expected).withColumn("n_new", F.col("n_entries") - F.col("n_included"))
    by_equality = feed.withColumn("key", F.col("eq_key"))
    suffix = sequence_is_suffix(by_equality, expected.select("feed_id", "seq_pos", F.col("eq_key").alias("key")))
    joined = counts.join(suffix, "feed_id", "left")
    outcome = (
        F.when(F.col("n_new") == 0, "no_new").when(F.col("n_included") < 3, "mismatch")
        .when(~F.coalesce("is_suffix", F.lit(False)), "mismatch").when(F.col("n_matched") != F.col("n_included"), "mismatch")
        .otherwise("new")
    )
    outcomes = joined.select("feed_id", outcome.alias("outcome"), "n_new", "n_included")
    fresh = feed.join(outcomes.where("outcome = 'new'").select("feed_id", "n_new"), "feed_id").where("pos < n_new")
    return outcomes, fresh.select("feed_id", "pos", F.col("link_url").alias("url"), "title")
