"""Subscriptions and schedules: overview, preview, selection, versioned updates, time zones."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import schedule as S
from feedlake.functions.ordered import position_chunk, top_per_key, with_max_before


def active(df: DataFrame) -> DataFrame:
    """Rows that were not soft-deleted."""
    return df.where("discarded_at is null")


def post_counts(sub_posts: DataFrame) -> DataFrame:
    return sub_posts.groupBy("subscription_id").agg(
        F.count("published_at").alias("published_count"), F.count("*").alias("total_count"))


def subscription_overview(subs: DataFrame, sub_posts: DataFrame) -> DataFrame:
    """Not-discarded subscriptions with their counts and section; order per user: newest first, unfinished on top."""
    joined = active(subs).join(post_counts(sub_posts), F.col("id") == F.col("subscription_id"), "left").drop("subscription_id")
    section = F.when(F.col("status") != "live", "setting_up").when(
        F.col("published_count") < F.col("total_count"), "active").otherwise("finished")
    return joined.withColumn("section", section).orderBy(
        "user_id", F.col("finished_setup_at").desc_nulls_first(), F.col("created_at").desc(), "id")


def subscription_detail(subs: DataFrame, sub_posts: DataFrame, schedules: DataFrame, blogs: DataFrame) -> DataFrame:
    """Tagged rows per subscription: one with its fields and counts, and one per schedule day."""
    live = active(subs)
    head = (
        live.join(post_counts(sub_posts).withColumnRenamed("subscription_id", "id"), "id", "left")
        .join(blogs.select(F.col("id").alias("blog_id"), "url"), "blog_id", "left")
        .select(F.lit("subscription").alias("tag"), F.col("id").alias("subscription_id"), "name", "is_paused", "status", "url",
                F.coalesce("published_count", F.lit(0)).alias("published_count"),
                F.coalesce("total_count", F.lit(0)).alias("total_count"))
    )
    days = schedules.join(live.select(F.col("id").alias("subscription_id")), "subscription_id", "left_semi").select(
        F.lit("schedule").alias("tag"), "subscription_id", "day_of_week", "count")
    return head.unionByName(days, allowMissingColumns=True)


def names_by_day(subs: DataFrame, sub_posts: DataFrame, schedules: DataFrame, current: DataFrame) -> DataFrame:
    """Names of a user's other unfinished live subscriptions per weekday, each repeated as often as it is scheduled.

    ``current(user_id, current_id)`` holds one subscription per user.
    """
    unfinished = post_counts(sub_posts).where("published_count <> total_count").select(F.col("subscription_id").alias("id"))
    others = (
        active(subs).where("status = 'live'").join(unfinished, "id", "left_semi")
        .join(current, "user_id").where("id <> current_id")
    )
    days = schedules.where("count > 0").withColumnRenamed("subscription_id", "id")
    repeated = others.join(days, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    return repeated.select("user_id", "current_id", "day_of_week", "id", "name", "created_at", "copy").orderBy(
        "user_id", "day_of_week", F.col("created_at").desc(), "id", "copy")


def schedule_preview(sub_posts: DataFrame, prev_lines: int = 2, next_lines: int = 5) -> DataFrame:
    """Rows ``prev`` and ``next`` around the publishing point of each subscription, with its counts.

    A side with more posts than lines gives up one line for the ellipsis.
    """
    order_next = [F.col("index"), F.col("id")]
    order_prev = [F.col("index").desc(), F.col("id").desc()]
    prev = top_per_key(sub_posts.where("published_at is not null"), ["subscription_id"], order_prev, prev_lines)
    nxt = top_per_key(sub_posts.where("published_at is null"), ["subscription_id"], order_next, next_lines)
    both = prev.withColumn("tag", F.lit("prev")).unionByName(nxt.withColumn("tag", F.lit("next")))
    sized = both.join(post_counts(sub_posts), "subscription_id")
    available = F.when(F.col("tag") == "prev", F.col("published_count")).otherwise(F.col("total_count") - F.col("published_count"))
    lines = F.when(F.col("tag") == "prev", prev_lines).otherwise(next_lines)
    shown = sized.withColumn("has_more", available > lines)
    return shown.where(F.col("rank") <= F.when(F.col("has_more"), lines - 1).otherwise(lines))


def random_id(*seed: Column) -> Column:
    """Url-safe 22-character id that is the same on every rerun."""
    digest = F.base64(F.unhex(F.md5(F.concat_ws("/", *seed))))
    return F.rtrim(F.translate(digest, "+/=", "-_ "))


def select_posts(picks: DataFrame, assignments: DataFrame) -> DataFrame:
    """Posts of the picked category per subscription. ``picks(subscription_id, category_id)``."""
    posts = picks.join(assignments, "category_id").select("subscription_id", "blog_post_id")
    return posts.withColumn("random_id", random_id(F.col("subscription_id").cast("string"), F.col("blog_post_id").cast("string")))


def selection_share(selected: DataFrame, picks: DataFrame, blog_posts: DataFrame) -> DataFrame:
    """Selected count and fraction of the blog's posts. ``picks(subscription_id, blog_id)``."""
    chosen = selected.groupBy("subscription_id").agg(F.count("*").alias("selected_count"))
    totals = blog_posts.groupBy("blog_id").agg(F.count("*").alias("posts_count"))
    joined = picks.select("subscription_id", "blog_id").join(chosen, "subscription_id").join(totals, "blog_id")
    return joined.withColumn("selected_fraction", F.col("selected_count") / F.col("posts_count"))


def apply_versioned(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Mark each update ``(id, seq, version)`` as applied or conflict, in order of ``seq``.

    An update counts only if its version is above the stored one and above all earlier updates.
    """
    ranked = with_max_before(updates, ["id"], ["seq"], "version", "_earlier", position_chunk(F.col("seq")))
    joined = ranked.join(current.select("id", F.col("version").alias("_stored")), "id", "left")
    known = F.greatest(F.coalesce("_stored", F.lit(-1)), F.coalesce("_earlier", F.lit(-1)))
    return joined.withColumn("outcome", F.when(F.col("version") > known, "applied").otherwise("conflict")).withColumn(
        "known_version", known).drop("_earlier", "_stored")


def schedule_metrics(schedules: DataFrame) -> DataFrame:
    totals = schedules.groupBy("subscription_id").agg(
        F.sum("count").alias("weekly_count"), F.count_if(F.col("count") > 0).alias("active_days"))
    share = F.when(F.col("active_days") > 0, F.col("weekly_count") / F.col("active_days"))
    return totals.withColumn("posts_per_active_day", share)


def first_delivery(subs: DataFrame, schedules: DataFrame) -> DataFrame:
    """First delivery date and message of ``subs(subscription_id, local_date, ran_today, published_count)``."""
    start = F.when(F.col("ran_today"), F.date_add("local_date", 1)).otherwise(F.col("local_date"))
    days = subs.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn(
        "date", F.date_add(start, F.col("_offset")))
    days = days.withColumn("day_of_week", S.day_of_week(F.col("date")))
    enabled = days.join(schedules.where("count > 0"), ["subscription_id", "day_of_week"])
    first = enabled.groupBy("subscription_id").agg(
        F.min("date").alias("first_date"), F.min_by("count", "date").alias("first_count"))
    message = (
        F.when(F.col("published_count") == 1, "arrived_one").when(F.col("published_count") > 1, "arrived_many")
        .when(F.col("first_count") == 1, "will_arrive_one").otherwise("will_arrive_many")
    )
    return subs.join(first, "subscription_id").withColumn("message", message)


def next_schedule_date(users: DataFrame, now: Column) -> DataFrame:
    """Realistic next run date (text) of ``users(user_id, timezone, job_date)``."""
    local = S.local_now(now, F.col("timezone"))
    today = S.date_text(local)
    unset = F.when(S.is_early_morning(local), today).otherwise(S.date_text(F.date_add(F.to_date(local), 1)))
    date = F.when(F.col("job_date").isNull(), unset).when(F.col("job_date") < today, today).otherwise(F.col("job_date"))
    return users.withColumn("next_schedule_date", date)


def resolve_timezones(df: DataFrame) -> DataFrame:
    """Known zone ids stay; others become a fixed offset from ``offset_minutes`` (west positive), else UTC.

    The list of zone ids comes from the time-zone database and has a fixed size, so it is broadcast.
    """
    known = df.sparkSession.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "timezone_in string")
    tagged = df.join(F.broadcast(known.withColumn("_known", F.lit(True))), "timezone_in", "left")
    ratio = F.col("offset_minutes") / 60
    # Half hours round away from zero.
    hours = (F.signum(ratio) * F.floor(F.abs(ratio) + 0.5)).cast("int")
    named = F.concat(F.lit("Etc/GMT"), F.when(hours >= 0, "+").otherwise(""), hours.cast("string"))
    zone = F.when(F.col("_known"), F.col("timezone_in")).when(hours.between(-14, 12), named).otherwise("UTC")
    return tagged.withColumn("timezone", zone).drop("_known")


def claim_anonymous(subs: DataFrame, logins: DataFrame) -> DataFrame:
    """Give anonymous subscriptions to the user who later logged in: ``logins(anon_id, login_user_id)``."""
    joined = subs.join(logins, "anon_id", "left")
    return joined.withColumn("user_id", F.coalesce("user_id", "login_user_id")).drop("login_user_id")
