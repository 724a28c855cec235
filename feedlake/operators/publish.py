"""Daily publishing: next posts, final items, feed items and feed text, for all subscriptions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import schedule as S
from feedlake.functions.ordered import position_chunk, top_per_key, with_row_number, with_running_sum
from feedlake.functions.text import slug, xml_escaped

# Fixed value: the number of items a feed holds.
POSTS_IN_FEED = 30


def next_posts(subs: DataFrame, sub_posts: DataFrame, schedules: DataFrame, date: Column) -> DataFrame:
    """The first unpublished posts of every live, unpaused subscription, as many as the weekday asks for."""
    today = schedules.where(F.col("day_of_week") == S.day_of_week(date)).where("count > 0").select("subscription_id", "count")
    due = (
        subs.where("status = 'live' and discarded_at is null and not is_paused")
        .select(F.col("id").alias("subscription_id")).join(today, "subscription_id")
    )
    waiting = sub_posts.where("published_at is null").join(due, "subscription_id")
    ranked = with_row_number(waiting, ["subscription_id"], ["index", "id"], "rank", position_chunk(F.col("index")))
    return ranked.where("rank <= count").drop("count")


def stamp_published(posts: DataFrame, now: Column, date: Column) -> DataFrame:
    return posts.withColumn("published_at", now).withColumn("published_at_local_date", S.date_text(date))


def initial_posts(subs: DataFrame, sub_posts: DataFrame, schedules: DataFrame, users: DataFrame, now: Column,
                  date: Column) -> DataFrame:
    """First batch of new subscriptions: only where today's run has passed and it is still early morning."""
    local = S.local_now(now, F.col("timezone"))
    early = users.where(S.is_early_morning(local) & (F.col("job_date") > S.date_text(local))).select("user_id")
    return next_posts(subs.join(early, "user_id", "left_semi"), sub_posts, schedules, date)


def final_items(subs: DataFrame, sub_posts: DataFrame, new_posts: DataFrame) -> DataFrame:
    """Live subscriptions not yet final whose unpublished posts all go out now; nothing left and nothing new counts."""
    left = sub_posts.groupBy("subscription_id").agg(F.count_if(F.col("published_at").isNull()).alias("n_left"))
    new = new_posts.groupBy("subscription_id").agg(F.count("*").alias("n_new"))
    open_subs = subs.where("status = 'live' and discarded_at is null and final_item_published_at is null")
    counted = open_subs.withColumnRenamed("id", "subscription_id").join(left, "subscription_id", "left").join(
        new, "subscription_id", "left")
    return counted.where(F.coalesce("n_left", F.lit(0)) == F.coalesce("n_new", F.lit(0))).select("subscription_id", "user_id")


def publish_status(channel: Column) -> Column:
    return F.when(channel.isin("single_feed", "multiple_feeds"), "rss_published").when(channel == "email", "email_pending")


def item_guid(identifier: Column) -> Column:
    return F.sha2(identifier, 256)


def post_link(base_url: str, title: Column, random_id: Column) -> Column:
    return F.concat(F.lit(f"{base_url}/posts/"), slug(title), F.lit("/"), random_id, F.lit("/"))


def subscription_items(subs: DataFrame, sub_posts: DataFrame, new_posts: DataFrame, now: Column, base_url: str,
                       product: str) -> DataFrame:
    """Feed items of every live subscription, ``rank`` 1 first: final item, posts newest first, initial item.

    ``subs`` carry the final items of this run. ``new_posts`` are this run's posts, not yet stamped.
    """
    live = subs.where("status = 'live' and discarded_at is null")
    head = live.select(F.col("id").alias("subscription_id"), "user_id", "name", "finished_setup_at", "final_item_published_at")
    url = F.concat(F.lit(f"{base_url}/subscriptions/"), F.col("subscription_id").cast("string"))
    n_new = new_posts.groupBy("subscription_id").agg(F.count("*").alias("n_new"))
    sized = head.join(n_new, "subscription_id", "left").withColumns({
        "sub_url": url,
        "n_new": F.coalesce("n_new", F.lit(0)),
        "n_final": F.col("final_item_published_at").isNotNull().cast("int"),
    })
    newest_first = [F.col("index").desc(), F.col("id").desc()]
    older = top_per_key(sub_posts.where("published_at is not null"), ["subscription_id"], newest_first, POSTS_IN_FEED, "recency")
    older = older.join(sized, "subscription_id").where(F.col("recency") <= POSTS_IN_FEED - F.col("n_final") - F.col("n_new"))
    fresh = new_posts.withColumn("published_at", now).join(sized, "subscription_id")
    manage = F.concat(F.lit('<a href="'), F.col("sub_url"), F.lit('">Manage</a>'))
    from_name = F.concat(F.lit("from "), F.col("name"), F.lit("<br><br>"), manage)

    def post_rows(df: DataFrame, group: int) -> DataFrame:
        return df.select(
            "user_id", "subscription_id", "finished_setup_at", F.lit(group).alias("grp"), F.col("index"), F.col("id").alias("post_id"),
            F.col("title"), post_link(base_url, F.col("title"), F.col("random_id")).alias("url"),
            item_guid(F.col("id").cast("string")).alias("guid"), manage.alias("description"),
            from_name.alias("user_description"), F.col("published_at").alias("pub_date"))

    def notice_rows(df: DataFrame, group: int, title: Column, suffix: str, text: Column, date: str) -> DataFrame:
        return df.select(
            "user_id", "subscription_id", "finished_setup_at", F.lit(group).alias("grp"), F.lit(0).alias("index"),
            F.lit(0).cast("long").alias("post_id"), title.alias("title"), F.col("sub_url").alias("url"),
            item_guid(F.concat(F.col("subscription_id").cast("string"), F.lit(suffix))).alias("guid"),
            text.alias("description"), text.alias("user_description"), F.col(date).alias("pub_date"))

    more = F.lit(f'<a href="{base_url}/subscriptions/add">Want to read something else?</a>')
    finals = notice_rows(sized.where("n_final = 1"), 0, F.concat(F.lit("You're all caught up with "), F.col("name")), "-final",
                         more, "final_item_published_at")
    posts = post_rows(fresh, 1).unionByName(post_rows(older, 2))
    n_posts = posts.groupBy("subscription_id").agg(F.count("*").alias("n_posts"))
    room = sized.join(n_posts, "subscription_id", "left").where(
        F.coalesce("n_posts", F.lit(0)) + F.col("n_final") < POSTS_IN_FEED)
    initials = notice_rows(room, 3, F.concat(F.col("name"), F.lit(f" added to {product}")), "-welcome", manage,
                           "finished_setup_at")
    items = finals.unionByName(posts).unionByName(initials)
    # At most one feed's worth of older items per subscription, plus the batch of the day.
    order = [F.col("grp"), F.col("index").desc(), F.col("post_id").desc()]
    return items.withColumn("rank", F.row_number().over(Window.partitionBy("subscription_id").orderBy(*order)))


def user_items(items: DataFrame) -> DataFrame:
    """The newest items over all subscriptions of a user; ties go by newer subscription, then item order."""
    order = [F.col("pub_date").desc(), F.col("finished_setup_at").desc(), F.col("subscription_id").desc(), F.col("rank")]
    merged = top_per_key(items.withColumnRenamed("rank", "sub_rank").withColumn("rank", F.col("sub_rank")), ["user_id"], order,
                         POSTS_IN_FEED, "user_rank")
    return merged.drop("rank").withColumnRenamed("user_rank", "rank")


def item_text(description: Column) -> Column:
    date = F.date_format("pub_date", "EEE, dd MMM yyyy HH:mm:ss xx")

    def line(name: str, value: Column, attributes: str = "") -> Column:
        return F.concat(F.lit(f"      <{name}{attributes}>"), xml_escaped(value), F.lit(f"</{name}>\n"))

    return F.concat(
        F.lit("    <item>\n"), line("title", F.col("title")), line("link", F.col("url")),
        line("guid", F.col("guid"), ' isPermaLink="false"'), line("description", description), line("pubDate", date),
        F.lit("    </item>\n"))


def feed_text(title: Column, url: Column, items: Column) -> Column:
    return F.concat(
        F.lit('\n<?xml version="1.0" encoding="UTF-8"?>\n'
              '<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/">\n  <channel>\n'),
        F.lit("    <title>"), xml_escaped(title), F.lit("</title>\n    <link>"), xml_escaped(url), F.lit("</link>\n"),
        items, F.lit("  </channel>\n</rss>\n"))


def render_feeds(items: DataFrame, key: str, title: Column, url: Column, description: Column) -> DataFrame:
    """One feed text per ``key``; a feed holds a bounded number of items, so the ordered concatenation is small."""
    texts = items.withColumn("_text", item_text(description)).withColumn("_title", title).withColumn("_url", url)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "_text"))), lambda s: s["_text"])
    grouped = texts.groupBy(key).agg(F.array_join(ordered, "").alias("_items"), F.first("_title").alias("_title"),
                                     F.first("_url").alias("_url"))
    return grouped.select(key, feed_text(F.col("_title"), F.col("_url"), F.col("_items")).alias("body"))


def missing_feeds(owners: DataFrame, feeds: DataFrame, key: str) -> DataFrame:
    """Owners without a stored feed; they get an empty one."""
    return owners.select(key).join(feeds.select(key), key, "left_anti")


def publish_plan(subs: DataFrame, sub_posts: DataFrame, schedules: DataFrame, start: Column, days: int) -> DataFrame:
    """Date on which each unpublished post goes out within ``days`` days from ``start``.

    Instead of replaying days, the weekday counts are summed up per subscription; post number r goes out on the day whose
    range of post numbers holds r. Each (subscription, number) pair is matched by equality.
    """
    live = subs.where("status = 'live' and discarded_at is null and not is_paused").select(F.col("id").alias("subscription_id"))
    calendar = live.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn(
        "date", F.date_add(start, F.col("_offset")))
    calendar = calendar.withColumn("day_of_week", S.day_of_week(F.col("date")))
    counted = calendar.join(schedules.where("count > 0"), ["subscription_id", "day_of_week"])
    running = with_running_sum(counted, ["subscription_id"], ["_offset"], F.col("count").cast("long"), "last",
                               position_chunk(F.col("_offset")))
    slots = running.select("subscription_id", "date", F.explode(
        F.sequence(F.col("last") - F.col("count") + 1, F.col("last"))).alias("rank"))
    waiting = sub_posts.where("published_at is null").join(live, "subscription_id", "left_semi")
    ranked = with_row_number(waiting, ["subscription_id"], ["index", "id"], "rank", position_chunk(F.col("index")))
    return ranked.join(slots, ["subscription_id", "rank"])
