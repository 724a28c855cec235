"""Link mining from messages and merging of seed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.ordered import first_per_key
from feedlake.session import checkpointed

def _trim_link(link: Column) -> Column:
    def one_too_many(text: Column, close: str, opened: str) -> Column:
        surplus = F.length(F.replace(text, F.lit(opened), F.lit(""))) - F.length(F.replace(text, F.lit(close), F.lit("")))
        return F.when(text.endswith(close) & (surplus == 1), F.left(text, F.length(text) - 1)).otherwise(text)

    no_dot = F.regexp_replace(link, r"\.$", "")
    no_comma = F.regexp_replace(no_dot, ",$", "")
    return one_too_many(one_too_many(no_comma, ")", "("), ">", "<")


def message_links(messages: DataFrame) -> DataFrame:
    """Links in the text of ``messages(message_id, text)``: ``(message_id, pos, link)``, closing punctuation trimmed."""
    found = messages.select("message_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"https?://\S+"), 0)).alias("pos", "_raw"))
    return found.select("message_id", "pos", _trim_link(F.col("_raw")).alias("link"))


def mine_links(messages: DataFrame) -> DataFrame:
    """How often each link occurs and in how many messages; the message ids stay in ``message_links``."""
    per_message = message_links(messages).groupBy("link", "message_id").agg(F.count("*").alias("_n"))
    return per_message.groupBy("link").agg(F.sum("_n").alias("n"), F.count("*").alias("n_messages"))


def block_hosts(links: DataFrame, blocked: DataFrame) -> DataFrame:
    """Links of hosts that the curated list ``blocked(host)`` does not name, with their host."""
    return links.withColumn("host", U.url_host(F.col("link"))).join(blocked.select("host"), "host", "left_anti")


def links_by_host(links: DataFrame) -> DataFrame:
    return links.groupBy("host").agg(F.count("*").alias("n_links"), F.sum("n").alias("n_mentions"))


def feed_stats(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Mentions per feed: ``rows(seq, link, message_id, feed_url)`` with ``rules(kind, pattern, target)``.

    Feeds are grouped scheme-less; the first seen form names the group. Exact urls and prefixes drop a feed, replacements
    rename it. Order: distinct messages, then first occurrence. Prefix rules of any length are matched by equality on
    prefixes of the rule lengths, of which there are few.
    """
    keyed = rows.withColumn("feed_key", U.scheme_less(F.col("feed_url")))
    stats = keyed.groupBy("feed_key").agg(
        F.min_by("feed_url", "seq").alias("feed_url"), F.count_distinct("message_id").alias("n_messages"),
        F.count_distinct("link").alias("n_links"), F.min("seq").alias("first_seq"))
    kept = stats.join(rules.where("kind = 'exact'").select(F.col("pattern").alias("feed_url")), "feed_url", "left_anti")
    prefixes = rules.where("kind = 'prefix'").select("pattern", F.length("pattern").alias("_len"))
    lengths = prefixes.agg(F.sort_array(F.collect_set("_len")).alias("_lengths"))
    heads = kept.join(F.broadcast(lengths)).select("feed_url", F.explode("_lengths").alias("_len")).select(
        "feed_url", F.expr("substring(feed_url, 1, _len)").alias("pattern"))
    hit = heads.join(prefixes, "pattern", "left_semi").select("feed_url").distinct()
    renamed = rules.where("kind = 'replace'").select(F.col("pattern").alias("feed_url"), "target")
    final = kept.join(hit, "feed_url", "left_anti").join(renamed, "feed_url", "left")
    return final.select(F.coalesce("target", "feed_url").alias("feed_url"), "n_messages", "n_links", "first_seq").orderBy(
        F.col("n_messages").desc(), "first_seq")


def merge_feed_lists(feeds: DataFrame, scores: DataFrame) -> DataFrame:
    """Merge feed-search runs: ``feeds(seq, url, feed_url)``, ``scores(url, sum_score, n)``.

    Scores add up per scheme-less url. In order of ``seq`` a url opens the feed it names, or adds its score to a feed
    opened before; once it has opened one, its later rows are skipped.
    """
    score = scores.groupBy(U.scheme_less(F.col("url")).alias("key")).agg(F.sum("sum_score").alias("sum_score"), F.sum("n").alias("n"))
    rows = feeds.withColumns({"key": U.scheme_less(F.col("url")), "feed_key": U.scheme_less(F.col("feed_url"))})
    owners = feed_owners(rows)
    counted = rows.join(owners.select("key", F.col("seq").alias("_own")), "key", "left").where(
        F.col("_own").isNull() | (F.col("seq") <= F.col("_own")))
    sums = counted.join(score, "key").groupBy("feed_key").agg(F.sum("sum_score").alias("sum_score"), F.sum("n").alias("n"))
    return owners.join(sums, "feed_key").select("url", "feed_url", "sum_score", "n", "seq").orderBy(
        F.col("sum_score").desc(), "seq")


def feed_owners(rows: DataFrame) -> DataFrame:
    """Rows that open a feed: each url opens at most one, each feed is opened once, earlier rows go first.

    A row that comes first for both its url and its feed is certain. Those rows settle their url and feed, all other rows
    of either are taken out, and the rule runs again on what is left; unrelated rows settle in the same round.
    """
    live = checkpointed(first_per_key(rows, ["key", "feed_key"], ["seq"]))
    settled = None
    while not live.isEmpty():
        by_url = live.groupBy("key").agg(F.min("seq").alias("_url_seq"))
        by_feed = live.groupBy("feed_key").agg(F.min("seq").alias("_feed_seq"))
        certain = checkpointed(
            live.join(by_url, "key").where("seq = _url_seq").drop("_url_seq")
            .join(by_feed, "feed_key").where("seq = _feed_seq").drop("_feed_seq").select(*rows.columns))
        settled = certain if settled is None else settled.unionByName(certain)
        live = checkpointed(live.join(certain, "key", "left_anti").join(certain, "feed_key", "left_anti").select(*rows.columns))
    return rows.limit(0) if settled is None else settled


def remaining_work(rows: DataFrame, done: DataFrame, cutoff: int) -> DataFrame:
    """Rows ``(row, url, sum_score)``, sorted by score, still to do: before the first one under the cutoff, not done."""
    stop = rows.where(F.col("sum_score") < cutoff).agg(F.min("row").alias("_stop"))
    open_rows = rows.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("row") < F.col("_stop"))).drop("_stop")
    return open_rows.join(done.select("row"), "row", "left_anti")
