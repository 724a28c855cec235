"""Product events and telemetry: anonymising, client classes, dispatch, funnels, dashboards, progress checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.ordered import position_chunk, with_last_known, with_previous

# User-agent rules, first match wins: (pattern, name). A bot counts before any browser.
BOT_RULES = [
    ("(?i)googlebot", "Google Bot"), ("(?i)bingbot", "Bing Bot"), ("(?i)duckduckbot", "DuckDuckGo Bot"),
    ("(?i)feedly/", "Feedly"), ("(?i)bot|crawler|spider|slurp", "Generic Bot"),
]
BROWSER_RULES = [
    ("Edg(?:e|A|iOS)?/", "Microsoft Edge"), ("OPR/|Opera", "Opera"), ("Firefox/|FxiOS/", "Firefox"),
    ("Chrome/|CriOS/", "Chrome"), ("Safari/", "Safari"),
]
OS_RULES = [
    ("Windows NT ([0-9.]+)", "Windows"), ("Android ([0-9.]+)", "Android"), ("(?:iPhone )?OS ([0-9_]+) like Mac", "iOS"),
    ("Mac OS X ([0-9_.]+)", "macOS"), ("Linux", "Generic Linux"),
]


def _first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    chosen = F.lit(default).cast("string")
    for pattern, name in reversed(rules):
        chosen = F.when(text.rlike(pattern), name).otherwise(chosen)
    return chosen


def anonymize_ip(df: DataFrame, ip: str = "user_ip") -> DataFrame:
    return df.withColumn(ip, F.regexp_replace(ip, r"\.\d+\.\d+$", ".0.1"))


def resolve_platform(df: DataFrame, agent: str = "user_agent") -> DataFrame:
    """Add ``browser, os_name, os_version, bot_name``; bots get ``Crawler`` in all three."""
    text = F.col(agent)
    version = F.lit(None).cast("string")
    for pattern, _name in reversed(OS_RULES):
        if "(" in pattern:
            version = F.when(text.rlike(pattern), F.translate(F.regexp_extract(text, pattern, 1), "_", ".")).otherwise(version)
        else:
            version = F.when(text.rlike(pattern), F.lit(None).cast("string")).otherwise(version)
    named = df.withColumn("bot_name", _first_match(text, BOT_RULES, None))
    bot = F.col("bot_name").isNotNull()
    return named.withColumns({
        "browser": F.when(bot, "Crawler").otherwise(_first_match(text, BROWSER_RULES, "Unknown Browser")),
        "os_name": F.when(bot, "Crawler").otherwise(_first_match(text, OS_RULES, "Unknown")),
        "os_version": F.when(bot, "Crawler").otherwise(version),
    })


def collapse_referer(referer: Column, own_hosts: list[str], label: str) -> Column:
    """Referers from the product's own hosts become one label; others stay."""
    return F.when(U.url_host(referer).isin(own_hosts), label).otherwise(referer)


def reader_client(agent: Column) -> Column:
    return F.when(agent.startswith("Feedly/"), "Feedly").when(agent.contains("inoreader.com;"), "Inoreader").otherwise(agent)


def build_events(df: DataFrame, event_type: str, properties: dict[str, Column]) -> DataFrame:
    """Typed event rows: the properties become one JSON text."""
    fields = F.struct(*[value.alias(name) for name, value in properties.items()])
    return df.withColumns({"event_type": F.lit(event_type), "event_properties": F.to_json(fields)})


def schedule_events(metrics: DataFrame, event_type: str) -> DataFrame:
    """``schedule`` / ``update schedule`` events out of ``schedule_metrics`` rows."""
    names = ["subscription_id", "weekly_count", "active_days"]
    return build_events(metrics, event_type, {name: F.col(name) for name in names})


def _is_skipped_bot(events: DataFrame) -> Column:
    # Any value but false and null lets bots in.
    allowed = F.coalesce(F.get_json_object("user_properties", "$.allow_bots"), F.lit("false")) != "false"
    return F.col("bot_name").isNotNull() & F.col("user_properties").isNotNull() & ~allowed


def dispatch_batch(events: DataFrame) -> DataFrame:
    """Payload of every undispatched event that is not a skipped bot."""
    pending = events.where("dispatched_at is null").where(~_is_skipped_bot(events))
    return pending.select(
        F.col("product_user_id").alias("user_id"), "event_type", F.unix_millis("created_at").alias("time"),
        "event_properties", "user_properties", F.col("browser").alias("platform"), "os_name", "os_version",
        F.col("user_ip").alias("ip"), F.col("id").alias("event_id"), F.col("id").cast("string").alias("insert_id"))


def stamp_dispatched(events: DataFrame, now: Column) -> DataFrame:
    """Events as they are stored after a dispatch: all that were pending are stamped, skipped bots too, or they would come
    again with each batch."""
    return events.withColumn("dispatched_at", F.coalesce("dispatched_at", now))


def bot_skip_counts(events: DataFrame) -> DataFrame:
    skipped = events.where("dispatched_at is null").where(_is_skipped_bot(events))
    return skipped.groupBy("bot_name").agg(F.count("*").alias("n_skipped"))


def funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """Distinct users reaching each step after all earlier ones: ``(step, event_type, users)``."""
    firsts = events.where(F.col("event_type").isin(steps)).groupBy("user_id").agg(
        *[F.min(F.when(F.col("event_type") == s, F.col("ts"))).alias(f"_t{i}") for i, s in enumerate(steps)])
    reached = F.col("_t0").isNotNull()
    counts = [F.count_if(reached).alias("_n0")]
    for i in range(1, len(steps)):
        reached = reached & (F.col(f"_t{i}") >= F.col(f"_t{i - 1}"))
        counts.append(F.count_if(reached).alias(f"_n{i}"))
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("event_type"), F.col(f"_n{i}").alias("users"))
                     for i, s in enumerate(steps)])
    return firsts.agg(*counts).select(F.inline(rows))


def crawl_wait(subs: DataFrame, blogs: DataFrame) -> DataFrame:
    """Seconds from subscribing to the end of the crawl, for discarded subscriptions too."""
    joined = subs.join(blogs.select("blog_id", "finished_at"), "blog_id")
    return joined.select(
        "subscription_id", F.coalesce("product_user_id", "anon_product_user_id").alias("product_user_id"),
        (F.unix_timestamp("finished_at") - F.unix_timestamp("created_at")).alias("wait_duration"))


def crawl_telemetry(runs: DataFrame) -> DataFrame:
    """Telemetry points ``(run_id, key, value)`` of crawl runs, with the recrawl outcome after a failure.

    ``runs(run_id, feed_url, succeeded, elapsed, title_seconds, duplicates)``; run ids grow over time.
    """
    seen = with_previous(runs, ["feed_url"], ["run_id"], {"_before": "succeeded"}, position_chunk(F.col("run_id")))

    def points(df: DataFrame, key: Column, value: Column) -> DataFrame:
        return df.select("run_id", key.alias("key"), value.cast("double").alias("value"))

    outcome = F.when(F.col("succeeded"), "guided_crawling_job_success").otherwise("guided_crawling_job_failure")
    entries = F.array_compact(F.array(
        F.struct(outcome.alias("key"), F.col("elapsed").cast("double").alias("value")),
        F.when(F.col("title_seconds").isNotNull(), F.struct(
            F.lit("crawling_title_fetch_duration").alias("key"), F.col("title_seconds").cast("double").alias("value"))),
        F.when(F.col("duplicates") > 0, F.struct(
            F.lit("crawling_duplicate_requests").alias("key"), F.col("duplicates").cast("double").alias("value"))),
        F.when(~F.col("_before"), F.struct(
            F.lit("recrawl_status").alias("key"), F.col("succeeded").cast("double").alias("value")))))
    return seen.select("run_id", F.inline(entries))


def _scale_max(top: Column) -> Column:
    ten = F.pow(F.lit(10.0), F.ceil(F.log10(F.when(top > 0, top))).cast("double"))
    scaled = F.when(ten / top >= 5, ten / 5).when(ten / top >= 2, ten / 2).otherwise(ten)
    return F.when(top > 0, scaled).otherwise(F.lit(1.0))


def telemetry_scales(points: DataFrame, priority_keys: list[str]) -> DataFrame:
    """Per key: order rank, y-scale top (1, 2 or 5 steps of a power of ten) and its eleven ticks."""
    tops = points.groupBy("key").agg(F.max("value").alias("_top"))
    rank = F.coalesce(*[F.when(F.col("key") == k, i) for i, k in enumerate(priority_keys)], F.lit(len(priority_keys)))
    scaled = tops.select("key", rank.alias("priority"), _scale_max(F.greatest("_top", F.lit(0.0))).alias("y_max"))
    return scaled.withColumn("y_ticks", F.transform(F.sequence(F.lit(10), F.lit(0), F.lit(-1)), lambda i: F.col("y_max") * i / 10))


def telemetry_dashboard(points: DataFrame, now: Column, priority_keys: list[str]) -> DataFrame:
    """Bars of the last seven days and one date marker per day from a key's first to its last point."""
    since = F.date_sub(F.to_date(now), 6).cast("timestamp")
    recent = points.where(F.col("created_at") > since)
    scales = telemetry_scales(recent, priority_keys).drop("y_ticks")
    percent = F.when(F.col("value") >= 0, F.col("value") * 100 / F.col("y_max")).otherwise(5.0)
    bars = recent.join(scales, "key").select(
        "key", "priority", F.lit("bar").alias("item"), F.date_format("created_at", "yyyy-MM-dd").alias("date"), "created_at",
        "value", "y_max", percent.alias("percent"))
    spans = recent.groupBy("key").agg(F.min(F.to_date("created_at")).alias("_from"), F.max(F.to_date("created_at")).alias("_to"))
    days = spans.join(scales, "key").select(
        "key", "priority", F.lit("date").alias("item"), F.explode(F.sequence("_from", "_to")).alias("_day"))
    markers = days.withColumn("date", F.date_format("_day", "yyyy-MM-dd")).drop("_day")
    return bars.unionByName(markers, allowMissingColumns=True).orderBy(
        "priority", "key", "date", F.col("item").desc(), "created_at")


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ";"), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def timing_deviation(df: DataFrame) -> DataFrame:
    """Client against server epoch durations: ``df(server_times, client_times, epoch, socket_wait)``.

    Rows whose two lists differ in length are dropped. Deviations are root mean squares over ``epoch``.
    """
    lists = df.withColumns({"_server": _numbers(F.col("server_times")), "_client": _numbers(F.col("client_times"))})
    equal = lists.where(F.size("_server") == F.size("_client"))
    rest = F.slice("_client", 2, F.size("_client"))
    first_load = F.array_position(F.transform(rest, lambda x: x != 0), True)
    loaded = F.when(first_load == 0, F.array().cast("array<double>")).otherwise(
        F.slice(rest, (first_load + 1).cast("int"), F.size("_client")))
    cut = equal.withColumn("_late", loaded)
    # The last entries of the server list, as many as the client has left.
    tail = F.slice("_server", F.size("_server") - F.size("_late") + 1, F.size("_server"))

    def deviation(left: Column, right: Column) -> Column:
        squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.col("epoch"))

    return cut.withColumns({
        "deviation": deviation(F.col("_client"), F.col("_server")),
        "deviation_after_load": deviation(F.col("_late"), tail),
        "initial_load": F.element_at("_client", 1),
        "socket_wait": F.greatest(F.lit(0.0), F.col("socket_wait") - F.element_at("_server", 1)),
    }).drop("_server", "_client", "_late")


def progress_regressions(updates: DataFrame) -> DataFrame:
    """Steps backwards in crawl progress, per crawl in order of ``epoch``.

    ``updates(crawl_id, epoch, status, remaining, fetched)`` hold one-field structs: a null struct means "not reported,
    keep the last", a struct with a null inside means "reported as unknown".
    """
    names = {"_status": "status", "_remaining": "remaining", "_fetched": "fetched"}
    seen = with_last_known(updates, ["crawl_id"], ["epoch"], names, position_chunk(F.col("epoch")), before=True)
    return seen.withColumn("regressions", _regressions()).where("regressions <> ''").drop(*names)


def _regressions() -> Column:
    def value(name: str) -> Column:
        return F.col(f"{name}.value")

    reset = F.col("status").isNotNull() & value("_status") & ~F.coalesce(value("status"), F.lit(False))
    up = F.col("remaining").isNotNull() & value("_remaining").isNotNull() & (
        value("remaining").isNull() | (value("remaining") >= value("_remaining")))
    down = F.col("fetched").isNotNull() & value("_fetched").isNotNull() & (
        value("fetched").isNull() | (value("fetched") < value("_fetched")))
    return F.concat_ws(",", F.when(reset, "postprocessing_reset"), F.when(up, "remaining_count_up"),
                       F.when(down, "fetched_count_down"))


def typed_url_stats(log: DataFrame) -> DataFrame:
    """Result codes of typed urls per source, and how many needed stripping."""
    return log.groupBy("source", "result").agg(
        F.count("*").alias("n"), F.count_if(F.col("typed_url") != F.col("stripped_url")).alias("n_stripped"))


def latest_status(updates: DataFrame) -> DataFrame:
    """Latest crawl status per blog."""
    return updates.groupBy("blog_id").agg(F.max_by("status", "epoch").alias("status"), F.max("epoch").alias("epoch"))


def telemetry_windows(points: DataFrame, width: str) -> DataFrame:
    """Tumbling windows per key; works on batches and on watermarked streams alike."""
    return points.groupBy(F.window("created_at", width).alias("_w"), "key").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")).select(
        F.col("_w.start").alias("window_start"), "key", "n", "total", "top")
