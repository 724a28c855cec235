"""Event, telemetry and e-mail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import email_ops as M
from feedlake.operators import events as O
from feedlake.plans.registry import query

c = F.col

# User agents handed out by event.
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/110.0 Safari/537.36 Edg/110.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1 Version/16.1 Safari/605.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/110.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Feedly/1.0 (+http://www.feedly.com/fetcher.html; 3 subscribers)",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_2 like Mac OS X) AppleWebKit/605.1 CriOS/110.0 Mobile Safari/604.1",
    "Mozilla/5.0 (compatible; inoreader.com; 5 subscribers)",
]
PLATFORMS_SQL = """(VALUES (0, 'Microsoft Edge', 'Windows', '10.0', NULL), (1, 'Safari', 'macOS', '10.15.7', NULL), (2, 'Firefox', 'Generic Linux', NULL, NULL),
  (3, 'Crawler', 'Crawler', 'Crawler', 'Google Bot'), (4, 'Crawler', 'Crawler', 'Crawler', 'Feedly'), (5, 'Chrome', 'iOS', '16.2', NULL),
  (6, 'Unknown Browser', 'Unknown', NULL, NULL)) AS p(pick, browser, os_name, os_version, bot_name)"""


def agent():
    return F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (c("event_id") % 7 + 1).cast("int"))


def product_events(t):
    k = c("event_id")
    raw = t.events.select(
        k.alias("id"), F.concat(F.lit("u"), c("user_id").cast("string")).alias("product_user_id"), "event_type",
        c("props").alias("event_properties"), F.when(k % 5 != 0, F.when(k % 3 == 0, '{"allow_bots":true}').otherwise(
            '{"bot_is_allowed":true}')).alias("user_properties"),
        F.concat(F.lit("10."), (k % 200).cast("string"), F.lit("."), (k % 100).cast("string"), F.lit("."), (c("user_id") % 250).cast("string")).alias("user_ip"),
        agent().alias("user_agent"), c("ts").alias("created_at"), F.when(k % 4 == 0, c("ts")).alias("dispatched_at"))
    return O.resolve_platform(O.anonymize_ip(raw))


@query("l01_anonymize_ip", "SELECT event_id, '10.' || (event_id % 200) || '.0.1' AS user_ip FROM events")
def _(t):
    return product_events(t).select(c("id").alias("event_id"), "user_ip")


@query("l02_resolve_platform", f"SELECT event_id, browser, os_name, os_version, bot_name FROM events JOIN {PLATFORMS_SQL} ON pick = event_id % 7")
def _(t):
    return product_events(t).select(c("id").alias("event_id"), "browser", "os_name", "os_version", "bot_name")


@query("l03_client_classes", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Reader' WHEN 1 THEN 'https://news.example.org/item' END AS referer,
    CASE event_id % 7 WHEN 4 THEN 'Feedly' WHEN 6 THEN 'Inoreader' ELSE 'other' END AS client FROM events""")
def _(t):
    referer = F.when(c("event_id") % 3 == 0, "https://www.reader.example.com/x").when(c("event_id") % 3 == 1, "https://news.example.org/item")
    client = O.reader_client(agent())
    return t.events.select(
        "event_id", O.collapse_referer(referer, ["reader.example.com", "www.reader.example.com"], "Reader").alias("referer"),
        F.when(client.isin("Feedly", "Inoreader"), client).otherwise("other").alias("client"))


@query("l04_build_events", """SELECT o_orderkey AS subscription_id, 'schedule' AS event_type, '{"subscription_id":' || o_orderkey || ',"weekly_count":' || (7 + o_orderkey % 3)
    || ',"active_days":' || (o_orderkey % 7) || '}' AS event_properties FROM orders""")
def _(t):
    k = c("o_orderkey")
    metrics = t.orders.select(k.alias("subscription_id"), (7 + k % 3).alias("weekly_count"), (k % 7).alias("active_days"))
    return O.schedule_events(metrics, "schedule").select("subscription_id", "event_type", "event_properties")


BOTS_SQL = f"""e AS (SELECT *, event_id % 4 <> 0 AS pending,
  bot_name IS NOT NULL AND event_id % 5 <> 0 AND event_id % 3 <> 0 AS skipped FROM events JOIN {PLATFORMS_SQL} ON pick = event_id % 7)"""


@query("l05_dispatch_batch", f"""WITH {BOTS_SQL} SELECT event_id, 'u' || user_id AS user_id, event_type, epoch_us(ts) // 1000 AS time, event_id::VARCHAR AS insert_id, browser AS platform, os_version
    FROM e WHERE pending AND NOT skipped""")
def _(t):
    return O.dispatch_batch(product_events(t)).select("event_id", "user_id", "event_type", "time", "insert_id", "platform", "os_version")


@query("l05_stamp_dispatched", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ts ELSE TIMESTAMP '2030-01-01' END AS dispatched_at FROM events")
def _(t):
    return O.stamp_dispatched(product_events(t), F.lit("2030-01-01").cast("timestamp")).select(c("id").alias("event_id"), "dispatched_at")


@query("l05_bot_skip_counts", f"WITH {BOTS_SQL} SELECT bot_name, count(*) AS n_skipped FROM e WHERE pending AND skipped GROUP BY 1")
def _(t):
    return O.bot_skip_counts(product_events(t))


@query("l06_funnel", """WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS t0, min(ts) FILTER (WHERE event_type = 'click') AS t1,
      min(ts) FILTER (WHERE event_type = 'signup') AS t2, min(ts) FILTER (WHERE event_type = 'purchase') AS t3 FROM events GROUP BY 1)
    SELECT 0 AS step, 'view' AS event_type, count(*) FILTER (WHERE t0 IS NOT NULL) AS users FROM f
    UNION ALL SELECT 1, 'click', count(*) FILTER (WHERE t1 >= t0) FROM f UNION ALL SELECT 2, 'signup', count(*) FILTER (WHERE t1 >= t0 AND t2 >= t1) FROM f
    UNION ALL SELECT 3, 'purchase', count(*) FILTER (WHERE t1 >= t0 AND t2 >= t1 AND t3 >= t2) FROM f""")
def _(t):
    return O.funnel(t.events, ["view", "click", "signup", "purchase"])


@query("l07_crawl_wait", """WITH b AS (SELECT o_custkey AS blog_id, max(o_orderdate) + INTERVAL 1 HOUR AS finished_at FROM orders GROUP BY 1)
    SELECT o_orderkey AS subscription_id, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || o_custkey ELSE 'anon' || o_orderkey END AS product_user_id,
      epoch(finished_at)::BIGINT - epoch(o_orderdate)::BIGINT AS wait_duration FROM orders JOIN b ON blog_id = o_custkey""")
def _(t):
    subs = t.orders.select(
        c("o_orderkey").alias("subscription_id"), c("o_custkey").alias("blog_id"), c("o_orderdate").alias("created_at"),
        F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("u"), c("o_custkey").cast("string"))).alias("product_user_id"),
        F.concat(F.lit("anon"), c("o_orderkey").cast("string")).alias("anon_product_user_id"))
    blogs = t.orders.groupBy(c("o_custkey").alias("blog_id")).agg(F.timestamp_add("HOUR", F.lit(1), F.max("o_orderdate")).alias("finished_at"))
    return O.crawl_wait(subs, blogs)


@query("l08_crawl_telemetry", """WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 3 <> 0 AS ok, o_totalprice AS elapsed,
      CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 17)::DOUBLE END AS title_seconds, o_orderkey % 5 AS duplicates,
      lag(o_orderkey % 3 <> 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
    SELECT run_id, CASE WHEN ok THEN 'guided_crawling_job_success' ELSE 'guided_crawling_job_failure' END AS key, elapsed AS value FROM r
    UNION ALL SELECT run_id, 'crawling_title_fetch_duration', title_seconds FROM r WHERE title_seconds IS NOT NULL
    UNION ALL SELECT run_id, 'crawling_duplicate_requests', duplicates FROM r WHERE duplicates > 0
    UNION ALL SELECT run_id, 'recrawl_status', CASE WHEN ok THEN 1.0 ELSE 0.0 END FROM r WHERE before = false""")
def _(t):
    k = c("o_orderkey")
    runs = t.orders.select(k.alias("run_id"), c("o_custkey").alias("feed_url"), (k % 3 != 0).alias("succeeded"),
                           c("o_totalprice").alias("elapsed"), F.when(k % 2 == 0, k % 17).alias("title_seconds"), (k % 5).alias("duplicates"))
    return O.crawl_telemetry(runs)


PRIORITY = ["purchase", "error"]


def points(t):
    return t.events.select(c("event_type").alias("key"), (c("value") - 20).alias("value"), c("ts").alias("created_at"))


@query("l09_telemetry_dashboard", """WITH p AS (SELECT event_type AS key, value - 20 AS value, ts AS created_at FROM events WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 6 DAY),
    s AS (SELECT key, greatest(max(value), 0) AS top, CASE key WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS priority FROM p GROUP BY 1),
    y AS (SELECT *, pow(10.0, ceil(log10(top))) AS ten FROM s),
    m AS (SELECT key, priority, CASE WHEN ten / top >= 5 THEN ten / 5 WHEN ten / top >= 2 THEN ten / 2 ELSE ten END AS y_max FROM y),
    spans AS (SELECT key, min(created_at)::DATE AS a, max(created_at)::DATE AS b FROM p GROUP BY 1)
    SELECT p.key, priority, 'bar' AS item, strftime(created_at, '%Y-%m-%d') AS date, epoch_us(created_at) // 1000 AS at_ms, value, y_max, round(CASE WHEN value >= 0 THEN value * 100 / y_max ELSE 5.0 END, 6) AS percent
    FROM p JOIN m USING (key)
    UNION ALL SELECT key, priority, 'date', strftime(a + unnest(range((b - a)::INT + 1))::INT, '%Y-%m-%d'), NULL, NULL, NULL, NULL FROM spans JOIN m USING (key)""")
def _(t):
    board = O.telemetry_dashboard(points(t), F.lit("2024-01-15 10:00:00").cast("timestamp"), PRIORITY)
    return board.select("key", "priority", "item", "date", F.unix_millis("created_at").alias("at_ms"), "value", "y_max",
                        F.round("percent", 6).alias("percent"))


@query("l09_telemetry_scales", """WITH s AS (SELECT event_type AS key, greatest(max(value - 20), 0) AS top FROM events GROUP BY 1), y AS (SELECT *, pow(10.0, ceil(log10(top))) AS ten FROM s),
    m AS (SELECT key, CASE WHEN ten / top >= 5 THEN ten / 5 WHEN ten / top >= 2 THEN ten / 2 ELSE ten END AS y_max FROM y)
    SELECT key, CASE key WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS priority, i::INT AS i, y_max * (10 - i) / 10 AS tick FROM m, range(11) AS r(i)""")
def _(t):
    return O.telemetry_scales(points(t), PRIORITY).select("key", "priority", F.posexplode("y_ticks").alias("i", "tick"))


@query("l10_timing_deviation", """WITH s AS (SELECT o_orderkey AS k, (o_orderkey % 4 + 2)::INT AS n FROM orders WHERE o_orderkey % 9 <> 0),
    l AS (SELECT k, n, list_transform(range(1, n + 1), lambda i: i + (k % 3) / 2) AS server,
      list_transform(range(1, n + 1), lambda i: CASE WHEN i = 1 THEN 2.5::DOUBLE + k % 11 WHEN i = 2 AND k % 2 = 0 THEN 0 ELSE i + 0.25::DOUBLE END) AS client FROM s),
    f AS (SELECT *, CASE WHEN k % 2 = 1 THEN 2 WHEN n > 2 THEN 3 ELSE n END AS first_load FROM l),
    late AS (SELECT *, client[first_load + 1:] AS late FROM f)
    SELECT k AS o_orderkey, round(sqrt(list_sum(list_transform(range(1, n + 1), lambda i: pow(client[i] - server[i], 2))) / n), 6) AS deviation,
      round(sqrt(coalesce(list_sum(list_transform(range(1, len(late) + 1), lambda i: pow(late[i] - server[n - len(late) + i], 2))), 0) / n), 6) AS deviation_after_load,
      client[1] AS initial_load, greatest(0.0, k % 5 - server[1])::DOUBLE AS socket_wait FROM late""")
def _(t):
    k = c("o_orderkey")
    n = (k % 4 + 2).cast("int")
    ids = F.sequence(F.lit(1), n)
    server = F.transform(ids, lambda i: (i + (k % 3) / 2).cast("string"))
    client = F.transform(ids, lambda i: F.when(i == 1, (2.5 + k % 11).cast("string")).when(
        (i == 2) & (k % 2 == 0), F.lit("0")).otherwise((i + 0.25).cast("string")))
    longer = F.when(k % 9 == 0, F.concat(client, F.array(F.lit("1")))).otherwise(client)
    rows = t.orders.select(k, F.array_join(server, ";").alias("server_times"), F.array_join(longer, ";").alias("client_times"),
                           n.alias("epoch"), (k % 5).cast("double").alias("socket_wait"))
    return O.timing_deviation(rows).select("o_orderkey", F.round("deviation", 6).alias("deviation"),
                                           F.round("deviation_after_load", 6).alias("deviation_after_load"), "initial_load", "socket_wait")


def progress_updates(events):
    kind, n = c("event_type"), F.floor("value").cast("long")
    none = F.lit(None)

    def boxed(value):
        return F.struct(value.alias("value"))

    return events.select(
        c("user_id").cast("long").alias("crawl_id"), c("event_id").alias("epoch"),
        F.when(kind == "view", boxed(F.lit(False))).when(kind != "click", boxed(F.lit(True))).alias("status"),
        F.when(kind == "purchase", boxed(n % 50)).when(kind != "click", boxed(none.cast("long"))).alias("remaining"),
        F.when(kind.isin("click", "purchase"), boxed(n)).when(kind == "signup", boxed(none.cast("long"))).alias("fetched"))


@query("l11_progress_regressions", """WITH u AS (SELECT user_id AS crawl_id, event_id AS epoch,
      CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN NULL ELSE 1 END AS status,
      CASE event_type WHEN 'purchase' THEN floor(value)::BIGINT % 50 WHEN 'click' THEN NULL ELSE -1 END AS remaining,
      CASE WHEN event_type IN ('click', 'purchase') THEN floor(value)::BIGINT WHEN event_type = 'signup' THEN -1 END AS fetched FROM events),
    w AS (SELECT *, last_value(status IGNORE NULLS) OVER x AS ps, nullif(last_value(remaining IGNORE NULLS) OVER x, -1) AS pr, nullif(last_value(fetched IGNORE NULLS) OVER x, -1) AS pf
      FROM u WINDOW x AS (PARTITION BY crawl_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT crawl_id, epoch, concat_ws(',', CASE WHEN ps = 1 AND status = 0 THEN 'postprocessing_reset' END,
      CASE WHEN pr IS NOT NULL AND (remaining = -1 OR remaining >= pr) THEN 'remaining_count_up' END,
      CASE WHEN pf IS NOT NULL AND (fetched = -1 OR fetched < pf) THEN 'fetched_count_down' END) AS regressions FROM w)
    SELECT crawl_id::BIGINT AS crawl_id, epoch, regressions FROM r WHERE regressions <> ''""")
def _(t):
    return O.progress_regressions(progress_updates(t.events)).select("crawl_id", "epoch", "regressions")


def mail(t):
    """Messages out of line items: the posts of an order are grouped by line number, so retries occur."""
    key = (c("l_orderkey") * 10 + c("l_linenumber")) * 10_000_000_000 + c("l_partkey") * 100_000 + c("l_suppkey")
    return t.lineitem.select(
        key.alias("message_id"), F.when(c("l_linenumber") % 3 == 0, "sub_final").otherwise("sub_post").alias("message_type"),
        c("l_orderkey").alias("subscription_id"), F.when(c("l_linenumber") % 3 != 0, c("l_linenumber") % 2).alias("subscription_post_id"),
        F.when(c("l_returnflag") == "A", "Transient").when(c("l_returnflag") == "N", "HardBounce").otherwise("AutoResponder").alias("bounce_type"),
        c("l_suppkey").alias("pick"))


def bounce_inputs(t):
    messages = mail(t)
    bounces = messages.where("pick % 3 = 0").select(c("message_id").alias("bounce_id"), "message_id", "bounce_type")
    subs = t.orders.select(c("o_orderkey").alias("subscription_id"), c("o_custkey").alias("user_id"))
    marked = t.customer.where("c_custkey % 4 = 0").select(c("c_custkey").alias("user_id"))
    return bounces, messages.drop("bounce_type", "pick"), subs, marked


MAIL_SQL = """mail AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 100000 + l_suppkey AS message_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'sub_final' ELSE 'sub_post' END AS message_type, l_orderkey AS subscription_id,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 2 END AS post_id,
  CASE l_returnflag WHEN 'A' THEN 'Transient' WHEN 'N' THEN 'HardBounce' ELSE 'AutoResponder' END AS bounce_type, l_suppkey AS pick FROM lineitem)"""


@query("l12_triage_bounces", f"""WITH {MAIL_SQL},
    a AS (SELECT *, count(*) OVER (PARTITION BY message_type, subscription_id, post_id) AS attempt_count FROM mail),
    b AS (SELECT a.*, o_custkey AS user_id, CASE WHEN bounce_type = 'Transient' THEN CASE attempt_count WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 40 WHEN 4 THEN 120 WHEN 5 THEN 180 WHEN 6 THEN 360 END END AS wait_minutes
      FROM a JOIN orders ON o_orderkey = subscription_id WHERE pick % 3 = 0),
    k AS (SELECT *, CASE WHEN bounce_type = 'AutoResponder' THEN 'noise' WHEN wait_minutes IS NOT NULL THEN 'retry' ELSE 'hard' END AS kind FROM b),
    f AS (SELECT user_id, min(message_id) AS first_id FROM k WHERE kind = 'hard' GROUP BY 1)
    SELECT message_id AS bounce_id, k.user_id, attempt_count, wait_minutes, CASE WHEN kind <> 'hard' THEN kind WHEN first_id = message_id AND k.user_id % 4 <> 0 THEN 'mark_user' ELSE 'already_marked' END AS action
    FROM k LEFT JOIN f USING (user_id)""")
def _(t):
    return M.triage_bounces(*bounce_inputs(t)).select("bounce_id", "user_id", "attempt_count", "wait_minutes", "action")


@query("l13_new_bounces", f"WITH {MAIL_SQL} SELECT message_id AS bounce_id, bounce_type FROM mail WHERE pick % 3 = 0 AND subscription_id % 2 = 0")
def _(t):
    bounces, messages, _subs, _marked = bounce_inputs(t)
    known = messages.where("subscription_id % 2 = 1").select(c("message_id").alias("bounce_id"))
    return M.new_bounces(bounces.unionByName(bounces), known).select("bounce_id", "bounce_type")


BATCH_SQL = """batch AS (SELECT o_custkey AS user_id, l_orderkey AS subscription_id, strftime(l_shipdate, '%Y-%m-%d') AS date, l_linenumber AS line
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_custkey % 4 <> 0)"""


def email_batch(t):
    posts = t.lineitem.select(
        c("l_orderkey").alias("subscription_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published_at_local_date"),
        F.when(c("l_returnflag") == "R", "email_pending").otherwise("email_sent").alias("publish_status"),
        F.when((c("l_linenumber") == 7) & (c("l_orderkey") % 2 == 0), 405).otherwise(0).alias("error_code"))
    _b, _m, subs, bounced = bounce_inputs(t)
    return M.email_batch(posts, subs, bounced)


@query("l14_pending_by_date", f"WITH {BATCH_SQL} SELECT user_id, date AS published_at_local_date, count(*) AS n FROM batch GROUP BY 1, 2")
def _(t):
    return M.pending_by_date(email_batch(t))


@query("l14_email_outcomes", f"""WITH {BATCH_SQL} SELECT user_id, count(*) FILTER (WHERE NOT (line = 7 AND subscription_id % 2 = 0)) AS n_sent,
    count(*) FILTER (WHERE line = 7 AND subscription_id % 2 = 0) AS n_unsent, count(*) FILTER (WHERE line = 7 AND subscription_id % 2 = 0) = 0 AS send_final_item FROM batch GROUP BY 1""")
def _(t):
    return M.email_outcomes(email_batch(t))


@query("l15_typed_url_stats", """SELECT o_orderpriority AS source, o_orderstatus AS result, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 12 = 1) AS n_stripped FROM orders GROUP BY 1, 2""")
def _(t):
    raw = F.concat(F.when(c("o_orderkey") % 12 == 1, " http://").otherwise("http://"), c("o_orderkey").cast("string"))
    log = t.orders.select(c("o_orderpriority").alias("source"), c("o_orderstatus").alias("result"), raw.alias("typed_url"), F.trim(raw).alias("stripped_url"))
    return O.typed_url_stats(log)
