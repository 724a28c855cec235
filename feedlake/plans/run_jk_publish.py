"""Publishing-time and publishing-batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import publish as P
from feedlake.operators import timeplan as T
from feedlake.plans.registry import query
from feedlake.sources import adapters as A

WITH = f"WITH {A.SUBSCRIPTIONS_SQL}"
BASE = "https://reader.example.com"
NOW = "1999-06-15 12:00:00"
DATE = "1999-06-15"
HOUR_SQL = "CASE WHEN delivery_channel = 'email' THEN 5 ELSE 2 END"


def now():
    return F.lit(NOW).cast("timestamp")


def date():
    return F.lit(DATE).cast("date")


def order_users(t):
    return t.orders.join(A.users(t.customer), F.col("o_custkey") == F.col("user_id"))


def text(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# A skipped wall-clock time moves on by whole hours until it exists: at most one hour for these zones.
# Of two instants with the same wall-clock time the earlier one counts.
RUN_SQL = """(CASE WHEN timezone(timezone, timezone(timezone, {0}) - INTERVAL 1 HOUR) = {0} THEN timezone(timezone, {0}) - INTERVAL 1 HOUR
  WHEN timezone(timezone, timezone(timezone, {0})) = {0} THEN timezone(timezone, {0}) ELSE timezone(timezone, {0} + INTERVAL 1 HOUR) END)"""


def sql_run(local):
    return RUN_SQL.format(f"({local})")


@query("j01_local_to_utc", f"""{WITH} SELECT o_orderkey, strftime(timezone('UTC', {sql_run("o_orderdate + " + HOUR_SQL + " * INTERVAL 1 HOUR")}), '%Y-%m-%d %H:%M:%S') AS run_at
    FROM orders JOIN users ON user_id = o_custkey""")
def _(t):
    return T.local_runs(order_users(t), F.to_date("o_orderdate")).select("o_orderkey", text("run_at"))


def sql_first(start):
    """First of four days whose run is not before now."""
    runs = " ".join(
        f"WHEN {sql_run(f'{start} + INTERVAL {d} DAY + {HOUR_SQL} * INTERVAL 1 HOUR')} >= timezone('UTC', TIMESTAMP '{NOW}') THEN {d}"
        for d in range(4))
    return f"(CASE {runs} END)"


@query("j02_next_runs", f"""{WITH},
    j AS (SELECT o_orderkey, timezone, delivery_channel, o_orderdate::DATE + 1 AS start,
      greatest(o_orderdate::DATE + 1, timezone(timezone, timezone('UTC', TIMESTAMP '{NOW}'))::DATE - 1) AS begin FROM orders JOIN users ON user_id = o_custkey),
    n AS (SELECT *, begin + {sql_first('begin')} AS next_date FROM j)
    SELECT o_orderkey, strftime(next_date, '%Y-%m-%d') AS next_date, (next_date - start)::INT AS days_skipped,
      strftime(timezone('UTC', {sql_run("next_date + " + HOUR_SQL + " * INTERVAL 1 HOUR")}), '%Y-%m-%d %H:%M:%S') AS next_run FROM n""")
def _(t):
    jobs = order_users(t).withColumn("job_date", F.to_date("o_orderdate"))
    return T.next_runs(jobs, now()).select("o_orderkey", F.date_format("next_date", "yyyy-MM-dd").alias("next_date"),
                                           "days_skipped", text("next_run"))


@query("j03_initial_runs", f"""{WITH},
    n AS (SELECT *, DATE '1999-06-14' + {sql_first("DATE '1999-06-14'")} AS next_date FROM users)
    SELECT user_id, strftime(next_date, '%Y-%m-%d') AS next_date,
      strftime(timezone('UTC', {sql_run("next_date + " + HOUR_SQL + " * INTERVAL 1 HOUR")}), '%Y-%m-%d %H:%M:%S') AS next_run FROM n""")
def _(t):
    return T.initial_runs(A.users(t.customer), now()).select(
        "user_id", F.date_format("next_date", "yyyy-MM-dd").alias("next_date"), text("next_run"))


@query("j04_published_today", f"""{WITH} SELECT user_id, count(*) AS published_subscriptions FROM subs
    WHERE discarded_at IS NULL AND id IN (SELECT subscription_id FROM posts WHERE published_at_local_date = '{DATE}') GROUP BY 1""")
def _(t):
    return T.published_today(A.subscriptions(t.orders), A.subscription_posts(t.lineitem), F.lit(DATE))


@query("j05_due_jobs", f"""{WITH} SELECT o_orderkey FROM orders JOIN users ON user_id = o_custkey
    WHERE strftime(o_orderdate, '%Y-%m-%d') >= strftime(timezone(timezone, timezone('UTC', TIMESTAMP '{NOW}')), '%Y-%m-%d')""")
def _(t):
    jobs = order_users(t).withColumn("job_date_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return T.due_jobs(jobs, now()).select("o_orderkey")


@query("j06_job_log_facts", f"""WITH j AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS run_at, strftime(o_orderdate, '%Y-%m-%d') AS job_date FROM orders WHERE o_orderkey % 3 = 0)
    SELECT user_id, max_by(job_date, (run_at, id)) AS next_date, count(*) AS n_jobs, count(*) FILTER (WHERE run_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS n_stalled,
      count(*) > 1 AS is_double FROM j GROUP BY 1""")
def _(t):
    name = F.when(F.col("o_orderkey") % 3 == 0, "PublishJob").otherwise("OtherJob")
    handler = F.concat(
        F.lit("--- !ruby/object:Job\njob_data:\n  job_class: "), name, F.lit("\n  arguments:\n  - "), F.col("o_custkey").cast("string"),
        F.lit("\n  - '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("'\n  - '2000-01-01 00:00:00'\n"))
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("run_at"), handler.alias("handler"))
    return T.job_log_facts(jobs, "PublishJob", now())


@query("j07_row_count_alert", """WITH c AS (SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem)
    SELECT table_name, n, (sum(n) OVER ())::BIGINT AS total, sum(n) OVER () > 50000 AS over_limit FROM c""")
def _(t):
    return T.row_count_alert({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}, 50_000)


NEXT_SQL = f"""{A.SUBSCRIPTIONS_SQL},
new_posts AS (SELECT p.*, row_number() OVER (PARTITION BY p.subscription_id ORDER BY index, p.id) AS rank, s.count AS cnt FROM posts p
  JOIN subs u ON u.id = p.subscription_id JOIN schedules s ON s.subscription_id = p.subscription_id AND s.day_of_week = 'tue'
  WHERE status = 'live' AND discarded_at IS NULL AND NOT is_paused AND published_at IS NULL
  QUALIFY rank <= cnt),
left_counts AS (SELECT subscription_id, count(*) - count(published_at) AS n_left FROM posts GROUP BY 1),
new_counts AS (SELECT subscription_id, count(*) AS n_new FROM new_posts GROUP BY 1),
finals AS (SELECT u.id AS subscription_id, user_id FROM subs u LEFT JOIN left_counts l ON l.subscription_id = u.id LEFT JOIN new_counts n ON n.subscription_id = u.id
  WHERE status = 'live' AND discarded_at IS NULL AND final_item_published_at IS NULL AND coalesce(n_left, 0) = coalesce(n_new, 0))"""


def new_posts(t):
    return P.next_posts(A.subscriptions(t.orders), A.subscription_posts(t.lineitem), A.schedules(t.orders), date())


@query("k01_next_posts", f"""WITH {NEXT_SQL} SELECT subscription_id, id, rank, '{NOW}' AS published_at, '{DATE}' AS published_at_local_date FROM new_posts""")
def _(t):
    stamped = P.stamp_published(new_posts(t), now(), date())
    return stamped.select("subscription_id", "id", "rank", text("published_at"), "published_at_local_date")


@query("k02_initial_posts", f"""WITH {NEXT_SQL},
    early AS (SELECT user_id FROM users WHERE hour(timezone(timezone, timezone('UTC', TIMESTAMP '1999-06-15 18:00:00'))) < 5
      AND CASE WHEN user_id % 2 = 0 THEN '1999-06-17' ELSE '1999-06-14' END > strftime(timezone(timezone, timezone('UTC', TIMESTAMP '1999-06-15 18:00:00')), '%Y-%m-%d'))
    SELECT n.subscription_id, n.id FROM new_posts n JOIN subs u ON u.id = n.subscription_id WHERE user_id IN (SELECT user_id FROM early)""")
def _(t):
    users = A.users(t.customer).withColumn("job_date", F.when(F.col("user_id") % 2 == 0, "1999-06-17").otherwise("1999-06-14"))
    return P.initial_posts(A.subscriptions(t.orders), A.subscription_posts(t.lineitem), A.schedules(t.orders), users,
                           F.lit("1999-06-15 18:00:00").cast("timestamp"), date()).select("subscription_id", "id")


@query("k03_final_items", f"WITH {NEXT_SQL} SELECT subscription_id, user_id FROM finals")
def _(t):
    return P.final_items(A.subscriptions(t.orders), A.subscription_posts(t.lineitem), new_posts(t))


@query("k04_publish_status", f"""{WITH} SELECT user_id, delivery_channel, CASE delivery_channel WHEN 'email' THEN 'email_pending' ELSE 'rss_published' END AS publish_status FROM users""")
def _(t):
    return A.users(t.customer).select("user_id", "delivery_channel", P.publish_status(F.col("delivery_channel")).alias("publish_status"))


ITEMS_SQL = f"""{NEXT_SQL},
live AS (SELECT u.id AS subscription_id, u.user_id, name, finished_setup_at,
  CASE WHEN f.subscription_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE final_item_published_at END AS final_at, coalesce(n_new, 0) AS n_new,
  '{BASE}/subscriptions/' || u.id AS sub_url FROM subs u LEFT JOIN finals f ON f.subscription_id = u.id LEFT JOIN new_counts n ON n.subscription_id = u.id
  WHERE status = 'live' AND discarded_at IS NULL),
old AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY index DESC, id DESC) AS recency FROM posts WHERE published_at IS NOT NULL),
sent AS (SELECT l.*, 1 AS grp, n.index, n.id AS post_id, title, random_id, TIMESTAMP '{NOW}' AS pub_date FROM new_posts n JOIN live l USING (subscription_id)
  UNION ALL SELECT l.*, 2, o.index, o.id, title, random_id, published_at FROM old o JOIN live l USING (subscription_id)
  WHERE recency <= 30 - n_new - CASE WHEN final_at IS NULL THEN 0 ELSE 1 END),
sent_counts AS (SELECT subscription_id, count(*) AS n_posts FROM sent GROUP BY 1),
items AS (
  SELECT user_id, subscription_id, finished_setup_at, 0 AS grp, 0 AS index, 0 AS post_id, 'You''re all caught up with ' || name AS title, sub_url AS url,
    sha256(subscription_id || '-final') AS guid, '<a href="{BASE}/subscriptions/add">Want to read something else?</a>' AS description,
    '<a href="{BASE}/subscriptions/add">Want to read something else?</a>' AS user_description, final_at AS pub_date FROM live WHERE final_at IS NOT NULL
  UNION ALL SELECT user_id, subscription_id, finished_setup_at, grp, index, post_id, title,
    '{BASE}/posts/' || array_to_string(regexp_extract_all(lower(title), '\\w+'), '-') || '/' || random_id || '/', sha256(post_id::VARCHAR),
    '<a href="' || sub_url || '">Manage</a>', 'from ' || name || '<br><br><a href="' || sub_url || '">Manage</a>', pub_date FROM sent
  UNION ALL SELECT user_id, l.subscription_id, finished_setup_at, 3, 0, 0, name || ' added to Reader', sub_url, sha256(l.subscription_id || '-welcome'),
    '<a href="' || sub_url || '">Manage</a>', '<a href="' || sub_url || '">Manage</a>', finished_setup_at FROM live l LEFT JOIN sent_counts c ON c.subscription_id = l.subscription_id
    WHERE coalesce(n_posts, 0) + CASE WHEN final_at IS NULL THEN 0 ELSE 1 END < 30),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY grp, index DESC, post_id DESC) AS rank FROM items),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, finished_setup_at DESC, subscription_id DESC, rank) AS user_rank FROM ranked),
merged AS (SELECT * EXCLUDE (rank, user_rank), user_rank AS rank FROM numbered WHERE user_rank <= 30)"""


def items(t):
    subs, posts = A.subscriptions(t.orders), A.subscription_posts(t.lineitem)
    new = new_posts(t)
    finals = P.final_items(subs, posts, new).select(F.col("subscription_id").alias("id"), F.lit(True).alias("_final"))
    subs = subs.join(finals, "id", "left").withColumn(
        "final_item_published_at", F.when(F.col("_final"), now()).otherwise(F.col("final_item_published_at")))
    return P.subscription_items(subs, posts, new.drop("rank"), now(), BASE, "Reader")


ITEM_COLUMNS = ["subscription_id", "rank", "title", "url", "guid", "description"]
FEED_SQL = """E'\\n<?xml version="1.0" encoding="UTF-8"?>\\n<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/">\\n  <channel>\\n    <title>' || {title}
  || E'</title>\\n    <link>' || {url} || E'</link>\\n' || string_agg(
  E'    <item>\\n      <title>' || {esc_title} || E'</title>\\n      <link>' || url || E'</link>\\n      <guid isPermaLink="false">' || guid
  || E'</guid>\\n      <description>' || {esc_description} || E'</description>\\n      <pubDate>' || strftime(pub_date, '%a, %d %b %Y %H:%M:%S +0000') || E'</pubDate>\\n    </item>\\n', '' ORDER BY rank)
  || E'  </channel>\\n</rss>\\n'"""


def sql_escape(value):
    return f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("k05_subscription_items", f"""WITH {ITEMS_SQL} SELECT subscription_id, rank::INT AS rank, title, url, guid, description,
    strftime(pub_date, '%Y-%m-%d %H:%M:%S') AS pub_date FROM ranked""")
def _(t):
    return items(t).select(*ITEM_COLUMNS, text("pub_date"))


@query("k06_user_items", f"""WITH {ITEMS_SQL} SELECT user_id, subscription_id, rank::INT AS rank, title, url, guid, user_description AS description,
    strftime(pub_date, '%Y-%m-%d %H:%M:%S') AS pub_date FROM merged""")
def _(t):
    return P.user_items(items(t)).select("user_id", "subscription_id", "rank", "title", "url", "guid",
                                         F.col("user_description").alias("description"), text("pub_date"))


@query("k07_item_guid", "SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS guid, sha256(o_orderkey || '-final') AS final_guid, sha256(o_orderkey || '-welcome') AS welcome_guid FROM orders")
def _(t):
    k = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", P.item_guid(k).alias("guid"), P.item_guid(F.concat(k, F.lit("-final"))).alias("final_guid"),
                           P.item_guid(F.concat(k, F.lit("-welcome"))).alias("welcome_guid"))


@query("k08_post_link", f"""{WITH} SELECT id, '{BASE}/posts/' || array_to_string(regexp_extract_all(lower(title), '\\w+'), '-') || '/' || random_id || '/' AS url FROM posts""")
def _(t):
    return A.subscription_posts(t.lineitem).select("id", P.post_link(BASE, F.col("title"), F.col("random_id")).alias("url"))


@query("k09_render_subscription_feeds", f"""WITH {ITEMS_SQL}, named AS (SELECT r.*, s.name FROM ranked r JOIN subs s ON s.id = subscription_id)
    SELECT subscription_id, {FEED_SQL.format(title=sql_escape('any_value(name)') + " || ' · Reader'", url=f"'{BASE}/subscriptions/' || subscription_id",
                                             esc_title=sql_escape('title'), esc_description=sql_escape('description'))} AS body FROM named GROUP BY 1""")
def _(t):
    named = items(t).join(A.subscriptions(t.orders).select(F.col("id").alias("subscription_id"), "name"), "subscription_id")
    url = F.concat(F.lit(f"{BASE}/subscriptions/"), F.col("subscription_id").cast("string"))
    return P.render_feeds(named, "subscription_id", F.concat(F.col("name"), F.lit(" · Reader")), url, F.col("description"))


@query("k09_render_user_feeds", f"""WITH {ITEMS_SQL}
    SELECT user_id, {FEED_SQL.format(title="'Reader'", url=f"'{BASE}'", esc_title=sql_escape('title'), esc_description=sql_escape('user_description'))} AS body FROM merged GROUP BY 1""")
def _(t):
    return P.render_feeds(P.user_items(items(t)), "user_id", F.lit("Reader"), F.lit(BASE), F.col("user_description"))


@query("k10_missing_feeds", f"{WITH} SELECT id FROM subs WHERE id NOT IN (SELECT subscription_id FROM posts WHERE published_at IS NOT NULL)")
def _(t):
    feeds = A.subscription_posts(t.lineitem).where("published_at is not null").select(F.col("subscription_id").alias("id"))
    return P.missing_feeds(A.subscriptions(t.orders), feeds, "id")


@query("k11_publish_plan", f"""{WITH},
    live AS (SELECT id FROM subs WHERE status = 'live' AND discarded_at IS NULL AND NOT is_paused),
    cal AS (SELECT id, DATE '{DATE}' + d::INT AS date FROM live, range(7) AS r(d)),
    cum AS (SELECT c.id, date, sum(count) OVER (PARTITION BY c.id ORDER BY date) AS last, count FROM cal c JOIN schedules s ON s.subscription_id = c.id AND s.day_of_week = lower(strftime(date, '%a'))),
    waiting AS (SELECT subscription_id, id, row_number() OVER (PARTITION BY subscription_id ORDER BY index, id) AS rank FROM posts WHERE published_at IS NULL)
    SELECT w.subscription_id, w.id, rank::BIGINT AS rank, strftime(date, '%Y-%m-%d') AS date FROM waiting w JOIN cum c ON c.id = w.subscription_id AND rank <= last AND rank > last - count""")
def _(t):
    plan = P.publish_plan(A.subscriptions(t.orders), A.subscription_posts(t.lineitem), A.schedules(t.orders), date(), 7)
    return plan.select("subscription_id", "id", "rank", F.date_format("date", "yyyy-MM-dd").alias("date"))
