"""Subscription and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import slug
from feedlake.operators import subscriptions as O
from feedlake.plans.registry import query
from feedlake.sources import adapters as A

WITH = f"WITH {A.SUBSCRIPTIONS_SQL}"


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_stamp(name):
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query("b22_title_slug", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\w+')[1:10] AS words FROM documents),
    n AS (SELECT doc_id, words, greatest(1, coalesce(len(list_filter(list_transform(range(1, len(words) + 1),
        lambda i: len(array_to_string(words[1:i], '-'))), lambda n: n <= 100)), 0)) AS k FROM w)
    SELECT doc_id, coalesce(left(array_to_string(words[1:k], '-'), 100), '') AS slug FROM n""")
def _(t):
    return t.documents.select("doc_id", slug(F.col("text")).alias("slug"))


@query("i01_active", f"{WITH} SELECT user_id, count(*) AS n FROM subs WHERE discarded_at IS NULL GROUP BY 1")
def _(t):
    return O.active(A.subscriptions(t.orders)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("i02_subscription_overview", f"""{WITH} SELECT id, user_id, name, status, is_paused, {sql_stamp('finished_setup_at')},
      published_count, total_count, CASE WHEN status <> 'live' THEN 'setting_up' WHEN published_count < total_count THEN 'active' ELSE 'finished' END AS section
    FROM subs LEFT JOIN counts ON id = subscription_id WHERE discarded_at IS NULL""")
def _(t):
    out = O.subscription_overview(A.subscriptions(t.orders), A.subscription_posts(t.lineitem))
    return out.select("id", "user_id", "name", "status", "is_paused", stamp("finished_setup_at"), "published_count", "total_count", "section")


BLOGS_SQL = "blogs AS (SELECT DISTINCT c_custkey % 100 AS id, 'https://b' || (c_custkey % 100) || '.example.com' AS url FROM customer)"


def blogs(t):
    return t.customer.select((F.col("c_custkey") % 100).alias("id")).distinct().withColumn(
        "url", F.concat(F.lit("https://b"), F.col("id").cast("string"), F.lit(".example.com")))


@query("i03_subscription_detail", f"""{WITH}, {BLOGS_SQL},
    live AS (SELECT * FROM subs WHERE discarded_at IS NULL)
    SELECT 'subscription' AS tag, l.id AS subscription_id, name, is_paused, status, url, coalesce(published_count, 0) AS published_count,
      coalesce(total_count, 0) AS total_count, NULL::VARCHAR AS day_of_week, NULL::INT AS count
    FROM live l LEFT JOIN counts c ON c.subscription_id = l.id LEFT JOIN blogs b ON b.id = l.blog_id
    UNION ALL SELECT 'schedule', subscription_id, NULL, NULL, NULL, NULL, NULL, NULL, day_of_week, count
    FROM schedules WHERE subscription_id IN (SELECT id FROM live)""")
def _(t):
    return O.subscription_detail(A.subscriptions(t.orders), A.subscription_posts(t.lineitem), A.schedules(t.orders), blogs(t))


@query("i04_names_by_day", f"""{WITH},
    current AS (SELECT user_id, max(id) AS current_id FROM subs GROUP BY 1),
    others AS (SELECT s.*, current_id FROM subs s JOIN current USING (user_id) JOIN counts c ON c.subscription_id = s.id
      WHERE status = 'live' AND discarded_at IS NULL AND published_count <> total_count AND s.id <> current_id)
    SELECT user_id, current_id, day_of_week, id, name, unnest(range(1, count + 1))::INT AS copy FROM others o JOIN schedules d ON d.subscription_id = o.id WHERE count > 0""")
def _(t):
    subs = A.subscriptions(t.orders)
    current = subs.groupBy("user_id").agg(F.max("id").alias("current_id"))
    return O.names_by_day(subs, A.subscription_posts(t.lineitem), A.schedules(t.orders), current).drop("created_at")


@query("i05_schedule_preview", f"""{WITH},
    p AS (SELECT *, 'prev' AS tag, row_number() OVER (PARTITION BY subscription_id ORDER BY index DESC, id DESC) AS rank FROM posts WHERE published_at IS NOT NULL
      UNION ALL SELECT *, 'next', row_number() OVER (PARTITION BY subscription_id ORDER BY index, id) FROM posts WHERE published_at IS NULL),
    s AS (SELECT p.*, CASE tag WHEN 'prev' THEN 2 ELSE 5 END AS lines,
      CASE tag WHEN 'prev' THEN published_count ELSE total_count - published_count END AS available FROM p JOIN counts USING (subscription_id))
    SELECT subscription_id, tag, rank::INT AS rank, url, title, published_at_local_date, available > lines AS has_more FROM s
    WHERE rank <= CASE WHEN available > lines THEN lines - 1 ELSE lines END""")
def _(t):
    return O.schedule_preview(A.subscription_posts(t.lineitem)).select(
        "subscription_id", "tag", "rank", "url", "title", "published_at_local_date", "has_more")


def picks(t):
    return t.orders.select(F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("category_id"), F.col("o_custkey").alias("blog_id"))


def assignments(t):
    # Fifty posts in a category, however many parts there are; all but every fifth are selected.
    return t.part.where("p_partkey % 5 <> 0").select(F.floor(F.col("p_partkey") / 50).cast("long").alias("category_id"), F.col("p_partkey").alias("blog_post_id"))


@query("i06_select_posts", """SELECT o_orderkey AS subscription_id, p_partkey AS blog_post_id,
    rtrim(replace(replace(base64(unhex(md5(o_orderkey || '/' || p_partkey))), '+', '-'), '/', '_'), '=') AS random_id
    FROM orders JOIN part ON p_partkey // 50 = o_custkey WHERE p_partkey % 5 <> 0""")
def _(t):
    return O.select_posts(picks(t).drop("blog_id"), assignments(t))


@query("i06_selection_share", """WITH totals AS (SELECT p_partkey // 50 AS blog_id, count(*) AS posts_count, count(*) FILTER (WHERE p_partkey % 5 <> 0) AS selected_count FROM part GROUP BY 1)
    SELECT o_orderkey AS subscription_id, selected_count, posts_count, round(selected_count / posts_count, 6) AS selected_fraction
    FROM orders JOIN totals ON blog_id = o_custkey WHERE selected_count > 0""")
def _(t):
    selected = O.select_posts(picks(t).drop("blog_id"), assignments(t))
    blog_posts = t.part.select(F.floor(F.col("p_partkey") / 50).cast("long").alias("blog_id"))
    return O.selection_share(selected, picks(t), blog_posts).select(
        "subscription_id", "selected_count", "posts_count", F.round("selected_fraction", 6).alias("selected_fraction"))


@query("i07_apply_versioned", """WITH u AS (SELECT user_id AS id, event_id AS seq, floor(value)::BIGINT AS version FROM events),
    r AS (SELECT *, greatest(coalesce(max(version) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), id % 9) AS known_version FROM u)
    SELECT id, seq, version, known_version, CASE WHEN version > known_version THEN 'applied' ELSE 'conflict' END AS outcome FROM r""")
def _(t):
    updates = t.events.select(F.col("user_id").cast("long").alias("id"), F.col("event_id").alias("seq"),
                              F.floor("value").cast("long").alias("version"))
    current = updates.select("id").distinct().withColumn("version", F.col("id") % 9)
    return O.apply_versioned(updates, current)


@query("i08_schedule_metrics", f"""{WITH} SELECT subscription_id, sum(count)::BIGINT AS weekly_count, count(*) FILTER (WHERE count > 0) AS active_days,
    round(sum(count) / nullif(count(*) FILTER (WHERE count > 0), 0), 6) AS posts_per_active_day FROM schedules GROUP BY 1""")
def _(t):
    return O.schedule_metrics(A.schedules(t.orders)).withColumn("posts_per_active_day", F.round("posts_per_active_day", 6))


@query("i09_first_delivery", f"""{WITH},
    s AS (SELECT o_orderkey AS subscription_id, o_orderdate::DATE + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS start FROM orders),
    d AS (SELECT subscription_id, start + unnest(range(7))::INT AS date FROM s),
    e AS (SELECT d.subscription_id, min(date) AS first_date, min_by(count, date) AS first_count FROM d JOIN schedules c
      ON c.subscription_id = d.subscription_id AND c.day_of_week = lower(strftime(date, '%a')) AND count > 0 GROUP BY 1)
    SELECT e.subscription_id, strftime(first_date, '%Y-%m-%d') AS first_date, CASE WHEN published_count = 1 THEN 'arrived_one' WHEN published_count > 1 THEN 'arrived_many'
      WHEN first_count = 1 THEN 'will_arrive_one' ELSE 'will_arrive_many' END AS message FROM e JOIN counts c ON c.subscription_id = e.subscription_id""")
def _(t):
    subs = t.orders.select(F.col("o_orderkey").alias("subscription_id"), F.to_date("o_orderdate").alias("local_date"),
                           (F.col("o_orderkey") % 2 == 0).alias("ran_today"))
    counted = subs.join(O.post_counts(A.subscription_posts(t.lineitem)), "subscription_id")
    out = O.first_delivery(counted, A.schedules(t.orders))
    return out.select("subscription_id", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), "message")


@query("i10_next_schedule_date", f"""{WITH},
    o AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS now, timezone,
      CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate - INTERVAL 5 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') END AS job_date
      FROM orders JOIN users ON user_id = o_custkey),
    l AS (SELECT *, timezone(timezone, timezone('UTC', now)) AS local FROM o)
    SELECT o_orderkey AS subscription_id, CASE WHEN job_date IS NULL THEN strftime(CASE WHEN hour(local) < 5 THEN local ELSE local + INTERVAL 1 DAY END, '%Y-%m-%d')
      WHEN job_date < strftime(local, '%Y-%m-%d') THEN strftime(local, '%Y-%m-%d') ELSE job_date END AS next_schedule_date FROM l""")
def _(t):
    k = F.col("o_orderkey")
    rows = t.orders.join(A.users(t.customer), F.col("o_custkey") == F.col("user_id")).select(
        k.alias("subscription_id"), "timezone", F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("o_orderdate")).alias("now"),
        F.when(k % 3 == 1, F.date_format(F.date_sub("o_orderdate", 5), "yyyy-MM-dd")).when(
            k % 3 == 2, F.date_format(F.date_add("o_orderdate", 5), "yyyy-MM-dd")).alias("job_date"))
    return O.next_schedule_date(rows, F.col("now")).select("subscription_id", "next_schedule_date")


@query("i11_resolve_timezones", """WITH c AS (SELECT c_custkey, c_custkey % 41 AS pick, (c_custkey % 41 - 20) * 60 + (c_custkey % 4) * 15 AS offset_minutes FROM customer),
    h AS (SELECT *, round(offset_minutes / 60.0)::INT AS hours FROM c)
    SELECT c_custkey, CASE WHEN pick = 7 THEN 'Europe/Berlin' WHEN pick = 8 THEN 'UTC' WHEN hours BETWEEN -14 AND 12
      THEN 'Etc/GMT' || CASE WHEN hours >= 0 THEN '+' ELSE '' END || hours ELSE 'UTC' END AS timezone FROM h""")
def _(t):
    pick = F.col("c_custkey") % 41
    rows = t.customer.select("c_custkey", F.when(pick == 7, "Europe/Berlin").when(pick == 8, "UTC").otherwise("Mars/Base").alias("timezone_in"),
                             ((pick - 20) * 60 + (F.col("c_custkey") % 4) * 15).alias("offset_minutes"))
    return O.resolve_timezones(rows).select("c_custkey", "timezone")


@query("i12_claim_anonymous", """SELECT o_orderkey AS subscription_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey WHEN c_custkey IS NOT NULL THEN c_custkey + 1000000 END AS user_id
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0""")
def _(t):
    subs = t.orders.select(F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("anon_id"),
                           F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("user_id"))
    logins = t.customer.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("anon_id"), (F.col("c_custkey") + 1_000_000).alias("login_user_id"))
    return O.claim_anonymous(subs, logins).select("subscription_id", "user_id")
