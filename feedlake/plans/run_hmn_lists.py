"""Blog version, evaluation, mining and reader queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.ordered import position_chunk, with_row_number
from feedlake.operators import blogs as H
from feedlake.operators import evaluate as M
from feedlake.operators import mining as N
from feedlake.plans.registry import query
from feedlake.sources import adapters as A
from feedlake.sources import lines as L
from feedlake.sources import responses as R
from feedlake.sources import tables as S

c = F.col


def text(col):
    return col.cast("string")


# Blogs: every sixth order is the current version of its customer's feed.
BLOGS_SQL = """blogs AS (SELECT o_orderkey AS id, 'https://c' || o_custkey || '.example.com/feed' AS feed_url,
  CASE WHEN o_orderkey % 6 = 0 THEN 1000000 ELSE (o_orderkey % 1000)::INT END AS version,
  ['crawl_failed', 'crawled_voting', 'update_from_feed_failed', 'crawled_confirmed', 'crawled_looks_wrong', 'crawl_in_progress', 'manually_inserted'][(o_orderkey % 7 + 1)::INT] AS status,
  ['recrawl', 'update_from_feed_or_fail', 'fail', 'no_op'][(o_orderkey % 4 + 1)::INT] AS update_action, o_orderdate AS status_updated_at FROM orders),
next AS (SELECT feed_url, coalesce(max(version) FILTER (WHERE version <> 1000000), 0) + 1 AS next_version FROM blogs GROUP BY 1)"""


def blogs(t):
    k = c("o_orderkey")
    statuses = F.array(*[F.lit(s) for s in ("crawl_failed", "crawled_voting", "update_from_feed_failed", "crawled_confirmed",
                                            "crawled_looks_wrong", "crawl_in_progress", "manually_inserted")])
    actions = F.array(*[F.lit(s) for s in ("recrawl", "update_from_feed_or_fail", "fail", "no_op")])
    return t.orders.select(
        k.alias("id"), F.concat(F.lit("https://c"), text(c("o_custkey")), F.lit(".example.com/feed")).alias("feed_url"),
        F.when(k % 6 == 0, H.LATEST_VERSION).otherwise((k % 1000).cast("int")).alias("version"),
        F.element_at(statuses, (k % 7 + 1).cast("int")).alias("status"),
        F.element_at(actions, (k % 4 + 1).cast("int")).alias("update_action"), c("o_orderdate").alias("status_updated_at"))


@query("h01_latest_blogs", f"WITH {BLOGS_SQL} SELECT id, feed_url, next_version FROM blogs JOIN next USING (feed_url) WHERE version = 1000000")
def _(t):
    b = blogs(t)
    return H.latest_blogs(b).join(H.next_version(b), "feed_url").select("id", "feed_url", "next_version")


@query("h02_reset_failed", f"""WITH {BLOGS_SQL} SELECT id, next_version + row_number() OVER (PARTITION BY feed_url ORDER BY id) - 1 AS new_version FROM blogs JOIN next USING (feed_url)
    WHERE version = 1000000 AND status IN ('crawl_failed', 'update_from_feed_failed', 'crawled_looks_wrong') AND status_updated_at < TIMESTAMP '2000-01-01'""")
def _(t):
    return H.reset_failed(blogs(t), F.lit("2000-01-01").cast("timestamp")).select("id", "new_version")


# Post lists: the parts of one size are the posts of a blog, newest first; categories come from type and brand.
LIST_SQL = """found AS (SELECT p_size AS blog_id, p_partkey AS key, 'https://b/' || p_partkey AS url, p_name AS title,
  row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS position FROM part),
cats AS (SELECT p_size AS blog_id, p_type AS category, p_type = 'ECONOMY' AS is_top, 1 AS category_position, p_partkey AS key FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_size, p_brand, false, 2, p_partkey FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_size, 'Unlisted', false, 0, -p_partkey - 1 FROM part)"""


def post_list(t):
    parts = t.part.select(c("p_size").alias("blog_id"), c("p_partkey").alias("key"), F.concat(F.lit("https://b/"), text(c("p_partkey"))).alias("url"),
                          c("p_name").alias("title"))
    ranked = with_row_number(parts, ["blog_id"], ["key"], "_n", position_chunk(c("key")))
    return ranked.withColumn("position", c("_n") - 1).drop("_n")


def list_categories(t):
    p = t.part

    def rows(df, name, top, position, key):
        return df.select(c("p_size").alias("blog_id"), name.alias("category"), top.alias("is_top"), F.lit(position).alias("category_position"), key.alias("key"))

    return (rows(p.where("p_partkey % 2 = 0"), c("p_type"), c("p_type") == "ECONOMY", 1, c("p_partkey"))
            .unionByName(rows(p.where("p_partkey % 3 = 0"), c("p_brand"), F.lit(False), 2, c("p_partkey")))
            .unionByName(rows(p, F.lit("Unlisted"), F.lit(False), 0, -c("p_partkey") - 1)))


@query("h03_blog_posts", f"WITH {LIST_SQL} SELECT blog_id, url, title, count(*) OVER (PARTITION BY blog_id) - 1 - position AS index FROM found")
def _(t):
    return H.blog_posts(post_list(t)).select("blog_id", "url", "title", "index")


@query("h03_blog_categories", f"""WITH {LIST_SQL},
    n AS (SELECT blog_id, category, min(category_position) AS cp, bool_or(is_top) AS is_top FROM cats JOIN found USING (blog_id, key) GROUP BY 1, 2
      UNION ALL SELECT DISTINCT blog_id, 'Everything', 99, true FROM found)
    SELECT blog_id, category, is_top, (row_number() OVER (PARTITION BY blog_id ORDER BY cp, category) - 1)::INT AS index FROM n""")
def _(t):
    return H.blog_categories(post_list(t), list_categories(t))


@query("h03_category_posts", f"""WITH {LIST_SQL} SELECT DISTINCT blog_id, category, key FROM cats JOIN found USING (blog_id, key) UNION ALL SELECT blog_id, 'Everything', key FROM found""")
def _(t):
    return H.category_posts(post_list(t), list_categories(t))


PLAN_SQL = f"""{BLOGS_SQL},
plan AS (SELECT id AS blog_id, CASE WHEN status IN ('crawl_in_progress', 'crawl_failed', 'crawled_looks_wrong') OR id % 3 = 0 THEN 'keep'
  WHEN update_action = 'recrawl' THEN 'recrawl' WHEN update_action = 'update_from_feed_or_fail' AND id % 3 = 1 THEN 'append'
  WHEN update_action IN ('update_from_feed_or_fail', 'fail') THEN 'mark_failed' ELSE 'keep' END AS decision, status FROM blogs)"""


def update_plan(t):
    outcomes = t.orders.select(c("o_orderkey").alias("blog_id"), F.when(c("o_orderkey") % 3 == 0, "no_new").when(
        c("o_orderkey") % 3 == 1, "new").otherwise("mismatch").alias("outcome"))
    return H.update_plan(blogs(t).withColumnRenamed("id", "blog_id"), outcomes)


@query("h04_update_plan", f"WITH {PLAN_SQL} SELECT blog_id, decision, CASE WHEN decision = 'mark_failed' THEN 'update_from_feed_failed' ELSE status END AS status FROM plan")
def _(t):
    return update_plan(t).select("blog_id", "decision", "status")


@query("h04_append_new_posts", f"""WITH {PLAN_SQL},
    tops AS (SELECT l_orderkey AS blog_id, max(l_linenumber) AS top FROM lineitem GROUP BY 1),
    fresh AS (SELECT o_orderkey AS blog_id, unnest(range(o_orderkey % 3 + 1)) AS position, o_orderkey % 3 + 1 AS n FROM orders)
    SELECT blog_id, top + n - position AS index, 'https://new/' || blog_id || '/' || position AS url FROM fresh JOIN plan USING (blog_id) JOIN tops USING (blog_id) WHERE decision = 'append'""")
def _(t):
    posts = t.lineitem.select(c("l_orderkey").alias("blog_id"), c("l_linenumber").alias("index"))
    fresh = t.orders.select(c("o_orderkey").alias("blog_id"), F.explode(F.sequence(F.lit(0).cast("long"), c("o_orderkey") % 3)).alias("position"))
    fresh = fresh.withColumns({"url": F.concat(F.lit("https://new/"), text(c("blog_id")), F.lit("/"), text(c("position"))), "title": F.lit("New")})
    return H.append_new_posts(update_plan(t), posts, fresh).select("blog_id", "index", "url")


def manual_lines(t):
    k = c("p_partkey")
    url = F.concat(F.when(k % 17 == 0, "ftp://b/").otherwise("https://b/"), text(k))
    line = F.concat(F.lit(" "), url, F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(" "), c("p_name"))))
    return t.part.select(c("p_size").alias("blog_id"), k.alias("line_no"), line.alias("line"))


@query("a05_parse_url_labels", """SELECT p_partkey AS line_no, CASE WHEN p_partkey % 17 = 0 THEN 'ftp://b/' ELSE 'https://b/' END || p_partkey AS url,
    CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS label, CASE WHEN p_partkey % 17 = 0 THEN 'no full url' WHEN p_partkey % 13 = 0 THEN 'no label' END AS reject FROM part""")
def _(t):
    return L.parse_url_labels(manual_lines(t)).select("line_no", "url", "label", "reject")


@query("h05_load_manual_posts", """SELECT p_size AS blog_id, 'https://b/' || p_partkey AS url, p_name AS label, count(*) OVER (PARTITION BY p_size) - row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS index
    FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0""")
def _(t):
    return H.load_manual_posts(manual_lines(t), newest_first=True).select("blog_id", "url", "label", "index")


def manual_categories(t):
    posts = H.load_manual_posts(manual_lines(t), newest_first=True)
    lines = t.part.where("p_partkey % 2 = 0").select(
        c("p_size").alias("blog_id"), c("p_partkey").alias("line_no"), F.concat(F.lit("https://b/"), text(c("p_partkey")), F.lit(" "), c("p_type")).alias("line"))
    tops = t.part.select(c("p_size").alias("blog_id"), F.lit("SMALL").alias("category"), F.lit(0).alias("position")).distinct()
    return H.load_manual_categories(posts, lines, tops)


MANUAL_SQL = """posts AS (SELECT p_size AS blog_id, p_partkey AS key FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0),
tagged AS (SELECT p_size AS blog_id, p_partkey AS key, p_type AS category FROM part WHERE p_partkey % 2 = 0)"""


@query("h05_load_manual_categories", f"""WITH {MANUAL_SQL},
    n AS (SELECT DISTINCT p_size AS blog_id, 'SMALL' AS category, 0 AS grp, 0 AS position FROM part
      UNION ALL SELECT blog_id, category, 1, min(key) FROM tagged JOIN posts USING (blog_id, key) WHERE category <> 'SMALL' GROUP BY 1, 2
      UNION ALL SELECT DISTINCT blog_id, 'Everything', 2, 0 FROM posts)
    SELECT blog_id, category, grp <> 1 AS is_top, (row_number() OVER (PARTITION BY blog_id ORDER BY grp, position, category) - 1)::INT AS index FROM n""")
def _(t):
    return manual_categories(t)[0]


@query("h05_unknown_categorized", f"""WITH {MANUAL_SQL} SELECT blog_id, 'https://b/' || key AS url, 'unknown categorized url' AS reject FROM tagged WHERE key NOT IN (SELECT key FROM posts)""")
def _(t):
    return manual_categories(t)[1].select("blog_id", "url", "reject")


@query("h06_category_overview", """WITH cats AS (SELECT p_size AS blog_id, p_size * 100 + p_brand_no AS category_id, p_brand_no AS index, p_brand_no % 5 = 0 AS is_top, p_partkey
      FROM (SELECT *, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS p_brand_no FROM part)),
    one AS (SELECT DISTINCT blog_id, category_id, index, is_top FROM cats), two AS (SELECT category_id, p_partkey FROM cats UNION ALL SELECT category_id + 1, p_partkey FROM cats WHERE index % 5 <> 4),
    first AS (SELECT blog_id, min_by(category_id, index) AS first_id FROM one WHERE is_top GROUP BY 1)
    SELECT o.category_id, CASE WHEN first_id IS NULL THEN 0 ELSE count(DISTINCT t.p_partkey) END AS post_count, count(DISTINCT f.p_partkey) AS checked_count
    FROM one o LEFT JOIN two t USING (category_id) LEFT JOIN first USING (blog_id) LEFT JOIN two f ON f.category_id = first_id AND f.p_partkey = t.p_partkey GROUP BY o.category_id, first_id""")
def _(t):
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    cats = t.part.select(c("p_size").alias("blog_id"), (c("p_size") * 100 + number).alias("category_id"), number.alias("index"),
                         (number % 5 == 0).alias("is_top"), c("p_partkey").alias("blog_post_id"))
    two = cats.select("category_id", "blog_post_id").unionByName(
        cats.where("index % 5 <> 4").select((c("category_id") + 1).alias("category_id"), "blog_post_id")).distinct()
    return H.category_overview(cats.drop("blog_post_id").distinct(), two).select("category_id", "post_count", "checked_count")


@query("h07_vote_counts", """SELECT o_custkey AS blog_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS confirmed, count(*) FILTER (WHERE o_orderstatus = 'O') AS looks_wrong FROM orders GROUP BY 1""")
def _(t):
    votes = t.orders.select(c("o_custkey").alias("blog_id"), F.when(c("o_orderstatus") == "F", "confirmed").when(
        c("o_orderstatus") == "O", "looks_wrong").alias("value"))
    return H.vote_counts(votes)


@query("h08_dependents", """WITH owners AS (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT 'subscriptions' AS table_name, o_custkey AS user_id, count(*) AS n FROM orders WHERE o_custkey IN (SELECT user_id FROM owners) GROUP BY 2
    UNION ALL SELECT 'subscription_posts', o_custkey, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT user_id FROM owners) GROUP BY 2""")
def _(t):
    owners = t.customer.where("c_mktsegment = 'MACHINERY'").select(c("c_custkey").alias("user_id"))
    subs = t.orders.select(c("o_orderkey").alias("subscription_id"), c("o_custkey").alias("user_id"))
    posts = t.lineitem.select(c("l_orderkey").alias("subscription_id")).join(subs, "subscription_id")
    return H.dependents(owners, "user_id", {"subscriptions": subs, "subscription_posts": posts})


# Mining.

TAILS = ["", ".", ",", "),", ")", ">", "(a)", "."]


def messages(t):
    k = c("conv_id") * 31 + c("turn")
    tail = F.element_at(F.array(*[F.lit(x) for x in TAILS]), (k % 8 + 1).cast("int"))
    link = F.concat(F.lit("https://h"), text(c("conv_id") % 7), F.lit(".example.com/p/"), text(c("conv_id") % 40), tail)
    more = F.concat(F.lit(" and https://github.com/x/"), text(c("turn")))
    return t.conversations.select(F.concat(text(c("conv_id")), F.lit("-"), text(c("turn"))).alias("message_id"), k.alias("k"),
                                  F.concat(c("text"), F.lit(" see "), link, more).alias("text"))


MESSAGES_SQL = """mined AS (SELECT conv_id || '-' || turn AS message_id, 'https://h' || (conv_id % 7) || '.example.com/p/' || (conv_id % 40)
    || CASE WHEN (conv_id * 31 + turn) % 8 = 6 THEN '(a)' ELSE '' END AS link FROM conversations
  UNION ALL SELECT conv_id || '-' || turn, 'https://github.com/x/' || turn FROM conversations)"""


@query("n01_message_links", f"WITH {MESSAGES_SQL} SELECT message_id, link FROM mined")
def _(t):
    return N.message_links(messages(t)).select("message_id", "link")


@query("n01_mine_links", f"WITH {MESSAGES_SQL} SELECT link, count(*) AS n, count(DISTINCT message_id) AS n_messages FROM mined GROUP BY 1")
def _(t):
    return N.mine_links(messages(t))


@query("n02_block_hosts", f"""WITH {MESSAGES_SQL}, l AS (SELECT link, regexp_extract(link, '^https?://([^/]*)', 1) AS host, count(*) AS n FROM mined GROUP BY 1, 2)
    SELECT host, count(*) AS n_links, sum(n)::BIGINT AS n_mentions FROM l WHERE host NOT IN (SELECT 'c' || c_custkey || '.example.com' FROM customer WHERE c_custkey % 3 = 0) AND host <> 'github.com' GROUP BY 1""")
def _(t):
    blocked = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), c("c_custkey").cast("string"), F.lit(".example.com")).alias("host"))
    blocked = blocked.unionByName(t.region.limit(1).select(F.lit("github.com").alias("host")))
    return N.links_by_host(N.block_hosts(N.mine_links(messages(t)), blocked))


RULE_LINES = ["https://f1.example.com/1*", "https://f2.example.com/2", "http://f3.example.com/3 -> https://renamed.example.com/3", "https://f5*"]


@query("n03_feed_stats", """WITH r AS (SELECT o_orderkey AS seq, 'l' || (o_orderkey % 500) AS link, 'm' || o_custkey AS message_id,
      CASE WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'https' END || '://f' || (o_custkey % 9) || '.example.com/' || (o_custkey % 20) AS feed_url FROM orders),
    s AS (SELECT regexp_replace(feed_url, '^https?://', '') AS feed_key, min_by(feed_url, seq) AS feed_url, count(DISTINCT message_id) AS n_messages, count(DISTINCT link) AS n_links, min(seq) AS first_seq FROM r GROUP BY 1)
    SELECT CASE WHEN feed_url = 'http://f3.example.com/3' THEN 'https://renamed.example.com/3' ELSE feed_url END AS feed_url, n_messages, n_links FROM s
    WHERE NOT starts_with(feed_url, 'https://f1.example.com/1') AND feed_url <> 'https://f2.example.com/2' AND NOT starts_with(feed_url, 'https://f5')""")
def _(t):
    rows = t.orders.select(
        c("o_orderkey").alias("seq"), F.concat(F.lit("l"), text(c("o_orderkey") % 500)).alias("link"), F.concat(F.lit("m"), text(c("o_custkey"))).alias("message_id"),
        F.concat(F.when(c("o_orderkey") % 2 == 0, "http").otherwise("https"), F.lit("://f"), text(c("o_custkey") % 9), F.lit(".example.com/"),
                 text(c("o_custkey") % 20)).alias("feed_url"))
    rules = L.parse_post_rules(t.spark.createDataFrame([(r,) for r in RULE_LINES], "line string"))
    return N.feed_stats(rows, rules).drop("first_seq")


@query("n04_merge_feed_lists", """WITH r AS (SELECT o_orderkey AS seq, o_orderkey AS u, o_custkey AS f, floor(o_totalprice)::BIGINT AS score FROM orders
      UNION ALL SELECT o_orderkey + 1000000000, o_orderkey, o_custkey, floor(o_totalprice)::BIGINT FROM orders WHERE o_orderkey % 3 = 0),
    own AS (SELECT f, min(seq) AS own_seq, min_by(u, seq) AS own_u FROM r GROUP BY 1)
    SELECT 'http://u' || any_value(own_u) AS url, 'http://f' || f || '.xml' AS feed_url, sum(score * 2)::BIGINT AS sum_score, (count(*) * 2)::BIGINT AS n
    FROM r JOIN own USING (f) WHERE NOT (u = own_u AND seq <> own_seq) GROUP BY f""")
def _(t):
    k = c("o_orderkey")

    def run(df, offset, scheme):
        return df.select((k + offset).alias("seq"), F.concat(F.lit(f"{scheme}://u"), text(k)).alias("url"),
                         F.concat(F.lit(f"{scheme}://f"), text(c("o_custkey")), F.lit(".xml")).alias("feed_url"))

    feeds = run(t.orders, 0, "http").unionByName(run(t.orders.where("o_orderkey % 3 = 0"), 1_000_000_000, "https"))
    base = t.orders.select(F.concat(F.lit("http://u"), text(k)).alias("url"), F.floor("o_totalprice").cast("long").alias("sum_score"), F.lit(1).cast("long").alias("n"))
    scores = base.unionByName(base.withColumn("url", F.replace("url", F.lit("http://"), F.lit("https://"))))
    return N.merge_feed_lists(feeds, scores).drop("seq")


@query("n05_remaining_work", """WITH r AS (SELECT o_orderkey AS row, 600000 - o_orderkey * 2 AS sum_score FROM orders)
    SELECT row, sum_score FROM r WHERE row < (SELECT coalesce(min(row), 1000000000) FROM r WHERE sum_score < 580000) AND row % 4 <> 0""")
def _(t):
    rows = t.orders.select(c("o_orderkey").alias("row"), (600000 - c("o_orderkey") * 2).alias("sum_score"))
    return N.remaining_work(rows, t.orders.where("o_orderkey % 4 = 0").select(c("o_orderkey").alias("row")), 580_000)


# Evaluation.

def results(t):
    """Found lists: the posts of an order, newest first."""
    url = F.concat(F.lit("b"), text(c("l_orderkey")), F.lit(".example.com/p/"), text(c("l_partkey")), F.lit("/"))
    entry = F.struct(c("l_linenumber"), c("l_partkey"), c("l_suppkey"), url.alias("url"), F.concat(F.lit("Post ‘"), text(c("l_partkey")), F.lit("’")).alias("title"))
    grouped = t.lineitem.groupBy(c("l_orderkey").alias("start_link_id")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    k = c("start_link_id")
    host = F.concat(F.lit("b"), text(k), F.lit(".example.com"))
    return grouped.select(k, F.element_at(F.array(F.lit("archives"), F.lit("paged_next")), (k % 2 + 1).cast("int")).alias("pattern"),
                          host.alias("blog_url"), F.concat(host, F.lit("/archive")).alias("main_url"),
                          c("e.url").alias("links"), c("e.title").alias("titles"))


def truth(t):
    k = c("start_link_id")
    r = results(t)
    plain = F.transform("links", lambda u: F.regexp_replace(F.concat(F.lit("www."), u), "/$", ""))
    changed = F.when(k % 10 == 0, F.concat(F.array(F.lit("other.example.com/x")), F.slice(plain, 2, F.size(plain)))).when(
        (k % 11 == 0) & (F.size(plain) > 1), F.slice(plain, 1, F.size(plain) - 1)).otherwise(plain)
    titles = F.transform("titles", lambda x: F.regexp_replace(x, "[‘’]", "'"))
    noted = F.when(k % 9 == 0, F.transform(titles, lambda x: F.concat(x, F.lit(" | Blog")))).when(
        (k % 11 == 0) & (F.size(titles) > 1), F.slice(titles, 1, F.size(titles) - 1)).when(k % 13 != 0, titles)
    return r.select(k, F.when(k % 7 == 0, "shuffled").otherwise(c("pattern")).alias("pattern"), "blog_url", F.when(
        k % 8 == 0, F.lit("x")).otherwise(c("main_url")).alias("main_url"), changed.alias("_l"), noted.alias("titles")).select(
        k, "pattern", "blog_url", "main_url", "titles", F.size("_l").alias("entries_count"), F.element_at("_l", -1).alias("oldest_url"),
        F.when(k % 12 != 5, c("_l")).alias("links"))


def truth_rules(t):
    host = F.concat(F.lit("b"), text(c("o_orderkey")), F.lit(".example.com"))
    return t.orders.select(c("o_orderkey").alias("start_link_id"), F.array(host, F.concat(F.lit("www."), host)).alias("same_hosts"),
                           F.lit(False).alias("expect_post_paths"))


SEEDS_SQL = """seeds AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
cmp AS (SELECT k AS start_link_id, n,
  CASE WHEN k % 7 = 0 THEN 'failure' ELSE 'success' END AS pattern_status,
  CASE WHEN k % 10 <> 0 AND k % 11 = 0 AND n > 1 THEN 'failure' WHEN k % 12 = 5 THEN 'neutral' WHEN k % 10 = 0 THEN 'failure' ELSE 'success' END AS count_status,
  CASE WHEN (k % 10 = 0 AND n = 1) OR (k % 10 <> 0 AND k % 11 = 0 AND n > 1) THEN 'failure' ELSE 'success' END AS oldest_status, k % 8 <> 0 AS main_url_matching FROM seeds),
verdict AS (SELECT *, pattern_status <> 'failure' AND count_status <> 'failure' AND oldest_status <> 'failure' AS links_matching FROM cmp)"""


def compared(t):
    return M.compare_to_truth(results(t), truth(t), truth_rules(t))


# A dropped last link may repeat the one before it, so the oldest link is looked up.
@query("m01_compare_to_truth", f"""WITH {SEEDS_SQL},
    ends AS (SELECT l_orderkey AS start_link_id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1)
    SELECT start_link_id, 'success' AS blog_url_status, pattern_status, count_status,
      CASE WHEN oldest_status = 'failure' AND n > 1 AND parts[-1] = parts[-2] THEN 'success' ELSE oldest_status END AS oldest_status, main_url_matching, links_matching FROM verdict JOIN ends USING (start_link_id)""")
def _(t):
    return compared(t).select("start_link_id", "blog_url_status", "pattern_status", "count_status", "oldest_status",
                              "main_url_matching", "links_matching")


@query("m02_compare_titles", """WITH s AS (SELECT l_orderkey AS k, count(*)::INT AS n FROM lineitem GROUP BY 1),
    x AS (SELECT k, n, k % 9 = 0 AS suffixed, k % 9 <> 0 AND k % 11 = 0 AND n > 1 AS cut, k % 9 <> 0 AND NOT (k % 11 = 0 AND n > 1) AND k % 13 = 0 AS unknown FROM s),
    d AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem GROUP BY 1)
    SELECT k AS start_link_id, CASE WHEN unknown THEN NULL WHEN suffixed THEN 0 WHEN cut THEN len(list_filter(p, lambda v: list_contains(p[:-2], v)))::INT ELSE n END AS n_exact,
      CASE WHEN unknown THEN NULL WHEN cut THEN len(list_filter(p, lambda v: list_contains(p[:-2], v)))::INT ELSE n END AS n_partial, CASE WHEN NOT unknown THEN CASE WHEN cut THEN n - 1 ELSE n END END AS n_truth,
      CASE WHEN unknown THEN 'neutral' WHEN suffixed OR cut THEN 'failure' ELSE 'success' END AS exact_status,
      CASE WHEN unknown THEN 'neutral' WHEN cut THEN 'failure' ELSE 'success' END AS partial_status FROM x JOIN d USING (k)""")
def _(t):
    return M.compare_titles(results(t), truth(t))


@query("m03_regressions", f"""WITH {SEEDS_SQL} SELECT start_link_id, CASE WHEN start_link_id % 3 <> 0 THEN 'neutral' WHEN links_matching THEN 'success' ELSE 'failure' END AS regression_status,
    links_matching AND start_link_id % 3 <> 0 AS save_success FROM verdict""")
def _(t):
    matching = compared(t).select("start_link_id", c("links_matching").alias("matching"))
    successes = t.orders.where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("start_link_id"))
    return M.regressions(matching, successes).drop("matching")


def cells(t):
    k = c("o_orderkey")
    entries = F.array(
        F.struct(F.lit("source").alias("column"), F.lit("neutral").alias("rule"), c("o_orderpriority").alias("value"), F.lit(None).cast("string").alias("manual_status")),
        F.struct(F.lit("feed_url").alias("column"), F.lit("neutral_present").alias("rule"), F.when(k % 5 != 0, c("o_orderstatus")).alias("value"), F.lit(None).cast("string").alias("manual_status")),
        F.struct(F.lit("links_found").alias("column"), F.lit("boolean").alias("rule"), (k % 3 != 0).cast("string").alias("value"), F.when(k % 9 == 0, "neutral").alias("manual_status")))
    return t.orders.select(k.alias("row_id"), F.inline(entries))


CELLS_SQL = """cells AS (SELECT o_orderkey AS row_id, 'source' AS col, 'neutral' AS status FROM orders
  UNION ALL SELECT o_orderkey, 'feed_url', CASE WHEN o_orderkey % 5 <> 0 THEN 'neutral' ELSE 'failure' END FROM orders
  UNION ALL SELECT o_orderkey, 'links_found', CASE WHEN o_orderkey % 9 = 0 THEN 'neutral' WHEN o_orderkey % 3 <> 0 THEN 'success' ELSE 'failure' END FROM orders),
verdicts AS (SELECT row_id, CASE WHEN bool_or(status = 'failure') THEN 'failure' ELSE 'success' END AS verdict FROM cells GROUP BY 1)"""


@query("m04_row_verdicts", f"WITH {CELLS_SQL} SELECT row_id, verdict FROM verdicts")
def _(t):
    return M.row_verdicts(cells(t))


@query("m05_report_summary", f"""WITH {CELLS_SQL} SELECT count(*) FILTER (WHERE verdict = 'success') AS n_success, count(*) FILTER (WHERE verdict = 'failure') AS n_failure, 0::BIGINT AS n_bad_failure,
    count(*) AS n_rows, count(*) FILTER (WHERE verdict = 'success') * 100 // count(*) AS success_percent FROM verdicts""")
def _(t):
    return M.report_summary(M.row_verdicts(cells(t)))


@query("m05_column_counters", f"""WITH {CELLS_SQL} SELECT col AS "column", count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = 'neutral') AS n_neutral,
    count(*) FILTER (WHERE status = 'failure') AS n_failure FROM cells GROUP BY 1 HAVING count(*) FILTER (WHERE status <> 'neutral') > 0""")
def _(t):
    return M.column_counters(cells(t))


@query("m05_report_order", f"""WITH {CELLS_SQL}, l AS (SELECT row_id, col, CASE status WHEN 'success' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS level FROM cells)
    SELECT row_id, max(level) FILTER (WHERE col = 'source')::INT AS source, max(level) FILTER (WHERE col = 'feed_url')::INT AS feed_url, max(level) FILTER (WHERE col = 'links_found')::INT AS links_found,
      CASE WHEN row_id % 4 = 0 THEN 'no feed' ELSE '' END AS error FROM l GROUP BY 1""")
def _(t):
    errors = t.orders.where("o_orderkey % 4 = 0").select(c("o_orderkey").alias("row_id"), F.lit("no feed").alias("error"))
    return M.report_order(cells(t), ["source", "feed_url", "links_found"], errors)


@query("m06_eligible_seeds", """SELECT o_orderkey AS start_link_id, CASE WHEN o_orderkey % 7 = 1 THEN 'fails' WHEN o_orderkey % 7 = 2 THEN 'javascript' END AS issue, o_orderkey % 7 = 1 AS fails_early
    FROM orders WHERE o_orderkey % 7 <> 0""")
def _(t):
    k = c("o_orderkey")
    severity = F.when(k % 7 == 0, "discard").when(k % 7 == 1, "fail").otherwise("warn")
    issues = t.orders.where(k % 7 <= 2).select(k.alias("start_link_id"), severity.alias("severity"), F.when(k % 7 == 1, "fails").otherwise("javascript").alias("issue"))
    return M.eligible_seeds(t.orders.select(k.alias("start_link_id")), issues)


def notes(t):
    """One notes file per customer: a good section with its order ids, then a bad section of five-line records."""
    k = c("o_orderkey")
    good = t.orders.where(k % 3 == 0).select(c("o_custkey").alias("file"), (k + 10).alias("line_no"), text(F.floor(k / 2)).alias("line"))
    bad = t.orders.where(k % 3 == 1).select(c("o_custkey").alias("file"), F.posexplode(F.array(
        text(k + 5_000_000), F.lit("archives"), F.lit("12"), F.lit("main"), F.when(k % 2 == 0, "oldest").otherwise(""))).alias("i", "line"), k)
    # Records start at multiples of ten, after all good lines.
    bad = bad.select("file", (k * 10 + c("i") + 2_000_000_000).alias("line_no"), "line")
    heads = t.customer.select(c("c_custkey").alias("file"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("Good").alias("line")), F.struct(F.lit(5).cast("long").alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(1_999_999_999).cast("long").alias("line_no"), F.lit("Bad").alias("line")))))
    return heads.unionByName(good.select("file", "line_no", "line")).unionByName(bad)


@query("m07_parse_review_notes", """WITH good AS (SELECT o_custkey AS file, o_orderkey AS ln, (o_orderkey // 2)::VARCHAR AS txt FROM orders WHERE o_orderkey % 3 = 0),
    bad AS (SELECT o_custkey AS file, o_orderkey * 10 + i AS ln, CASE i WHEN 0 THEN (o_orderkey + 5000000)::VARCHAR WHEN 1 THEN 'archives' WHEN 2 THEN '12' WHEN 3 THEN 'main' ELSE 'oldest' END AS txt
      FROM orders, range(5) AS r(i) WHERE o_orderkey % 3 = 1 AND NOT (i = 4 AND o_orderkey % 2 = 1)),
    numbered AS (SELECT file, 'good' AS section, row_number() OVER (PARTITION BY file ORDER BY ln) - 1 AS record, ln, txt, 1 AS width FROM good
      UNION ALL SELECT file, 'bad', (row_number() OVER (PARTITION BY file ORDER BY ln) - 1) // 5, ln, txt, 5 FROM bad)
    SELECT file, section, record, string_agg(txt, '|' ORDER BY ln) AS fields, count(*) = any_value(width) AS complete FROM numbered GROUP BY 1, 2, 3""")
def _(t):
    return M.parse_review_notes(notes(t)).select("file", "section", "record", F.array_join("fields", "|").alias("fields"), "complete")


@query("m07_plan_truth_updates", """WITH good AS (SELECT (o_orderkey // 2)::INT AS id FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT id AS start_link_id, count(*) AS n FROM good GROUP BY 1)
    SELECT start_link_id, 'good' AS section, CASE WHEN n > 1 THEN 'duplicate' WHEN start_link_id % 5 = 0 THEN 'exists' END AS problem FROM n""")
def _(t):
    records = M.parse_review_notes(notes(t)).where("section = 'good'")
    truth_ids = t.orders.where("o_orderkey % 5 = 0").select(c("o_orderkey").cast("int").alias("start_link_id"))
    return M.plan_truth_updates(records, truth_ids)


@query("m07_copy_good_results", """WITH good AS (SELECT (o_orderkey // 2)::INT AS id FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT id, count(*) AS n FROM good GROUP BY 1)
    SELECT o_orderkey AS start_link_id, o_custkey FROM orders JOIN n ON id = o_orderkey WHERE n = 1 AND id % 5 <> 0""")
def _(t):
    records = M.parse_review_notes(notes(t)).where("section = 'good'")
    truth_ids = t.orders.where("o_orderkey % 5 = 0").select(c("o_orderkey").cast("int").alias("start_link_id"))
    found = t.orders.select(c("o_orderkey").alias("start_link_id"), "o_custkey")
    return M.copy_good_results(M.plan_truth_updates(records, truth_ids), found)


@query("m08_orphan_pages", "SELECT l_orderkey AS start_link_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey % 3 <> 0 GROUP BY 1")
def _(t):
    pages = t.lineitem.select(c("l_orderkey").alias("start_link_id"), F.when(c("l_returnflag") != "N", c("l_linestatus")).alias("content"))
    return M.orphan_pages(pages, t.orders.where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("start_link_id")))


@query("m09_lost_seeds", "SELECT o_orderkey AS start_link_id, o_orderpriority AS pattern FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 <> 0")
def _(t):
    k = c("o_orderkey").alias("start_link_id")
    patterns = t.orders.select(k, c("o_orderpriority").alias("pattern"), c("o_orderstatus").alias("main_url"))
    return M.lost_seeds(t.orders.where("o_orderkey % 2 = 0").select(k), patterns, t.orders.where("o_orderkey % 3 = 0").select(k),
                        ["1-URGENT", "2-HIGH"]).select("start_link_id", "pattern")


# Readers and sinks.

@query("a01_conform_tables", f"""WITH {A.SUBSCRIPTIONS_SQL} SELECT id, subscription_id, blog_post_id, random_id, strftime(published_at, '%Y-%m-%d') AS published_at, published_at_local_date, NULL::VARCHAR AS publish_status FROM posts""")
def _(t):
    rows = S.conform(A.subscription_posts(t.lineitem), "subscription_posts")
    return rows.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd"))


@query("a02_decode_responses", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'status' WHEN 4 THEN 'charset' WHEN 5 THEN 'media_type' END AS reject,
    CASE page_id % 6 WHEN 1 THEN 'UTF-8' WHEN 2 THEN 'UTF-16' WHEN 3 THEN 'UTF-8' WHEN 4 THEN 'KLINGON' ELSE 'UTF-8' END AS charset,
    CASE WHEN page_id % 6 IN (1, 2) THEN 'page' WHEN page_id % 6 = 3 THEN 'feed' END AS kind, CASE WHEN page_id % 6 IN (1, 2) THEN md5(html) END AS content_md5 FROM pages""")
def _(t):
    pick = c("page_id") % 6
    content_type = F.when(pick == 1, "text/html; charset=utf8").when(pick == 2, "text/html;charset=UTF-16").when(
        pick == 3, "application/xml").when(pick == 4, "text/html; charset=klingon").when(pick == 5, "image/png").otherwise("text/html")
    body = F.when(pick == 2, F.encode("html", "UTF-16")).when(pick == 3, F.encode(F.concat(
        F.lit('<?xml version="1.0"?>\n<rss version="2.0"><channel><title>'), text(c("page_id")), F.lit("</title></channel></rss>")), "UTF-8")).otherwise(F.encode("html", "UTF-8"))
    raw = t.pages.select("page_id", c("page_id").alias("start_link_id"), c("url").alias("fetch_url"), F.when(pick == 0, "404").otherwise("200").alias("code"),
                         content_type.alias("content_type"), body.alias("body"))
    return R.decode_responses(raw).select("page_id", "reject", "charset", "kind", F.when(c("kind") == "page", F.md5("content")).alias("content_md5"))


@query("a03_prefer_rendered", "SELECT page_id, page_id % 3 = 0 AS is_rendered, CASE WHEN page_id % 3 = 0 THEN md5(html || '<!-- rendered -->') ELSE md5(html) END AS content_md5 FROM pages")
def _(t):
    pages = t.pages.select("page_id", c("page_id").alias("start_link_id"), c("url").alias("fetch_url"), c("html").alias("content"))
    rendered = pages.where("page_id % 3 = 0").select("start_link_id", "fetch_url", F.concat("content", F.lit("<!-- rendered -->")).alias("body"))
    return R.prefer_rendered(pages, rendered).select("page_id", "is_rendered", F.md5("content").alias("content_md5"))


@query("a04_parse_seed_lines", """SELECT source, url, comment FROM (
      SELECT 'semicolon' AS source, 'https://s' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS comment FROM customer
      UNION ALL SELECT 'dashes', 'http://d' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END FROM customer WHERE c_custkey < 100 AND c_custkey % 3 <> 0
      UNION ALL SELECT 'plain', 'http://p' || c_custkey, NULL FROM customer WHERE c_custkey < 120)
    UNION ALL SELECT 'kept', 'https://k' || c_custkey, NULL FROM customer""")
def _(t):
    k = c("c_custkey")
    semi = t.customer.select(F.lit("semicolon").alias("source"), k.alias("line_no"), F.concat(F.lit("https://s"), text(k), F.lit(";"), F.when(
        k % 2 == 0, c("c_mktsegment")).otherwise("")).alias("line"))
    dashes = t.customer.select(F.lit("dashes").alias("source"), k.alias("line_no"), F.when(k == 100, " ").when(k % 3 == 0, "# note").otherwise(F.concat(
        F.lit("http://d"), text(k), F.when(k % 2 == 0, F.concat(F.lit(" -- "), c("c_name"))).otherwise(""))).alias("line"))
    plain = t.customer.select(F.lit("plain").alias("source"), k.alias("line_no"), F.when(k == 120, "").otherwise(F.concat(F.lit("http://p"), text(k))).alias("line"))
    fresh = L.parse_seed_lines(semi, "semicolon").unionByName(L.parse_seed_lines(dashes, "dashes")).unionByName(L.parse_seed_lines(plain, "plain"))
    stored = t.customer.select(F.explode(F.array(F.lit("kept"), F.lit("plain"))).alias("source"), F.concat(F.lit("https://k"), text(k)).alias("url"),
                               F.lit(None).cast("string").alias("comment"))
    return L.replace_source(stored, fresh)


@query("a06_parse_feed_rows", """SELECT 'l' || o_orderkey AS link, o_custkey AS n, o_orderkey || ',' || o_custkey AS message_ids, 'f' || o_orderkey AS feeds FROM orders""")
def _(t):
    k = text(c("o_orderkey"))
    line = F.concat_ws("\t", F.concat(F.lit("l"), k), text(c("o_custkey")), F.concat(F.lit("["), k, F.lit(","), text(c("o_custkey")), F.lit("]")),
                       F.lit("url"), F.concat(F.lit("f"), k))
    rows = L.parse_feed_rows(t.orders.select(line.alias("line")))
    return rows.select("link", "n", F.array_join("message_ids", ",").alias("message_ids"), F.array_join("feeds", ",").alias("feeds"))


@query("a07_export_link_dataset", """WITH h AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT '{"fetch_url":"' || url || '","url":"' || href || '"}' AS value FROM h""")
def _(t):
    links = A.page_hrefs(t.pages).select(c("page_url").alias("fetch_url"), c("href").alias("url"))
    return R.link_dataset(links)


@query("a08_split_feed_csv", """SELECT 'https://u/' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN ',x' ELSE '' END AS url, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS rejected FROM orders""")
def _(t):
    k = c("o_orderkey")
    df = t.orders.select(F.concat(F.lit("https://u/"), text(k), F.when(k % 5 == 0, ",x").otherwise("")).alias("url"),
                         F.concat(F.lit("https://f/"), text(k), F.when(k % 7 == 0, ",y").otherwise("")).alias("feed_url"))
    good, bad = R.split_feed_csv(df)
    return good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True))).select("url", "rejected")


@query("a09_upsert_feeds", "SELECT o_orderkey AS subscription_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS body FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def _(t):
    k = c("o_orderkey").alias("subscription_id")
    stored = t.orders.where("o_orderkey % 2 = 0").select(k, F.lit("old").alias("body"))
    return R.upsert_by_key(stored, t.orders.where("o_orderkey % 3 = 0").select(k, F.lit("new").alias("body")), "subscription_id")


@query("a10_classify_feed_status", """WITH r AS (SELECT o_custkey AS page, 'https://r/' || o_orderkey AS rss_url, (o_orderkey % 20)::INT AS posts_count, CASE WHEN o_orderkey % 3 = 0 THEN 'Gone' ELSE 'Active' END AS status FROM orders)
    SELECT rss_url, posts_count, CASE WHEN posts_count < 10 AND status <> 'Active' THEN posts_count || ' posts, Gone' WHEN posts_count < 10 THEN posts_count || ' posts' WHEN status <> 'Active' THEN 'Gone' END AS comment FROM r""")
def _(t):
    row = F.concat(F.lit('<tr><td><a href="https://r/'), text(c("o_orderkey")), F.lit('">feed</a> <span>('), text(c("o_orderkey") % 20),
                   F.lit(" posts)</span></td><td><span>"), F.when(c("o_orderkey") % 3 == 0, "Gone").otherwise("Active"), F.lit("</span></td></tr>"))
    # One small scraped table per customer.
    pages = t.orders.select("o_custkey", "o_orderkey", F.concat(F.lit("<table>"), row, F.lit("</table>")).alias("html"))
    return R.classify_feed_status(R.membership_rows(pages)).select("rss_url", "posts_count", "comment")
