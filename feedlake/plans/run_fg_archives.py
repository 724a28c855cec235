"""Position-mask and archive queries over pages that Spark renders from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.ordered import position_chunk, with_row_number
from feedlake.operators import archives as G
from feedlake.operators import masks as M
from feedlake.operators import pages as P
from feedlake.plans.registry import query
from feedlake.plans.run_c_feeds import ENTRIES_SQL, candidates, entries
from feedlake.plans.run_l_events import c
from feedlake.session import checkpointed, checkpointed_pages, deal, discard
from feedlake.sources.adapters import order_urls, page_hrefs


def text(col):
    return col.cast("string")


def post_lines(t):
    """Posts of a blog: the lines of an order, numbered from 1."""
    rows = t.lineitem.select(c("l_orderkey").alias("page_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return checkpointed_pages(with_row_number(deal(rows, "page_id"), ["page_id"], ["l_linenumber", "l_partkey", "l_suppkey"], "i", position_chunk(c("l_linenumber"))).select(
        "page_id", "i", "l_shipdate"))


def rendered_pages(lines):
    """One archive page per order: navigation, then a list of dated posts; even pages group them into sections of three."""
    item = F.concat(
        F.lit('<li class="item post-'), text(c("i")), F.lit('"><a href="/p/'), text(c("page_id")), F.lit("-"), text(c("i")), F.lit('">Post '), text(c("i")),
        F.lit('</a> <time datetime="'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('">on</time></li>'))
    even = c("page_id") % 2 == 0
    opened = F.when(even & ((c("i") - 1) % 3 == 0), F.when(c("i") > 1, "</ul></section><section><ul>").otherwise("<section><ul>")).otherwise(
        F.when(c("i") == 1, "<section><ul>").otherwise(""))
    body = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(opened, item).alias("h")))).alias("_h"))
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>Archive</title></head><body><nav><a href="/about">About</a><a href="/archive">Archive</a></nav><main class="list b a">'),
        F.array_join(F.transform("_h", lambda s: s["h"]), ""), F.lit("</ul></section></main></body></html>"))
    return body.select("page_id", F.concat(F.lit("https://b"), text(c("page_id")), F.lit(".example.com/archive")).alias("url"), html.alias("html"))


def page_entries(lines):
    """The feed: the first five posts in page order for odd pages, in reverse for every third page; dated by position."""
    short = lines.where("i <= 5")
    key = F.concat(F.lit("b"), text(c("page_id")), F.lit(".example.com//p/"), text(c("page_id")), F.lit("-"), text(c("i")), F.lit("?"))
    sizes = short.groupBy("page_id").agg(F.count("*").alias("_n"))
    pos = F.when(c("page_id") % 3 == 0, c("_n") - c("i")).otherwise(c("i") - 1)
    return short.join(sizes, "page_id").select("page_id", pos.alias("pos"), pos.alias("bucket"), key.alias("key"),
                                                F.concat(F.lit("post "), text(c("i"))).alias("title"))


#: What masks are made of; queries that need more of a link name it.
PLACED = ["page_id", "pos", "xpath", "class_xpath", "key"]


def flagged(found, feed):
    """Links that are stored by page as ``found``, stored with what the feed says of them in its place."""
    links = checkpointed_pages(M.flag_feed_links(found, feed))
    discard(found)
    return links


def mined(t, *more):
    """Feed, links and all nodes of the pages."""
    lines = post_lines(t)
    nodes = checkpointed_pages(P.nodes(rendered_pages(lines)), dealt=True)
    feed = page_entries(lines)
    return nodes, feed, flagged(checkpointed_pages(P.links_of_nodes(nodes).select(*PLACED, *more), dealt=True), feed)


def mined_links(t, *more):
    """Feed and links of the pages: other nodes are neither stored nor handed on."""
    lines = post_lines(t)
    found = checkpointed_pages(P.links_of_nodes(P.link_nodes(rendered_pages(lines))).select(*PLACED, *more), dealt=True)
    feed = page_entries(lines)
    return feed, flagged(found, feed)


# Posts in SQL; the section of a post and its place there give its position.
PAGES_SQL = """posts AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_shipdate FROM lineitem),
placed AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, i <= 5 AS is_feed, CASE WHEN page_id % 2 = 0 THEN (i - 1) // 3 + 1 ELSE 1 END AS s, CASE WHEN page_id % 2 = 0 THEN (i - 1) % 3 + 1 ELSE i END AS j FROM posts),
li AS (SELECT page_id, s, '/html[1]/body[1]/main[1]/section[' || s || ']/ul[1]/li[*]/a[1]' AS mask, count(*) AS n_links FROM placed GROUP BY 1, 2 HAVING count(*) > 1 AND bool_or(is_feed)),
sec AS (SELECT page_id, j, '/html[1]/body[1]/main[1]/section[*]/ul[1]/li[' || j || ']/a[1]' AS mask, count(*) AS n_links FROM placed GROUP BY 1, 2 HAVING count(*) > 1 AND bool_or(is_feed)),
one AS (SELECT page_id, mask, n_links FROM li UNION ALL SELECT page_id, mask, n_links FROM sec),
two AS (SELECT page_id, any_value(n) AS n_links FROM placed GROUP BY 1 HAVING max(s) > 1)"""


@query("f01_mask_groups", f"WITH {PAGES_SQL} SELECT page_id, mask, n_links FROM one")
def _(t):
    return M.mask_groups(mined_links(t)[1], 1).groupBy("page_id", "mask").agg(F.count("*").alias("n_links"))


@query("f01_mask_groups_two_stars", f"""WITH {PAGES_SQL} SELECT page_id, '/html()[1]/body()[1]/main(a,b,list)[1]/section()[*]/ul()[1]/li(item)[*]/a()[1]' AS mask, n_links FROM two""")
def _(t):
    return M.mask_groups(mined_links(t)[1], 2).groupBy("page_id", "mask").agg(F.count("*").alias("n_links"))


@query("f02_order_masks", f"""WITH {PAGES_SQL}, m AS (SELECT p.page_id, mask, count(*) AS n_links, count(*) FILTER (WHERE is_feed) AS n_own, min(i) AS first FROM placed p JOIN li ON li.page_id = p.page_id AND li.s = p.s GROUP BY ALL
      UNION ALL SELECT p.page_id, mask, count(*), count(*) FILTER (WHERE is_feed), min(i) FROM placed p JOIN sec ON sec.page_id = p.page_id AND sec.j = p.j GROUP BY ALL)
    SELECT page_id, mask, n_links, n_own, row_number() OVER (PARTITION BY page_id ORDER BY n_own DESC, first, mask)::INT AS mask_rank FROM m""")
def _(t):
    return M.order_masks(M.mask_groups(mined_links(t, "text")[1], 1)).select("page_id", "mask", "n_links", "n_own", "mask_rank")


@query("f03_infer_title_position", f"WITH {PAGES_SQL} SELECT page_id, mask, 'self' AS kind FROM one")
def _(t):
    nodes, _feed, links = mined(t, "text")
    return M.infer_title_position(checkpointed_pages(M.mask_groups(links, 1)), nodes).select("page_id", "mask", "kind")


@query("f04_apply_title_position", f"""WITH {PAGES_SQL} SELECT p.page_id, mask, 'Post ' || i AS title FROM placed p JOIN li ON li.page_id = p.page_id AND li.s = p.s
    UNION ALL SELECT p.page_id, mask, 'Post ' || i FROM placed p JOIN sec ON sec.page_id = p.page_id AND sec.j = p.j""")
def _(t):
    nodes, _feed, links = mined(t, "text")
    groups = checkpointed_pages(M.mask_groups(links, 1))
    return M.apply_title_position(groups, M.infer_title_position(groups, nodes), nodes).select("page_id", "mask", "title")


@query("f05_collapse_runs", """WITH b AS (SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey % 3 AS key,
      CASE WHEN l_linenumber % 4 <> 0 THEN 't' || l_linenumber END AS title, l_linestatus AS source FROM lineitem),
    s AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY group_id ORDER BY pos) = key THEN 0 ELSE 1 END AS st FROM b), r AS (SELECT *, sum(st) OVER (PARTITION BY group_id ORDER BY pos) AS run FROM s)
    SELECT group_id, min(pos) AS pos, any_value(key) AS key, count(*) AS n_merged, string_agg(title, '' ORDER BY pos) AS title,
      CASE WHEN min(source) FILTER (WHERE title IS NOT NULL) = max(source) FILTER (WHERE title IS NOT NULL) THEN min(source) FILTER (WHERE title IS NOT NULL) WHEN count(title) > 0 THEN 'collapsed' END AS source FROM r GROUP BY group_id, run""")
def _(t):
    rows = t.lineitem.select(c("l_orderkey").alias("group_id"), "l_linenumber", "l_partkey", "l_suppkey", (c("l_partkey") % 3).alias("key"),
                             F.when(c("l_linenumber") % 4 != 0, F.concat(F.lit("t"), text(c("l_linenumber")))).alias("title"), c("l_linestatus").alias("source"))
    ranked = checkpointed(with_row_number(rows, ["group_id"], ["l_linenumber", "l_partkey", "l_suppkey"], "_n", position_chunk(c("l_linenumber"))))
    return M.collapse_runs(ranked.withColumn("pos", c("_n") - 1).drop("_n"))


@query("f06_infer_date_position", f"WITH {PAGES_SQL} SELECT page_id, mask, '/time[1]' AS rel, 'time' AS source FROM li UNION ALL SELECT page_id, mask, '/ul[1]/li[' || j || ']/time[1]', 'time' FROM sec s WHERE (SELECT count(DISTINCT q.j) FROM placed q WHERE q.page_id = s.page_id AND q.s IN (SELECT r.s FROM placed r WHERE r.page_id = s.page_id AND r.j = s.j AND r.is_feed) AND (SELECT count(*) FROM placed x WHERE x.page_id = s.page_id AND x.j = q.j AND x.s IN (SELECT r.s FROM placed r WHERE r.page_id = s.page_id AND r.j = s.j AND r.is_feed)) = (SELECT count(*) FROM placed r WHERE r.page_id = s.page_id AND r.j = s.j AND r.is_feed)) = 1")
def _(t):
    nodes, _feed, links = mined(t)
    return M.infer_date_position(checkpointed_pages(M.mask_groups(links, 1)), checkpointed_pages(P.dated_nodes(nodes)))


@query("f07_assign_markup_dates", f"WITH {PAGES_SQL} SELECT p.page_id, mask, i, strftime(l_shipdate, '%Y-%m-%d') AS date FROM placed p JOIN li ON li.page_id = p.page_id AND li.s = p.s")
def _(t):
    nodes, _feed, links = mined(t, "link_url")
    groups = checkpointed_pages(M.mask_groups(links, 1).where("mask like '%li[*]%'"))
    dates = checkpointed_pages(P.dated_nodes(nodes))
    dated = M.assign_markup_dates(groups, M.infer_date_position(groups, dates), dates)
    return dated.select("page_id", "mask", F.regexp_extract("link_url", r"-(\d+)$", 1).cast("long").alias("i"), F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("f08_post_categories", """WITH l AS (SELECT p_size AS blog_id, p_partkey AS key, p_partkey AS pos, CASE WHEN p_partkey % 5 = 0 THEN 'Uncategorized' WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END AS name FROM part)
    SELECT blog_id, min_by(name, pos) AS category, count(DISTINCT key) AS n_posts FROM l GROUP BY blog_id, lower(name)""")
def _(t):
    links = t.part.select(c("p_size").alias("blog_id"), c("p_partkey").alias("key"), c("p_partkey").alias("pos"), F.when(c("p_partkey") % 5 == 0, F.lit(None)).when(
        c("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(c("p_type")).alias("name"))
    return M.post_categories(links)


@query("g00_archive_gate", """WITH f AS (SELECT l_orderkey AS page_id, count(DISTINCT l_partkey) AS n_entries, count(DISTINCT l_partkey) FILTER (WHERE l_partkey % 4 <> 0) AS n_included FROM lineitem GROUP BY 1),
    g AS (SELECT *, CASE WHEN n_entries <= 3 THEN n_entries WHEN n_entries <= 7 THEN n_entries - 1 WHEN n_entries <= 25 THEN n_entries - 2 WHEN n_entries <= 62 THEN n_entries - 3 ELSE n_entries - 7 END AS threshold FROM f)
    SELECT page_id, n_entries, n_included, threshold FROM g WHERE n_included >= threshold""")
def _(t):
    feed = t.lineitem.select(c("l_orderkey").alias("page_id"), c("l_partkey").alias("key")).distinct()
    return G.archive_gate(feed.where("key % 4 <> 0"), feed)


def dated_groups(t):
    feed, links = mined_links(t, U.path_date(c("parts.path")).alias("url_date"))
    groups = checkpointed_pages(M.mask_groups(links, 1).unionByName(M.mask_groups(links, 2)).select(
        "page_id", "mask", "stars", "pos", "key", "url_date", F.lit(None).cast("date").alias("date")), dealt=True)
    discard(links)
    return groups, feed


# The whole list is the only group as long as the feed, unless a section holds the whole feed.
SORTED_SQL = f"""{PAGES_SQL}, sizes AS (SELECT page_id, any_value(n) AS n, least(any_value(n), 5) AS nf, max(s) AS sections FROM placed GROUP BY 1),
full_list AS (SELECT page_id, 1 AS stars, '/html[1]/body[1]/main[1]/section[1]/ul[1]/li[*]/a[1]' AS mask, n, nf FROM sizes WHERE sections = 1 AND n > 1
  UNION ALL SELECT page_id, 2, '/html()[1]/body()[1]/main(a,b,list)[1]/section()[*]/ul()[1]/li(item)[*]/a()[1]', n, nf FROM sizes WHERE sections > 1)"""


@query("g01_detect_sorted", f"WITH {SORTED_SQL} SELECT page_id, stars, mask, n AS n_links, page_id % 3 = 0 AS is_reversed, 'archives' AS pattern FROM full_list WHERE page_id % 3 <> 0 OR n <= 5")
def _(t):
    groups, feed = dated_groups(t)
    return G.detect_sorted(groups, feed)


@query("g05_detect_almost_feed", f"""WITH {PAGES_SQL}, sizes AS (SELECT page_id, least(any_value(n), 5) AS nf FROM placed GROUP BY 1),
    inside AS (SELECT page_id, s, bool_and(is_feed) AS fed FROM placed GROUP BY 1, 2), across AS (SELECT page_id, j, bool_and(is_feed) AS fed FROM placed GROUP BY 1, 2),
    g AS (SELECT page_id, mask, n_links FROM li JOIN inside USING (page_id, s) WHERE fed UNION ALL SELECT page_id, mask, n_links FROM sec JOIN across USING (page_id, j) WHERE fed)
    SELECT page_id, mask, nf AS n_links, 'feed' AS pattern FROM g JOIN sizes USING (page_id) WHERE n_links < nf AND n_links >= CASE WHEN nf <= 3 THEN nf ELSE nf - 1 END""")
def _(t):
    groups, feed = dated_groups(t)
    return G.detect_almost_feed(groups.where("stars = 1"), feed).select("page_id", "mask", "n_links", "pattern")


@query("g06_detect_shuffled", f"WITH {SORTED_SQL} SELECT page_id, stars, mask, n AS n_links, false AS has_dates, 'shuffled' AS pattern FROM full_list")
def _(t):
    groups, feed = dated_groups(t)
    return G.detect_shuffled(groups, feed)


@query("g08_detect_long_feed", """WITH f AS (SELECT l_suppkey AS page_id, l_orderkey AS key FROM lineitem WHERE l_suppkey % 3 = 0 OR l_orderkey % 2 = 0), n AS (SELECT page_id, count(DISTINCT key) AS n_links, bool_or(page_id % 3 = 0 AND key % 97 = 0) AS lacks FROM f GROUP BY 1)
    SELECT page_id, n_links, 'long_feed' AS pattern FROM n WHERE n_links >= 31 AND NOT lacks AND n_links > CASE WHEN page_id % 2 = 0 THEN 400 ELSE 0 END""")
def _(t):
    feed = t.lineitem.select(c("l_suppkey").alias("page_id"), c("l_orderkey").alias("key")).where("page_id % 3 = 0 or key % 2 = 0").distinct()
    on_page = feed.where("not (page_id % 3 = 0 and key % 97 = 0)")
    best = feed.where("page_id % 2 = 0").select("page_id", F.lit(400).alias("n_links"))
    return G.detect_long_feed(on_page, feed, best)


@query("g09_archive_candidates", f"WITH {SORTED_SQL} SELECT page_id, CASE WHEN page_id % 3 <> 0 OR n <= 5 THEN 'archives' ELSE 'shuffled' END AS pattern, n AS n_links FROM full_list")
def _(t):
    groups, feed = dated_groups(t)
    found = G.archive_candidates(G.detect_sorted(groups, feed), G.detect_shuffled(groups, feed))
    return found.select("page_id", "pattern", "n_links")


# Each line item is a finding of some detector on the page of its order; the oracle asks them one by one.
STAGE_NAMES = ", ".join(f"'{p}'" for p in G.STAGES)


@query("g09_cascade", f"""WITH RECURSIVE found AS (
      SELECT l_orderkey AS page_id, (l_partkey % 10)::INT AS stage, (l_suppkey % 3 + 1)::INT AS stars, 'm' || l_linenumber AS mask,
        l_quantity::BIGINT AS n_links, l_partkey % 4 = 0 AS has_dates, l_suppkey % 5 = 0 AS is_sorted FROM lineitem),
    best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page_id, stage, stars ORDER BY n_links DESC, mask) = 1),
    asked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY stage, stars) AS turn FROM best),
    judged AS (
      SELECT page_id, 0::BIGINT AS turn, 0::BIGINT AS least, false AS over, false AS dated, NULL::BIGINT AS main, []::BIGINT[] AS bundle FROM asked WHERE turn = 1
      UNION ALL
      SELECT page_id, turn, CASE WHEN yes THEN n_links + 1 ELSE least END, over OR (yes AND stage = 2),
        CASE WHEN yes AND NOT apart THEN has_dates AND stage IN (0, 5, 6, 7, 8) ELSE dated END,
        CASE WHEN yes AND NOT apart THEN turn ELSE main END, CASE WHEN yes AND apart THEN list_append(bundle, turn) ELSE bundle END
      FROM (SELECT j.page_id, j.turn + 1 AS turn, j.least, j.over, j.dated, j.main, j.bundle, a.n_links, a.stage, a.has_dates,
          a.stage IN (5, 6, 8) AND NOT a.is_sorted AS apart,
          NOT j.over AND a.n_links >= j.least AND NOT (a.stage IN (5, 6, 8) AND j.dated) AS yes
        FROM judged j JOIN asked a ON a.page_id = j.page_id AND a.turn = j.turn + 1)),
    last AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY turn DESC) = 1),
    parts AS (SELECT page_id, 'main' AS part, main AS turn FROM last WHERE main IS NOT NULL
      UNION ALL SELECT page_id, 'bundle', unnest(bundle) FROM last)
    SELECT page_id, part, [{STAGE_NAMES}][stage + 1] AS pattern, stars, mask, n_links,
      CASE WHEN part = 'bundle' THEN max(n_links) OVER (PARTITION BY page_id, part) END AS bundle_links
    FROM parts JOIN asked USING (page_id, turn)""")
def _(t):
    names = F.array(*map(F.lit, G.STAGES))
    found = t.lineitem.select(
        c("l_orderkey").alias("page_id"), F.element_at(names, (c("l_partkey") % 10 + 1).cast("int")).alias("pattern"),
        (c("l_suppkey") % 3 + 1).cast("int").alias("stars"), F.concat(F.lit("m"), text(c("l_linenumber"))).alias("mask"),
        c("l_quantity").cast("long").alias("n_links"), (c("l_partkey") % 4 == 0).alias("has_dates"), (c("l_suppkey") % 5 == 0).alias("is_sorted"))
    return G.archive_candidates(found)


@query("g03_detect_pinned", """WITH e AS (SELECT DISTINCT l_orderkey AS page_id, l_partkey AS key FROM lineitem),
    n AS (SELECT page_id, count(*) AS n_feed, max(key) AS top FROM e GROUP BY 1)
    SELECT page_id, n_feed + 1 AS n_links, top AS pinned_key FROM n WHERE page_id % 2 = 0 AND n_feed >= 2 AND page_id % 3 <> 0 AND page_id % 5 <> 0""")
def _(t):
    # The entry with the largest key is pinned; every page lists one link more, every third page no pinned entry, every
    # fifth an undated link.
    page = c("page_id")
    feed = t.lineitem.select(c("l_orderkey").alias("page_id"), c("l_partkey").alias("key")).distinct()
    tops = feed.groupBy("page_id").agg(F.max("key").alias("key"))
    listed = feed.join(tops, ["page_id", "key"], "left_anti").unionByName(tops.select("page_id", F.lit(-1).cast("long").alias("key")))
    day = F.when((page % 5 != 0) | (c("key") >= 0), F.lit("2020-01-01").cast("date"))
    groups = listed.select("page_id", F.lit(1).alias("stars"), F.lit("m").alias("mask"), "key", day.alias("url_date"), F.lit(None).cast("date").alias("date"))
    keys = listed.select("page_id", "key").unionByName(tops.where(page % 3 != 0))
    makers = feed.select("page_id", F.when(page % 2 == 0, "medium").otherwise("blogger").alias("generator"))
    return G.detect_pinned(groups, feed, keys, makers).select("page_id", "n_links", "pinned_key")


def paging_links(t):
    """Anchors of pages plus one paging link each, of a shape chosen by the page number."""
    base = U.with_canonical(page_hrefs(t.pages), "href", "page_url").select("page_id", "link_url")
    k = c("page_id")
    host = F.regexp_extract("url", "^(https?://[^/]*)", 1)
    extra = t.pages.select(k, F.when(k % 6 == 0, F.concat(host, F.lit("/blog/page/2/"))).when(k % 6 == 1, F.concat(host, F.lit("/?page=2"))).when(
        k % 6 == 2, F.concat(host, F.lit("/archive/2"))).when(k % 6 == 3, F.concat(host, F.lit("/search?updated-max=2020"))).when(
        k % 6 == 4, F.concat(host, F.lit("/page2"))).otherwise(F.concat(host, F.lit("/none"))).alias("link_url"))
    second = t.pages.where("page_id % 6 = 4").select(k, F.concat(host, F.lit("/page-2x/page2")).alias("link_url"))
    rows = U.with_canonical(base.unionByName(extra).unionByName(second), "link_url", prefix="p_").select(
        k, "link_url", c("p_parts.host").alias("host"), c("p_parts.trimmed_path").alias("trimmed_path"), c("p_parts.query").alias("query"),
        F.regexp_extract("link_url", r"\?(.*)$", 1).alias("raw_query"), c("p_key").alias("key"))
    pages = t.pages.select(k, U.url_host(c("url")).alias("page_host"), F.when(k % 6 == 3, "blogger").alias("generator"))
    return rows, pages


@query("g11_page2_links", """SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) || CASE page_id % 6 WHEN 0 THEN '/blog/page/2/' WHEN 1 THEN '/?page=2' WHEN 2 THEN '/archive/2' ELSE '/search?updated-max=2020' END AS link_url,
    page_id % 6 <> 2 AS is_certain, CASE page_id % 6 WHEN 0 THEN '/blog/page/%d' WHEN 2 THEN '/archive/%d' END AS path_template, CASE WHEN page_id % 6 = 1 THEN 'page=%d' END AS query_template FROM pages WHERE page_id % 6 < 4""")
def _(t):
    return G.page2_links(*paging_links(t)).drop("host")


@query("g12_next_page_links", """SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 2) THEN 'one' ELSE 'none' END AS status,
    CASE WHEN page_id % 6 < 3 THEN regexp_extract(url, '^(https?://[^/]*)', 1) || CASE page_id % 6 WHEN 0 THEN '/blog/page/2/' WHEN 1 THEN '/?page=2' ELSE '/archive/2' END END AS link_url FROM pages WHERE page_id % 6 <> 4""")
def _(t):
    links, pages = paging_links(t)
    k = c("page_id") % 6
    templates = pages.where("page_id % 6 <> 4").select(
        "page_id", c("page_host").alias("host"), F.when(k == 0, "/blog/page/%d").when(k == 2, "/archive/%d").when(k > 2, "/nothing/%d").alias("path_template"),
        F.when(k == 1, "page=%d").alias("query_template"), F.lit(2).alias("number"))
    return G.next_page_links(links, templates)


def paged(t):
    """Pages of a blog: the orders of a customer, numbered; every seventh order repeats a link of the first page."""
    rows = t.orders.select(c("o_custkey").alias("blog_id"), "o_orderkey")
    ranked = checkpointed(with_row_number(rows, ["blog_id"], ["o_orderkey"], "number", position_chunk(c("o_orderkey"))))
    holes = ranked.where("not (blog_id % 3 = 0 and number = 4)")
    own = F.array(*[F.struct(F.lit(i).alias("pos"), F.concat(text(c("o_orderkey")), F.lit(f"/{i}")).alias("key")) for i in range(2)])
    shared = F.array(F.struct(F.lit(9).alias("pos"), F.lit("same").alias("key")))
    links = F.when((c("number") == 1) | (c("o_orderkey") % 7 == 0), F.concat(own, shared)).otherwise(own)
    return holes.select("blog_id", "number", links.alias("links"))


PAGED_SQL = """r AS (SELECT o_custkey AS blog_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders),
stop AS (SELECT blog_id, min(number) AS stop FROM r WHERE number > 1 AND k % 7 = 0 AND NOT (blog_id % 3 = 0 AND number >= 4) GROUP BY 1),
kept AS (SELECT r.* FROM r LEFT JOIN stop USING (blog_id) WHERE (stop IS NULL OR number < stop) AND NOT (blog_id % 3 = 0 AND number >= 4)),
links AS (SELECT blog_id, number, 0 AS pos, k || '/0' AS key FROM kept UNION ALL SELECT blog_id, number, 1, k || '/1' FROM kept UNION ALL SELECT blog_id, number, 9, 'same' FROM kept WHERE number = 1)"""


@query("g15_assemble_paged", f"WITH {PAGED_SQL} SELECT blog_id, row_number() OVER (PARTITION BY blog_id ORDER BY number, pos) - 1 AS index, key, number FROM links")
def _(t):
    return G.assemble_paged(paged(t))


@query("g15_page_size_histogram", f"WITH {PAGED_SQL}, s AS (SELECT blog_id, number, count(*) AS page_size FROM links GROUP BY 1, 2) SELECT blog_id, page_size, count(*) AS n_pages FROM s GROUP BY 1, 2")
def _(t):
    return G.page_size_histogram(checkpointed(G.assemble_paged(paged(t))))


@query("g16_sort_by_page_dates", """SELECT o_custkey AS blog_id, o_orderkey AS page_id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'meta' AS date_source,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS index FROM orders WHERE o_custkey % 4 <> 0""")
def _(t):
    k = c("o_orderkey")
    lists = t.orders.select(c("o_custkey").alias("blog_id"), k.alias("pos"), k.alias("page_id"))
    day = F.to_date("o_orderdate")
    spots = F.array(
        F.struct(F.lit("/meta[1]").alias("xpath"), F.when(c("o_custkey") % 4 == 0, "text").otherwise("meta").alias("source"), day.alias("date")),
        F.struct(F.lit("/p[1]").alias("xpath"), F.lit("text").alias("source"), F.date_add(day, 1).alias("date")))
    dates = t.orders.select(k.alias("page_id"), F.inline(spots))
    return G.sort_by_page_dates(lists, dates).select("blog_id", "page_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "date_source", "index")


@query("g18_agrees_with_feed", f"""WITH {ENTRIES_SQL}, seq AS (SELECT feed_id, key, row_number() OVER (PARTITION BY feed_id ORDER BY CASE WHEN feed_id % 3 = 2 THEN 0 ELSE bucket END, key DESC, pos) - 1 AS seq_pos FROM entries WHERE NOT (feed_id % 4 = 0 AND pos = 0)),
    present AS (SELECT feed_id, bucket, key, row_number() OVER (PARTITION BY feed_id ORDER BY pos) - 1 AS pos FROM entries e WHERE EXISTS (SELECT 1 FROM seq s WHERE s.feed_id = e.feed_id AND s.key = e.key)),
    hit AS (SELECT s.feed_id, bool_and(EXISTS (SELECT 1 FROM present q WHERE q.feed_id = p.feed_id AND q.bucket = p.bucket AND q.key = s.key)) AS ok FROM seq s JOIN present p ON p.feed_id = s.feed_id AND p.pos = s.seq_pos GROUP BY 1),
    f AS (SELECT feed_id, bool_or(order_certain) AS certain FROM entries GROUP BY 1)
    SELECT feed_id, NOT certain OR coalesce(ok, true) AS is_matching_feed FROM f LEFT JOIN hit USING (feed_id)""")
def _(t):
    e = entries(t)
    return G.agrees_with_feed(candidates(e), e)


@query("g19_choose_candidate", """WITH x AS (SELECT o_custkey AS blog_id, o_orderkey AS arrival, o_orderkey % 3 = 0 AS matches_feed, (o_orderkey % 50)::INT AS speculative, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 40)::INT END AS validated FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY blog_id ORDER BY matches_feed DESC, CASE WHEN matches_feed THEN least(speculative, validated) ELSE validated END DESC, arrival) AS n FROM x WHERE validated IS NOT NULL)
    SELECT blog_id, arrival, validated, validated >= 11 AS is_enough FROM r WHERE n = 1""")
def _(t):
    k = c("o_orderkey")
    rows = t.orders.select(c("o_custkey").alias("blog_id"), k.alias("arrival"), (k % 3 == 0).alias("matches_feed"), (k % 50).cast("int").alias("speculative"),
                           F.when(k % 7 != 0, (k % 40).cast("int")).alias("validated"))
    return G.accepted(G.choose_candidate(rows)).select("blog_id", "arrival", "validated", "is_enough")


@query("g20_curated_categories", """SELECT o_custkey AS site, o_orderpriority AS category, 'https://c' || o_custkey || '.example.com/' || o_orderkey || '/' AS url FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""")
def _(t):
    url = F.concat(F.lit("https://c"), text(c("o_custkey")), F.lit(".example.com/"), text(c("o_orderkey")))
    posts = t.orders.where("o_orderkey % 3 <> 0").select(c("o_custkey").alias("site"), F.concat(url, F.lit("/")).alias("url"))
    curated = t.orders.where("o_orderkey % 2 = 0").select(c("o_custkey").alias("site"), c("o_orderpriority").alias("category"), F.lit(True).alias("is_top"), url.alias("url"))
    return G.apply_curated_categories(posts, curated)[0].select("site", "category", "url")


@query("g13_detect_page1", f"""WITH {PAGES_SQL}, n AS (SELECT page_id, any_value(n) AS n FROM placed WHERE page_id % 10 > 1 GROUP BY 1),
    r AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 3 WHEN page_id % 2 = 0 THEN least(n, 3) ELSE n END AS page_size, page_id % 3 <> 0 AS includes_newest FROM n WHERE n > 1 AND (page_id % 3 <> 0 OR n = 2))
    SELECT page_id, 1 AS stars, '/html[1]/body[1]/main[1]/section[1]/ul[1]/li[*]/a[1]' AS mask, page_size, includes_newest, page_size * 2 + 1 AS speculative FROM r""")
def _(t):
    feed, links = mined_links(t)
    groups = checkpointed_pages(M.mask_groups(links, 1).select("page_id", "mask", "stars", "pos", "key"))
    k = c("page_id")
    target = F.when(k % 10 == 0, F.concat(F.lit("b"), text(k), F.lit(".example.com//p/"), text(k), F.lit("-2?"))).otherwise("page2")
    page2 = feed.where("page_id % 10 <> 1").select("page_id").distinct().withColumn("key", target)
    return G.detect_page1(groups, feed, page2)


@query("g17_sort_with_pinned", """WITH r AS (SELECT o_custkey AS blog_id, o_orderkey AS pos, o_orderkey AS key, o_orderdate::DATE AS date FROM orders),
    p AS (SELECT c_custkey, make_date(1998, (c_custkey % 12 + 1)::INT, (c_custkey % 28 + 1)::INT) AS date FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 5 <> 0),
    m AS (SELECT * FROM r UNION ALL SELECT c_custkey, -1, -1, date FROM p)
    SELECT blog_id, key, strftime(date, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY blog_id ORDER BY date DESC, pos) - 1 AS index FROM m""")
def _(t):
    lists = t.orders.select(c("o_custkey").alias("blog_id"), c("o_orderkey").alias("pos"), c("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("date"))
    k = c("blog_id")
    day = F.make_date(F.lit(1998), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"))
    pinned = lists.select("blog_id").distinct().select("blog_id", F.lit(-1).cast("long").alias("key"), F.when(k % 5 == 0, "no date").otherwise(
        F.concat(F.lit("Pinned, "), F.date_format(day, "MMMM d"))).alias("text"))
    return G.sort_with_pinned(lists, pinned, F.lit(1998)).select("blog_id", "key", F.date_format("date", "yyyy-MM-dd").alias("date"), "index")


@query("g14_detect_page2", f"""WITH {ENTRIES_SQL}, halves AS (SELECT *, pos < (count(*) OVER (PARTITION BY feed_id) + 1) // 2 AS early FROM entries),
    one AS (SELECT feed_id, pos, key FROM halves WHERE early),
    two AS (SELECT feed_id, CASE WHEN feed_id % 4 = 1 THEN -pos ELSE pos END AS pos, key FROM halves WHERE NOT early UNION ALL SELECT feed_id, 1000000, key FROM entries WHERE pos = 0 AND feed_id % 7 = 0),
    seq AS (SELECT feed_id, key, row_number() OVER (PARTITION BY feed_id ORDER BY pos) - 1 AS sp FROM two), s1 AS (SELECT feed_id, count(*) AS size1 FROM one GROUP BY 1),
    s2 AS (SELECT feed_id, count(*) AS size2, count(DISTINCT key) AS d FROM two GROUP BY 1),
    bad AS (SELECT DISTINCT feed_id FROM two JOIN one USING (feed_id, key)),
    hits AS (SELECT s.feed_id, bool_and(EXISTS (SELECT 1 FROM entries b WHERE b.feed_id = e.feed_id AND b.bucket = e.bucket AND b.key = s.key)) AS ok FROM seq s JOIN s1 USING (feed_id) JOIN entries e ON e.feed_id = s.feed_id AND e.pos = sp + size1 GROUP BY 1)
    SELECT feed_id, 'm' AS mask, size1, size2 FROM s2 JOIN s1 USING (feed_id) LEFT JOIN hits USING (feed_id) WHERE size2 = d AND feed_id NOT IN (SELECT feed_id FROM bad) AND coalesce(ok, true)""")
def _(t):
    # The first half of a feed is page one, the rest page two.
    e = entries(t)
    sizes = e.groupBy("feed_id").agg(F.floor((F.count("*") + 1) / 2).alias("half"))
    rows = e.join(sizes, "feed_id").select("feed_id", F.lit("m").alias("mask"), "pos", "key", (c("pos") < c("half")).alias("early"))
    turned = rows.where("not early").withColumn("pos", F.when(c("feed_id") % 4 == 1, -c("pos")).otherwise(c("pos")))
    repeated = rows.where("pos = 0 and feed_id % 7 = 0").withColumn("pos", F.lit(1_000_000).cast("long"))
    return G.detect_page2(rows.where("early").drop("early"), turned.unionByName(repeated).drop("early"), e)


@query("g02_detect_sorted_first", f"""WITH {ENTRIES_SQL}, n AS (SELECT feed_id, count(*) AS n FROM entries GROUP BY 1), fb AS (SELECT feed_id, count(*) AS b FROM entries e WHERE bucket = (SELECT min(bucket) FROM entries x WHERE x.feed_id = e.feed_id) GROUP BY 1),
    rev AS (SELECT a.feed_id, bool_and(a.bucket = z.bucket) AS ok FROM entries a JOIN n USING (feed_id) JOIN entries z ON z.feed_id = a.feed_id AND z.pos = n - a.pos WHERE a.pos >= 1 GROUP BY 1)
    SELECT feed_id AS page_id, n AS n_links, '0' AS first_key FROM n JOIN fb USING (feed_id) JOIN rev USING (feed_id) WHERE n >= 3 AND feed_id % 2 = 0 AND (feed_id % 3 <> 0 OR b = n OR (b = 1 AND ok))""")
def _(t):
    # Positions are the keys; every third list is upside down, and all repeat one link at the top.
    e = entries(t).select(c("feed_id").alias("page_id"), "pos", "bucket", text(c("pos")).alias("key"))
    listed = e.where("pos >= 1").select("page_id", F.lit(1).alias("stars"), F.lit("m").alias("mask"), F.when(
        c("page_id") % 3 == 0, -c("pos")).otherwise(c("pos")).alias("pos"), "key")
    again = listed.where("key = '2'").withColumn("pos", F.lit(-1000).cast("long"))
    page_keys = e.where("pos >= 1 or page_id % 2 = 0").select("page_id", "key")
    return G.detect_sorted_first(listed.unionByName(again), e, page_keys).select("page_id", "n_links", "first_key")
