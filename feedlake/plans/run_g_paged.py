"""Queries of lists over numbered pages, which Spark renders from the line items of a part.

Kinds by blog number modulo 6: page one links to the last page (0), only to the next (1), has its list in another place than the
others (2), has the newest post apart from its list (3), is followed by a page that repeats a post (4), or by a third
page with two posts exchanged (5). On blogs divisible by seven page two has two links to page three.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import archives as G
from feedlake.operators import masks as M
from feedlake.operators import pages as P
from feedlake.operators import paged_lists as L
from feedlake.plans.registry import query
from feedlake.plans.run_fg_archives import PLACED, text
from feedlake.plans.run_g_lists import POSTS_SQL, blog_posts, feed_of, host_of, path_of, post_number
from feedlake.plans.run_l_events import c
from feedlake.session import checkpointed


def numbered_pages(posts):
    b, i, kind = c("b"), c("i"), c("b") % 6
    size = b % 3 + 4
    number = F.floor((i - 1) / size) + 1
    slot = F.when((kind == 5) & (number == 3) & (i <= 2 * size + 2), 4 * size + 3 - i).otherwise(i)
    rows = posts.select("b", number.alias("number"), slot.alias("slot"), "i", F.ceil(c("n") / size).alias("last"))
    again = rows.where((kind == 4) & (i == 1) & (c("last") > 1)).select("b", F.lit(2).cast("long").alias("number"), F.lit(999).cast("long").alias("slot"), "i", "last")
    link = F.concat(F.lit('<a href="'), path_of(b, i), F.lit('">Post '), text(i), F.lit("</a>"))
    apart = (kind == 3) & (i == 1)
    item = F.when(apart, F.concat(F.lit("<header><h1>"), link, F.lit("</h1></header>"))).otherwise(F.concat(F.lit("<article>"), link, F.lit("</article>")))
    body = rows.unionByName(again).groupBy("b", "number", "last").agg(F.array_sort(F.collect_list(F.struct("slot", apart.alias("apart"), item.alias("h")))).alias("_h"))

    def part(apart):
        return F.array_join(F.transform(F.filter("_h", lambda s: s["apart"] == F.lit(apart)), lambda s: s["h"]), "")

    k, last = c("number"), c("last")
    nxt = F.when(k < last, F.concat(F.lit('<a href="/page/'), text(k + 1), F.lit('">Older</a>'))).otherwise("")
    two = F.when((b % 7 == 0) & (k == 2) & (k < last), '<a href="/page/3?sort=asc">Older, oldest first</a>').otherwise("")
    end = F.when((k == 1) & (kind != 1) & (last > 2), F.concat(F.lit('<a href="/page/'), text(last), F.lit('">Last</a>'))).otherwise("")
    moved = (kind == 2) & (k == 1)
    html = F.concat(F.lit('<html><body><nav><a href="/about">About</a>'), nxt, two, end, F.lit("</nav><main>"), part(True), F.when(moved, "<section>").otherwise(""),
                    F.lit("<div>"), part(False), F.lit("</div>"), F.when(moved, "</section>").otherwise(""), F.lit("</main></body></html>"))
    url = F.concat(F.lit("https://"), host_of(b), F.when(k == 1, "/").otherwise(F.concat(F.lit("/page/"), text(k))))
    return body.select((b * 100 + k).alias("page_id"), "b", "number", url.alias("url"), html.alias("html"))


def paged(t):
    posts = blog_posts(t)
    feed = checkpointed(feed_of(posts))
    rendered = checkpointed(numbered_pages(posts))
    found = checkpointed(P.links_of_nodes(P.link_nodes(rendered.select("page_id", "url", "html"))))
    blog, number = F.floor(c("page_id") / 100), c("page_id") % 100
    first = feed.select((c("b") * 100 + 1).alias("page_id"), "pos", "bucket", "key", "title")
    links = found.select("*", c("parts.host").alias("host"), c("parts.trimmed_path").alias("trimmed_path"), c("parts.query").alias("query"),
                         F.regexp_extract("link_url", r"\?(.*)$", 1).alias("raw_query"))
    page2 = checkpointed(G.page2_links(links.where(number == 1), rendered.where("number = 1").select(
        "page_id", host_of(c("b")).alias("page_host"), F.lit(None).cast("string").alias("generator"))))
    templates = rendered.select("page_id", "b", "number").join(page2.select(F.floor(c("page_id") / 100).alias("b"), "host", "path_template", "query_template"), "b")
    steps = G.next_page_links(links, templates.select("page_id", "host", "path_template", "query_template", (c("number") + 1).alias("number")))
    steps = steps.select(blog.alias("blog_id"), number.alias("number"), "status", F.concat(host_of(blog), F.lit("//page/"), text(number + 1), F.lit("?")).alias("key"))
    home = templates.where("number = 1").select(c("b").alias("blog_id"), F.lit(0).cast("long").alias("number"), F.lit(None).cast("string").alias("status"), F.concat(host_of(c("b")), F.lit("/?")).alias("key"))
    ends = rendered.groupBy("b").agg(F.max("number").alias("number"))
    jump = G.next_page_links(links.where(number == 1), templates.where("number = 1").drop("number").join(ends, "b").select(
        "page_id", "host", "path_template", "query_template", "number"))
    jumps = jump.where("status <> 'none'").select(blog.alias("blog_id")).join(ends.withColumnRenamed("b", "blog_id"), "blog_id")
    groups = checkpointed(M.mask_groups(M.flag_feed_links(found.where(number == 1).select(*PLACED), first), 1))
    target = page2.select("page_id", F.concat(host_of(blog), F.lit("//page/2?")).alias("key"))
    opened = checkpointed(G.detect_page1(groups, first.drop("title"), target))
    members = groups.join(opened.select("page_id", "stars", "mask", "page_size", "includes_newest"), ["page_id", "stars", "mask"])
    return L.paged_lists(
        members.select(blog.alias("blog_id"), "mask", "stars", "pos", "key", "page_size", "includes_newest"),
        found.where(number > 1).select(blog.alias("blog_id"), number.alias("number"), "pos", "xpath", "class_xpath", "key"),
        feed.select(c("b").alias("blog_id"), "pos", "bucket", "key"), checkpointed(steps.unionByName(home)), jumps,
        page2.where("is_certain").select(blog.alias("blog_id")))


PAGED_SQL = f"""{POSTS_SQL},
sized AS (SELECT *, b % 3 + 4 AS size, ceil(n / (b % 3 + 4))::BIGINT AS last FROM blog),
good AS (
  SELECT * FROM sized WHERE last > 1 AND b % 6 <> 4 AND NOT (b % 7 = 0 AND last > 2) AND NOT (b % 6 = 5 AND nf > 2 * size AND n > 2 * size + 1)),
placed AS (
  SELECT *, (i - 1) // size + 1 AS number, CASE WHEN b % 6 = 5 AND i IN (2 * size + 1, 2 * size + 2) AND n > 2 * size + 1 THEN 4 * size + 3 - i ELSE i END AS slot FROM good)"""


@query("g15_paged_lists", f"""WITH {PAGED_SQL}
    SELECT b AS blog_id, CASE WHEN any_value(last) = 2 OR b % 6 <> 1 THEN 'paged_last' ELSE 'paged_next' END AS pattern,
      '/html[1]/body[1]/main[1]/' || CASE WHEN b % 6 = 2 THEN 'section[1]/' ELSE '' END || 'div[1]/article[*]/a[1]' AS mask, any_value(last) AS n_pages, count(*) AS n_links
    FROM placed GROUP BY b""")
def _(t):
    return paged(t)[0]


@query("g15_paged_links", f"WITH {PAGED_SQL} SELECT b AS blog_id, row_number() OVER (PARTITION BY b ORDER BY slot) - 1 AS index, number, i FROM placed")
def _(t):
    return paged(t)[1].select("blog_id", "index", "number", post_number())
