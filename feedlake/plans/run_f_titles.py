"""Queries of masks with three stars and of title positions, over pages that Spark renders from the line items of a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import masks as M
from feedlake.operators import pages as P
from feedlake.plans.registry import query
from feedlake.plans.run_fg_archives import PLACED, flagged, text
from feedlake.plans.run_g_lists import POSTS_SQL, blog_posts, feed_of, host_of, path_of
from feedlake.plans.run_l_events import c
from feedlake.session import checkpointed_pages


def page(b, url_path, body):
    html = F.concat(F.lit('<html><body><nav><a href="/about">About</a><a href="/archive">Archive</a></nav><main>'), body, F.lit("</main></body></html>"))
    return b.alias("page_id"), F.concat(F.lit("https://"), host_of(b), F.lit(url_path)).alias("url"), html.alias("html")


def page_feed(posts):
    return checkpointed_pages(feed_of(posts).withColumnRenamed("b", "page_id"))


def mined(posts, rendered, *more):
    nodes = checkpointed_pages(P.nodes(rendered), dealt=True)
    return nodes, flagged(checkpointed_pages(P.links_of_nodes(nodes).select(*PLACED, *more), dealt=True), page_feed(posts))


# Titles by blog number modulo 8: the link's text (4, and 0 with two others), an element of the link (5, and 1 where the first two links
# have a bare text), a heading beside it (2, 6), a heading or an element after it in turn (3, 7).
def titled_pages(posts):
    b, i = c("b"), c("i")
    name = F.concat(F.lit("Post "), text(i))
    odd = (i <= 2) & (b % 8 < 4)
    link = F.concat(F.lit('<a href="'), path_of(b, i), F.lit('">'))
    item = F.when(b % 4 == 0, F.concat(link, F.when(odd, "Untitled").otherwise(name), F.lit("</a>"))).when(
        b % 4 == 1, F.concat(link, F.when(odd, name).otherwise(F.concat(F.lit("<b>"), name, F.lit("</b>"))), F.lit("<i> by someone</i></a>"))).when(
        b % 4 == 2, F.concat(F.lit("<h3>"), name, F.lit("</h3>"), link, F.lit("Read more</a><p>Some words</p>"))).otherwise(
        F.concat(F.when(i % 2 == 1, F.concat(F.lit("<h3><span>"), name, F.lit("</span></h3>"))).otherwise(""), link, F.lit("Read more</a><em>"), name, F.lit("</em>")))
    body = posts.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("<li>"), item, F.lit("</li>")).alias("h")))).alias("_h"))
    return body.select(*page(b, "/archive", F.concat(F.lit("<ul>"), F.array_join(F.transform("_h", lambda s: s["h"]), ""), F.lit("</ul>"))))


TITLES_SQL = f"""{POSTS_SQL},
size AS (SELECT DISTINCT b, n, nf, nf > 8 AS many FROM blog WHERE n > 1),
position AS (
  SELECT b, 'self' AS kind, NULL AS rel, 0 AS rank FROM size WHERE b % 8 = 4 OR b % 8 = 0 AND many
  UNION ALL SELECT b, 'child', '/a[1]/b[1]', 0 FROM size WHERE b % 8 = 5 OR b % 8 = 1 AND many
  UNION ALL SELECT b, 'neighbor', '/a[1]/text()[1]', 0 FROM size WHERE b % 8 = 1 AND NOT many
  UNION ALL SELECT b, 'neighbor', '/a[1]/b[1]', 1 FROM size WHERE b % 8 = 1 AND NOT many AND n > 2
  UNION ALL SELECT b, 'neighbor', '/h3[1]', 0 FROM size WHERE b % 4 = 2
  UNION ALL SELECT b, 'neighbor', unnest(['/h3[1]', '/em[1]']), unnest([0, 1]) FROM size WHERE b % 4 = 3)"""


@query("f03_title_positions", f"WITH {TITLES_SQL} SELECT b AS page_id, kind, rel, rank::INT AS rank FROM position")
def _(t):
    posts = blog_posts(t)
    nodes, links = mined(posts, titled_pages(posts), "text")
    return M.infer_title_position(checkpointed_pages(M.mask_groups(links, 1)), nodes).select("page_id", "kind", "rel", "rank")


@query("f04_titles", f"""WITH {TITLES_SQL} SELECT b AS page_id, i,
      CASE WHEN b % 8 = 0 AND NOT many OR b % 8 = 1 AND many AND i <= 2 THEN NULL WHEN b % 8 = 0 AND i <= 2 THEN 'Untitled' ELSE 'Post ' || i END AS title,
      CASE WHEN b % 8 = 0 AND NOT many OR b % 8 = 1 AND many AND i <= 2 THEN NULL WHEN b % 4 = 0 THEN 'self' WHEN b % 8 = 5 OR b % 8 = 1 AND many THEN 'child' ELSE 'neighbor' END AS title_kind,
      CASE WHEN b % 8 = 0 AND NOT many OR b % 8 = 1 AND many AND i <= 2 THEN NULL WHEN b % 4 = 3 AND i % 2 = 1 THEN 'Post ' || i ELSE '' END AS others
    FROM blog JOIN size USING (b)""")
def _(t):
    posts = blog_posts(t)
    nodes, links = mined(posts, titled_pages(posts), "text", "link_url")
    groups = checkpointed_pages(M.mask_groups(links, 1))
    titled = M.apply_title_position(groups, checkpointed_pages(M.infer_title_position(groups, nodes)), nodes)
    number = F.regexp_extract("link_url", r"-(\d+)$", 1).cast("long").alias("i")
    return titled.select("page_id", number, "title", "title_kind", F.array_join("alternatives", "|").alias("others"))


# Years, months and posts, each a list of its own: three stars hold all posts.
def nested_pages(posts):
    b, i = c("b"), c("i")
    item = F.concat(F.lit('<li><a href="'), path_of(b, i), F.lit('">Post '), text(i), F.lit("</a></li>"))
    months = posts.groupBy("b", F.floor((i - 1) / 12).alias("y"), F.floor((i - 1) / 4).alias("m")).agg(
        F.array_sort(F.collect_list(F.struct("i", item.alias("h")))).alias("_h")).select(
        "b", "y", F.struct("m", F.concat(F.lit("<section><ol>"), F.array_join(F.transform("_h", lambda s: s["h"]), ""), F.lit("</ol></section>")).alias("h")).alias("s"))
    years = months.groupBy("b", "y").agg(F.array_sort(F.collect_list("s")).alias("_s")).select(
        "b", F.struct("y", F.concat(F.lit("<article>"), F.array_join(F.transform("_s", lambda s: s["h"]), ""), F.lit("</article>")).alias("h")).alias("s"))
    body = years.groupBy("b").agg(F.array_sort(F.collect_list("s")).alias("_s"))
    return body.select(*page(b, "/archive", F.array_join(F.transform("_s", lambda s: s["h"]), "")))


@query("f01_mask_groups_three_stars", f"""WITH {POSTS_SQL}, placed AS (SELECT *, (i - 1) // 12 AS y, (i - 1) % 12 // 4 AS m, (i - 1) % 4 AS d FROM blog)
    SELECT b AS page_id, '/html()[1]/body()[1]/main()[1]/article()[*]/section()[*]/ol()[1]/li()[*]/a()[1]' AS mask, count(*) AS n_links
    FROM placed GROUP BY b HAVING max(i) > 12""")
def _(t):
    posts = blog_posts(t)
    links = flagged(checkpointed_pages(P.links_of_nodes(P.link_nodes(nested_pages(posts))).select(*PLACED), dealt=True), page_feed(posts))
    return M.mask_groups(links, 3).groupBy("page_id", "mask").agg(F.count("*").alias("n_links"))
