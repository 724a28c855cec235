"""Queries of lists with several forms, two masks or categories, over pages that Spark renders from the line items of a part.

A part is a blog, its line items are posts, newest first. One archive page for each blog in one of eight layouts, and up to
six category pages; all are html that is parsed and mined like any page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.ordered import position_chunk, with_row_number
from feedlake.operators import archive_lists as A
from feedlake.operators import masks as M
from feedlake.operators import pages as P
from feedlake.operators.archives import STAGES, archive_candidates, detect_almost_feed, detect_shuffled
from feedlake.plans.registry import query
from feedlake.plans.run_fg_archives import PLACED, flagged, text
from feedlake.plans.run_l_events import c
from feedlake.session import checkpointed, checkpointed_pages, deal, discard


def blog_posts(t):
    """``b, o, i, n, nf``: posts of each blog by number, blog size, feed size."""
    rows = t.lineitem.select(c("l_partkey").alias("b"), c("l_orderkey").alias("o"), "l_linenumber")
    posts = with_row_number(deal(rows, "b"), ["b"], ["o", "l_linenumber"], "i", position_chunk(c("o")))
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"))
    return checkpointed_pages(posts.join(sizes, "b").select("b", "o", "i", "n", F.least("n", c("b") % 20 + 5).alias("nf")), "b")


def day_of(i):
    return F.date_sub(F.lit("2024-12-31").cast("date"), i.cast("int"))


def path_of(b, i):
    """Posts of some blogs carry their day in the path."""
    plain = F.concat(F.lit("/p/"), text(b), F.lit("-"), text(i))
    return F.when(b % 16 == 6, F.concat(F.lit("/"), F.date_format(day_of(i), "yyyy/MM/dd"), plain)).otherwise(plain)


def url_day():
    return U.path_date(c("parts.path")).alias("url_date")


def host_of(b):
    return F.concat(F.lit("b"), text(b), F.lit(".example.com"))


def feed_of(posts):
    """Feed entries by blog; blogs divisible by three date two posts a day, which share a bucket."""
    pos = c("i") - 1
    bucket = F.when(c("b") % 3 == 0, F.floor(pos / 2)).otherwise(pos)
    key = F.concat(host_of(c("b")), F.lit("/"), path_of(c("b"), c("i")), F.lit("?"))
    return posts.where("i <= nf").select("b", pos.alias("pos"), bucket.alias("bucket"), key.alias("key"), F.concat(F.lit("post "), text(c("i"))).alias("title"))


POSTS_SQL = """posts AS (SELECT l_partkey AS b, l_orderkey AS o, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem),
blog AS (SELECT *, count(*) OVER (PARTITION BY b) AS n, least(count(*) OVER (PARTITION BY b), b % 20 + 5) AS nf FROM posts)"""


# Category pages.

def category_pages(posts):
    """Six kinds of categories; some posts are in none, some blogs lack a kind, and a kind may stand deeper than the others."""
    b, i, o = c("b"), c("i"), c("o")
    kinds = F.array(
        F.when(i % 3 == 0, 0), F.when(i % 3 == 1, 1), F.when(i % 3 == 2, 2), F.when((o % 2 == 0) & (b % 3 != 0), 3),
        F.when((o % 2 == 1) & (b % 3 != 0), 4), F.when(i % 4 != 0, 5))
    listed = posts.where("not ((o + i) % 11 = 0 and b % 4 <> 0)").select("b", "i", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    item = F.concat(F.lit('<li><a href="'), path_of(b, i), F.lit('">Post '), text(i), F.lit("</a></li>"))
    body = listed.groupBy("b", "kind").agg(F.array_sort(F.collect_list(F.struct("i", item.alias("h")))).alias("_h"))
    html = F.concat(F.lit('<html><body><nav><a href="/about">About</a><a href="/archive">Archive</a></nav><main><ul>'),
                    F.array_join(F.transform("_h", lambda s: s["h"]), ""), F.lit("</ul></main></body></html>"))
    deep = F.when((c("kind") == 4) & (b % 3 == 1), "/blog/category/").otherwise("/category/")
    return body.select((b * 6 + c("kind")).alias("page_id"), "b", "kind", F.concat(F.lit("https://"), host_of(b), deep, text(c("kind"))).alias("url"), html.alias("html"))


def categories(t):
    posts = blog_posts(t)
    feed = checkpointed(feed_of(posts))
    rendered = checkpointed(category_pages(posts))
    path = F.regexp_extract("url", "^https://[^/]*(/.*)$", 1)
    level = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    pages = rendered.select("page_id", c("b").alias("blog_id"), level.alias("level"), ((c("kind") * 5 + c("b")) % 6).cast("long").alias("arrival"))
    by_page = feed.join(pages.select("page_id", c("blog_id").alias("b")), "b").drop("b")
    links = checkpointed(M.flag_feed_links(P.links_of_nodes(P.link_nodes(rendered.select("page_id", "url", "html"))).select(*PLACED, url_day()), by_page))
    groups = checkpointed(M.mask_groups(links, 1).select(
        "page_id", "mask", "stars", "pos", "key", "url_date", F.lit(None).cast("date").alias("date")))
    return A.category_archives(groups, feed.select(c("b").alias("blog_id"), "pos", "key"), pages)


# All pairs and triples of a blog's categories, tried one by one.
CATEGORIES_SQL = f"""{POSTS_SQL},
member AS (
  SELECT b, nf, i, kind FROM blog, (SELECT unnest(range(0, 6)) AS kind)
  WHERE NOT ((o + i) % 11 = 0 AND b % 4 <> 0)
    AND CASE WHEN kind < 3 THEN i % 3 = kind WHEN kind < 5 THEN o % 2 = kind - 3 AND b % 3 <> 0 ELSE i % 4 <> 0 END),
page AS (
  SELECT b, nf, kind, (kind * 5 + b) % 6 AS arrival, CASE WHEN kind = 4 AND b % 3 = 1 THEN 3 ELSE 2 END AS level, count(*) AS n,
    list(i ORDER BY i) FILTER (WHERE i <= nf) AS held, list(i ORDER BY i) AS listed
  FROM member GROUP BY b, nf, kind HAVING count(*) >= 2),
fit AS (SELECT * FROM page WHERE len(held) >= 2 AND len(held) <= nf - 2),
cat AS (
  SELECT b, nf, held, min(arrival) AS arrival, arg_max(level, n * 10 - arrival) AS level, arg_max(kind, n * 10 - arrival) AS kind,
    arg_max(listed, n * 10 - arrival) AS listed, CASE WHEN nf <= 9 THEN nf WHEN nf <= 19 THEN nf - 1 ELSE nf - 2 END AS least
  FROM fit GROUP BY b, nf, held),
combo AS (
  SELECT x.b, x.nf, x.least, [x.kind, y.kind] AS kinds, [x.arrival, y.arrival] AS turns, list_distinct(list_concat(x.held, y.held)) AS held,
    list_concat(x.listed, y.listed) AS listed
  FROM cat x JOIN cat y ON x.b = y.b AND x.level = y.level AND x.arrival < y.arrival
  UNION ALL
  SELECT x.b, x.nf, x.least, [x.kind, y.kind, z.kind], [x.arrival, y.arrival, z.arrival], list_distinct(list_concat(list_concat(x.held, y.held), z.held)),
    list_concat(list_concat(x.listed, y.listed), z.listed)
  FROM cat x JOIN cat y ON x.b = y.b AND x.level = y.level AND x.arrival < y.arrival
  JOIN cat z ON z.b = x.b AND z.level = x.level AND y.arrival < z.arrival),
best AS (
  SELECT * FROM combo WHERE len(held) >= least
  QUALIFY row_number() OVER (PARTITION BY b ORDER BY turns[-1], len(turns), turns) = 1),
rows AS (
  SELECT b, nf, kinds, held, unnest(listed) AS i, unnest(range(1, len(listed) + 1)) AS slot FROM best
  UNION ALL
  SELECT b, nf, kinds, held, i, 100000 + i FROM (SELECT b, nf, kinds, held, unnest(range(1, nf + 1)) AS i FROM best) WHERE NOT list_contains(held, i)),
firsts AS (SELECT b, nf, kinds, held, i, min(slot) AS slot FROM rows GROUP BY ALL)"""


@query("g10_category_archives", f"""WITH {CATEGORIES_SQL}
    SELECT b AS blog_id, CASE WHEN len(any_value(held)) < any_value(nf) THEN 'categories_almost' ELSE 'categories' END AS pattern,
      len(any_value(kinds))::INT AS n_pages, array_to_string(list_transform(any_value(kinds), lambda k: b * 6 + k), ' ') AS pages,
      any_value(nf) - len(any_value(held)) AS n_missing, count(*) AS n_links
    FROM firsts GROUP BY b""")
def _(t):
    return categories(t)[0].withColumn("pages", F.array_join("pages", " "))


@query("g10_category_list", f"""WITH {CATEGORIES_SQL}
    SELECT b AS blog_id, row_number() OVER (PARTITION BY b ORDER BY slot) - 1 AS index, i FROM firsts""")
def _(t):
    return categories(t)[1].select("blog_id", "index", F.regexp_extract("key", r"-(\d+)\?$", 1).cast("long").alias("i"))


# Archive pages in eight layouts.

def shuffle_key(o, i):
    return (o * 7919 + i * 104729) % 1009


def archive_pages(posts):
    """Layout by blog number modulo 8: down, up, one entry absent, shuffled with times, two parts, two parts upside down, a part and a
    shuffled rest, sections as long as the feed or of three posts."""
    b, i, o, n, nf = c("b"), c("i"), c("o"), c("n"), c("nf")
    layout, first = b % 8, i <= F.least(b % 5 + 2, nf - 1)
    swapped = F.when(b % 3 == 0, F.when(i % 2 == 0, i - 1).otherwise(i + 1)).otherwise(i)
    shuffled = shuffle_key(o, i)
    size = F.when(b % 16 == 7, nf).otherwise(3)
    part = F.when(layout.isin(4, 6), F.when(first, 1).otherwise(2)).when(layout == 5, F.when(first, 2).otherwise(1)).when(
        layout == 7, F.floor((i - 1) / size) + 1).otherwise(1).cast("long")
    at = F.when(layout == 0, swapped).when(layout == 1, n + 1 - i).when(layout == 3, shuffled).when(
        (layout == 6) & ~first, shuffled).otherwise(i).cast("long")
    time = F.when(layout == 3, F.concat(F.lit(' <time datetime="'), F.date_format(day_of(i), "yyyy-MM-dd"), F.lit('">on</time>'))).otherwise("")
    item = F.concat(F.lit('<li><a href="'), path_of(b, i), F.lit('">Post '), text(i), F.lit("</a>"), time, F.lit("</li>"))
    opened = F.when(layout.isin(4, 5, 6), F.when(first, '<section class="top"><ul>').otherwise('<section class="rest"><ol>')).when(
        layout == 7, "<section><ul>").otherwise("<ul>")
    closed = F.when(layout.isin(4, 5, 6), F.when(first, "</ul></section>").otherwise("</ol></section>")).when(layout == 7, "</ul></section>").otherwise("</ul>")
    items = posts.where("not (b % 8 = 2 and i = 2)").select("b", part.alias("part"), opened.alias("x"), closed.alias("y"), F.struct(at.alias("at"), i.alias("i"), item.alias("h")).alias("s"))
    parts = items.groupBy("b", "part", "x", "y").agg(F.array_sort(F.collect_list("s")).alias("_s")).select(
        "b", F.struct("part", F.concat("x", F.array_join(F.transform("_s", lambda s: s["h"]), ""), "y").alias("h")).alias("p"))
    body = parts.groupBy("b").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    html = F.concat(F.lit('<html><body><nav><a href="/about">About</a><a href="/archive">Archive</a></nav><main>'),
                    F.array_join(F.transform("_p", lambda p: p["h"]), ""), F.lit("</main></body></html>"))
    return body.select(b.alias("page_id"), F.concat(F.lit("https://"), host_of(b), F.lit("/archive")).alias("url"), html.alias("html"))


def mined_archives(t):
    """Mask groups of one and two stars with their dates, and the feeds."""
    posts = blog_posts(t)
    feed = checkpointed_pages(feed_of(posts).withColumnRenamed("b", "page_id"))
    nodes = checkpointed_pages(P.nodes(archive_pages(posts)), dealt=True)
    links = flagged(checkpointed_pages(P.links_of_nodes(nodes).select(*PLACED, url_day()), dealt=True), feed)
    dates = checkpointed_pages(P.dated_nodes(nodes))
    discard(nodes)
    groups = checkpointed_pages(M.mask_groups(links, 1).unionByName(M.mask_groups(links, 2)), dealt=True)
    discard(links)
    positions = checkpointed_pages(M.infer_date_position(groups, dates))
    dated = A.with_list_dates(M.assign_markup_dates(groups, positions, dates), positions, feed)
    listed = checkpointed_pages(dated.select("page_id", "mask", "stars", "pos", "key", "url_date", "date"))
    discard(groups)
    return listed, feed


# The groups that mining finds, written down from the layouts: members by place, with the day where the list is dated.
GROUPS_SQL = f"""{POSTS_SQL},
laid AS (
  SELECT *, b % 8 AS layout, i <= least(b % 5 + 2, nf - 1) AS top, (o * 7919 + i * 104729) % 1009 AS mix, CASE WHEN b % 16 = 7 THEN nf ELSE 3 END AS size
  FROM blog WHERE NOT (b % 8 = 2 AND i = 2)),
placed AS (
  SELECT *, CASE WHEN layout IN (4, 6) THEN CASE WHEN top THEN 1 ELSE 2 END WHEN layout = 5 THEN CASE WHEN top THEN 2 ELSE 1 END
      WHEN layout = 7 THEN (i - 1) // size + 1 ELSE 1 END AS part,
    CASE WHEN layout = 0 AND b % 3 = 0 THEN CASE WHEN i % 2 = 0 THEN i - 1 ELSE i + 1 END WHEN layout = 1 THEN n + 1 - i
      WHEN layout = 3 OR layout = 6 AND NOT top THEN mix ELSE i END AS slot FROM laid),
page AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY part, slot, i) - 1 AS pos, CASE WHEN layout = 7 THEN (i - 1) % size END AS j FROM placed),
found AS (
  SELECT b, 1 AS stars, 'p' || part AS mask, part, pos, i, nf, layout FROM page
  UNION ALL SELECT b, 1, 'j' || j, part, pos, i, nf, layout FROM page WHERE layout = 7
  UNION ALL SELECT b, 2, 'all', part, pos, i, nf, layout FROM page WHERE layout = 7),
grp AS (
  SELECT b, stars, mask, pos, i, nf, layout, row_number() OVER w - 1 AS seq, count(*) OVER whole AS k, count(*) FILTER (WHERE i <= nf) OVER whole AS held,
    min(pos) OVER whole AS lead, max(pos) OVER whole AS tail
  FROM found WINDOW whole AS (PARTITION BY b, stars, mask), w AS (PARTITION BY b, stars, mask ORDER BY pos)
  QUALIFY count(*) OVER whole > 1 AND count(*) FILTER (WHERE i <= nf) OVER whole > 0 AND (stars = 1 OR max(part) OVER whole > min(part) OVER whole)),
feed AS (SELECT b, i - 1 AS slot, CASE WHEN b % 3 = 0 THEN (i - 1) // 2 ELSE i - 1 END AS bucket, i FROM blog WHERE i <= nf)"""


def sorted_sql(enough: str) -> str:
    return f"""{GROUPS_SQL},
open AS (SELECT * FROM grp WHERE k >= nf AND {enough}),
target AS (SELECT b, stars, mask, bucket, row_number() OVER (PARTITION BY b, stars, mask ORDER BY slot) - 1 AS p FROM open JOIN feed USING (b, i)),
lists AS (
  SELECT b, stars, mask, k, lead, 'down' AS form, 0 AS rank, seq AS p, i FROM open
  UNION ALL SELECT b, stars, mask, k, lead, 'up', 1, k - 1 - seq, i FROM open
  UNION ALL SELECT b, stars, mask, k, lead, 'dated', 2, row_number() OVER (PARTITION BY b ORDER BY i) - 1, i FROM open WHERE layout = 3),
fit AS (
  SELECT l.b, l.stars, l.mask, l.k, l.lead, l.form, l.rank FROM lists l JOIN target t ON t.b = l.b AND t.stars = l.stars AND t.mask = l.mask AND t.p = l.p
  LEFT JOIN feed f ON f.b = l.b AND f.i = l.i GROUP BY ALL HAVING bool_and(coalesce(f.bucket = t.bucket, false))),
one AS (SELECT * FROM fit WHERE stars = 1 QUALIFY row_number() OVER (PARTITION BY b ORDER BY k DESC, lead, mask, rank) = 1),
kept AS (SELECT l.b, l.p, l.i, one.k FROM lists l JOIN one USING (b, stars, mask, form)),
held_by AS (
  SELECT l.b, l.mask, l.form, count(*) FILTER (WHERE kept.p = l.p) AS starts, count(*) FILTER (WHERE l.form = 'up' AND l.p = l.k - kept.k + kept.p) AS ends, any_value(kept.k) AS size
  FROM lists l JOIN kept ON kept.b = l.b AND kept.i = l.i WHERE l.stars = 2 GROUP BY ALL),
two AS (
  SELECT fit.* FROM fit LEFT JOIN one ON one.b = fit.b LEFT JOIN held_by h ON h.b = fit.b AND h.mask = fit.mask AND h.form = fit.form
  WHERE fit.stars = 2 AND (one.k IS NULL OR fit.k > one.k AND (h.starts = size OR h.ends = size OR fit.form = 'dated'))
  QUALIFY row_number() OVER (PARTITION BY fit.b ORDER BY fit.rank) = 1),
best AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


EXACT, ALMOST = "held = nf", "held < nf AND held >= CASE WHEN nf <= 3 THEN nf WHEN nf <= 7 THEN nf - 1 ELSE nf - 2 END"


def sorted_query(name: str, enough: str, almost: bool):
    @query(name, f"""WITH {sorted_sql(enough)} SELECT b AS page_id, stars, k AS n_links, form, form = 'dated' OR b % 8 = 3 AS has_dates,
      '{'archives_almost' if almost else 'archives'}' AS pattern FROM best""")
    def _(t):
        groups, feed = mined_archives(t)
        return A.sorted_lists(groups, feed, almost)[0].select("page_id", "stars", "n_links", "form", "has_dates", "pattern")

    @query(f"{name}_links", f"WITH {sorted_sql(enough)} SELECT b AS page_id, stars, p AS seq_pos, i FROM lists JOIN best USING (b, stars, mask, form)")
    def _(t):
        groups, feed = mined_archives(t)
        return A.sorted_lists(groups, feed, almost)[1].select("page_id", "stars", "seq_pos", post_number())


def post_number():
    return F.regexp_extract("key", r"-(\d+)\?$", 1).cast("long").alias("i")


sorted_query("g01_sorted_lists", EXACT, False)
sorted_query("g01_sorted_almost", ALMOST, True)


OPENINGS_SQL = f"""{GROUPS_SQL},
opening AS (
  SELECT g.b, g.mask, g.k, g.lead, g.tail FROM grp g JOIN feed spot ON spot.b = g.b AND spot.slot = g.seq LEFT JOIN feed f ON f.b = g.b AND f.i = g.i
  WHERE g.stars = 1 AND g.k < g.nf GROUP BY ALL HAVING bool_and(coalesce(f.bucket = spot.bucket, false)))"""

TWO_MASKS_SQL = f"""{OPENINGS_SQL},
starts AS (
  SELECT g.b, g.stars, g.mask, g.k, g.nf, g.lead, f.bucket, (SELECT max(slot) + 1 FROM feed x WHERE x.b = g.b AND x.bucket = f.bucket) AS next
  FROM grp g JOIN feed f ON f.b = g.b AND f.i = g.i WHERE g.seq = 0),
runs AS (
  SELECT s.*, coalesce((SELECT min(g.seq) FROM grp g LEFT JOIN feed f ON f.b = g.b AND f.i = g.i
    WHERE g.b = s.b AND g.stars = s.stars AND g.mask = s.mask AND f.bucket IS DISTINCT FROM s.bucket), k) AS run FROM starts s),
going AS (
  SELECT r.* FROM runs r WHERE next >= run AND NOT EXISTS (
    SELECT 1 FROM grp g JOIN feed spot ON spot.b = g.b AND spot.slot = g.seq + r.next - r.run LEFT JOIN feed f ON f.b = g.b AND f.i = g.i
    WHERE g.b = r.b AND g.stars = r.stars AND g.mask = r.mask AND g.seq >= r.run AND f.bucket IS DISTINCT FROM spot.bucket)),
pair AS (
  SELECT g.b, g.stars, g.mask, g.k + o.k AS total, o.k AS n_prefix, o.mask AS prefix_mask, g.lead
  FROM going g JOIN (SELECT * FROM opening QUALIFY row_number() OVER (PARTITION BY b, k ORDER BY lead, mask) = 1) o ON o.b = g.b AND o.k = g.next - g.run
  WHERE g.k + o.k >= g.nf AND o.tail < g.lead),
joined AS (
  SELECT p.b, p.stars, p.mask, g.seq AS p, g.i FROM pair p JOIN grp g ON g.b = p.b AND g.stars = 1 AND g.mask = p.prefix_mask
  UNION ALL SELECT p.b, p.stars, p.mask, p.n_prefix + g.seq, g.i FROM pair p JOIN grp g ON g.b = p.b AND g.stars = p.stars AND g.mask = p.mask),
fit AS (SELECT * FROM pair SEMI JOIN (SELECT b, stars, mask FROM joined GROUP BY ALL HAVING count(*) = count(DISTINCT i)) USING (b, stars, mask)),
one AS (SELECT * FROM fit WHERE stars = 1 QUALIFY row_number() OVER (PARTITION BY b ORDER BY total DESC, lead, mask) = 1),
two AS (
  SELECT * FROM fit WHERE stars = 2 AND NOT EXISTS (SELECT 1 FROM one WHERE one.b = fit.b AND (one.total >= fit.total OR one.total > (
    SELECT count(*) FROM joined x JOIN joined y ON x.b = y.b AND x.p = y.p AND x.i = y.i
    WHERE x.b = fit.b AND x.stars = 1 AND x.mask = one.mask AND y.stars = 2 AND y.mask = fit.mask)))),
best AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


@query("g04_two_mask_lists", f"WITH {TWO_MASKS_SQL} SELECT b AS page_id, stars, total AS n_links, n_prefix, 'two_masks' AS pattern FROM best")
def _(t):
    groups, feed = mined_archives(t)
    return A.two_mask_lists(groups, feed)[0].select("page_id", "stars", "n_links", "n_prefix", "pattern")


@query("g04_two_mask_links", f"WITH {TWO_MASKS_SQL} SELECT b AS page_id, stars, p AS seq_pos, i FROM joined JOIN best USING (b, stars, mask)")
def _(t):
    groups, feed = mined_archives(t)
    return A.two_mask_lists(groups, feed)[1].select("page_id", "stars", "seq_pos", post_number())


SHUFFLED_SQL = f"""{OPENINGS_SQL},
first AS (SELECT * FROM opening QUALIFY row_number() OVER (PARTITION BY b ORDER BY k DESC, lead, mask) = 1),
whole AS (
  SELECT g.b, g.stars, g.mask, g.k, g.lead, f.k AS n_prefix, f.mask AS prefix_mask FROM (SELECT DISTINCT b, stars, mask, k, nf, lead FROM grp) g JOIN first f ON f.b = g.b
  WHERE g.k >= g.nf AND NOT EXISTS (SELECT 1 FROM feed e WHERE e.b = g.b AND NOT EXISTS (
    SELECT 1 FROM grp x WHERE x.b = e.b AND x.i = e.i AND (x.stars = g.stars AND x.mask = g.mask OR x.stars = 1 AND x.mask = f.mask)))),
best AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY b, stars ORDER BY k DESC, lead, mask) = 1),
joined AS (
  SELECT s.b, s.stars, g.i, min(CASE WHEN g.stars = 1 AND g.mask = s.prefix_mask THEN g.seq ELSE 100000 + g.seq END) AS slot
  FROM best s JOIN grp g ON g.b = s.b AND (g.stars = s.stars AND g.mask = s.mask OR g.stars = 1 AND g.mask = s.prefix_mask) GROUP BY ALL)"""


@query("g07_shuffled_two_masks", f"""WITH {SHUFFLED_SQL}
    SELECT b AS page_id, stars, count(*) AS n_links, any_value(n_prefix) AS n_prefix, b % 16 = 6 OR b % 8 = 3 AS is_sorted, 'shuffled_two_masks' AS pattern
    FROM joined JOIN best USING (b, stars) GROUP BY b, stars""")
def _(t):
    groups, feed = mined_archives(t)
    return A.shuffled_two_mask_lists(groups, feed)[0].select("page_id", "stars", "n_links", "n_prefix", "is_sorted", "pattern")


@query("g07_shuffled_two_mask_links", f"""WITH {SHUFFLED_SQL}
    SELECT b AS page_id, stars, row_number() OVER (PARTITION BY b, stars ORDER BY CASE WHEN b % 16 = 6 THEN i ELSE slot END) - 1 AS seq_pos, i FROM joined""")
def _(t):
    groups, feed = mined_archives(t)
    return A.shuffled_two_mask_lists(groups, feed)[1].select("page_id", "stars", "seq_pos", post_number())


# All detectors on one set of mined pages; which list wins depends on the layout.
LEAST = "CASE WHEN nf <= 3 THEN nf WHEN nf <= 7 THEN nf - 1 ELSE nf - 2 END"
FINDINGS_SQL = f"""found AS (
  SELECT b, 0 AS stage, stars, n_links, has_dates, false AS sorted FROM (WITH {sorted_sql(EXACT)} SELECT b, stars, k AS n_links, b % 8 = 3 AS has_dates FROM best)
  UNION ALL SELECT b, 7, stars, n_links, has_dates, false FROM (WITH {sorted_sql(ALMOST)} SELECT b, stars, k AS n_links, b % 8 = 3 AS has_dates FROM best)
  UNION ALL SELECT b, 3, stars, n_links, false, false FROM (WITH {TWO_MASKS_SQL} SELECT b, stars, total AS n_links FROM best)
  UNION ALL SELECT b, 6, stars, n_links, false, sorted FROM (WITH {SHUFFLED_SQL}
    SELECT b, stars, count(*) AS n_links, b % 16 = 6 OR b % 8 = 3 AS sorted FROM joined JOIN best USING (b, stars) GROUP BY b, stars)
  UNION ALL SELECT b, stage, stars, max(n_links), dated, false FROM (WITH {GROUPS_SQL}
    SELECT b, stars, CASE WHEN k < nf THEN 4 WHEN held = nf THEN 5 ELSE 8 END AS stage, CASE WHEN k < nf THEN nf ELSE k END AS n_links,
      k >= nf AND (b % 16 = 6 OR b % 8 = 3) AS dated
    FROM grp WHERE seq = 0 AND held >= {LEAST} AND (k >= nf OR k = held)) GROUP BY ALL)"""


@query("g09_mined_cascade", f"""WITH RECURSIVE {FINDINGS_SQL},
    asked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY b ORDER BY stage, stars) AS turn FROM found),
    judged AS (
      SELECT DISTINCT b, 0::BIGINT AS turn, 0::BIGINT AS least, false AS dated, NULL::BIGINT AS main, []::BIGINT[] AS bundle FROM asked
      UNION ALL
      SELECT b, turn, CASE WHEN yes THEN n_links + 1 ELSE least END, CASE WHEN yes AND NOT apart THEN has_dates AND stage IN (0, 5, 6, 7, 8) ELSE dated END,
        CASE WHEN yes AND NOT apart THEN turn ELSE main END, CASE WHEN yes AND apart THEN list_append(bundle, turn) ELSE bundle END
      FROM (SELECT j.b, j.turn + 1 AS turn, j.least, j.dated, j.main, j.bundle, a.n_links, a.stage, a.has_dates, a.stage IN (5, 6, 8) AND NOT a.sorted AS apart,
          a.n_links >= j.least AND NOT (a.stage IN (5, 6, 8) AND j.dated) AS yes
        FROM judged j JOIN asked a ON a.b = j.b AND a.turn = j.turn + 1)),
    last AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY b ORDER BY turn DESC) = 1),
    parts AS (SELECT b, 'main' AS part, main AS turn FROM last WHERE main IS NOT NULL UNION ALL SELECT b, 'bundle', unnest(bundle) FROM last)
    SELECT b AS page_id, part, [{", ".join(f"'{p}'" for p in STAGES)}][stage + 1] AS pattern, stars, n_links FROM parts JOIN asked USING (b, turn)""")
def _(t):
    groups, feed = mined_archives(t)
    found = archive_candidates(
        A.sorted_lists(groups, feed)[0], A.two_mask_lists(groups, feed)[0], detect_almost_feed(groups, feed), detect_shuffled(groups, feed),
        A.shuffled_two_mask_lists(groups, feed)[0], A.sorted_lists(groups, feed, almost=True)[0])
    return found.select("page_id", "part", "pattern", "stars", "n_links")
