"""Page queries over the page snapshots and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import equalized_title, normalized_title, titles_roughly_equal
from feedlake.functions.urls import ARCHIVES_PATTERN, MAIN_PAGE_PATTERN, with_canonical
from feedlake.operators import pages as O
from feedlake.plans.registry import query
from feedlake.plans.run_b_urls import PAGE_LINKS_SQL
from feedlake.sources.adapters import ORDER_URLS_SQL, order_urls, page_hrefs

c = F.col


@query("e01_page_links_dom", f"WITH {PAGE_LINKS_SQL} SELECT page_id, server || path AS link_url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM page_links")
def _(t):
    from feedlake.functions.ordered import position_chunk, with_row_number

    links = O.page_links(t.pages)
    return with_row_number(links, ["page_id"], ["pos"], "n", position_chunk(c("pos"))).select("page_id", "link_url", "n")


@query("e01_page_links", f"WITH {PAGE_LINKS_SQL} SELECT host, path, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM page_links GROUP BY 1, 2")
def _(t):
    links = with_canonical(page_hrefs(t.pages), "href", "page_url")
    per_page = links.groupBy(c("parts.host").alias("host"), c("parts.path").alias("path"), "page_id").agg(F.count("*").alias("k"))
    return per_page.groupBy("host", "path").agg(F.sum("k").alias("n"), F.count("*").alias("n_pages"))


@query("e02_empty_anchors", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS txt FROM pages)
    SELECT page_id, count(*) * 3 - count(*) FILTER (WHERE txt = '') AS n_links FROM a GROUP BY 1""")
def _(t):
    # Every anchor once as it is, once empty and hidden, once empty with a label, and once more in full.
    doubled = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', '<a href="$1">$2</a><a href="$1"></a><a href="$1" aria-label="x"></a><a href="$1">y</a>')
    pages = t.pages.select("page_id", "url", doubled.alias("html"))
    return O.page_links(pages).groupBy("page_id").agg(F.count("*").alias("n_links"))


@query("e03_canonical_xpath", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS i FROM pages)
    SELECT page_id, '/html[1]/body[1]/nav[1]/ul[1]/li[' || (i + 1) || ']/a[1]' AS xpath FROM a""")
def _(t):
    # The raw position leaves out the index 1, as document positions usually do.
    links = O.page_links(t.pages).select("page_id", F.regexp_replace("xpath", r"\[1\]", "").alias("raw"))
    return links.select("page_id", O.canonical_xpath(c("raw")).alias("xpath"))


@query("e04_class_token", """SELECT c_custkey, 'a%5Bx%5D,' || lower(c_mktsegment) || ',z%2F%28' || c_custkey || '%29' AS token FROM customer""")
def _(t):
    classes = F.concat(F.lit(" z/("), c("c_custkey").cast("string"), F.lit(") post-"), c("c_custkey").cast("string"), F.lit("  "),
                       F.lower("c_mktsegment"), F.lit(" a[x]"))
    return t.customer.select("c_custkey", O.class_token(classes).alias("token"))


@query("e05_page_text_nodes", r"""WITH h AS (SELECT page_id, html, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title>.*?</title>', '', 'g') AS body FROM pages),
    t AS (SELECT page_id, unnest(regexp_extract_all(body, '>([^<]+)', 1)) AS txt FROM h)
    SELECT page_id, 'text' AS kind, count(*) AS n FROM t WHERE regexp_matches(txt, '\S') GROUP BY 1
    UNION ALL SELECT page_id, 'a', len(regexp_extract_all(html, '<a href=')) FROM h UNION ALL SELECT page_id, 'title', 1 FROM h WHERE regexp_matches(html, '<title>[^<]*\S') UNION ALL SELECT page_id, 'meta', len(regexp_extract_all(html, '<meta ')) FROM h""")
def _(t):
    return O.nodes(t.pages).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


DATE_FORMS = ["dd MMM yyyy", "MMMM d, yyyy", "'Posted on' yyyy-MM-dd HH:mm", "yyyy MMM d -", "dd-MM-yyyy", "MMMM yyyy", "MM/dd/yyyy", "MMM d ''yy", "MMM d"]


@query("e06_text_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1, 2, 3, 4, 7) THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN o_orderkey % 9 = 8 THEN '2000' || strftime(o_orderdate, '-%m-%d') END AS text_date FROM orders""")
def _(t):
    k = c("o_orderkey")
    text = F.coalesce(*[F.when(k % 9 == i, F.date_format("o_orderdate", form)) for i, form in enumerate(DATE_FORMS)])
    rows = O.text_dates(t.orders.select(k, F.concat(F.lit("  "), text, F.lit("\n")).alias("text")), "text", F.lit(2000))
    return rows.select("o_orderkey", F.date_format("text_date", "yyyy-MM-dd").alias("text_date"))


# One title for each line of a document.
TITLE_SQL = """lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
titles AS (SELECT doc_id, line_no, source, ' ' || replace(line, ' ', '  ') || chr(13) || chr(10) || '“End”… ' AS raw FROM lines),
norm AS (SELECT doc_id, line_no, source, regexp_replace(replace(trim(raw), chr(13) || chr(10), ' '), ' +', ' ', 'g') AS title FROM titles)"""


def titles(t):
    lines = t.documents.select("doc_id", c("source").alias("blog_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    raw = F.concat(F.lit(" "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit("\r\n“End”… "))
    return lines.select("doc_id", c("line_no").cast("long").alias("line_no"), "blog_id", normalized_title(raw).alias("title"))


@query("e07_normalize_titles", f"WITH {TITLE_SQL} SELECT doc_id, line_no, md5(title) AS title_md5, md5(lower(replace(replace(replace(title, '“', '\"'), '”', '\"'), '…', '...'))) AS equalized_md5 FROM norm")
def _(t):
    return O.equalize_titles(titles(t)).select("doc_id", "line_no", F.md5("title").alias("title_md5"), F.md5("equalized").alias("equalized_md5"))


@query("e07_titles_roughly_equal", f"WITH {TITLE_SQL} SELECT doc_id, line_no, doc_id % 3 <> 2 AS is_close FROM norm")
def _(t):
    title = c("title")
    other = F.when(c("doc_id") % 3 == 0, F.replace(F.replace(F.upper(title), F.lit("“"), F.lit('"')), F.lit("…"), F.lit("..."))).when(
        c("doc_id") % 3 == 1, F.concat(F.regexp_replace(title, "…$", ""), F.lit(" and more"))).otherwise(F.concat(F.lit("x"), title))
    # Upper-casing is not reversible for every letter, so those titles are compared in lower case.
    base = F.when(c("doc_id") % 3 == 0, equalized_title(F.upper(title))).otherwise(title)
    return titles(t).select("doc_id", "line_no", titles_roughly_equal(base, other).alias("is_close"))


@query("e08_page_titles", """SELECT page_id, regexp_replace(CASE WHEN page_id % 2 = 0 THEN 'Og ' || page_id ELSE nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') END, ' +', ' ', 'g') AS title FROM pages""")
def _(t):
    og = F.when(c("page_id") % 2 == 0, F.concat(F.lit('<meta property="og:title" content="Og '), c("page_id").cast("string"), F.lit('">'))).otherwise("")
    return O.page_titles(t.pages.select("page_id", F.concat(og, c("html")).alias("html")))


def page_title_rows(t):
    # Blogs share a prefix; two thirds of them share a suffix, too.
    title = F.concat(F.lit("Blog "), c("blog_id"), F.lit(": "), c("doc_id").cast("string"), F.lit(" t"), (c("doc_id") % 7).cast("string"),
                     F.when(F.length("blog_id") % 3 == 0, "").otherwise("... - The End"))
    return t.documents.select("doc_id", c("source").alias("blog_id")).select("blog_id", "doc_id", title.alias("title"))


AFFIX_SQL = """rows AS (SELECT source AS blog_id, doc_id, doc_id || ' t' || (doc_id % 7) AS core, 'Blog ' || source || ': ' AS p, CASE WHEN length(source) % 3 = 0 THEN '' ELSE '... - The End' END AS s FROM documents),
ends AS (SELECT blog_id, min(core) AS a, max(core) AS b, min(reverse(core)) AS x, max(reverse(core)) AS y, any_value(p) AS p, any_value(s) AS s, min(length(p || core || s)) AS shortest, count(*) AS n FROM rows GROUP BY 1),
lens AS (SELECT *, coalesce(list_max(list_filter(range(0, 40), lambda i: a[:i] = b[:i] AND i <= length(a) AND i <= length(b))), 0) AS pl, coalesce(list_max(list_filter(range(0, 40), lambda i: x[:i] = y[:i] AND i <= length(x) AND i <= length(y))), 0) AS sl FROM ends),
cut AS (SELECT blog_id, n, shortest, p || left(a, pl::INT) AS prefix, CASE WHEN s = '' THEN right(a, sl::INT) WHEN sl = 0 THEN s[4:] ELSE right(a, sl::INT) || s END AS suffix FROM lens)"""


@query("e09_common_affixes", f"WITH {AFFIX_SQL} SELECT blog_id, n AS n_titles, CASE WHEN length(prefix) + length(suffix) >= shortest THEN '' ELSE prefix END AS prefix, CASE WHEN length(prefix) + length(suffix) >= shortest THEN '' ELSE suffix END AS suffix FROM cut")
def _(t):
    return O.common_affixes(page_title_rows(t))


@query("e09_strip_common_affixes", f"""WITH {AFFIX_SQL}, f AS (SELECT blog_id, CASE WHEN length(prefix) + length(suffix) >= shortest THEN '' ELSE prefix END AS prefix, CASE WHEN length(prefix) + length(suffix) >= shortest THEN '' ELSE suffix END AS suffix FROM cut)
    SELECT doc_id, CASE WHEN length(blog_id) % 2 = 0 THEN (p || core || s)[length(prefix) + 1:length(p || core || s) - length(suffix)] ELSE p || core || s END AS title FROM rows JOIN f USING (blog_id)""")
def _(t):
    rows = page_title_rows(t)
    # Half of the lists hold more links than page titles, and their first title does not fit.
    sizes = rows.groupBy("blog_id").agg(F.count("*").alias("n")).select("blog_id", F.when(F.length("blog_id") % 2 == 0, c("n")).otherwise(c("n") + 1).alias("n_links"))
    first = sizes.select("blog_id", F.lit("No such title").alias("page_title"))
    return O.strip_common_affixes(rows, sizes, first).select("doc_id", "title")


FILL_SQL = """l AS (SELECT o_custkey AS blog_id, o_orderkey AS key, 'https://b/' || o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'Own ' || o_orderkey END AS own, CASE WHEN o_orderkey % 3 = 0 THEN 'Page ' || o_orderkey END AS page FROM orders),
n AS (SELECT blog_id, count(*) AS nl FROM l GROUP BY 1),
feed AS (SELECT o_custkey AS blog_id, o_orderkey AS key, 'Feed ' || o_orderkey AS title FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, -o_orderkey - 1, 'Old' FROM orders WHERE o_custkey % 2 = 0),
nf AS (SELECT blog_id, count(*) AS nf FROM feed GROUP BY 1),
filled AS (SELECT l.blog_id, url, CASE WHEN own IS NOT NULL THEN 'innertext' WHEN nl <= nf AND f.title IS NOT NULL THEN 'feed' WHEN page IS NOT NULL THEN 'page_title' ELSE 'page_url' END AS source,
  coalesce(own, CASE WHEN nl <= nf THEN f.title END, page, url) AS title FROM l JOIN n USING (blog_id) LEFT JOIN nf USING (blog_id) LEFT JOIN feed f ON f.blog_id = l.blog_id AND f.key = l.key)"""


def filled(t):
    k = c("o_orderkey")

    def named(prefix, condition):
        return F.when(condition, F.concat(F.lit(prefix), k.cast("string")))

    url = F.concat(F.lit("https://b/"), k.cast("string"))
    links = t.orders.select(c("o_custkey").alias("blog_id"), k.alias("key"), url.alias("url"), named("Own ", k % 4 == 0).alias("title"),
                            F.when(k % 4 == 0, "innertext").alias("source"))
    feed = t.orders.where(k % 2 == 0).select(c("o_custkey").alias("blog_id"), k.alias("key"), named("Feed ", F.lit(True)).alias("title")).unionByName(
        t.orders.where("o_custkey % 2 = 0").select(c("o_custkey").alias("blog_id"), (-k - 1).alias("key"), F.lit("Old").alias("title")))
    pages = t.orders.where(k % 3 == 0).select(url.alias("url"), named("Page ", F.lit(True)).alias("title"))
    return O.fill_titles(links, feed, pages)


@query("e10_fill_titles", f"WITH {FILL_SQL} SELECT url, title, source FROM filled")
def _(t):
    return filled(t).select("url", "title", "source")


@query("e11_title_source_counts", f"WITH {FILL_SQL} SELECT blog_id, source, count(*) AS n FROM filled GROUP BY 1, 2")
def _(t):
    return O.title_source_counts(filled(t))


@query("e12_common_links", f"""WITH {PAGE_LINKS_SQL}, pairs AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS blog_id, min(page_id) AS page_a, max(page_id) AS page_b FROM pages GROUP BY 1),
    b AS (SELECT blog_id, page_a, l.page_id, host || path AS canonical, min(pos) AS pos FROM page_links l JOIN pairs ON page_b = l.page_id GROUP BY ALL)
    SELECT blog_id, page_id, canonical, pos FROM b WHERE EXISTS (SELECT 1 FROM page_links a WHERE a.page_id = page_a AND a.host || a.path = b.canonical)""")
def _(t):
    links = with_canonical(page_hrefs(t.pages), "href", "page_url").select("page_id", "pos", "canonical", "key")
    pairs = t.pages.groupBy(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("blog_id")).agg(
        F.min("page_id").alias("page_a"), F.max("page_id").alias("page_b"))
    return O.common_links(links, pairs).select("blog_id", "page_id", "canonical", "pos")


@query("e13_candidate_pages", f"""WITH {ORDER_URLS_SQL},
    l AS (SELECT site_id AS blog_id, CASE WHEN url_id % 2 = 0 THEN 'start_page' ELSE 'two_entries' END AS source, url_id AS pos, key, trimmed_path,
        host || port || '/' || trimmed_path || '?' AS queryless_key, len(trimmed_path) - len(replace(trimmed_path, '/', '')) AS depth,
        regexp_matches(trimmed_path, '{O.YEAR_ARCHIVE_PATTERN}') AS yearly,
        CASE WHEN regexp_matches(trimmed_path, '{ARCHIVES_PATTERN}') THEN 'archives' WHEN regexp_matches(trimmed_path, '{MAIN_PAGE_PATTERN}') THEN 'main_page' ELSE 'other' END AS role
      FROM links WHERE reject IS NULL),
    fed AS MATERIALIZED (SELECT DISTINCT blog_id, key FROM l WHERE pos % 5 = 0),
    f AS (SELECT l.*, fed.key IS NOT NULL AS in_feed FROM l LEFT JOIN fed ON fed.blog_id = l.blog_id AND fed.key = l.key),
    g AS (SELECT *, count(*) FILTER (WHERE role = 'other' AND source = 'two_entries' AND NOT in_feed) OVER (PARTITION BY blog_id) AS crowd FROM f)
    SELECT blog_id, queryless_key, role, source, pos FROM g
    WHERE role <> 'other' OR (source = 'two_entries' AND NOT in_feed AND (NOT yearly OR crowd <= 10)) OR (source = 'start_page' AND depth <= 1 AND NOT yearly)
    QUALIFY row_number() OVER (PARTITION BY blog_id, queryless_key ORDER BY CASE role WHEN 'archives' THEN 0 WHEN 'main_page' THEN 1 ELSE 2 END, source, pos) = 1""")
def _(t):
    links = with_canonical(order_urls(t.orders), "raw_url", "base_url").where("reject is null").select(
        c("site_id").alias("blog_id"), F.when(c("url_id") % 2 == 0, "start_page").otherwise("two_entries").alias("source"),
        c("url_id").alias("pos"), "parts", "key")
    entries = links.where("pos % 5 = 0").select("blog_id", "key", F.lit(2).alias("depth"))
    return O.candidate_pages(links, entries).select("blog_id", "queryless_key", "role", "source", "pos")
