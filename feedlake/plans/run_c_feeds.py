"""Feed queries: documents are rendered from orders and line items by Spark, then parsed, ordered and matched."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.ordered import position_chunk, with_row_number
from feedlake.operators import feeds as O
from feedlake.operators import seqmatch as S
from feedlake.plans.registry import query
from feedlake.session import checkpointed, checkpointed_pages, deal, discard

c = F.col


def text(col):
    return col.cast("string")


def feed_docs(t):
    """One document per order: rss, rdf and atom by turns, every 17th an html page."""
    k = c("l_orderkey")
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    grouped = t.lineitem.groupBy(k.alias("feed_id")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    f = c("feed_id")

    def dated(e, open_tag, close_tag, pattern):
        stamp = F.concat(F.lit(open_tag), F.date_format(e["l_shipdate"], pattern), F.lit(close_tag))
        return F.when((f % 5 == 0) & (e["l_linenumber"] == 1), F.lit("")).otherwise(stamp)

    def url(e):
        return F.concat(F.lit("https://f"), text(f % 97), F.lit(".example.com/p/"), text(e["l_partkey"]))

    def title(e):
        return F.concat(F.lit("<title>Post &amp;amp; "), text(e["l_partkey"]), F.lit(" <![CDATA[é <x> ]]></title>"))

    rss = F.array_join(F.transform("e", lambda e: F.concat(
        F.lit("<item>"), title(e), F.lit("<link>"), url(e), F.lit("</link>"),
        dated(e, "<pubDate>", " GMT</pubDate>", "EEE, dd MMM yyyy HH:mm:ss"), F.lit("</item>\n"))), "")
    rdf = F.array_join(F.transform("e", lambda e: F.concat(
        F.lit("<item>"), title(e), F.lit("<link>"), url(e), F.lit("</link>"),
        dated(e, "<dc:date>", "</dc:date>", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("</item>\n"))), "")
    atom = F.array_join(F.transform("e", lambda e: F.concat(
        F.lit("<entry>"), title(e), F.lit('<link rel="self" href="x"/><link rel="alternate" href="'), url(e), F.lit('"/>'),
        dated(e, "<published>", "</published>", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("</entry>\n"))), "")
    root = F.concat(F.lit("https://f"), text(f % 97), F.lit(".example.com/"))
    content = (
        F.when(f % 17 == 0, F.lit("<!DOCTYPE html><html><body>Gone</body></html>"))
        .when(f % 3 == 0, F.concat(
            F.lit('<?xml version="1.0"?>\n<rss version="2.0"><channel><title>Feed &amp;#233; '), text(f), F.lit("</title><link>"), root,
            F.lit("</link><generator>Medium</generator>"), rss, F.lit("</channel></rss>")))
        .when(f % 3 == 1, F.concat(
            F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" '
                  'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><link>'), root, F.lit("</link></channel>"), rdf, F.lit("</rdf:RDF>")))
        .otherwise(F.concat(
            F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom '), text(f), F.lit('</title><link href="'), root,
            F.lit('"/><generator uri="x">Blogger</generator>'), atom, F.lit("</feed>"))))
    return grouped.select("feed_id", F.concat(F.lit("https://f"), text(f % 97), F.lit(".example.com/feed.xml")).alias("fetch_url"),
                          content.alias("content"))


DOCS_SQL = """docs AS (SELECT DISTINCT l_orderkey AS feed_id FROM lineitem),
lines AS (SELECT l_orderkey AS feed_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
  l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_orderkey % 17 <> 0)"""


@query("c01_classify_feeds", f"WITH {DOCS_SQL} SELECT feed_id, CASE WHEN feed_id % 17 = 0 THEN NULL WHEN feed_id % 3 = 0 THEN 'rss' WHEN feed_id % 3 = 1 THEN 'rdf' ELSE 'atom' END AS feed_kind FROM docs")
def _(t):
    return O.classify_feeds(feed_docs(t)).select("feed_id", "feed_kind")


@query("c02_parse_feeds", f"""WITH {DOCS_SQL} SELECT feed_id, pos, 'Post & ' || l_partkey || ' é <x> ' AS title, false AS feed_error,
      CASE WHEN NOT (feed_id % 5 = 0 AND l_linenumber = 1) THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS date,
      'https://f' || (feed_id % 97) || '.example.com/p/' || l_partkey AS url FROM lines
    UNION ALL SELECT feed_id, NULL, NULL, true, NULL, NULL FROM docs WHERE feed_id % 17 = 0""")
def _(t):
    return O.parse_feeds(feed_docs(t)).select(
        "feed_id", "pos", F.when(c("title").isNotNull(), F.concat("title", F.lit(" "))).alias("title"), "feed_error",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "url")


@query("c03_feed_metadata", f"""WITH {DOCS_SQL} SELECT feed_id, CASE WHEN feed_id % 17 = 0 OR feed_id % 3 = 1 THEN 'f' || (feed_id % 97) || '.example.com' WHEN feed_id % 3 = 0 THEN 'Feed é ' || feed_id ELSE 'Atom ' || feed_id END AS title,
    CASE WHEN feed_id % 17 = 0 OR feed_id % 3 = 1 THEN NULL WHEN feed_id % 3 = 0 THEN 'medium' ELSE 'blogger' END AS generator,
    CASE WHEN feed_id % 17 <> 0 THEN 'https://f' || (feed_id % 97) || '.example.com/' END AS root_url FROM docs""")
def _(t):
    return O.feed_metadata(feed_docs(t)).select("feed_id", "title", "generator", "root_url")


@query("c04_decode_titles", """SELECT doc_id, md5(replace(text, '&', '+') || ' & <é> ' || chr(10) || '€ &unknown;') AS title_md5 FROM documents""")
def _(t):
    whole = F.replace("text", F.lit("&"), F.lit("+"))
    df = t.documents.select("doc_id", F.concat(whole, F.lit(" &amp; &lt;&eacute;&gt; <br/>&#8364; &unknown;")).alias("title"))
    return O.decode_titles(df).select("doc_id", F.md5("title").alias("title_md5"))


# Entries straight from line items: dates are cut to years, so that ties occur.
ENTRIES_SQL = """base AS (SELECT l_orderkey AS feed_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
  CASE WHEN l_orderkey % 6 = 0 THEN NULL WHEN l_orderkey % 6 = 1 THEN date_trunc('year', min(l_shipdate) OVER (PARTITION BY l_orderkey)) WHEN l_orderkey % 6 = 2 THEN make_timestamp(2000 + l_linenumber::BIGINT, 1, 1, 0, 0, 0.0)
    WHEN l_orderkey % 6 = 3 THEN make_timestamp(2000 - l_linenumber::BIGINT, 1, 1, 0, 0, 0.0) ELSE date_trunc('year', l_shipdate)::TIMESTAMP END AS date, l_partkey % 50 AS key FROM lineitem),
stepped AS (SELECT *, lag(date) OVER (PARTITION BY feed_id ORDER BY pos) AS prev FROM base),
shape AS (SELECT feed_id, count(*) AS n, bool_or(date IS NULL) AS missing, coalesce(bool_or(prev < date), false) AS rises, coalesce(bool_or(prev > date), false) AS falls FROM stepped GROUP BY 1),
ordered AS (SELECT b.feed_id, b.key, b.date, NOT (missing OR n < 2) AS order_certain, CASE WHEN missing OR n < 2 THEN b.pos WHEN rises AND falls THEN row_number() OVER (PARTITION BY b.feed_id ORDER BY b.date DESC, b.pos) - 1
  WHEN NOT falls THEN n - 1 - b.pos ELSE b.pos END AS pos FROM base b JOIN shape USING (feed_id)),
entries AS (SELECT *, sum(CASE WHEN NOT order_certain OR prev IS NULL OR prev <> date THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY pos)::BIGINT AS bucket
  FROM (SELECT *, lag(date) OVER (PARTITION BY feed_id ORDER BY pos) AS prev FROM ordered))"""


def raw_entries(t):
    k = c("l_orderkey")
    lines = deal(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), "l_orderkey")
    firsts = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("_first"))
    year = F.when(k % 6 == 2, 2000 + c("l_linenumber")).otherwise(2000 - c("l_linenumber"))
    made = F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    date = F.when(k % 6 == 1, F.date_trunc("year", "_first")).when((k % 6).isin(2, 3), made).when(k % 6 != 0, F.date_trunc("year", "l_shipdate"))
    rows = lines.join(firsts, "l_orderkey").select(
        k.alias("feed_id"), "l_linenumber", "l_partkey", "l_suppkey", date.alias("date"), (c("l_partkey") % 50).alias("key"))
    ranked = with_row_number(rows, ["feed_id"], ["l_linenumber", "l_partkey", "l_suppkey"], "_n", position_chunk(c("l_linenumber")))
    return ranked.select("feed_id", (c("_n") - 1).alias("pos"), "date", "key")


def entries(t):
    """The entry table is read many times by the matching queries, so it is materialised once, in buckets by feed: a feed is one document."""
    raw = checkpointed_pages(raw_entries(t), "feed_id", dealt=True)
    ordered = checkpointed_pages(O.infer_feed_order(raw), "feed_id", dealt=True)
    discard(raw)
    bucketed = checkpointed_pages(O.bucket_entries(ordered), "feed_id", dealt=True)
    discard(ordered)
    return bucketed


@query("c05_infer_feed_order", f"WITH {ENTRIES_SQL} SELECT feed_id, pos, key, order_certain FROM ordered")
def _(t):
    return O.infer_feed_order(raw_entries(t)).select("feed_id", "pos", "key", "order_certain")


@query("c06_bucket_entries", f"WITH {ENTRIES_SQL} SELECT feed_id, pos, key, bucket FROM entries")
def _(t):
    return entries(t).select("feed_id", "pos", "key", "bucket")


def members(e):
    """Half of the feeds lack the entries of every fifth key."""
    return e.where("feed_id % 2 = 0 or key % 5 <> 0").select("feed_id", "key")


MEMBERS_SQL = f"""{ENTRIES_SQL}, members AS (SELECT DISTINCT feed_id, key FROM entries WHERE feed_id % 2 = 0 OR key % 5 <> 0),
flagged AS (SELECT e.*, m.key IS NOT NULL AS included FROM entries e LEFT JOIN members m ON m.feed_id = e.feed_id AND m.key = e.key)"""


@query("c07_filter_included", f"WITH {MEMBERS_SQL} SELECT feed_id, key, bucket, row_number() OVER (PARTITION BY feed_id ORDER BY pos) - 1 AS pos FROM flagged WHERE included")
def _(t):
    e = entries(t)
    return S.filter_included(e, members(e)).select("feed_id", "key", "bucket", "pos")


@query("c07_except_keys", f"WITH {MEMBERS_SQL} SELECT feed_id, key, bucket, row_number() OVER (PARTITION BY feed_id ORDER BY pos) - 1 AS pos FROM flagged WHERE NOT included")
def _(t):
    e = entries(t)
    return S.except_keys(e, members(e)).select("feed_id", "key", "bucket", "pos")


@query("c07_count_included", f"WITH {MEMBERS_SQL} SELECT feed_id, count(*) AS n_entries, count(*) FILTER (WHERE included) AS n_included, bool_and(included) AS all_included FROM flagged GROUP BY 1")
def _(t):
    e = entries(t)
    return S.count_included(e, members(e))


@query("c08_included_prefix_length", f"""WITH {MEMBERS_SQL}, b AS (SELECT feed_id, bucket, count(*) AS n, count(*) FILTER (WHERE included) AS k FROM flagged GROUP BY 1, 2),
    s AS (SELECT feed_id, min(bucket) FILTER (WHERE k < n) AS stop FROM b GROUP BY 1)
    SELECT feed_id, sum(k)::BIGINT AS prefix_length FROM b JOIN s USING (feed_id) WHERE stop IS NULL OR bucket <= stop GROUP BY 1""")
def _(t):
    e = entries(t)
    return S.included_prefix_length(e, members(e))


def candidates(e):
    """Lists made from the feeds: in bucket order for two thirds, else by key; every fourth starts one entry late."""
    lead = F.when(c("feed_id") % 3 == 2, 0).otherwise(c("bucket"))
    rows = e.where(~((c("feed_id") % 4 == 0) & (c("pos") == 0))).select("feed_id", lead.alias("_lead"), "key", "pos")
    ranked = with_row_number(rows, ["feed_id"], ["_lead", c("key").desc(), "pos"], "_n", position_chunk(c("_lead")))
    return checkpointed_pages(ranked.select("feed_id", (c("_n") - 1).alias("seq_pos"), "key"), "feed_id", dealt=True)


SEQ_SQL = f"""{ENTRIES_SQL}, seq AS (SELECT feed_id, key, row_number() OVER (PARTITION BY feed_id ORDER BY CASE WHEN feed_id % 3 = 2 THEN 0 ELSE bucket END, key DESC, pos) - 1 AS seq_pos
  FROM entries WHERE NOT (feed_id % 4 = 0 AND pos = 0)),
in_bucket AS (SELECT DISTINCT feed_id, bucket, key FROM entries), feeds AS (SELECT feed_id, count(*) AS n FROM entries GROUP BY 1)"""


@query("c09_sequence_match", f"""WITH {SEQ_SQL}, placed AS (SELECT s.feed_id, i.key IS NOT NULL AS hit FROM seq s JOIN entries e ON e.feed_id = s.feed_id AND e.pos = s.seq_pos
      LEFT JOIN in_bucket i ON i.feed_id = s.feed_id AND i.bucket = e.bucket AND i.key = s.key)
    SELECT f.feed_id, coalesce(bool_and(hit), true) AS is_match, count(*) FILTER (WHERE hit) AS n_matched FROM feeds f LEFT JOIN placed p USING (feed_id) GROUP BY 1""")
def _(t):
    e = entries(t)
    return S.sequence_match(e, candidates(e))


@query("c10_match_except_first", f"""WITH {SEQ_SQL}, fb AS (SELECT e.feed_id, e.bucket, count(*) AS b FROM entries e JOIN (SELECT feed_id, min(bucket) AS bucket FROM entries GROUP BY 1) m USING (feed_id, bucket) GROUP BY 1, 2),
    lens AS (SELECT feed_id, count(*) AS len FROM seq GROUP BY 1),
    lead AS (SELECT s.feed_id, s.key, row_number() OVER (PARTITION BY s.feed_id, s.key ORDER BY seq_pos) AS occ FROM seq s JOIN fb USING (feed_id) WHERE seq_pos < b - 1),
    first AS (SELECT e.feed_id, e.key, e.pos, row_number() OVER (PARTITION BY e.feed_id, e.key ORDER BY pos) AS occ FROM entries e JOIN fb USING (feed_id, bucket)),
    wrong AS (SELECT feed_id, count(*) AS w FROM lead l WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.feed_id = l.feed_id AND f.key = l.key AND f.occ = l.occ) GROUP BY 1),
    spare AS (SELECT feed_id, min_by(key, pos) AS first_key FROM first f WHERE NOT EXISTS (SELECT 1 FROM lead l WHERE f.feed_id = l.feed_id AND f.key = l.key AND f.occ = l.occ) GROUP BY 1),
    tail AS (SELECT s.feed_id, bool_and(i.key IS NOT NULL) AS follows FROM seq s JOIN fb USING (feed_id) JOIN entries e ON e.feed_id = s.feed_id AND e.pos = s.seq_pos + 1
      LEFT JOIN in_bucket i ON i.feed_id = s.feed_id AND i.bucket = e.bucket AND i.key = s.key WHERE seq_pos >= b - 1 GROUP BY 1),
    r AS (SELECT f.feed_id, n, first_key, CASE WHEN n = 1 THEN true WHEN coalesce(len, 0) < b - 1 THEN false ELSE w IS NULL AND coalesce(follows, true) END AS is_match
      FROM feeds f JOIN fb USING (feed_id) LEFT JOIN lens USING (feed_id) LEFT JOIN wrong USING (feed_id) LEFT JOIN spare USING (feed_id) LEFT JOIN tail USING (feed_id))
    SELECT feed_id, is_match, CASE WHEN is_match AND n > 1 THEN first_key END AS first_key FROM r""")
def _(t):
    e = entries(t)
    return S.match_except_first(e, candidates(e))


@query("c11_sequence_is_suffix", f"""WITH {SEQ_SQL}, st AS (SELECT e.feed_id, min(bucket) AS start FROM entries e JOIN seq s ON s.feed_id = e.feed_id AND s.key = e.key AND seq_pos = 0 GROUP BY 1),
    nx AS (SELECT feed_id, start, count(*) FILTER (WHERE bucket <= start) AS nxt FROM entries JOIN st USING (feed_id) GROUP BY 1, 2),
    rn AS (SELECT s.feed_id, coalesce(min(seq_pos) FILTER (WHERE i.key IS NULL), count(*)) AS run FROM seq s JOIN st USING (feed_id) LEFT JOIN in_bucket i ON i.feed_id = s.feed_id AND i.bucket = start AND i.key = s.key GROUP BY 1),
    tail AS (SELECT s.feed_id, bool_and(i.key IS NOT NULL) AS follows, count(*) FILTER (WHERE i.key IS NOT NULL) AS hits FROM seq s JOIN rn USING (feed_id) JOIN nx USING (feed_id) JOIN entries e ON e.feed_id = s.feed_id AND e.pos = seq_pos - run + nxt
      LEFT JOIN in_bucket i ON i.feed_id = s.feed_id AND i.bucket = e.bucket AND i.key = s.key WHERE seq_pos >= run GROUP BY 1),
    r AS (SELECT f.feed_id, start IS NOT NULL AND coalesce(follows, true) AS ok, run, nxt, hits FROM feeds f LEFT JOIN nx USING (feed_id) LEFT JOIN rn USING (feed_id) LEFT JOIN tail USING (feed_id))
    SELECT feed_id, ok AS is_suffix, CASE WHEN ok THEN run + coalesce(hits, 0) END AS n_matched, CASE WHEN ok THEN nxt - run END AS prefix_length FROM r""")
def _(t):
    e = entries(t)
    return S.sequence_is_suffix(e, candidates(e))


def linked_entries(t):
    """Feed entries as links; stored posts are the feed without its newest entries, in feed order for most feeds."""
    url = F.concat(F.lit("https://f"), text(c("feed_id") % 97), F.lit(".example.com/p/"), text(c("pos")))
    rows = entries(t).withColumns({"link_url": url, "title": F.concat(F.lit("Post "), text(c("pos")))}).drop("key")
    return checkpointed(U.with_canonical(rows, "link_url", prefix="_x").select(
        "feed_id", "pos", "bucket", "title", "link_url", F.col("_xparts").alias("parts")))


def stored(t):
    e = linked_entries(t)
    fresh = c("feed_id") % 3
    kept = e.where((c("pos") >= fresh) & (c("pos") != fresh + 1)).select("feed_id", "pos", c("link_url").alias("url"))
    swapped = kept.withColumn("pos", F.when((c("feed_id") % 5 == 0), -c("pos")).otherwise(c("pos")))
    discarded = e.where(c("pos") == fresh + 1).select("feed_id", "pos", c("link_url").alias("url"))
    extra = e.where("pos = 0").select("feed_id", F.lit(-1000).cast("long").alias("pos"), F.concat("link_url", F.lit("-missing")).alias("url"))
    rules = e.select("feed_id").distinct().select("feed_id", F.array().cast("array<string>").alias("same_hosts"), F.lit(False).alias("expect_post_paths"))
    return e, swapped.unionByName(extra), discarded, extra, rules


# Positions are the urls, so the comparison can be said in positions: posts p >= fresh without fresh + 1, reversed for every fifth feed.
UPDATE_SQL = f"""{ENTRIES_SQL}, e AS (SELECT feed_id, pos, bucket, feed_id % 3 AS fresh FROM entries),
kept AS (SELECT feed_id, bucket, pos, fresh, row_number() OVER (PARTITION BY feed_id ORDER BY pos) - 1 AS fp FROM e WHERE pos <> fresh + 1),
counts AS (SELECT feed_id, count(*) FILTER (WHERE pos < fresh) AS n_new, count(*) FILTER (WHERE pos >= fresh) AS n_included FROM kept GROUP BY 1),
seq AS (SELECT feed_id, pos, bucket, row_number() OVER (PARTITION BY feed_id ORDER BY CASE WHEN feed_id % 5 = 0 THEN -pos ELSE pos END) - 1 AS sp FROM kept WHERE pos >= fresh),
st AS (SELECT feed_id, bucket AS start FROM seq WHERE sp = 0),
nx AS (SELECT k.feed_id, start, count(*) FILTER (WHERE bucket <= start) AS nxt FROM kept k JOIN st USING (feed_id) GROUP BY 1, 2),
rn AS (SELECT s.feed_id, coalesce(min(sp) FILTER (WHERE bucket <> start), count(*)) AS run FROM seq s JOIN st USING (feed_id) GROUP BY 1),
tail AS (SELECT s.feed_id, bool_and(s.bucket = k.bucket) AS follows, count(*) AS hits FROM seq s JOIN rn USING (feed_id) JOIN nx USING (feed_id) JOIN kept k ON k.feed_id = s.feed_id AND k.fp = sp - run + nxt WHERE sp >= run GROUP BY 1),
outcomes AS (SELECT feed_id, n_new, n_included, CASE WHEN n_new = 0 THEN 'no_new' WHEN n_included < 3 THEN 'mismatch' WHEN NOT coalesce(follows, true) THEN 'mismatch'
  WHEN run + coalesce(hits, 0) <> n_included THEN 'mismatch' ELSE 'new' END AS outcome FROM counts LEFT JOIN rn USING (feed_id) LEFT JOIN tail USING (feed_id))"""


@query("c12_update_outcomes", f"WITH {UPDATE_SQL} SELECT feed_id, outcome, n_new, n_included FROM outcomes")
def _(t):
    return S.new_posts_from_feeds(*stored(t))[0]


@query("c12_new_posts", f"WITH {UPDATE_SQL} SELECT feed_id, fp AS pos, 'Post ' || pos AS title FROM kept JOIN outcomes USING (feed_id) WHERE outcome = 'new' AND fp < n_new")
def _(t):
    return S.new_posts_from_feeds(*stored(t))[1].drop("url")


@query("c13_discarded_entries", f"WITH {MEMBERS_SQL} SELECT feed_id, pos, key FROM flagged WHERE NOT included")
def _(t):
    e = entries(t)
    return O.discarded_entries(e, members(e)).select("feed_id", "pos", "key")


@query("c14_missing_from_feed", f"""WITH {ENTRIES_SQL}, held AS MATERIALIZED (SELECT feed_id, pos, key FROM entries), posts AS MATERIALIZED (SELECT feed_id, pos + 1 AS pos, key FROM held UNION ALL SELECT feed_id, 1000 + pos, key + 100 FROM held UNION ALL SELECT feed_id, 0, -1 FROM held WHERE pos = 0),
    ends AS (SELECT feed_id, max_by(key, pos) AS last FROM held GROUP BY 1),
    marked AS (SELECT p.feed_id, p.pos, p.key, min(CASE WHEN p.key = e.last THEN p.pos END) OVER (PARTITION BY p.feed_id) AS start FROM posts p JOIN ends e USING (feed_id)),
    known AS (SELECT feed_id, key, bool_or(h) AS h FROM (SELECT feed_id, key, true AS h FROM held UNION ALL SELECT feed_id, key, false FROM posts) GROUP BY ALL)
    SELECT m.feed_id, m.pos, m.key FROM marked m JOIN known k USING (feed_id, key) WHERE m.pos >= m.start AND NOT k.h""")
def _(t):
    e = entries(t)
    posts = e.select("feed_id", (c("pos") + 1).alias("pos"), "key").unionByName(
        e.select("feed_id", (c("pos") + 1000).alias("pos"), (c("key") + 100).alias("key"))).unionByName(
        e.where("pos = 0").select("feed_id", F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("key")))
    return O.missing_from_feed(posts, e).select("feed_id", "pos", "key")


@query("c15_infer_same_hosts", f"""WITH {ENTRIES_SQL}, h AS (SELECT feed_id, pos, CASE WHEN key % 3 = 0 THEN 'a' ELSE 'b' END || (feed_id % 7) AS host FROM entries),
    g AS (SELECT feed_id, host, count(*) AS n, min(pos) AS first FROM h GROUP BY 1, 2),
    red AS (SELECT o_orderkey AS feed_id, 'a' || (o_orderkey % 7) AS host, 'www' || (o_orderkey % 7) AS final_host FROM orders WHERE o_orderkey % 2 = 0),
    direct AS (SELECT DISTINCT r.feed_id, unnest([r.host, r.final_host]) AS host FROM red r JOIN g ON g.feed_id = r.feed_id AND g.host = r.host),
    covered AS (SELECT DISTINCT feed_id FROM direct),
    picked AS (SELECT feed_id, min_by(host, (n, first)) AS host FROM g WHERE feed_id NOT IN (SELECT feed_id FROM covered) GROUP BY 1)
    SELECT * FROM direct UNION SELECT feed_id, unnest([host, 'to' || host]) FROM picked WHERE feed_id % 5 <> 0""")
def _(t):
    f = c("feed_id")
    hosts = entries(t).select("feed_id", "pos", F.concat(F.when(c("key") % 3 == 0, "a").otherwise("b"), text(f % 7)).alias("host"))
    rows = hosts.withColumn("link_url", F.concat_ws("/", F.lit("https:/"), "host", text(f), text(c("pos"))))
    k = c("o_orderkey")
    redirects = t.orders.select(
        k.alias("feed_id"), F.concat(F.lit("a"), text(k % 7)).alias("host"), F.lit("/feed").alias("path"),
        F.concat(F.lit("www"), text(k % 7)).alias("final_host"), F.when(k % 2 == 0, "/feed").otherwise("/other").alias("final_path"))
    targets = rows.select("link_url", F.concat(F.lit("to"), "host").alias("final_host"), (f % 5 != 0).alias("same_path"))
    return O.infer_same_hosts(rows, redirects, targets)


@query("c16_route_feeds", """WITH n AS (SELECT l_suppkey AS feed_id, count(*) AS n_entries FROM lineitem GROUP BY 1) SELECT feed_id, n_entries,
    CASE WHEN n_entries = 0 THEN 'empty' WHEN n_entries = 1 THEN 'single' WHEN n_entries > 50 AND n_entries % 100 <> 0 THEN 'long_feed' ELSE 'mine_pages' END AS route FROM n""")
def _(t):
    return O.route_feeds(t.lineitem.select(c("l_suppkey").alias("feed_id"), c("l_linenumber").alias("pos")))


@query("c17_title_agreement", f"""WITH {ENTRIES_SQL}, f AS (SELECT feed_id, count(*) AS n, count(*) FILTER (WHERE key % 7 = 0) AS bad FROM entries GROUP BY 1)
    SELECT feed_id, CASE WHEN feed_id % 4 = 0 OR feed_id % 9 = 0 THEN 'neutral' WHEN bad = 0 THEN 'success' ELSE 'failure' END AS status,
      CASE WHEN NOT (feed_id % 4 = 0 OR feed_id % 9 = 0) THEN n - bad END AS n_equal, CASE WHEN NOT (feed_id % 4 = 0 OR feed_id % 9 = 0) THEN n END AS n_compared FROM f""")
def _(t):
    e = entries(t).withColumns({"eq_key": c("key"), "title": F.when(c("feed_id") % 9 != 0, F.concat(F.lit("“T”… "), text(c("key"))))})
    posts = e.select("feed_id", "pos", "eq_key", F.concat(F.when(c("key") % 7 == 0, "other ").otherwise('"t"... '), text(c("key"))).alias("title"))
    matched = e.select("feed_id").distinct().withColumn("is_match", c("feed_id") % 4 != 0)
    return O.title_agreement(posts, e, matched)


@query("c18_api_posts", """WITH s AS (SELECT o_custkey AS blog_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS pos, o_orderkey % 5 AS pick FROM orders),
    x AS (SELECT blog_id, bool_or(blog_id % 6 = 0) AND count(*) > 1 AS broken FROM s GROUP BY 1)
    SELECT blog_id, pos, 'https://b/' || o_orderkey AS url, CASE pick WHEN 0 THEN 'Blog ' || blog_id WHEN 1 THEN 'Summary ' || o_orderkey ELSE 'Title ' || o_orderkey END AS title, NOT broken AS is_sorted FROM s JOIN x USING (blog_id)""")
def _(t):
    k = c("o_orderkey")
    # One api page per post: pages of a blog are numbered newest first.
    rows = t.orders.select(c("o_custkey").alias("blog_id"), k, (k % 5).alias("pick"))
    ranked = with_row_number(rows.withColumn("_down", -k), ["blog_id"], ["_down"], "page", position_chunk(c("_down")))
    post = F.struct(
        F.concat(F.lit("https://b/"), text(k)).alias("post_url"), F.when(c("pick") > 1, F.concat(F.lit(" Title  "), text(k))).alias("title"),
        F.when(c("pick") == 1, F.concat(F.lit("Summary\n"), text(k))).alias("summary"),
        F.when(c("blog_id") % 6 == 0, 5).otherwise(k).alias("timestamp"))
    blog = F.struct(F.lit("https://b").alias("url"), F.concat(F.lit("Blog "), text(c("blog_id"))).alias("title"), F.lit(1).alias("posts"))
    body = F.to_json(F.struct(F.struct(blog.alias("blog"), F.array(post).alias("posts")).alias("response")))
    return O.api_posts(ranked.select("blog_id", "page", body.alias("body"))).select("blog_id", "pos", "url", "title", "is_sorted")
