"""Stored steps of mined pages stay narrow, detectors judge only groups that can be a list, plain tags are read as any tag."""

import random
from html.parser import HTMLParser
from pathlib import Path

from pyspark.sql import functions as F

from feedlake.functions import dom
from feedlake.operators import archives as G
from feedlake.operators import masks as M
from feedlake.session import discard

LINKS = "page_id long, pos long, xpath string, class_xpath string, key string, is_feed boolean, text string"


def links(spark):
    rows = []
    for page in (1, 2):
        for s in (1, 2):
            for k in range(1, 4):
                path = f"/html[1]/section[{s}]/li[{k}]/a[1]"
                rows.append((page, 10 * s + k, path, path.replace("li[", "li(x)["), f"p{s}{k}", page == 1 and s == 1, "long text"))
        rows.append((page, 0, "/html[1]/nav[1]/a[1]", "/html[1]/nav[1]/a[1]", "about", False, "long text"))
    return spark.createDataFrame(rows, LINKS)


def test_mask_groups_stores_seeds_and_no_links(spark, monkeypatch):
    stored, store = [], M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df: stored.append(df.columns) or store(df))
    groups = M.mask_groups(links(spark), 1).groupBy("page_id", "mask").count().collect()
    assert {(r.page_id, r.mask, r["count"]) for r in groups} == {
        (1, "/html[1]/section[1]/li[*]/a[1]", 3), *((1, f"/html[1]/section[*]/li[{k}]/a[1]", 2) for k in (1, 2, 3))}
    assert not any({"text", "xpath", "key"} & set(columns) for columns in stored)


def test_masks_of_repeated_rows_and_of_pages_without_a_number(spark):
    nameless = links(spark).selectExpr("cast(null as long) as page_id", "pos", "xpath", "class_xpath", "key", "true as is_feed", "text")
    twice = links(spark).unionByName(links(spark)).unionByName(nameless)
    counts = {(r.page_id, r.mask): r["count"] for r in M.mask_groups(twice, 1).groupBy("page_id", "mask").count().collect()}
    assert counts == {(1, "/html[1]/section[1]/li[*]/a[1]"): 6, **{(1, f"/html[1]/section[*]/li[{k}]/a[1]"): 4 for k in (1, 2, 3)}}


def test_only_whole_lists_meet_the_feed(spark, monkeypatch):
    members = [(1, "whole", 1, k, f"k{k}") for k in range(4)] + [(1, "short", 1, k, f"k{k}") for k in range(2)] + [
        (1, "again", 1, 10 + k, "k1") for k in range(5)] + [(2, "up", 1, k, f"k{3 - k}") for k in range(4)]
    groups = spark.createDataFrame(members, "page_id long, mask string, stars int, pos long, key string")
    entries = spark.createDataFrame([(p, k, k, f"k{k}") for p in (1, 2) for k in range(4)], "page_id long, pos long, bucket long, key string")
    seen, match = [], G.sequence_match
    monkeypatch.setattr(G, "sequence_match", lambda e, s: seen.append({r.feed_id for r in e.collect()}) or match(e, s))
    found = {(r.page_id, r.mask, r.n_links, r.is_reversed) for r in G.detect_sorted(groups, entries).collect()}
    assert found == {(1, "whole", 4, False), (2, "up", 4, True)}
    assert seen == [{"1|1|whole", "2|1|up"}] * 2


class General(dom._Nodes):
    parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag


def test_plain_tags_are_read_as_by_the_general_parser():
    parts = ['<a href="/x">', "<a href='/y'>", '<a href="/x?a=1&amp;b=2">', '<A HREF="/z" class="b a">', "</a>", "</A >", "<li>", '<li class="post-7 n">', "</li>", "<ul>",
             "</ul>", '<time datetime="2020-01-02">', "</time>", "<br/>", '<p class="a>b">', '<p class="a"class="c">', "</p>", "<script>if (a < b) {'</li>'}", "</script>",
             "<style>", "</style>", "<!-- <li> -->", "text", " ", "&amp;", "<", "</", '<a href="', "<title>", "</title>", '<div class="x" class="y">', "</div>", "<section hidden>", "</section>",
             '<h1 data-a="1">', "</h1>", "<textarea>", "</textarea>", '<span class=\n"q">', "</span\n>"]
    rng = random.Random(3)
    for _ in range(3000):
        html = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        rows = []
        for kind in (dom._Nodes, General):
            parser = kind()
            parser.feed(html)
            parser.close()
            rows.append(parser.rows)
        assert rows[0] == rows[1], html
    calls = []
    parser = type("Counted", (dom._Nodes,), {"check_for_whole_start_tag": lambda self, i: calls.append(i) or HTMLParser.check_for_whole_start_tag(self, i)})()
    parser.feed('<main><ul><li class="item"><a href="/p">Post</a></li></ul></main>')
    assert not calls


def test_whole_pages_are_read_as_by_the_general_parser():
    plain = ["<!DOCTYPE html>", "<title>x</title>", '<a href="/x">', "</a>", "<li>", "</li>", "<ul>", "</ul>", '<time datetime="2020-01-02">', "</time>", "text", " "]
    odd = ["<title></title>", "<title>a&lt;</title>", "<title >", "<br/>", "&amp;", "<", "<!-- <li> -->", "<script>if (a < b) {'</li>'}", "</script>", "\x00", "a\r\nb", "<titled>"]
    rng = random.Random(5)
    for k in range(3000):
        html = "".join(rng.choices(plain, k=rng.randint(0, 12)) + rng.choices(odd + plain if k % 2 else plain, k=rng.randint(0, 12)))
        general, whole, linked = General(), dom._Nodes(), dom._Nodes(links=True)
        general.feed(html)
        general.close()
        whole.read(html)
        linked.read(html)
        assert whole.rows == general.rows, html
        assert linked.rows == [row if row[0] in dom.LINK_KINDS else None for row in general.rows], html


def test_steps_by_page_shuffle_nothing(spark):
    stored = M.checkpointed(links(spark).withColumn("is_feed", F.expr("page_id = 1")))
    groups = M.checkpointed(M.mask_groups(stored, 2).select("page_id", "stars", "mask", "key"))
    entries = M.checkpointed(stored.where("is_feed").select("page_id", "key").distinct())
    held = groups.join(entries, ["page_id", "key"]).groupBy("page_id", "stars", "mask").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.page_id, r["count"]) for r in held.collect()} == {(1, 6)}


def test_tables_of_pages_are_deleted_when_replaced(spark):
    stored = M.checkpointed(links(spark))
    kept = M.checkpointed(stored.where("page_id = 1"))
    discard(stored)
    assert not [f for f in stored.inputFiles() if Path(f.removeprefix("file:")).exists()]
    assert kept.count() == 7
