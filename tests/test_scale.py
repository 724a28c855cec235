"""What keeps disk, tasks and Python's memory small: stored steps, dealt rows, batches, and texts that are read once."""

import os
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import functions as F

from feedlake.functions import xmlfeeds as X
from feedlake.functions.dom import NODE_SCHEMA, page_nodes
from feedlake.operators import archives, masks, seqmatch
from feedlake.plans import registry, run_c_feeds, run_fg_archives  # noqa: F401
from feedlake.plans.registry import Tables
from feedlake.plans.run_d_discovery import site_pages
from feedlake.session import checkpointed, configure


def test_stored_step_is_small_and_read_by_columns(spark):
    steps = "".join(f"/section(item,post)[{i}]" for i in range(1, 12))
    df = spark.range(20_000).select("id", F.concat(F.lit(steps), (F.col("id") % 50).cast("string")).alias("xpath"), F.lit(None).cast("date").alias("date"))
    stored = checkpointed(df)
    files = [f.removeprefix("file:") for f in stored.inputFiles()]
    assert files and sum(os.path.getsize(f.removeprefix("//")) for f in files) < 500_000
    assert stored.dtypes == df.dtypes and stored.exceptAll(df).count() == 0 and stored.count() == 20_000
    assert checkpointed(df.where("id < 0")).count() == 0


def test_shuffle_files_go_with_their_step(spark):
    assert configure(spark).conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_pages_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [batch.num_rows]})

    got = configure(spark).range(5000).coalesce(1).mapInArrow(sizes, "id long").collect()
    assert max(r.id for r in got) <= 500 and sum(r.id for r in got) == 5000
    pages = spark.createDataFrame([(1, "u", '<p><a href="/x">é</a></p>'), (None, None, None), (1, "u", '<p><a href="/x">é</a></p>')], "page_id long, url string, html string")
    rows = pages.mapInArrow(page_nodes, NODE_SCHEMA).where("kind = 'a'").collect()
    assert [(r.page_id, r.xpath, r.href, r.value, r.is_empty) for r in rows] == [(1, "/p[1]/a[1]", "/x", "é", False)] * 2


def test_few_row_groups_spread_over_the_tasks(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    pages = site_pages(Tables(configure(spark), str(tmp_path)))
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pages.count() == 1000 and pages.select("page_id").distinct().count() == 1000


def test_nodes_offer_themselves_at_depths_of_items_only(spark):
    groups = spark.createDataFrame([(1, "/body[1]/li[1]"), (1, "/body[1]/li[2]"), (2, "/body[1]")], "page_id long, item string")
    deep = "".join(f"/div[{i}]" for i in range(1, 40))
    nodes = spark.createDataFrame([(1, 0, "/body[1]/li[1]/b[1]/text()[1]", "a"), (1, 1, "/body[1]/li[1]", "b"), (1, 2, "/body[1]", "c"), (2, 3, "/body[1]" + deep, "d"), (3, 4, deep, "e")],
                                  "page_id long, seq long, xpath string, value string")
    found = masks.item_nodes(groups, nodes, "value", [])
    assert sorted(map(tuple, found.select("page_id", "item", "value", "rel").collect())) == [
        (1, "/body[1]/li[1]", "a", "/b[1]/text()[1]"), (1, "/body[1]/li[1]", "b", ""), (2, "/body[1]", "d", deep)]
    # No list of all ancestors of every node.
    assert "sequence(" not in found._jdf.queryExecution().analyzed().toString()


def test_texts_are_matched_once(spark):
    df = spark.createDataFrame([("Tue, 5 Mar 2019 10:20 PST",), ("5 march 49 1:02:03 +0130",), ("6 Apr 1999 23:59:59 GMT ",), ("no date",), ("",), (None,)], "t string")
    dated = df.select(X.rfc822_date(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in dated.collect()] == ["2019-03-05 18:20:00", "2049-03-04 23:32:03", "1999-04-06 23:59:59", None, None, None]
    assert len(re.findall(r"A-Za-z\]\{3,9\}", dated._jdf.queryExecution().analyzed().toString())) <= 2
    tags = spark.createDataFrame([('<a HREF = "" href=\'b&amp;c\'>',), ("<a>",), ('<a href="">',), (None,)], "t string")
    read = tags.select(X.attribute(F.col("t"), "href").alias("v"))
    assert [r.v for r in read.collect()] == ["b&c", None, "", None]
    decoded = spark.createDataFrame([("a &lt;b&gt; &#8364;&nope; &",), ("plain",), (None,)], "t string").select(X.decode_entities(F.col("t")).alias("v"))
    assert [r.v for r in decoded.collect()] == ["a <b> €&nope; &", "plain", None]
    links = spark.createDataFrame([('<link rel="self" href="s"/><link rel="alternate" href="a"/><link href="p"/>',), ('<link href="p"/><link rel="self" href="s"/>',), ("",), (None,)], "t string")
    got = links.select(X.atom_link(F.col("t")).alias("x")).select("x.count", "x.href").collect()
    assert [tuple(r) for r in got][:3] == [(1, "a"), (1, "p"), (0, None)]


def feed_lines(spark, folder):
    rows = [(k, n, 10 * k + n, n, date(2020, 1, 1 + (k + n) % 9)) for k in range(1, 40) for n in range(1, 2 + k % 7)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    return Tables(configure(spark), str(folder))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_feeds_and_lists_meet_in_their_buckets(spark, tmp_path):
    e = run_c_feeds.entries(feed_lines(spark, tmp_path))
    listed = run_c_feeds.candidates(e)
    members = e.where("key % 5 <> 0").select("feed_id", "key")
    for df in (seqmatch.filter_included(e, members), seqmatch.match_except_first(e, listed), seqmatch.sequence_is_suffix(e, listed), seqmatch.sequence_match(e, listed)):
        assert shuffles(df) == 0 and df.count() > 20


def test_groups_of_a_feed_stay_in_its_bucket(spark, tmp_path, monkeypatch):
    seen = []
    for name in ("sequence_match", "match_except_first"):
        monkeypatch.setattr(archives, name, lambda *a, f=getattr(archives, name): seen.append(f(*a)) or seen[-1])
    t = Tables(configure(spark), feed_lines(spark, tmp_path).folder)
    run = {n: registry.QUERIES[n](spark, t.folder) for n in ("g14_detect_page2", "g02_detect_sorted_first")}
    assert len(seen) == 2 and all(shuffles(df) == 0 for df in seen)
    assert all(df.count() > 0 for df in run.values())
