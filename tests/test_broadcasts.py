"""Plans send no table to all tasks on a guess: stored files are small for their rows, and an explode makes many out of few."""

from datetime import date

from pyspark.sql import functions as F

from feedlake.llm import simhash
from feedlake.llm.common import Scratch, prepare
from feedlake.operators import masks, seqmatch
from feedlake.plans import run_c_feeds
from feedlake.plans.registry import Tables
from feedlake.session import checkpointed, checkpointed_pages, configure


def sent(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_fingerprints_and_their_anchors_are_not_sent(spark):
    values = [1, 3, 1 << 40, (1 << 40) + 7, -1, -8, -9]
    stored = Scratch(prepare(spark), "t").store(spark.createDataFrame([(v,) for v in values], "fp long"), "fps")
    links = simhash.near_links(stored)
    assert sent(links) == 0
    mask = (1 << 64) - 1
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_feeds_and_lists_are_not_sent(spark, tmp_path):
    rows = [(k, n, 10 * k + n, n, date(2020, 1, 1 + (k + n) % 9)) for k in range(1, 30) for n in range(1, 2 + k % 7)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(configure(spark), str(tmp_path))
    e = run_c_feeds.entries(t)
    listed = run_c_feeds.candidates(e)
    updates = seqmatch.new_posts_from_feeds(*run_c_feeds.stored(t))
    for df in (seqmatch.match_except_first(e, listed), seqmatch.sequence_is_suffix(e, listed), *updates):
        assert sent(df) == 0 and df.count() > 5


def test_nodes_of_pages_are_not_sent(spark):
    configure(spark)
    groups = checkpointed_pages(spark.createDataFrame([(1, "/body[1]/li[1]"), (1, "/body[1]/li[2]"), (2, "/body[1]")], "page_id long, item string"))
    nodes = checkpointed_pages(spark.createDataFrame([(1, 0, "/body[1]/li[1]/b[1]", "a"), (2, 1, "/body[1]", "c"), (None, 2, None, None)], "page_id long, seq long, xpath string, value string"))
    found = masks.item_nodes(groups, nodes, "value", [])
    assert sent(found) == 0
    assert sorted((r.page_id, r.item, r.value) for r in found.collect()) == [(1, "/body[1]/li[1]", "a"), (2, "/body[1]", "c")]


def test_a_table_that_is_measured_small_may_be_sent(spark):
    configure(spark)
    few = checkpointed(spark.range(3).select((F.col("id") * 100).alias("id")))
    joined = checkpointed(spark.range(20_000)).join(few.groupBy("id").count(), "id")
    assert sent(joined) == 0 and joined.count() == 3
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
