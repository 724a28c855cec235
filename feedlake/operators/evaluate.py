"""Evaluation of discovered post lists against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions.ordered import position_chunk, with_last_known, with_running_sum
from feedlake.functions.text import equalized_title
from feedlake.operators.urls import with_equality_key


def _link_keys(df: DataFrame, links: str, eq_cfg: DataFrame, out: str) -> DataFrame:
    """One row per list position with the equality key of its canonical url."""
    rows = df.select("start_link_id", F.posexplode(links).alias("pos", "_url")).withColumn("_url", F.concat(F.lit("http://"), "_url"))
    keyed = with_equality_key(U.with_canonical(rows, "_url"), eq_cfg, "start_link_id", out)
    return keyed.select("start_link_id", "pos", out)


def _status(ok: Column) -> Column:
    return F.when(ok, "success").otherwise("failure")


def compare_to_truth(found: DataFrame, truth: DataFrame, eq_cfg: DataFrame) -> DataFrame:
    """Status of each compared field per seed, and whether all of them match.

    ``found(start_link_id, pattern, blog_url, main_url, links)``, ``truth(start_link_id, pattern, entries_count, blog_url,
    main_url, oldest_url, links)``; urls are canonical, newest first, truth links may be null.
    """
    got = found.select("start_link_id", F.col("pattern").alias("found_pattern"), F.col("blog_url").alias("found_blog"),
                       F.col("main_url").alias("found_main"), F.size("links").alias("n_found"),
                       F.element_at("links", -1).alias("_oldest"))
    joined = truth.withColumn("_has_links", F.col("links").isNotNull()).drop("links").join(got, "start_link_id")
    left = _link_keys(found, "links", eq_cfg, "_found_key")
    right = _link_keys(truth, "links", eq_cfg, "_truth_key")
    pairs = left.join(right, ["start_link_id", "pos"])
    mismatches = pairs.groupBy("start_link_id").agg(F.count_if(F.col("_found_key") != F.col("_truth_key")).alias("n_link_mismatches"))
    ends = joined.select("start_link_id", F.array("_oldest", "oldest_url").alias("_ends"))
    keys = _link_keys(ends, "_ends", eq_cfg, "_key")
    oldest = keys.groupBy("start_link_id").agg((F.min("_key") == F.max("_key")).alias("_same_oldest"))
    full = joined.join(mismatches, "start_link_id", "left").join(oldest, "start_link_id")
    same_count = F.col("n_found") == F.col("entries_count")
    count_status = F.when(~same_count, "failure").when(~F.col("_has_links"), "neutral").otherwise(
        _status(F.coalesce("n_link_mismatches", F.lit(0)) == 0))
    stated = full.withColumns({
        "blog_url_status": _status(F.col("blog_url").eqNullSafe(F.col("found_blog"))),
        "pattern_status": _status(F.col("pattern").eqNullSafe(F.col("found_pattern"))),
        "count_status": count_status,
        "oldest_status": _status(F.col("_same_oldest")),
        "main_url_matching": F.col("main_url").eqNullSafe(F.col("found_main")),
    })
    failed = F.array_contains(F.array("blog_url_status", "pattern_status", "count_status", "oldest_status"), "failure")
    return stated.withColumn("links_matching", ~failed).drop("_has_links", "_oldest", "_same_oldest")


def compare_titles(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Exact and partial title agreement per seed: by position for equal lengths, else by membership.

    ``found(start_link_id, titles)``, ``truth(start_link_id, titles)`` (null titles = nothing to compare).
    """
    ours = F.transform("titles", equalized_title)
    joined = found.select("start_link_id", ours.alias("_f")).join(
        truth.select("start_link_id", ours.alias("_t")), "start_link_id")
    pairs = F.arrays_zip(F.col("_f").alias("f"), F.col("_t").alias("t"))
    inexact = F.filter(pairs, lambda p: p["f"] != p["t"])
    unlike = F.filter(inexact, lambda p: ~p["f"].endswith(p["t"]) & ~p["t"].startswith(p["f"]))
    same_length = F.size("_f") == F.size("_t")
    # Membership by a join of single titles, not by a search of one list for each member of the other.
    uneven = joined.where(~same_length)
    ours_ = uneven.select("start_link_id", F.explode("_f").alias("title")).groupBy("start_link_id", "title").agg(F.count("*").alias("n"))
    theirs = uneven.select("start_link_id", F.explode("_t").alias("title")).distinct()
    common = ours_.join(theirs, ["start_link_id", "title"]).groupBy("start_link_id").agg(F.sum("n").cast("int").alias("_common"))
    overlap = F.coalesce("_common", F.lit(0))
    counted = joined.join(common, "start_link_id", "left").withColumns({
        "n_exact": F.when(same_length, F.size("_t") - F.size(inexact)).otherwise(overlap),
        "n_partial": F.when(same_length, F.size("_t") - F.size(unlike)).otherwise(overlap),
        "n_truth": F.size("_t"),
    })
    known = F.col("_t").isNotNull()
    return counted.withColumns({
        "exact_status": F.when(~known, "neutral").otherwise(_status(same_length & (F.col("n_exact") == F.col("n_truth")))),
        "partial_status": F.when(~known, "neutral").otherwise(_status(same_length & (F.col("n_partial") == F.col("n_truth")))),
    }).select("start_link_id", *[F.when(known, F.col(c)).alias(c) for c in ("n_exact", "n_partial", "n_truth")],
              "exact_status", "partial_status")


def regressions(compared: DataFrame, successes: DataFrame) -> DataFrame:
    """``compared(start_link_id, matching)`` (null = no truth) against earlier successes: verdict and new successes."""
    seen = successes.select("start_link_id").distinct().withColumn("_before", F.lit(True))
    joined = compared.join(seen, "start_link_id", "left")
    status = F.when(F.col("matching").isNull() | F.col("_before").isNull(), "neutral").otherwise(_status(F.col("matching")))
    return joined.withColumns({
        "regression_status": status, "save_success": F.coalesce(F.col("matching"), F.lit(False)) & F.col("_before").isNull(),
    }).drop("_before")


def cell_statuses(cells: DataFrame) -> DataFrame:
    """Status of report cells ``(row_id, column, rule, value, manual_status)``.

    Rules: ``neutral``, ``neutral_present`` (failure when empty), ``boolean``. A manual status wins.
    """
    present = F.col("value").isNotNull() & (F.col("value") != "false")
    ruled = F.when(F.col("rule") == "neutral", "neutral").when(
        F.col("rule") == "neutral_present", F.when(present, "neutral").otherwise("failure")).otherwise(_status(present))
    return cells.withColumn("status", F.coalesce("manual_status", ruled))


def row_verdicts(cells: DataFrame) -> DataFrame:
    stated = cell_statuses(cells)
    return stated.groupBy("row_id").agg(
        F.when(F.bool_or(F.col("status") == "failure"), "failure").otherwise("success").alias("verdict"))


def report_summary(verdicts: DataFrame) -> DataFrame:
    """Totals of ``(row_id, verdict)``; rows without any result carry the verdict ``bad_failure``."""
    totals = verdicts.agg(
        F.count_if(F.col("verdict") == "success").alias("n_success"), F.count_if(F.col("verdict") == "failure").alias("n_failure"),
        F.count_if(F.col("verdict") == "bad_failure").alias("n_bad_failure"), F.count("*").alias("n_rows"))
    return totals.withColumn("success_percent", F.expr("n_success * 100 div n_rows"))


def column_counters(cells: DataFrame) -> DataFrame:
    """Success, neutral and failure counts per report column; columns that are neutral throughout are left out."""
    counts = cell_statuses(cells).groupBy("column").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "neutral", "failure")])
    return counts.where("n_success + n_failure > 0")


def report_order(cells: DataFrame, column_order: list[str], errors: DataFrame) -> DataFrame:
    """Report rows in order: by statuses column by column (success, neutral, failure), error text, id."""
    level = F.when(F.col("status") == "success", -1).when(F.col("status") == "neutral", 0).otherwise(1)
    wide = cell_statuses(cells).withColumn("_level", level).groupBy("row_id").pivot("column", column_order).agg(F.first("_level"))
    joined = wide.join(errors, "row_id", "left").withColumn("error", F.coalesce("error", F.lit("")))
    return joined.orderBy(*[F.col(c) for c in column_order], "error", "row_id")


def eligible_seeds(seeds: DataFrame, issues: DataFrame) -> DataFrame:
    """Seeds without a ``discard`` issue; ``fails_early`` marks those with a known ``fail`` issue."""
    kept = seeds.join(issues.where("severity = 'discard'").select("start_link_id"), "start_link_id", "left_anti")
    noted = issues.where("severity <> 'discard'").groupBy("start_link_id").agg(
        F.min("issue").alias("issue"), F.bool_or(F.col("severity") == "fail").alias("_fail"))
    joined = kept.join(noted, "start_link_id", "left")
    return joined.withColumn("fails_early", F.coalesce("_fail", F.lit(False))).drop("_fail")


# Section titles of review notes and the number of lines of one record in each.
NOTE_SECTIONS = {"good": 1, "new": 1, "issues": 3, "bad": 5}


def parse_review_notes(lines: DataFrame) -> DataFrame:
    """Records of review notes ``(file, line_no, line)``: ``(file, section, record, fields, complete)``.

    A section title sets the mode of the lines below it; blank lines do not count. A record cut short by a section end is
    marked incomplete.
    """
    text = F.trim("line")
    lowered = F.lower(text)
    is_title = lowered.isin(list(NOTE_SECTIONS))
    marked = lines.where(text != "").withColumns({"text": text, "_title": F.when(is_title, lowered), "_mark": is_title.cast("long")})
    chunk = position_chunk(F.col("line_no"))
    moded = with_last_known(marked, ["file"], ["line_no"], {"section": "_title"}, chunk)
    sectioned = with_running_sum(moded, ["file"], ["line_no"], F.col("_mark"), "_part", chunk)
    body = sectioned.where("_title is null and section is not null")
    numbered = with_running_sum(body, ["file", "_part"], ["line_no"], F.lit(1).cast("long"), "_n", chunk)
    width = F.coalesce(*[F.when(F.col("section") == s, n) for s, n in NOTE_SECTIONS.items()])
    sized = numbered.withColumns({"_width": width, "record": F.floor((F.col("_n") - 1) / width)})
    # A record has at most five lines.
    grouped = sized.groupBy("file", "section", "_part", "record", "_width").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]).alias("fields"))
    return grouped.withColumn("complete", F.size("fields") == F.col("_width")).drop("_width")


def plan_truth_updates(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Ids the notes would write and what is wrong with them: ``duplicate`` in the notes, ``exists`` already, ``incomplete``."""
    ids = records.where("section in ('good', 'bad')").select(
        F.element_at("fields", 1).try_cast("int").alias("start_link_id"), "section", "complete")
    counted = ids.groupBy("start_link_id").agg(F.count("*").alias("n"), F.min("section").alias("section"), F.bool_and("complete").alias("complete"))
    known = truth.select("start_link_id").distinct().withColumn("_known", F.lit(True))
    joined = counted.join(known, "start_link_id", "left")
    problem = F.when(F.col("n") > 1, "duplicate").when(F.col("_known"), "exists").when(~F.col("complete"), "incomplete")
    return joined.withColumn("problem", problem).drop("_known", "n", "complete")


def copy_good_results(plan: DataFrame, found: DataFrame) -> DataFrame:
    """Result rows that become truth."""
    return found.join(plan.where("section = 'good' and problem is null").select("start_link_id"), "start_link_id", "left_semi")


def orphan_pages(pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """Pages without content of seeds without a feed, counted per seed."""
    orphans = pages.where("content is null").join(feeds.select("start_link_id"), "start_link_id", "left_anti")
    return orphans.groupBy("start_link_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "start_link_id")


def lost_seeds(successes: DataFrame, truth: DataFrame, guided: DataFrame, patterns: list[str]) -> DataFrame:
    """Seeds that succeeded before, follow one of ``patterns``, and are not among the later successes."""
    before = successes.join(truth.select("start_link_id", "pattern", "main_url"), "start_link_id", "left")
    return before.where(F.col("pattern").isin(patterns)).join(guided.select("start_link_id"), "start_link_id", "left_anti")
