"""When the daily runs happen: next dates, guards against double and late runs, the job log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import schedule as S


def local_runs(users: DataFrame, date: Column) -> DataFrame:
    """UTC run time of ``users(timezone, delivery_channel)`` on a local date."""
    return users.withColumn("run_at", S.run_at(date, S.channel_hour(F.col("delivery_channel")), F.col("timezone")))


def next_runs(jobs: DataFrame, now: Column) -> DataFrame:
    """Next local date, run time and skipped days after each job ``(user_id, job_date, timezone, delivery_channel)``."""
    hour = S.channel_hour(F.col("delivery_channel"))
    start = F.date_add("job_date", 1)
    dated = jobs.withColumn("next_date", S.first_run_date(start, now, hour, F.col("timezone")))
    return dated.withColumns({
        "next_run": S.run_at(F.col("next_date"), hour, F.col("timezone")),
        "days_skipped": F.date_diff("next_date", start),
    })


def initial_runs(users: DataFrame, now: Column) -> DataFrame:
    """First run of new users, searched from yesterday's UTC date."""
    hour = S.channel_hour(F.col("delivery_channel"))
    dated = users.withColumn("next_date", S.first_run_date(F.date_sub(F.to_date(now), 1), now, hour, F.col("timezone")))
    return dated.withColumn("next_run", S.run_at(F.col("next_date"), hour, F.col("timezone")))


def published_today(subs: DataFrame, sub_posts: DataFrame, date: Column) -> DataFrame:
    """Users with a not-discarded subscription that already has posts of this local date."""
    published = sub_posts.where(F.col("published_at_local_date") == date).select(F.col("subscription_id").alias("id"))
    hit = subs.where("discarded_at is null").join(published, "id", "left_semi")
    return hit.groupBy("user_id").agg(F.count("*").alias("published_subscriptions"))


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose local date has not passed; dates are compared as text."""
    return jobs.where(F.col("job_date_text") >= S.date_text(S.local_now(now, F.col("timezone"))))


def parse_job_log(jobs: DataFrame, job_class: str) -> DataFrame:
    """Pull user and date out of the serialised job text of one class."""
    pattern = r"arguments:\n  - ([0-9]+)\n  - '([0-9-]+)'"
    mine = jobs.where(F.col("handler").contains(f"class: {job_class}\n"))
    return mine.select("id", "run_at", F.regexp_extract("handler", pattern, 1).cast("long").alias("user_id"),
                       F.regexp_extract("handler", pattern, 2).alias("job_date"))


def job_log_facts(jobs: DataFrame, job_class: str, now: Column, stalled_hours: int = 1) -> DataFrame:
    """Per user: date of the latest job, number of jobs, whether that is a double schedule, jobs overdue."""
    parsed = parse_job_log(jobs, job_class)
    late = F.col("run_at") < F.timestamp_add("HOUR", F.lit(-stalled_hours), now)
    facts = parsed.groupBy("user_id").agg(
        F.max_by("job_date", F.struct("run_at", "id")).alias("next_date"), F.count("*").alias("n_jobs"),
        F.count_if(late).alias("n_stalled"))
    return facts.withColumn("is_double", F.col("n_jobs") > 1)


def row_count_alert(tables: dict[str, DataFrame], limit: int = 5_000_000) -> DataFrame:
    """Row count per table with the total and the alert flag."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    per_table = reduce(DataFrame.unionByName, counts)
    total = per_table.agg(F.sum("n").alias("total"))
    # One row per table against a single total row.
    return per_table.join(F.broadcast(total)).withColumn("over_limit", F.col("total") > limit)
