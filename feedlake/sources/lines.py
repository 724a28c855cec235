"""Readers of hand-kept line formats: seed lists, url labels, tab-separated feed rows, review notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small hand-kept text files with their number per file: ``(file, line_no, line)``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def parse_seed_lines(lines: DataFrame, layout: str) -> DataFrame:
    """``(source, url, comment)`` of seed lines ``(source, line_no, line)``.

    Layouts: ``semicolon`` (url;comment), ``dashes`` (``url -- comment``) and ``plain``. The last two end at the first
    blank line of a source and skip lines that are no url.
    """
    text = F.trim("line")
    if layout == "semicolon":
        parts = F.split(text, ";")
        rows = lines.where(text != "")
        return rows.select("source", "line_no", parts[0].alias("url"), F.nullif(parts[1], F.lit("")).alias("comment"))
    ends = lines.where(text == "").groupBy("source").agg(F.min("line_no").alias("_end"))
    open_lines = lines.join(ends, "source", "left").where(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    urls = open_lines.where(text.startswith("http"))
    if layout == "plain":
        return urls.select("source", "line_no", text.alias("url"), F.lit(None).cast("string").alias("comment"))
    parts = F.split(text, " -- ")
    return urls.select("source", "line_no", parts[0].alias("url"), F.get(parts, F.lit(1)).alias("comment"))


def replace_source(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Seed table after an import: the fresh rows replace all rows of their sources."""
    kept = stored.join(fresh.select("source").distinct(), "source", "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def read_seed_lists(spark: SparkSession, paths_by_source: dict[str, tuple[str, str]]) -> DataFrame:
    """Seed rows of ``{source: (layout, path)}``."""
    tables = []
    for source, (layout, path) in paths_by_source.items():
        lines = read_lines(spark, path).withColumn("source", F.lit(source))
        tables.append(parse_seed_lines(lines, layout))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def parse_url_labels(lines: DataFrame) -> DataFrame:
    """Split ``url label`` lines at the first blank; ``reject`` names what is wrong with a line."""
    text = F.trim("line")
    reject = F.when(~text.rlike("^https?://"), "no full url").when(~text.contains(" "), "no label")
    return lines.withColumns({
        "url": F.substring_index(text, " ", 1),
        "label": F.when(text.contains(" "), F.expr("substring(trim(line), instr(trim(line), ' ') + 1)")),
        "reject": reject,
    }).drop("line")


def parse_feed_rows(lines: DataFrame) -> DataFrame:
    """Tab-separated mining results: ``link, n, [id,id], found_at, feed...`` per line."""
    cells = F.split("line", "\t")
    ids: Column = F.split(F.regexp_replace(cells[2], r"^\[|\]$", ""), ",")
    return lines.select(
        cells[0].alias("link"), cells[1].cast("long").alias("n"), ids.alias("message_ids"), cells[3].alias("found_at"),
        F.slice(cells, 5, F.size(cells)).alias("feeds"))


def parse_post_rules(lines: DataFrame) -> DataFrame:
    """Clean-up rules, one per line: ``prefix*``, ``from -> to`` or an exact url. ``(kind, pattern, target)``."""
    line = F.col("line")
    return lines.select(
        F.when(line.endswith("*"), "prefix").when(line.contains(" -> "), "replace").otherwise("exact").alias("kind"),
        F.when(line.endswith("*"), F.regexp_replace("line", r"\*$", "")).otherwise(
            F.substring_index("line", " -> ", 1)).alias("pattern"),
        F.when(~line.endswith("*") & line.contains(" -> "), F.regexp_extract("line", " -> (.*)$", 1)).alias("target"))
