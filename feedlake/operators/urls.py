"""Url operators over tables: canonicalisation, per-blog keys, dedup, membership, redirects and roll-ups.

Link tables carry the columns added by ``functions.urls.with_canonical``: ``reject, link_url, parts, canonical, key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import urls as U
from feedlake.functions import xmlfeeds as X
from feedlake.functions.ordered import first_per_key
from feedlake.session import checkpointed

# Response codes that end a crawl of a page for good.
PERMANENT_ERROR_CODES = [
    "400", "401", "402", "403", "404", "405", "406", "407", "410", "411", "412", "413", "414", "415", "416", "417",
    "418", "451", "ResponseBodyTooBig",
]


def canonicalize_urls(df: DataFrame, url: str, base: str | None = None, prefix: str = "") -> DataFrame:
    return U.with_canonical(df, url, base, prefix)


def canonical_key(df: DataFrame, eq_cfg: DataFrame, blog: str = "blog_id", out: str = "key") -> DataFrame:
    """Key under per-blog rules ``eq_cfg(<blog>, same_hosts, expect_post_paths)``; blogs without a row get the defaults."""
    joined = df.drop(out).join(eq_cfg.select(blog, "same_hosts", "expect_post_paths"), blog, "left")
    keyed = joined.withColumn(out, U.canonical_key(F.col("parts"), F.col("same_hosts"), F.col("expect_post_paths")))
    return keyed.drop("same_hosts", "expect_post_paths")


def with_equality_key(df: DataFrame, eq_cfg: DataFrame, blog: str = "blog_id", out: str = "eq_key") -> DataFrame:
    joined = df.join(eq_cfg.select(blog, "same_hosts", "expect_post_paths"), blog, "left")
    keyed = joined.withColumn(out, U.equality_key(F.col("parts"), F.col("same_hosts"), F.col("expect_post_paths")))
    return keyed.drop("same_hosts", "expect_post_paths")


def canonical_equal_join(left: DataFrame, right: DataFrame, eq_cfg: DataFrame, blog: str = "blog_id") -> DataFrame:
    """Inner join of two link tables of the same blogs on canonical equality (ports do not count)."""
    return with_equality_key(left, eq_cfg, blog).join(
        with_equality_key(right, eq_cfg, blog).withColumnRenamed("parts", "right_parts"), [blog, "eq_key"])


def dedup_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_per_key(df, keys, order)


def dedup_keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return first_per_key(df, keys, [F.col(position).desc()])


def rekey(df: DataFrame, eq_cfg: DataFrame, position: str, blog: str = "blog_id") -> DataFrame:
    """Rebuild a set of links after its blog's rules changed: new keys, first link per key kept."""
    return dedup_by_key(canonical_key(df, eq_cfg, blog), [blog, "key"], [position])


def semi_by_key(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(members, keys, "left_semi")


def anti_by_key(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(members, keys, "left_anti")


def dedup_queryless(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First link per canonical url without its query."""
    keyed = df.withColumn("queryless_key", U.canonical_key(U.without_query(F.col("parts"))))
    return dedup_by_key(keyed, [*keys, "queryless_key"], order)


def resolve_redirects(edges: DataFrame) -> DataFrame:
    """Follow ``edges(source, target)`` to the end: ``(source, target, status)``, status ``resolved`` or ``cycle``.

    Pointer doubling: after n rounds a pointer spans 2^n edges, so chains of any length need log2(length) joins. A
    self-loop ends a chain; of several targets of a source the least counts. A pointer still inside the edge set after more steps than there are edges is on a cycle.
    """
    live = edges.where("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    pointers = checkpointed(live)
    total = pointers.count()
    span = 1
    settled = None
    open_rows = pointers
    while span <= total:
        hops = pointers.select(F.col("source").alias("target"), F.col("target").alias("next"))
        stepped = checkpointed(
            open_rows.join(hops, "target", "left").select("source", F.coalesce("next", "target").alias("target"),
                                                          F.col("next").isNull().alias("_done")))
        done = stepped.where("_done").drop("_done")
        settled = done if settled is None else settled.unionByName(done)
        open_rows = stepped.where("not _done").drop("_done")
        # Rows already settled stay valid pointers, so later rounds can jump over them.
        pointers = settled.unionByName(open_rows)
        if open_rows.isEmpty():
            break
        span *= 2
    if settled is None:
        return live.withColumn("status", F.lit("resolved"))
    return settled.withColumn("status", F.lit("resolved")).unionByName(
        open_rows.select("source", F.lit(None).cast(live.schema["target"].dataType).alias("target"),
                         F.lit("cycle").alias("status")))


def redirect_edges(responses: DataFrame) -> DataFrame:
    """Edges from 3xx locations and html meta refresh tags; ``target`` null and ``bad_target`` true when unusable.

    ``responses(fetch_url, code, content_type, location, body)`` with ``body`` as text.
    """
    metas = F.filter(X.start_tags(X.live_markup(F.col("body")), "meta"), lambda tag: F.lower(X.raw_attribute(tag, "http-equiv")) == "refresh")
    refresh = F.coalesce(F.regexp_extract(X.raw_attribute(F.get(metas, F.lit(0)), "content"), r"\d+; *(?:URL|url)=(.+)", 1), F.lit(""))
    is_html = F.trim(F.substring_index("content_type", ";", 1)) == "text/html"
    raw = F.when(F.col("code").startswith("3"), F.coalesce("location", F.lit(""))).when(
        (F.col("code") == "200") & is_html & (refresh != ""), refresh)
    kind = F.when(F.col("code").startswith("3"), "location").otherwise("meta_refresh")
    found = responses.select("fetch_url", kind.alias("kind"), raw.alias("raw_target")).where("raw_target is not null")
    linked = U.with_canonical(found, "raw_target", "fetch_url")
    return linked.select("fetch_url", "kind", "raw_target", F.col("link_url").alias("target"),
                         F.col("link_url").isNull().alias("bad_target"))


def classify_responses(df: DataFrame, max_retries: int = 3) -> DataFrame:
    """Outcome class of each response ``(fetch_url, code, attempt)``; ``attempt`` counts earlier transient errors."""
    host = U.url_host(F.col("fetch_url"))
    outcome = (
        F.when(F.col("code").startswith("3"), "redirect")
        .when(F.col("code") == "200", "success")
        .when((F.col("code") == "SSLError") & host.startswith("www."), "retry_without_www")
        .when(F.col("code") == "SSLError", "tls_error")
        .when(F.col("code").isin(PERMANENT_ERROR_CODES) | (F.col("attempt") >= max_retries), "permanent_error")
        .otherwise("transient_error")
    )
    fallback = F.regexp_replace("fetch_url", r"^(https?://)www\.", "$1")
    return df.withColumn("outcome", outcome).withColumn("retry_url", F.when(F.col("outcome") == "retry_without_www", fallback))


def crawl_counters(responses: DataFrame, crawl: str = "crawl_id") -> DataFrame:
    """Per crawl: requests, pages reached and repeated fetches of one canonical url (``responses`` carry ``key``)."""
    per_page = responses.groupBy(crawl, "key").agg(F.count("*").alias("_n"))
    return per_page.groupBy(crawl).agg(
        F.sum("_n").alias("requests"), F.count("*").alias("pages"), F.sum(F.col("_n") - 1).alias("duplicate_fetches"))


def url_dates(df: DataFrame, path: Column) -> DataFrame:
    return df.withColumn("url_date", U.path_date(path))


def url_prefixes(df: DataFrame, url: str = "url") -> DataFrame:
    """The url and each parent down to ``scheme://host``, longest first: ``depth, prefix_url, prefix_key``."""
    slashes = F.size(F.split(url, "/")) - 1
    lengths = F.when(slashes >= 2, F.sequence(slashes + 1, F.lit(3), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    exploded = df.select("*", F.posexplode(lengths).alias("depth", "_segments"))
    prefixed = exploded.withColumn("prefix_url", F.expr(f"substring_index(`{url}`, '/', _segments)"))
    return prefixed.withColumn("prefix_key", U.scheme_less(F.col("prefix_url"))).drop("_segments")


def first_feed_prefix(prefixes: DataFrame, feeds: DataFrame, keys: list[str], longest_first: bool = True) -> DataFrame:
    """Per url the first prefix that yields a feed. ``feeds(prefix_key, feed_url)``."""
    order = F.col("depth") if longest_first else F.col("depth").desc()
    return first_per_key(prefixes.join(feeds, "prefix_key"), keys, [order, "feed_url"])


def rollup_parent_urls(df: DataFrame) -> DataFrame:
    """Score sums of parent urls: ``df(url, score)``."""
    tokens = F.size(F.split("url", "/"))
    parents = (
        df.where(F.col("url").isNotNull() & ~F.col("url").like("%jobs") & ~F.col("url").like("%careers"))
        .where((tokens > 4) | ((tokens == 4) & ~F.col("url").endswith("/")))
        .select(F.regexp_replace("url", "(/[0-9]+)*/[^/]+/?$", "").alias("up_url"), "score")
    )
    grouped = parents.groupBy(U.scheme_less(F.col("up_url")).alias("up_key")).agg(
        F.max("up_url").alias("up_url"), F.sum("score").alias("sum_score"), F.count("*").alias("n"))
    return grouped.orderBy(F.col("sum_score").desc(), "up_url")


def rollup_newsletter_roots(urls: DataFrame, marked_roots: DataFrame, hosted_domain: str, min_year: int = 2020,
                            min_score: int = 50) -> DataFrame:
    """Score sums of newsletter roots: ``urls(url, score, year)``, roots confirmed by ``marked_roots(root_url)``."""
    posts = urls.where((F.col("year") >= min_year) & (F.col("score") > min_score)
                       & F.col("url").contains("/p/") & ~F.col("url").contains(hosted_domain))
    roots = posts.groupBy(F.substring_index("url", "/p/", 1).alias("root_url")).agg(F.sum("score").alias("sum_score"))
    return roots.join(marked_roots, "root_url", "left_semi").orderBy(F.col("sum_score").desc(), "root_url")


def query_param_profile(df: DataFrame) -> DataFrame:
    """Per query parameter of ``df(site_id, url)``: distinct urls, sites and values, and whether it leads any of them."""
    pairs = F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")
    exploded = df.where(F.col("url").contains("?")).select("site_id", "url", F.explode(pairs).alias("_kv"))
    named = exploded.select("site_id", "url", F.substring_index("_kv", "=", 1).alias("param"),
                            F.when(F.col("_kv").contains("="), F.expr("substring(_kv, instr(_kv, '=') + 1)")).alias("value"))
    profile = named.groupBy("param").agg(
        F.count_distinct("url").alias("n_urls"), F.count_distinct("site_id").alias("n_sites"),
        F.count_distinct(F.coalesce("value", F.lit("\0"))).alias("n_values"))
    counts = ["n_urls", "n_sites", "n_values"]
    most = profile.agg(*[F.max(n).alias(f"_{n}") for n in counts])
    # The other side is one row.
    led = profile.crossJoin(F.broadcast(most))
    return led.select("param", *counts, *[(F.col(n) == F.col(f"_{n}")).alias(n.replace("n_", "most_")) for n in counts])


def repeated_param_urls(df: DataFrame) -> DataFrame:
    """Urls that give one parameter more than once."""
    names = F.transform(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda kv: F.substring_index(kv, "=", 1))
    return df.where(F.col("url").contains("?")).where(F.size(F.array_distinct(names)) < F.size(names))


def top_hosts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` hosts with most rows; ``key`` is a scheme-less url."""
    counts = df.groupBy(F.regexp_extract(key, "^[^/]+", 0).alias("host")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "host").limit(k)


# Fixed value: last path tokens counted together as archive-like.
ARCHIVE_TOKEN_PATTERN = r"^(?:archives?|blog|posts|articles|writing|journal|all)(?:\.[a-z]+)?$"


def path_token_hist(df: DataFrame, url: str) -> DataFrame:
    last = F.element_at(F.split(F.regexp_replace(url, "/$", ""), "/"), -1)
    token = F.when(last.rlike(ARCHIVE_TOKEN_PATTERN), F.lit(ARCHIVE_TOKEN_PATTERN)).otherwise(last)
    return df.groupBy(token.alias("token")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token")


def classify_link_role(df: DataFrame) -> DataFrame:
    return df.withColumn("role", U.link_role(F.coalesce(F.col("parts.trimmed_path"), F.lit(""))))


def audit_urls(df: DataFrame) -> DataFrame:
    """How many links of a dataset are usable, and why the others are not."""
    return df.groupBy(F.coalesce("reject", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))
