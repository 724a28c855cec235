"""Url expressions: parsing, escaping, relative resolution, canonical parts and comparison keys.

Everything here is a ``Column`` built from native functions, so a url pass stays inside one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The query parameters that identify a page, the patterns of page roles, and the blanks trimmed from
# both ends of a url.
PAGE_QUERY_PARAMS = [
    "page", "year", "m", "start", "offset", "skip", "updated-max", "sort", "order", "format",
]
PAGE_QUERY_PATTERN = ".*page"
ARCHIVES_PATTERN = r"/(?:[a-z-]*archives?|posts?|all(?:-[a-z]+)?)(?:\.[a-z]+)?$"
MAIN_PAGE_PATTERN = r"/(?:blog|articles|writing|journal|essays)(?:\.[a-z]+)?$"
POST_ID_PATTERN = r"^(/post/\d+)(?:/[^/]+)?/?$"
BLANKS = r"(?: |\t|\n|\x00|\x0b|\f|\r|%20|%09|%0a|%00|%0b|%0c|%0d)+"
PLAIN_URL = r"^(?:https?:)?[\-_.!~*'()a-zA-Z0-9;/?&=+$,]+$"

# A url, or a path of the same host, that says all that counts as it stands: host without port, path without empty or dot segments.
SIMPLE_URL = r"^(?:https?://[A-Za-z0-9.\-]++(?=/|\z)|(?=/))(?!.*/[/.])[A-Za-z0-9._~/\-]*+\z"
SIMPLE_BASE = r"^https?://[A-Za-z0-9.\-]++(?:/[A-Za-z0-9._~/\-]*+)?\z"

# RFC 3986, appendix B: 2 scheme, 3 //authority, 4 authority, 5 path, 6 ?query, 7 query, 8 #fragment.
RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
# Authority: 1 userinfo@, 2 host, 3 :port, 4 port.
AUTHORITY = r"^(.*@)?(\[[^\]]*\]|[^:]*)(:(.*))?$"
# RFC 3986 section 3.3: what a path segment may hold besides letters, digits and "-._*".
SEGMENT_CHARS = "~!$&'()+,;=:@/"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


# A noncharacter, which no text holds, keeps the parts of one match apart.
_CUT = "\uffff"


def _cut(text: Column, pattern: str, groups: list[int]) -> Column:
    """All wanted groups of a whole-text pattern from a single match, as an array; a missing group is empty."""
    return F.split(F.regexp_replace(text, pattern, _CUT.join(f"${g}" for g in groups)), _CUT)


def percent_decoded(text: Column) -> Column:
    """Decode every valid ``%xx``; a stray ``%`` and ``+`` stay. Undecodable bytes give the text back unchanged."""
    guarded = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9a-fA-F]{2})", "%25"), r"\+", "%2B")
    decoded = F.try_url_decode(guarded)
    return F.when(decoded.isNull() | decoded.contains("�"), text).otherwise(decoded)


def percent_encoded(text: Column, extra: str = "") -> Column:
    """Percent-encode all characters that a path segment (plus ``extra``) may not hold."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for ch in SEGMENT_CHARS + extra:
        encoded = F.replace(encoded, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return encoded


def without_dot_segments(path: Column) -> Column:
    """RFC 3986 section 5.2.4 on an absolute path, as a fold over its segments."""
    segments = F.split(path, "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(seg == ".", kept)
        .when(seg == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept))
        .otherwise(F.concat(kept, F.array(seg))),
    )
    text = F.array_join(folded, "/")
    closed = F.when(path.rlike(r"/\.\.?$") & ~text.endswith("/"), F.concat(text, F.lit("/"))).otherwise(text)
    rooted = F.when(closed.startswith("/"), closed).otherwise(F.concat(F.lit("/"), closed))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), rooted).otherwise(path)


def _merged_path(base_path: Column, path: Column) -> Column:
    folder = F.regexp_extract(base_path, "^(.*/)", 1)
    return (
        F.when(path == "", F.when(base_path == "", F.lit("/")).otherwise(base_path))
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    )


def with_canonical(df: DataFrame, url: str, base: str | None = None, prefix: str = "") -> DataFrame:
    """Add ``<prefix>reject``, ``link_url``, ``parts``, ``canonical`` and ``key`` of a raw href.

    A href without scheme takes scheme, host and port of ``base``, also when it names another host. Written as a chain
    of projections, so that each intermediate text is computed once and the chain stays in one code-generated stage. Simple
    urls are cut at their slashes, and the chain sees nulls in their place.
    """
    c = F.col
    base_col = F.lit(None).cast("string") if base is None else c(f"`{base}`")
    told = c(f"`{url}`").rlike(SIMPLE_URL) & (~c(f"`{url}`").startswith("/") | base_col.rlike(SIMPLE_BASE))
    kept = [*df.columns, "_simple", "_whole", "_from"]
    df = df.select(*[c(f"`{k}`") for k in df.columns], F.coalesce(told, F.lit(False)).alias("_simple"), c(f"`{url}`").alias("_whole"), base_col.alias("_from"))
    href, base_col = (F.when(~c("_simple"), x) for x in (c("_whole"), c("_from")))
    # Only an end that is a blank, or the last letter of an encoded one, is worth the search for a run of them.
    padded = href.rlike(r"^[\s\x00%]") | href.rlike(r"[\s\x0009abcdABCD]$")
    stripped = F.when(padded, F.regexp_replace(F.regexp_replace(href, f"(?i)^{BLANKS}", ""), f"(?i){BLANKS}$", "")).otherwise(href)
    one = df.select(*[c(f"`{k}`") for k in kept], base_col.alias("_base"),
                    F.replace(stripped, F.lit("\n"), F.lit("")).alias("_text"))
    two = one.withColumns({"_plain": c("_text").rlike(PLAIN_URL)})
    three = two.withColumns({
        "_raw": F.split(F.when(c("_plain"), c("_text")).otherwise(percent_decoded(c("_text"))), "#", 2)[0]
    })
    four = three.withColumns({"_p": _cut(c("_raw"), RFC3986, [2, 3, 4, 5, 6, 7]), "_b": _cut(c("_base"), RFC3986, [2, 4, 5])})
    named = four.select(
        *[c(f"`{k}`") for k in kept], "_plain", "_raw", c("_base").isNull().alias("_no_base"), c("_p")[0].alias("_scheme"),
        (c("_p")[1] != "").alias("_slashes"), c("_p")[3].alias("_path"), F.slice(c("_p"), 3, 4).alias("_plain_parts"), _cut(c("_p")[2], AUTHORITY, [2, 3, 4]).alias("_a"),
        F.lower(c("_b")[0]).alias("_base_scheme"), c("_b")[1].alias("_base_authority"), c("_b")[2].alias("_base_path"))
    five = named.withColumns({
        "_early": F.when(c("_raw").isNull(), "empty")
        .when(~c("_plain") & c("_raw").startswith(":"), "colon")
        .when(c("_raw").startswith("mailto:"), "mailto")
        .when((c("_scheme") != "") & ~c("_scheme").rlike(r"^[A-Za-z][A-Za-z0-9.+\-]*$"), "scheme")
        .when(c("_slashes") & c("_a")[0].rlike(r'[<>{}\\"\s^`|]'), "host")
        .when(c("_slashes") & (c("_a")[1] != "") & ~c("_a")[2].rlike(r"^\d*$"), "port")
        .when((c("_scheme") != "") & ~c("_slashes") & (c("_path") == ""), "no_path"),
    })
    # A plain url is its own encoded form, already cut.
    cut = five.withColumn("_f", F.when(c("_plain"), c("_plain_parts")).otherwise(_cut(percent_encoded(c("_raw"), "?"), RFC3986, [4, 5, 6, 7])))
    six = cut.select(
        *[c(f"`{k}`") for k in kept], "_early", "_slashes", F.lower(c("_scheme")).alias("_scheme"),
        # A bracketed host is the one place where encoded brackets come back.
        F.when(c("_f")[0].startswith("%5B"), F.replace(F.replace(c("_f")[0], F.lit("%5B"), F.lit("[")), F.lit("%5D"), F.lit("]"))).otherwise(
            c("_f")[0]).alias("_authority"),
        c("_f")[1].alias("_path"), F.when(c("_f")[2] != "", c("_f")[3]).alias("_query"),
        "_base_scheme", "_base_authority", "_base_path", "_no_base")
    relative = c("_scheme") == ""
    seven = six.select(
        *[c(f"`{k}`") for k in kept], "_early", "_slashes", "_no_base", "_query", relative.alias("_relative"),
        F.when(relative, c("_base_scheme")).otherwise(c("_scheme")).alias("_scheme"),
        F.when(relative, c("_base_authority")).otherwise(c("_authority")).alias("_authority"),
        F.when(relative, _merged_path(c("_base_path"), c("_path"))).otherwise(c("_path")).alias("_path"),
    )
    parted = seven.withColumns({
        "_h": _cut(c("_authority"), AUTHORITY, [1, 2, 4]), "_path": F.when(c("_relative"), without_dot_segments(c("_path"))).otherwise(c("_path"))})
    eight = parted.withColumns({"_userinfo": c("_h")[0], "_host": c("_h")[1], "_port": c("_h")[2]})
    default = ((c("_scheme") == "http") & (c("_port") == "80")) | ((c("_scheme") == "https") & (c("_port") == "443"))
    nine = eight.withColumns({
        "_reject": F.when(c("_early").isNotNull(), c("_early"))
        .when(c("_userinfo") != "", "userinfo")
        .when(c("_relative") & c("_no_base"), "not_http")
        .when(~c("_scheme").isin("http", "https"), "not_http")
        .when(~c("_relative") & ~c("_slashes"), "opaque")
    })
    keep = c("_reject").isNull()
    link = F.struct(
        c("_reject").alias("reject"),
        F.when(keep, c("_scheme")).alias("scheme"),
        F.when(keep, c("_host")).alias("host"),
        F.when(keep, F.when(default, F.lit("")).otherwise(c("_port"))).alias("port"),
        F.when(keep, F.replace(c("_path"), F.lit("//"), F.lit("/"))).alias("path"),
        F.when(keep, F.replace(c("_query"), F.lit("+"), F.lit("%2B"))).alias("query"),
    )
    ten = nine.select(*[c(f"`{k}`") for k in kept], link.alias("_link"))
    eleven = ten.select(*[c(f"`{k}`") for k in kept], c("_link"), canonical_parts(c("_link")).alias("_parts"))
    result = F.struct(
        c("_link.reject").alias(f"{prefix}reject"),
        link_url(c("_link")).alias(f"{prefix}link_url"),
        c("_parts").alias(f"{prefix}parts"),
        canonical_url(c("_parts")).alias(f"{prefix}canonical"),
        canonical_key(c("_parts")).alias(f"{prefix}key"),
    )
    # A simple url, as server and path.
    rooted = c("_whole").startswith("/")
    server = F.when(c("_simple"), F.substring_index(F.when(rooted, c("_from")).otherwise(c("_whole")), "/", 3))
    twelve = eleven.select(*[c(f"`{k}`") for k in kept], "_link", "_parts", server.alias("_server"))
    path = F.when(rooted, c("_whole")).otherwise(F.substring("_whole", F.length("_server") + 1, F.length("_whole")))
    thirteen = twelve.select(*[c(f"`{k}`") for k in kept], "_link", "_parts", "_server", F.when(c("_simple"), path).alias("_at"),
                             F.substring_index("_server", "/", -1).alias("_name"))
    made = thirteen.select(*[c(f"`{k}`") for k in kept[:-3]], F.when(c("_simple"), _simple_link(c("_server"), c("_name"), c("_at"), prefix)).otherwise(result).alias("_result"))
    # The one-element ``inline`` keeps later filters and join conditions on the results from being pushed below, which
    # would copy the whole chain into them once per reference.
    return made.select(*[c(f"`{k}`") for k in kept[:-3]], F.inline(F.array("_result")))


def _simple_link(server: Column, host: Column, path: Column, prefix: str) -> Column:
    """What ``with_canonical`` adds to a url that is ``SIMPLE_URL``."""
    shown = F.when(path == "/", "").otherwise(path)
    short = F.when(path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)
    return F.struct(
        F.lit(None).cast("string").alias(f"{prefix}reject"),
        F.concat(server, path).alias(f"{prefix}link_url"),
        F.struct(host.alias("host"), F.lit("").alias("port"), shown.alias("path"), F.nullif(short, F.lit("")).alias("trimmed_path"), F.lit("").alias("query")).alias(f"{prefix}parts"),
        F.concat(host, shown).alias(f"{prefix}canonical"),
        F.concat(host, F.lit("/"), short, F.lit("?")).alias(f"{prefix}key"),
    )


def link_url(link: Column) -> Column:
    """Absolute url text of a parsed link, null when rejected."""
    return F.when(
        link["reject"].isNull(),
        F.concat(
            link["scheme"], F.lit("://"), link["host"],
            F.when(link["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), link["port"])),
            link["path"],
            F.when(link["query"].isNull(), F.lit("")).otherwise(F.concat(F.lit("?"), link["query"])),
        ),
    )


def canonical_query(query: Column) -> Column:
    """``?`` plus the page-identifying parameters in order, or an empty text. ``p``, ``p=`` and ``p=v`` stay apart."""
    kept = F.filter(
        F.split(query, "&"),
        lambda kv: F.substring_index(kv, "=", 1).isin(PAGE_QUERY_PARAMS)
        | F.substring_index(kv, "=", 1).rlike(PAGE_QUERY_PATTERN),
    )
    joined = F.array_join(kept, "&")
    return F.when(query.isNull() | (joined == ""), F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def trimmed(path: Column) -> Column:
    """Path without trailing slashes; null when nothing else is left."""
    return F.nullif(F.regexp_replace(path, "/+$", ""), F.lit(""))


def canonical_parts(link: Column) -> Column:
    """``struct<host, port, path, trimmed_path, query>`` of a parsed link, null when rejected."""
    path = F.when((link["path"] == "/") & link["query"].isNull(), F.lit("")).otherwise(link["path"])
    return F.when(
        link["reject"].isNull(),
        F.struct(
            link["host"].alias("host"),
            F.when(link["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), link["port"])).alias("port"),
            path.alias("path"),
            trimmed(path).alias("trimmed_path"),
            canonical_query(link["query"]).alias("query"),
        ),
    )


def canonical_url(parts: Column) -> Column:
    return F.concat(parts["host"], parts["port"], parts["path"], parts["query"])


def _comparable_path(parts: Column, post_paths: Column) -> Column:
    post = F.regexp_extract(parts["path"], POST_ID_PATTERN, 1)
    return F.when(post_paths & (post != ""), post).otherwise(F.coalesce(parts["trimmed_path"], F.lit("")))


def canonical_key(parts: Column, same_hosts: Column | None = None, post_paths: Column | None = None) -> Column:
    """Set-membership key under per-blog rules: one token for the same-host group, optional post-id collapse."""
    server = F.concat(parts["host"], parts["port"])
    if same_hosts is not None:
        grouped = F.coalesce(F.array_contains(same_hosts, server), F.lit(False))
        server = F.when(grouped, F.lit(":same_hosts")).otherwise(server)
    post_paths = F.lit(False) if post_paths is None else F.coalesce(post_paths, F.lit(False))
    return F.concat(server, F.lit("/"), _comparable_path(parts, post_paths), F.lit("?"), parts["query"])


def equality_key(parts: Column, same_hosts: Column | None = None, post_paths: Column | None = None) -> Column:
    """Key of the pairwise equality rule: as ``canonical_key`` but blind to ports; a post id also hides the query."""
    host = parts["host"]
    if same_hosts is not None:
        host = F.when(F.coalesce(F.array_contains(same_hosts, host), F.lit(False)), F.lit(":same_hosts")).otherwise(host)
    post_paths = F.lit(False) if post_paths is None else F.coalesce(post_paths, F.lit(False))
    is_post = post_paths & (F.regexp_extract(parts["path"], POST_ID_PATTERN, 1) != "")
    query = F.when(is_post, F.lit("")).otherwise(parts["query"])
    return F.concat(host, F.lit("/"), _comparable_path(parts, post_paths), F.lit("?"), query)


def without_query(parts: Column) -> Column:
    return parts.withField("query", F.lit(""))


def link_role(trimmed_path: Column) -> Column:
    return (
        F.when(trimmed_path.rlike(ARCHIVES_PATTERN), "archives")
        .when(trimmed_path.rlike(MAIN_PAGE_PATTERN), "main_page")
        .otherwise("other")
    )


def scheme_less(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def path_date(path: Column) -> Column:
    """Date of a ``/yyyy/mm/dd/`` path part; null when absent or not a real day."""
    pattern = r"/(\d{4})/(\d{2})/(\d{2})/"
    text = F.concat_ws("-", *[F.regexp_extract(path, pattern, g) for g in (1, 2, 3)])
    return F.when(path.rlike(pattern), F.try_to_date(text, "yyyy-MM-dd"))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
