"""Feed document expressions: kind, items, fields, dates and entity decoding.

Stored feeds are often not well formed, so documents are read with patterns over a flattened text (comments dropped, CDATA
turned into escaped text), which keeps the whole parse in native expressions and never fails a task on a bad document.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.text import bound, xml_escaped

# Namespaces that identify a feed dialect, and zone names of RFC 822 with their offset in minutes.
ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"
RSS1_NAMESPACE = "http://purl.org/rss/1.0/"
ZONE_MINUTES = {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def flattened(content: Column) -> Column:
    """Document without comments and with CDATA sections as escaped text: every ``<`` left opens a tag."""
    def escaped(plain: Column) -> Column:
        pieces = F.transform(
            F.split(plain, r"<!\[CDATA\["),
            lambda p, i: F.when(i == 0, p).otherwise(F.concat(
                xml_escaped(F.substring_index(p, "]]>", 1)),
                F.when(p.contains("]]>"), F.regexp_extract(p, r"(?s)\]\]>(.*)$", 1)).otherwise(""))))
        return F.when(plain.contains("<![CDATA["), F.array_join(pieces, "")).otherwise(plain)

    return bound(F.when(content.contains("<!--"), F.regexp_replace(content, "(?s)<!--.*?-->", "")).otherwise(content), escaped)


def root_element(content: Column) -> Column:
    """The first start tag, with its attributes, behind declarations and comments."""
    return F.regexp_extract(
        content, r"(?s)^\x{FEFF}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z_][\w.:-]*(?:\s[^>]*)?)/?>", 1)


def feed_kind(content: Column) -> Column:
    """``rss``, ``rdf`` or ``atom``, null for anything else."""
    root = root_element(content)
    name = F.regexp_extract(root, r"^[\w.:-]+", 0)
    has_channel = content.rlike(r"<channel[\s/>]")
    return (
        F.when((name == "rss") & has_channel, "rss")
        .when((name == "rdf:RDF") & has_channel & root.contains("xmlns:rdf=")
              & root.rlike(f"xmlns=[\"']{RSS1_NAMESPACE}[\"']"), "rdf")
        .when((name == "feed") & root.rlike(f"xmlns=[\"']{ATOM_NAMESPACE}[\"']"), "atom")
    )


def elements(text: Column, name: str) -> Column:
    """Inner texts of all elements of that name; an empty element gives an empty text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{name}(?:\s[^>]*?)?(?:/>|>(.*?)</{name}\s*>)"), 1)


def without_elements(text: Column, names: list[str]) -> Column:
    return F.regexp_replace(text, rf"(?s)<({'|'.join(names)})(?:\s[^>]*)?>.*?</\1\s*>", "")


def inner_text(markup: Column) -> Column:
    return decode_entities(bound(markup, lambda m: F.when(m.contains("<"), F.regexp_replace(m, "<[^>]*>", "")).otherwise(m)))


def first_markup(text: Column, name: str) -> Column:
    """Content of the first element of that name, null when there is none."""
    return F.get(elements(text, name), F.lit(0))


def first_text(text: Column, name: str) -> Column:
    return inner_text(first_markup(text, name))


def raw_attribute(tag: Column, name: str) -> Column:
    """Attribute value as written, null when absent; names in any case, values with either quotes or none."""
    pattern = rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

    def value(whole: Column) -> Column:
        groups = F.concat(*(F.regexp_extract_all(whole, F.lit(pattern), k) for k in (1, 2, 3)))
        return F.coalesce(F.get(F.filter(groups, lambda v: v != ""), F.lit(0)), F.lit(""))

    return bound(tag, lambda t: F.when(t.rlike(pattern), value(t)))


def live_markup(html: Column) -> Column:
    """Html without comments and without the bodies of scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")


def start_tags(html: Column, names: str) -> Column:
    """Array of the start tags of elements whose names match a pattern, in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), 0)


def attribute(tag: Column, name: str) -> Column:
    return decode_entities(raw_attribute(tag, name))


def _entity_map() -> Column:
    # Two folded texts instead of hundreds of literals keep the plans small.
    entities = sorted({**name2codepoint, "apos": 39}.items())
    names = ",".join(name for name, _ in entities)
    chars = "\x01".join(chr(code) for _, code in entities)
    return F.map_from_arrays(F.split(F.lit(names), ","), F.split(F.lit(chars), "\x01"))


def decode_entities(text: Column) -> Column:
    """Decode named (HTML 4), decimal and hexadecimal references; unknown ones stay as they are."""
    names = _entity_map()
    pattern = "^(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]*));"
    scalar = "^0*(?:10[0-9a-fA-F]{4}|[0-9a-fA-F]{5}|[0-9a-ce-fA-CE-F][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}|[0-9a-fA-F]{1,3})$"

    def parts(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, pattern, 2)
        return F.named_struct(
            F.lit("piece"), piece, F.lit("name"), F.regexp_extract(piece, pattern, 3),
            F.lit("hex"), F.concat(F.regexp_extract(piece, pattern, 1), F.when(decimal != "", F.conv(decimal, 10, 16)).otherwise("")))

    def decode(part: Column, i: Column) -> Column:
        point = F.call_function("decode", F.unhex(F.lpad(part["hex"], 8, "0")), F.lit("UTF-32"))
        char = F.when(part["hex"].rlike(scalar), point).when(part["name"] != "", F.try_element_at(names, part["name"]))
        rest = F.regexp_extract(part["piece"], "(?s)^[^;]*;(.*)$", 1)
        return F.when(i == 0, part["piece"]).otherwise(
            F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part["piece"])))

    def decoded(whole: Column) -> Column:
        return F.array_join(F.transform(F.transform(F.split(whole, "&"), parts), decode), "")

    # Most texts hold no reference at all.
    return bound(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def decoded_title(text: Column) -> Column:
    """Second decoding of a title: entities, then line break tags to line breaks."""
    return F.regexp_replace(decode_entities(text), "<br/?>", "\n")


def rfc822_date(text: Column) -> Column:
    """Instant of an RFC 822 date. The weekday is not checked."""
    pattern = (r"^\s*(?:[A-Za-z]{3,9}\s*,\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{2}|\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
               r"\s*([A-Za-z]+|[+-]\d{4})\s*$")
    # One match gives all parts; a noncharacter, which no text holds, keeps them apart.
    def groups(whole: Column) -> Column:
        return F.split(F.regexp_replace(whole, pattern, "\uffff".join(f"${g}" for g in range(1, 8))), "\uffff")

    return bound(text, lambda t: F.when(t.rlike(pattern), bound(groups(t), _rfc822_instant)))


def _rfc822_instant(groups: Column) -> Column:
    """Instant of the parts: day, month, year, hour, minute, second, zone."""
    part = [None, *(groups[k] for k in range(7))]
    year = F.when(F.length(part[3]) == 4, part[3]).when(part[3] < "50", F.concat(F.lit("20"), part[3])).otherwise(
        F.concat(F.lit("19"), part[3]))
    stamp = F.concat_ws(" ", year, F.initcap(part[2]), F.lpad(part[1], 2, "0"), F.concat_ws(
        ":", F.lpad(part[4], 2, "0"), part[5], F.when(part[6] == "", "00").otherwise(part[6])))
    sign = F.when(part[7].startswith("-"), -1).otherwise(1)
    numeric = sign * (F.substring(part[7], 2, 2).try_cast("int") * 60 + F.substring(part[7], 4, 2).try_cast("int"))
    named = F.coalesce(*[F.when(F.upper(part[7]) == z, m) for z, m in ZONE_MINUTES.items()], F.lit(0))
    offset = F.when(part[7].rlike("^[+-]"), numeric).otherwise(named)
    local = F.try_to_timestamp(stamp, F.lit("yyyy MMM dd HH:mm:ss"))
    return F.timestamp_add("MINUTE", -offset, local)


def iso_date(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), trimmed.try_cast("timestamp"))


def atom_link(markup: Column) -> Column:
    """``struct<count, href>`` of the candidate links: those with rel=alternate, else those without rel."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?s)<link(\s[^>]*?)?/?>"), 1)

    def chosen(all_tags: Column) -> Column:
        alternates = F.filter(all_tags, lambda x: x.rlike(r"\srel\s*=\s*[\"']alternate[\"']"))
        plain = F.filter(all_tags, lambda x: ~x.rlike(r"\srel\s*="))
        return bound(alternates, lambda a: F.when(F.size(a) > 0, a).otherwise(plain))

    return bound(bound(tags, chosen), lambda links: F.named_struct(
        F.lit("count"), F.size(links), F.lit("href"), attribute(F.get(links, F.lit(0)), "href")))
