"""A Merkle manifest of a dataset: digests of rows, a tree over them for each group, and a proof for every row.

Nodes are labelled by the interval ``[lo, hi)`` of the leaf ranks that they cover, so an ancestor is a node whose interval
contains another's, whatever its level. Six levels form a band. Every node belongs to one bucket of its band: the
interval of the node on top of the band that contains it, at most 64 nodes wide. Building goes bucket by bucket, from the
leaves up; proofs come down again: nodes join the bucket whose interval contains theirs, the ancestors in the bucket are
those with containing intervals, and what a parent's interval has beyond the node's own names the siblings. What stands
above a bucket is attached to the bucket once and not to each leaf, so a leaf takes part in one join however high
the tree is.

Digests are lower-case hexadecimal SHA-256 values of concatenated texts. A lone last node has no sibling and is hashed
alone; a group with one row has its leaf as subroot. The subroots, ordered by group (null first, then by bytes), are the
leaves of one more tree, built in the same way, however many groups there are.

Null values count as ``-`` in a leaf, so a null and an empty text differ. Texts are hashed whole. Rows ascend by key, nulls
first; rows with the same key ascend by leaf, and equal leaves have neighbouring ranks, so repeated rows each have a
proof of their own. An empty table has an empty manifest. Columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm import ranks
from feedlake.llm.common import Scratch

#: Levels of a band: a bucket holds at most ``2 ** BAND`` nodes of its lowest level.
BAND = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row's values: each as its length in bytes, a colon and its text, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, from the lowest level up."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path in their order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclass
class Manifest:
    """``leaves``: the rows read, with ``grp``, ``rank``, ``leaf``. ``bands``: stored buckets of the groups' trees, lowest first
    (``grp, bucket, lo, hi, levels``). ``groups``: ``grp, name, n_leaves, subroot, path`` (from the subroot to the root)."""

    leaves: DataFrame
    bands: list[DataFrame]
    groups: DataFrame
    root: str | None

    def nodes(self) -> DataFrame:
        """Every node of the groups' trees: ``grp, level, lo, hi, digest``."""
        parts = []
        for band, buckets in enumerate(self.bands):
            levels = buckets.select("grp", "bucket", F.posexplode("levels").alias("k", "level_nodes"))
            parts.append(levels.filter("k > 0" if band else "k >= 0").select(
                "grp", (F.col("k") + band * BAND).alias("level"), F.inline("level_nodes")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


def _parents(level: Column) -> Column:
    """The level above: each two neighbours become one node that covers both intervals."""
    def join_two(i):
        one, two = F.get(level, 2 * i), F.get(level, 2 * i + 1)
        return F.struct(one["lo"].alias("lo"), F.coalesce(two["hi"], one["hi"]).alias("hi"),
                        digest(one["digest"], F.coalesce(two["digest"], F.lit(""))).alias("digest"))

    last = F.floor((F.size(level) + 1) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), join_two)


def _build(nodes: DataFrame, height: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored buckets of each band, and ``(grp, digest)`` of the top nodes.

    ``nodes (grp, pos, n, lo, hi, digest)``: ``n`` nodes of a group, numbered by ``pos``. ``height`` is that of the highest tree.
    """
    bands, tops = [], []
    for band in range(max(1, -(-height // BAND))):
        size = 1 << BAND
        members = F.sort_array(F.collect_list(F.struct("pos", "lo", "hi", "digest")))
        packed = nodes.groupBy("grp", F.shiftright("pos", BAND).alias("bucket"), "n").agg(members.alias("m"))
        base = packed.select("grp", "bucket", "n", F.transform("m", lambda x: F.struct(x["lo"], x["hi"], x["digest"])).alias("base"))
        # Below the top of its tree a bucket climbs all levels of the band, even from one node.
        count = F.when(F.col("n") > size, BAND).when(F.col("n") < 2, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
        steps = F.slice(F.array(*[F.lit(k) for k in range(BAND)]), F.lit(1), count)
        levels = F.aggregate(steps, F.array("base"), lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
        buckets = scratch.store(base.select(
            "grp", "bucket", "n", F.get("base", 0)["lo"].alias("lo"), F.element_at("base", -1)["hi"].alias("hi"), levels.alias("levels")), f"{name}-{band}")
        bands.append(buckets)
        top = buckets.withColumn("top", F.element_at(F.element_at("levels", -1), 1))
        tops.append(top.filter(F.col("n") <= size).select("grp", "top.digest"))
        nodes = top.filter(F.col("n") > size).select(
            "grp", F.col("bucket").alias("pos"), F.floor((F.col("n") + size - 1) / size).alias("n"), "top.lo", "top.hi", "top.digest")
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return bands, out


def _path(levels: Column, pos: Column, lo: Column, hi: Column) -> Column:
    """Siblings met on the way from a node of the lowest level to the top of its bucket, an element for each level.

    On each level the ancestor is the node whose interval contains ``[lo, hi)``; it stands at the place that the rank's leading
    bits name, and its parent's interval less its own is the interval of the sibling before or after it.
    """
    def step(level, k):
        place = F.call_function("shiftright", F.pmod(pos, F.lit(1 << BAND)).cast("int"), k)
        own, parent = F.get(level, place), F.get(F.get(levels, k + 1), F.call_function("shiftright", place, F.lit(1)))
        inside = (own["lo"] <= lo) & (hi <= own["hi"])
        before = F.when(inside & (parent["lo"] < own["lo"]), F.get(level, place - 1)["digest"])
        after = F.when(inside & (own["hi"] < parent["hi"]), F.get(level, place + 1)["digest"])
        return F.struct(F.coalesce(before, F.lit("")).alias("before"), F.coalesce(after, F.lit("")).alias("after"))

    below = F.slice(levels, F.lit(1), F.size(levels) - 1)
    return F.transform(below, step)


def _attach(nodes: DataFrame, buckets: DataFrame, *also: str) -> DataFrame:
    """Containment join: ``nodes (grp, pos, lo, hi, ...)`` with the bucket whose interval contains theirs; adds ``path``, which
    continues with the bucket's own, and the columns ``also`` of the bucket."""
    above = buckets.select(F.col("grp").alias("_g"), F.col("bucket").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                           F.col("levels").alias("_levels"), F.col("path").alias("_above"), *also)
    inside = ((F.col("grp") == F.col("_g")) & (F.shiftright("pos", BAND) == F.col("_b"))
              & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
    joined = nodes.join(above, inside)
    return joined.withColumn("path", F.concat(_path(F.col("_levels"), F.col("pos"), F.col("lo"), F.col("hi")), F.col("_above"))).drop(
        "_g", "_b", "_lo", "_hi", "_levels", "_above")


def _with_paths(bands: list[DataFrame], starts: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The lowest band's buckets with ``path``, the siblings from the top of the bucket on. ``starts (grp, path)`` is what
    follows above the tree of a group; without it nothing does."""
    above = None
    for band in range(len(bands) - 1, -1, -1):
        buckets = bands[band]
        size = 1 << BAND
        top = buckets.filter(F.col("n") <= size)
        top = top.join(starts, "grp") if starts is not None else top.withColumn("path", F.array().cast(f"array<{STEP}>"))
        out = top.select("grp", "bucket", "lo", "hi", "levels", "path")
        if above is not None:
            lower = buckets.filter(F.col("n") > size).select("grp", F.col("bucket").alias("pos"), "lo", "hi", "levels")
            out = out.union(_attach(lower, above).select("grp", F.col("pos").alias("bucket"), "lo", "hi", "levels", "path"))
        above = scratch.store(out, f"{name}-{band}") if band else out
    return above


def build_manifest(docs: DataFrame, scratch: Scratch, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
                   carry: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``docs``; ``carry`` are further columns to keep with the leaves."""
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("name"), leaf_digest([F.col(f) for f in fields]).alias("leaf"),
                       *[v.alias(k) for k, v in (carry or {}).items()])
    order = [F.col("name").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf").asc()]
    leaves = ranks.ranked(rows, "name", order, scratch, "leaves").withColumnsRenamed(
        {ranks.GROUP: "grp", ranks.POSITION: "rank", ranks.MEMBERS: "n_leaves"})
    tallest = leaves.agg(F.max("n_leaves")).first()[0]
    nodes = leaves.select("grp", F.col("rank").alias("pos"), F.col("n_leaves").alias("n"), F.col("rank").alias("lo"),
                          (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"))
    bands, subroots = _build(nodes, _height(tallest), scratch, "tree")
    # The subroots are the leaves of the upper tree.
    subroots = ranks.ranked(subroots.withColumnRenamed("digest", "subroot"), None, [F.col("grp").asc()], scratch, "subroots")
    subroots = subroots.select(F.col("grp").alias("child"), "subroot", F.lit(0).cast("long").alias("grp"), F.col(ranks.POSITION).alias("pos"),
                               F.col(ranks.POSITION).alias("lo"), (F.col(ranks.POSITION) + 1).alias("hi"), F.col(ranks.MEMBERS).alias("n"))
    total = subroots.agg(F.max("n")).first()[0]
    upper, tops = _build(subroots.withColumnRenamed("subroot", "digest").drop("child"), _height(total), scratch, "upper")
    top = tops.select("digest").first()
    paths = _attach(subroots, _with_paths(upper, None, scratch, "upper-paths"))
    names = leaves.select("grp", "name", "n_leaves").distinct()
    groups = scratch.store(paths.select(F.col("child").alias("grp"), "subroot", "path").join(names, "grp"), "groups")
    return Manifest(leaves, bands, groups, top[0] if top else None)


def _height(n: int | None) -> int:
    return max(0, (n or 1) - 1).bit_length()


def proofs(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """The leaves with ``subroot``, ``root`` and ``path``, the siblings from the lowest level to the root."""
    starts = manifest.groups.select("grp", "path")
    lowest = _with_paths(manifest.bands, starts, scratch, "paths").join(manifest.groups.select("grp", "subroot"), "grp")
    nodes = manifest.leaves.withColumns({"pos": F.col("rank"), "lo": F.col("rank"), "hi": F.col("rank") + 1})
    return _attach(nodes, scratch.store(lowest, "lowest"), "subroot").drop("pos", "lo", "hi").withColumn("root", F.lit(manifest.root))


def tamper_report(docs: DataFrame) -> DataFrame:
    """Every row's proof against a copy of the table in which some rows are altered.

    Where 7 divides the CRC32 of the decimal ``doc_id``, the copy has one more in ``n_chars`` (a null stays null, so that such a
    row is not altered); a row without id is not altered. The copy's leaf, folded with the siblings of the original tree,
    must give the root.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    altered = leaf_digest([F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in FIELDS])
    manifest = build_manifest(docs, scratch, carry={"copy": F.when(chosen, altered)})
    out = proofs(manifest, scratch).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("copy", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# DuckDB has no CRC32: bits are shifted out one by one, over the bytes of the decimal id.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, 3988292384 * (x % 2)))), 4294967295)")


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(parts) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp, row_number() OVER () AS id
  FROM (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
          CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS copy FROM documents)),
tree AS (
  SELECT grp, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY grp, level, pos // 2, n),
subroots AS (SELECT grp, level AS height, digest, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, grp AS pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT id, l.level AS step, CASE WHEN (l.pos >> l.level) % 2 = 1 THEN s.digest END AS before,
    CASE WHEN (l.pos >> l.level) % 2 = 0 THEN s.digest END AS after
  FROM (SELECT id, grp, pos, unnest(range(0, height)) AS level FROM leaves JOIN subroots USING (grp)) l
  LEFT JOIN tree s ON s.grp = l.grp AND s.level = l.level AND s.pos = xor(l.pos >> l.level, 1)
  UNION ALL
  SELECT id, height + u.level, CASE WHEN (grp >> u.level) % 2 = 1 THEN s.digest END, CASE WHEN (grp >> u.level) % 2 = 0 THEN s.digest END
  FROM (SELECT id, grp, height, unnest(range(0, (SELECT max(level) FROM upper))) AS level FROM leaves JOIN subroots USING (grp)) u
  LEFT JOIN upper s ON s.level = u.level AND s.pos = xor(u.grp >> u.level, 1)),
paths AS (
  SELECT id, list({{'before': coalesce(before, ''), 'after': coalesce(after, '')}} ORDER BY step) AS path,
    sha256(coalesce(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step), '')) AS proof
  FROM steps GROUP BY id),
folds AS (
  SELECT id, 0 AS k, coalesce(copy, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.id, k + 1, sha256(path[k + 1].before || digest || path[k + 1].after) FROM folds f JOIN paths p ON p.id = f.id AND k < len(path)),
folded AS (SELECT id, arg_max(digest, k) AS digest FROM folds GROUP BY id)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root,
  f.digest = r.digest AS verified
FROM leaves l JOIN subroots s USING (grp) JOIN folded f USING (id) LEFT JOIN paths p USING (id)
CROSS JOIN (SELECT digest FROM upper WHERE n = 1) r"""
