"""Fingerprints that follow edit distance: order MinHash over occurrence-numbered k-mers, in native expressions.

A text is a sequence of tokens: Latin words and numbers, cut at ``WORD`` characters, and any other visible character alone. Its
k-mers are two neighbouring tokens. The same k-mer counts again each time it occurs, with the number of the
occurrence, so that repeats are told apart. ``TUPLES`` times two random orders each select the least occurrence-numbered k-mer of
the whole text; the two keep the order in which they stand in the text, and the hash of that pair is one
number of the signature. Two texts agree in a number if they share both selected k-mers in the same order, so moved text lowers the
likeness as edits do; the likeness is the share of numbers that agree.

K-mers fall into ``CLASSES`` by their hash, and each order puts those of one class before all others. Only if a text has none of a
class do others count there, so a long text deals each k-mer to its own class alone. (A text of more than ``FEW`` k-mers
lacks a class once in millions of texts; its numbers of that class are those of no k-mer.)

Texts are read whole. Positions have 24 bits; from 16 million tokens on they are scaled, and k-mers nearer than that scale
count as standing together. Null texts are empty. All texts without tokens have one fingerprint, and a text with one token
has one k-mer. Equal texts have equal fingerprints, whatever their rows; blanks between tokens do not count.

``edited_table`` needs the next row by id. Ids are cut into cells of about ``CELL_ROWS`` rows at quantiles, a window inside the cell
takes the next text, and the first row of each cell also stands at the end of the cell before. An id that fills
several quantiles is cut further by the hash of its text. Rows without id come first; rows with the same id ascend by text hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch

#: Characters of the longest token; tokens of a k-mer; numbers in a signature.
WORD, SIZE, TUPLES = 16, 2, 64
TOKEN = rf"[0-9A-Za-zÀ-ɏ]{{1,{WORD}}}|[^\x00-\x20\u0085\u00A0]"
#: Classes of k-mers; texts up to this many k-mers may lack a class, so that theirs stand in for all classes.
CLASSES, FEW = 8, 128
CELL_ROWS, MOST_CELLS = 256, 1 << 16
# A code has 24 bits of position, three that tell how far a k-mer stands from its own class, and 37 of hash.
_POSITION, _HASH = 24, 27


def _code(h: Column, at: Column) -> Column:
    """The upper bits of a hash and a position in one number, ascending by hash."""
    return h.bitwiseAND(F.lit(-1 << _HASH)).bitwiseOR(at)


def _place(i: Column, n: Column) -> Column:
    most = 1 << _POSITION
    return F.when(n <= most, i).otherwise(F.floor(i.cast("double") * most / n)).cast("long")


def kmer_codes(tokens: Column) -> Column:
    """Sorted array of a text's k-mers: upper bits of the hash, and position."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - SIZE, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(starts, lambda i: _code(F.xxhash64(*[F.get(tokens, i + k) for k in range(SIZE)]), _place(i, n))))


def numbered_codes(codes: Column, steps: Column) -> Column:
    """The k-mers with their occurrence numbers hashed in. ``steps`` are the powers of two up to the size, descending.

    Equal k-mers stand together, by position; the number is the distance to the first of them. The nearest places are looked at
    one by one, the others by halving.
    """
    def numbered(x, i):
        least = x.bitwiseAND(F.lit(-1 << _HASH))
        first = F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.get(codes, acc + s - 1) < least, acc + s).otherwise(acc))
        number = i - first
        for k in (3, 2, 1, 0):
            number = F.when(F.get(codes, i - (k + 1)) >= least, number).otherwise(k)
        return _code(F.xxhash64(least, number), x.bitwiseAND(F.lit((1 << _POSITION) - 1)))

    return F.transform(codes, numbered)


def _all_classes(codes: Column) -> Column:
    """The k-mers of a short text once for each class, with the distance from their own."""
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(CLASSES - 1).cast("long")),
                                  lambda d: F.transform(codes, lambda x: x.bitwiseOR(d * (1 << _POSITION)))))
    return F.when(F.size(codes) <= FEW, every).otherwise(codes)


def with_codes(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``df`` with an array column of numbered k-mers for each of ``texts`` (new name to text)."""
    keep = df.columns
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    bits = {name: F.length(F.bin(F.size(name))) for name in texts}
    for name, text in texts.items():
        df = df.withColumn(name, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    for name in texts:
        df = df.withColumn(name, kmer_codes(F.col(name)))
    df = df.select(*keep, *[numbered_codes(F.col(name), F.slice(powers, 32 - b, b)).alias(name) for name, b in bits.items()])
    return df.select(*keep, *[_all_classes(F.col(name)).alias(name) for name in texts])


def _selected(code: Column, away: Column) -> list[Column]:
    """The least code under both orders of each tuple of a class; k-mers of other classes (``away`` is not 0) come later."""
    at = code.bitwiseAND(F.lit((1 << _POSITION) - 1))
    late = F.when(away == 0, at).otherwise(at.bitwiseOR(F.lit(1 << 56)))
    kmer = F.shiftright(code, _HASH)
    out = []
    for j in range(TUPLES // CLASSES):
        h = F.xxhash64(kmer, F.lit(j))
        # 32 bits of order and identity, then the position: never negative.
        upper = F.shiftleft(F.shiftrightunsigned(h, 32), _POSITION).bitwiseOR(late)
        lower = F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), _POSITION).bitwiseOR(late)
        out += [F.min(upper).alias(f"_a{j}"), F.min(lower).alias(f"_b{j}")]
    return out


def _numbers() -> Column:
    """The pairs of a class in their text order, hashed to eight hexadecimal digits each."""
    parts = []
    for j in range(TUPLES // CLASSES):
        a, b = F.col(f"_a{j}"), F.col(f"_b{j}")
        at = [x.bitwiseAND(F.lit((1 << _POSITION) - 1)) for x in (a, b)]
        kmers = [F.shiftright(x, _POSITION) for x in (a, b)]
        order = F.when(at[0] < at[1], -1).when(at[0] > at[1], 1).otherwise(0)
        parts.append(F.lpad(F.lower(F.hex(F.xxhash64(*kmers, order).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.concat(*parts)


def signatures(df: DataFrame, keys: list[str], texts: dict[str, Column]) -> DataFrame:
    """``keys`` and a fingerprint for each of ``texts`` (name to text). ``keys`` must tell the rows apart.

    The k-mers of a row become rows of their own only inside its task: where ``df`` is dealt by some of ``keys``, nothing
    is shuffled.
    """
    names = list(texts)
    coded = with_codes(df.select(*keys, *[t.alias(f"_t_{n}") for n, t in texts.items()]), {n: F.col(f"_t_{n}") for n in names})
    sides = coded.select(*keys, F.posexplode(F.array(*names)).alias("_side", "_codes"))
    rows = sides.select(*keys, "_side", F.explode_outer("_codes").alias("_code"))
    away = F.shiftright("_code", _POSITION).bitwiseAND(F.lit(CLASSES - 1)).cast("int")
    own = F.shiftright("_code", _HASH).bitwiseAND(F.lit(CLASSES - 1)).cast("int")
    found = rows.select(*keys, "_side", "_code", away.alias("_away"), F.pmod(own + away, F.lit(CLASSES)).alias("_class")).groupBy(
        *keys, "_side", "_class").agg(*_selected(F.col("_code"), F.col("_away"))).select(*keys, "_side", "_class", _numbers().alias("_part"))
    # A text without k-mers has a row of no class, so that all its numbers are zeros.
    return found.groupBy(*keys).agg(*[_joined(k).alias(n) for k, n in enumerate(names)])


def _joined(side: int) -> Column:
    none = F.lit("0" * (8 * TUPLES // CLASSES))
    return F.concat(*[F.coalesce(F.max(F.when((F.col("_side") == side) & (F.col("_class") == g), F.col("_part"))), none) for g in range(CLASSES)])


def likeness(one: Column, two: Column) -> Column:
    """Share of the numbers of two signatures that agree."""
    same = F.filter(F.sequence(F.lit(0), F.lit(TUPLES - 1)), lambda j: F.substr(one, 8 * j + 1, F.lit(8)) == F.substr(two, 8 * j + 1, F.lit(8)))
    return F.size(same) / F.lit(float(TUPLES))


def _cell(key: Column, h: Column, bounds: Column) -> Column:
    """Number of the quantile cell of an id: halving in the sorted bounds; an id that spans several cells is cut by its hash."""
    powers = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])

    def count(less):
        return F.aggregate(powers, F.lit(0), lambda acc, s: F.when(less(F.get(bounds, acc + s - 1)), acc + s).otherwise(acc))

    low, high = count(lambda b: b < key), count(lambda b: b <= key)
    part = (h.cast("double") / F.lit(2.0**64) + 0.5) * (high - low)
    return F.when(key.isNull(), F.lit(-1)).otherwise(low + F.least(F.floor(part), F.greatest(high - low - 1, F.lit(0))).cast("int"))


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(cell, ghost, at, doc_id, text, next_text)`` of every row, texts never null, and of the first row of the following cell.

    Dealt by ``cell`` and sorted by ``(cell, at)``; a ghost stands last in its cell and has no next text. The row after the last is the first.
    """
    ids = docs.select("doc_id").agg(F.count("doc_id").alias("n")).first().n
    cells = min(MOST_CELLS, ids // CELL_ROWS)
    bounds = docs.agg(F.percentile_approx("doc_id", [k / cells for k in range(1, cells)], 10 * cells)).first()[0] if cells > 1 else []
    limits = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    text = F.coalesce("text", F.lit(""))
    key, h = F.col("doc_id").cast("long"), F.xxhash64(text)
    rows = docs.select(_cell(key, h, limits).alias("cell"), F.lit(False).alias("ghost"), "doc_id", text.alias("text"), h.alias("h"))
    # The first row of each cell, and the cell before it in a circle: at most as many rows as cells.
    firsts = rows.groupBy("cell").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("m"))
    known = sorted((r.cell, r.m[0], r.m[1]) for r in firsts.collect())
    before = [(known[k - 1][0], *x) for k, x in enumerate(known)]
    heads = docs.sparkSession.createDataFrame(before, "cell int, own int, id long, first long")
    match = (rows["cell"] == heads["own"]) & (F.coalesce("doc_id", F.lit(0)) == heads["id"]) & (rows["h"] == heads["first"])
    ghosts = rows.join(F.broadcast(heads), match).select(heads["cell"], F.lit(True).alias("ghost"), "doc_id", "text", "h").dropDuplicates(["cell"])
    order = Window.partitionBy("cell").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h")
    both = rows.unionByName(ghosts)
    return both.select("cell", "ghost", F.row_number().over(order).alias("at"), "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (the second half replaced by the start of the next document), and how like
    the first is to that and to the next document's."""
    scratch = Scratch(docs.sparkSession, "order-minhash")
    rows = with_next(docs, scratch)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("ghost"), F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    made = rows.select("cell", "at", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.col("text"), edited.alias("edited"))
    made = made.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["cell", "at", "ghost", "doc_id", "n_chars", "edited_sha256"]
    prints = signatures(made, keys, {"fingerprint": F.col("text"), "edited_fingerprint": F.col("edited")})
    following = F.lead("fingerprint").over(Window.partitionBy("cell").orderBy("at"))
    out = prints.withColumn("following", following).filter(~F.col("ghost"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("following")).alias("near_next"))
