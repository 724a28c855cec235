"""Secret scans: three fixed shapes, and strings that a primed compressor can't shorten near a sensitive word.

Fixed shapes (leftmost matches that do not overlap, per kind): ``assign``, a value of 12 or more characters set to a
sensitive name; ``access``, a key id of 18 or more characters; ``hex``, a run of 16 or more hexadecimal digits.

Novelty adds the kind ``novel``: a candidate is a token of 12 or more key characters, dot-joined parts included, that
starts within ``REACH`` characters after a sensitive word, also directly after it. Of ``name=value`` each side is a candidate,
and what stands up to the last sensitive word in it is no part. A candidate mixes at least two kinds of characters (a
capitalised word does not); of dot-joined parts one that is novel is enough. Its cost is the number of bytes that
zstandard adds for it when primed with a dictionary of common identifiers and of the text around the candidate. Names,
paths and words that occur nearby or are well known cost a few bytes; keys cost about one byte a character. Candidates
at or above ``MIN_COST`` bytes a character are reported unless a fixed shape covers part of them.

Spans count code points, the end is exclusive. Null and empty texts have no spans. Repeated rows are scanned each for
itself.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import text_function, with_text

KINDS = ("assign", "access", "hex", "novel")
REACH, AROUND, MIN_COST = 48, 256, 0.8
MASK = "[secret]"


def _either_case(words: str) -> str:
    """Letters in either case, and only those of ASCII (a flag would let the long s and the Kelvin sign in)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile("(" + _either_case(_NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")
_FIXED_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Words after which a string is sensitive.
CONTEXT_WORDS = (*_FIXED_WORDS, "credential", "private key", "private_key", "access key", "access_key", "bearer", "authorization")
CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)))
LEAST_LENGTH = 12
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
TOKEN_START = re.compile(r"[A-Za-z0-9+/_=-]")
#: Between a name and its value; '=' that only fills up a value is none.
SET_TO = re.compile(r"=(?=[^=.])")
_CLASSES = [re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]")]
_PLAIN_WORD = re.compile("[A-Z]?[a-z]+(?:[-_][A-Z]?[a-z]+)*")
#: Names and values seen in much source code.
IDENTIFIERS = b" ".join(w.encode() for w in (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 application/json authorization bearer client_id "
    "client_secret access_token refresh_token api_key secret_key password username example placeholder changeme undefined "
    "localhost environment configuration settings getPassword setPassword getToken validateToken tokenizer tokenization "
    "passwordHash password_reset secretsmanager your_api_key_here xxxxxxxxxxxx process.env os.environ http:// https:// www. "
    "index.html production development test_user default_value").split())


def _cost(candidate: bytes, around: bytes) -> float:
    """Compressed bytes a character that the candidate adds to a frame primed with names and surrounding text."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_dict_id=False)
    return (len(packer.compress(candidate)) - _empty_frame()) / len(candidate)


@lru_cache(maxsize=1)
def _empty_frame() -> int:
    return len(zstandard.ZstdCompressor(level=19, write_content_size=False).compress(b""))


def find_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, start of the value)`` by start, then kind."""
    low = text.lower() if not text.isascii() else text.casefold()
    spans: list[tuple[str, int, int, int]] = []
    if any(w in low for w in _FIXED_WORDS):
        spans += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        spans += _novel(text, spans)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _novel(text: str, known: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    # Lower case by ASCII letters alone keeps positions.
    low = text.translate(_LOWER)
    starts, ends = _union([(s, e) for _, s, e, _ in known])
    done = 0
    for word in CONTEXT.finditer(low):
        at, last = max(word.end(), done), word.end() + REACH
        while at <= last and (first := TOKEN_START.search(text, at, last + 1)):
            start, end = first.start(), TOKEN.match(text, first.start()).end()
            at = end
            if end - start < LEAST_LENGTH:
                continue
            # Each token is taken once, so that long ones stay linear.
            done = end
            for s, e in _values(text, low, start, end):
                whole = [(s, e)] if not _covered(s, e, starts, ends) else [x for x in _parts(text, s, e) if not _covered(*x, starts, ends)]
                for s_, e_ in whole:
                    if _is_novel(text, s_, e_):
                        yield "novel", s_, e_, s_


def _values(text: str, low: str, start: int, end: int) -> list[tuple[int, int]]:
    """The values of a token: what stands after ``=`` and after sensitive words; the whole token if all are short."""
    cuts = [m.start() for m in SET_TO.finditer(text, start, end)]
    found = []
    for s, e in zip([start, *(c + 1 for c in cuts)], [*cuts, end], strict=True):
        for word in CONTEXT.finditer(low, s, e):
            s = word.end()
        if 0 < s < e and text[s] in "-_/" and text[s - 1].isalnum():
            s += 1
        if e - s >= LEAST_LENGTH:
            found.append((s, e))
    return found or [(start, end)]


def _parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The stretches between dots."""
    cuts = [i for i in range(start, end) if text[i] == "."]
    return list(zip([start, *(c + 1 for c in cuts)], [*cuts, end], strict=True))


def _covered(start: int, end: int, starts: list[int], ends: list[int]) -> bool:
    at = bisect_left(starts, end)
    return bool(at) and ends[at - 1] > start


def _is_novel(text: str, start: int, end: int) -> bool:
    """Whether a part of 12 or more characters is novel; a string of shorter parts is judged as a whole."""
    parts = [(s, e) for s, e in _parts(text, start, end) if e - s >= LEAST_LENGTH] or [(start, end)]
    for s, e in parts:
        run = text[s:e]
        if e - s < LEAST_LENGTH or all(_PLAIN_WORD.fullmatch(x) for x in run.split(".")) or sum(bool(c.search(run)) for c in _CLASSES) < 2:
            continue
        around = text[max(0, s - AROUND):s] + " " + text[e:e + AROUND]
        if _cost(run.encode(), around.encode()) >= MIN_COST:
            return True
    return False


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


_LOWER = {c: c + 32 for c in range(65, 91)}


def _joined(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def _scan(texts: list[str]) -> Iterator[tuple]:
    for text in texts:
        spans = find_spans(text)
        kinds = [s[0] for s in spans]
        base = _joined([s for s in spans if s[0] != "novel"])
        yield (*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), _joined(spans))


def _masked(texts: list[str]) -> Iterator[tuple]:
    for text in texts:
        parts, at = [], 0
        for _, _, end, value in find_spans(text):
            if end <= at:
                continue
            if value >= at:
                parts += [text[at:value], MASK]
            at = end
        yield ("".join(parts) + text[at:], len(parts))


scan = text_function(_scan, {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_novel": "long",
                             "base_sha256": "string", "spans": "string"})
mask = text_function(_masked, {"text": "string", "parts": "long"})


def secret_table(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row: ``doc_id`` and the fields of ``scan``."""
    derived, name = with_text(docs.select("doc_id", "text"), scan)
    return derived.select("doc_id", f"{name}.*")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret value replaced by a mark; ``n_chars`` follows the new text. A null text stays null."""
    derived, name = with_text(docs, mask)
    changed = F.col(f"{name}.parts") > 0
    out = derived.withColumn("text", F.when(changed, F.col(f"{name}.text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(name)
