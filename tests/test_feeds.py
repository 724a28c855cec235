"""Feed parsing, sequence matching and merging on small literal cases, the last two against brute force."""

import random
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import functions as F

from feedlake.functions.dates import text_date
from feedlake.functions.text import slug
from feedlake.operators import feeds, mining, seqmatch

ATOM = 'xmlns="http://www.w3.org/2005/Atom"'
BURNER = 'xmlns:feedburner="http://rssnamespace.org/feedburner/ext/1.0"'


def rss(*items, head="<link>https://root</link>", attrs=""):
    return f"<rss {attrs}><channel>{head}{''.join(f'<item>{i}</item>' for i in items)}</channel></rss>"


def atom(*entries, head='<link rel="alternate" href="https://root"/>', attrs=""):
    return f"<feed {ATOM} {attrs}>{head}{''.join(f'<entry>{e}</entry>' for e in entries)}</feed>"


def link(name):
    return f"<link>https://root/{name}</link>"


def alink(name):
    return f'<link rel="alternate" href="https://root/{name}"/>'


def dated(kind, when, url):
    """An entry of the kind of feed with the date written as that kind does."""
    day = datetime(2018, 3, 1, 6, tzinfo=UTC) + timedelta(seconds=when)
    if kind == "rss":
        return f"<pubDate>{day:%a, %d %b %Y %H:%M:%S GMT}</pubDate>{link(url)}"
    return f"<published>{day:%Y-%m-%dT%H:%M:%S}+00:00</published>{alink(url)}"


MAKE = {"rss": (rss, link), "atom": (atom, alink)}
ORDERS = {
    # Seconds after a day, entry by entry, and the expected order.
    "falling": ([900, 500, 100], [0, 1, 2]), "rising": ([100, 500, 900], [2, 1, 0]), "neither": ([500, 900, 100], [1, 0, 2]),
    "one second apart": ([11, 10], [0, 1]), "days apart": ([0, 86_400 * 40], [1, 0]), "all equal": ([7, 7, 7], [2, 1, 0]),
}


def parse_cases():
    """``(name, document, root url, urls in order or None if the feed fails, generator)`` from the rules of parsing."""
    for kind, (make, item) in MAKE.items():
        for name, (times, order) in ORDERS.items():
            yield f"{kind}: {name}", make(*(dated(kind, t, f"p{i}") for i, t in enumerate(times))), "https://root", [f"p{i}" for i in order], None
        undated = dated(kind, 5, "p0") + ("<pubDate>soon</pubDate>" if kind == "rss" else "<published>soon</published>")
        yield f"{kind}: two dates count as none", make(dated(kind, 1, "p1"), undated), "https://root", ["p1", "p0"], None
        unread = item("p0") + ("<pubDate>next week</pubDate>" if kind == "rss" else "<published>next week</published>")
        yield f"{kind}: unreadable date", make(dated(kind, 1, "p1"), unread), "https://root", ["p1", "p0"], None
        yield f"{kind}: entry without url", make(item("p0"), "<title>no link</title>"), "https://root", None, None
        yield f"{kind}: original link first", make(item("copy") + "<feedburner:origLink>https://root/p0</feedburner:origLink>", attrs=BURNER), "https://root", ["p0"], None
        yield f"{kind}: without root", make(item("p0"), head=""), None, ["p0"], None
        yield f"{kind}: without entries", make(), "https://root", [], None
        root = "<link>https://root</link>" if kind == "rss" else '<link rel="alternate" href="https://root"/>'
        # Only rss feeds of the first and the last name are told apart.
        for text, generator in (("Tumblr (9.9)", "tumblr"), ("Blogger", "blogger"), ("Medium", "medium"), ("Homegrown", None)):
            generator = None if kind == "atom" and text != "Blogger" else generator
            yield f"{kind}: by {text}", make(item("p0"), head=f"{root}<generator>{text}</generator>"), "https://root", ["p0"], generator
    yield "rss: permanent id for a link", rss('<guid isPermaLink="true">https://root/p0</guid>'), "https://root", ["p0"], None
    yield "rss: other id is no link", rss('<guid isPermaLink="false">https://root/p0</guid>'), "https://root", None, None
    yield "rss: link before id", rss(link("p0") + '<guid isPermaLink="true">https://root/other</guid>'), "https://root", ["p0"], None
    yield "atom: link without rel", atom('<link href="https://root/p0"/>'), "https://root", ["p0"], None
    yield "atom: alternate before other rels", atom('<link rel="edit" href="https://root/e"/>' + alink("p0")), "https://root", ["p0"], None


def test_parse_feed_cases(spark):
    cases = list(parse_cases())
    docs = spark.createDataFrame([(n, "https://root/feed", d) for n, d, *_ in cases], "feed_id string, fetch_url string, content string")
    parsed = feeds.parse_feeds(docs).cache()
    failed = {r.feed_id for r in parsed.where("feed_error").collect()}
    assert failed == {n for n, _d, _r, urls, _g in cases if urls is None}
    ordered = feeds.infer_feed_order(parsed.where("pos is not null and not feed_error"))
    got = {}
    for r in ordered.orderBy("feed_id", "pos").collect():
        got.setdefault(r.feed_id, []).append(r.url.removeprefix("https://root/"))
    meta = {r.feed_id: r for r in feeds.feed_metadata(docs).collect()}
    for name, _doc, root, urls, generator in cases:
        if urls is not None:
            assert got.get(name, []) == urls, name
        assert meta[name].root_url == root, name
        assert meta[name].generator == generator, name


# Ways to write a date in full, the surroundings it may stand in, and texts that state no single full date.
WRITTEN = ["%Y-%m-%d", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%d %b, %Y", "%B %d, %Y", "%b %d %Y", "%Y %b %d", "%Y %B %d", "%A, %d %B %Y", "%b %d, '%y"]
AROUND = ["{}", "- {}", "({})", "{}:", " {} |\t", "Written by a guest, {}", "{}: how it went", "{} at 18:20 UTC"]
DAYS = [date(2009, 1, 4), date(2015, 5, 17), date(2021, 12, 30)]
UNDATED = ["", " \n", "none", "-", "7", "(7 comments)", "7 hours", "'07'", "3/11/2017", "30/11/2017", "March 2017", "(Mar '17)", "in 2017", "Mar 9",
           "This text is longer than what is taken for a date; it goes on and on until Mar 9, 2017"]


def test_text_dates(spark):
    cases = [(frame.format(f"{day:{how}}"), str(day)) for how in WRITTEN for day in DAYS for frame in AROUND] + [(t, None) for t in UNDATED]
    suffixed = [(f"{day:%B} {day.day}th, {day.year}", str(day)) for day in DAYS]
    df = spark.createDataFrame(cases + suffixed, "text string, want string")
    rows = df.select("text", "want", F.date_format(text_date(F.col("text")), "yyyy-MM-dd").alias("got")).collect()
    assert not [r for r in rows if r.got != r.want]
    guessed = spark.createDataFrame([("Mar 9",), ("9 March",)], "text string").select(
        F.date_format(text_date(F.col("text"), F.lit(2023)), "yyyy-MM-dd").alias("d")).collect()
    assert [r.d for r in guessed] == ["2023-03-09", "2023-03-09"]


def test_slugs(spark):
    # The results that titles must keep.
    tens = [ch * 10 for ch in "abcdefghij"]
    cases = [("hello", "hello"), ("Hello", "hello"), ("hello world", "hello-world"), ("hello0123456789!@#$%^&*()-=+", "hello0123456789"),
             ("ด้้้ ด็็็", ""), ("a" * 200, "a" * 100), ("a b c d e f g h i j k", "a-b-c-d-e-f-g-h-i-j"), (" ".join(tens), "-".join(tens[:9]))]
    rows = spark.createDataFrame(cases, "title string, want string").select("want", slug(F.col("title")).alias("got")).collect()
    assert not [r for r in rows if r.got != r.want]


def brute_suffix(buckets, seq):
    """Follow the definition entry by entry."""
    start = next((i for i, b in enumerate(buckets) if seq[0] in b), None)
    if start is None:
        return False, None, None
    run = 0
    while run < len(seq) and seq[run] in buckets[start]:
        run += 1
    flat = [i for i, b in enumerate(buckets) for _ in b]
    following = sum(len(b) for b in buckets[: start + 1])
    matched = run
    for i, key in enumerate(seq[run:]):
        if following + i >= len(flat):
            break
        if key not in buckets[flat[following + i]]:
            return False, None, None
        matched += 1
    return True, matched, following - run


def test_suffix_against_brute_force(spark):
    rng = random.Random(7)
    entries, seqs, want = [], [], {}
    for feed in range(120):
        keys = list(range(rng.randint(1, 7)))
        buckets, pos = [], 0
        while keys:
            size = min(len(keys), rng.randint(1, 3))
            buckets.append([keys.pop(0) for _ in range(size)])
        for number, bucket in enumerate(buckets):
            for key in bucket:
                entries.append((feed, pos, number, str(key)))
                pos += 1
        flat = [k for b in buckets for k in rng.sample(b, len(b))]
        start = rng.randrange(len(flat))
        seq = flat[start:] + [100, 101][: rng.randint(0, 2)]
        if rng.random() < 0.3:
            rng.shuffle(seq)
        seqs += [(feed, i, str(k)) for i, k in enumerate(seq)]
        want[feed] = brute_suffix(buckets, seq)
    e = spark.createDataFrame(entries, "feed_id long, pos long, bucket long, key string")
    s = spark.createDataFrame(seqs, "feed_id long, seq_pos long, key string")
    got = {r.feed_id: (r.is_suffix, r.n_matched, r.prefix_length) for r in seqmatch.sequence_is_suffix(e, s).collect()}
    assert got == want


def test_merge_against_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(seq, f"http{'s' if rng.random() < 0.5 else ''}://u{rng.randrange(12)}", f"http://f{rng.randrange(8)}") for seq in range(60)]
    scores = [(f"http://u{i}", 10 + i, 1) for i in range(12)]
    owner_of_url, feed_rows = {}, {}
    for _seq, url, feed in rows:
        key = url.split("://")[1]
        if key in owner_of_url:
            continue
        value = 10 + int(key[1:])
        if feed in feed_rows:
            feed_rows[feed][1] += value
        else:
            owner_of_url[key] = feed
            feed_rows[feed] = [url, value]
    merged = mining.merge_feed_lists(spark.createDataFrame(rows, "seq long, url string, feed_url string"),
                                     spark.createDataFrame(scores, "url string, sum_score long, n long")).collect()
    assert {r.feed_url: [r.url, r.sum_score] for r in merged} == feed_rows


def test_documents_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([(1, "https://root/feed", rss(link("a")))], "feed_id long, fetch_url string, content string").write.parquet(str(tmp_path / "docs"))
    parsed = feeds.parse_feeds(spark.read.parquet(str(tmp_path / "docs")))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
