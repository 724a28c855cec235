"""Lists by orders, masks and categories: literal pages, and categories against all pairs and triples."""

import datetime
import random
from itertools import combinations

from feedlake.operators import archive_lists as A

GROUPS = "page_id long, mask string, stars int, pos long, key string, url_date date, date date"
ENTRIES = "page_id long, pos long, bucket long, key string"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def group(mask, keys, stars=1, start=0, dates=None, url_dates=None, page=1):
    return [(page, mask, stars, start + i, k, url_dates[i] if url_dates else None, dates[i] if dates else None) for i, k in enumerate(keys)]


def feed(keys, page=1, buckets=None):
    return [(page, i, buckets[i] if buckets else i, k) for i, k in enumerate(keys)]


def run(spark, fn, groups, entries, **kw):
    found, links = fn(spark.createDataFrame(groups, GROUPS), spark.createDataFrame(entries, ENTRIES), **kw)
    lists = {}
    for r in sorted(links.collect(), key=lambda r: (r.page_id, r.stars, r.seq_pos)):
        lists.setdefault((r.page_id, r.stars), []).append(r.key)
    return {(r.page_id, r.stars): (r, "".join(lists[r.page_id, r.stars])) for r in found.collect()}


def test_forms_of_a_sorted_list(spark):
    groups = (group("m", "abcd", page=1) + group("m", "dcba", page=2) + group("m", "bdac", dates=[day(3), day(1), day(4), day(2)], page=3)
              + group("m", "bdac", page=4) + group("m", "ba", page=5) + group("m", "bacd", page=6))
    entries = [e for p in (1, 2, 3, 4, 5) for e in feed("abc", page=p)] + feed("abc", page=6, buckets=[0, 0, 1])
    got = run(spark, A.sorted_lists, groups, entries)
    assert {k[0]: (r.form, text) for k, (r, text) in got.items()} == {1: ("down", "abcd"), 2: ("up", "abcd"), 3: ("dated", "abcd"), 6: ("down", "bacd")}


def test_repeated_links(spark):
    """A repeat spoils the order of a page; by dates it is one link if its dates agree."""
    groups = (group("m", "abcda", page=1) + group("m", "acbad", dates=[day(9), day(7), day(8), day(9), day(6)], page=2)
              + group("m", "acbad", dates=[day(9), day(7), day(8), day(5), day(6)], page=3))
    got = run(spark, A.sorted_lists, groups, [e for p in (1, 2, 3) for e in feed("abc", page=p)])
    assert {k[0]: (r.form, text, r.n_links) for k, (r, text) in got.items()} == {2: ("dated", "abcd", 4)}


def test_more_stars_extend_fewer(spark):
    few = "abcd"
    rows, entries = [], []
    for page, more in enumerate(["abcdxy", "abdcxy", "yxdcba", "abcd", "dcbayx"], 1):
        rows += group("s", few, page=page) + group("t", more, stars=2, start=10, page=page)
        entries += feed("abc", page=page)
    got = run(spark, A.sorted_lists, rows, entries)
    two = {k[0]: text for k, (r, text) in got.items() if k[1] == 2}
    # 2 leaves the feed's order after its third entry, which no feed checks, but not that of the shorter list; 3 is it upside down.
    assert two == {1: "abcdxy", 3: "abcdxy"}
    assert all(got[p, 1][1] == few for p in range(1, 6))


def test_dates_against_the_order_of_two_stars(spark):
    falling = [day(9 - i) for i in range(4)]
    rows = group("m", "abcd", stars=2, dates=falling, page=1) + group("m", "abcd", stars=2, dates=falling[::-1], page=2) + group("m", "abcd", dates=falling[::-1], page=3)
    got = run(spark, A.sorted_lists, rows, [e for p in (1, 2, 3) for e in feed("abc", page=p)])
    # Two stars: dates that rise contradict the order, and sorting by them contradicts the feed. One star: the order counts.
    assert {k[0]: r.form for k, (r, _) in got.items()} == {1: "down", 3: "down"}


def test_almost(spark):
    base = "abcdefgh"
    rows, entries = [], []
    for page, keys in enumerate(["abcdefghi", "bcdefghi", "acdefghij", "hgfedcaxy"[::1], "adefghijk", "abcdefgxy"], 1):
        rows += group("m", keys, page=page)
        entries += feed(base, page=page)
    got = run(spark, A.sorted_lists, rows, entries, almost=True)
    # 1 holds all, 2 is as long as the feed and lacks a, 3 lacks b, 4 (read upwards) begins with other links, 5 lacks two of eight, 6 lacks the last.
    assert {k[0]: (r.form, r.pattern) for k, (r, _) in got.items()} == {p: ("down", "archives_almost") for p in (2, 3, 5, 6)}
    rows = group("m", "acdexy") + group("m", "adexyz", page=2)
    got = run(spark, A.sorted_lists, rows, feed("abcde") + feed("abcde", page=2), almost=True)
    # One of five may be absent, not two.
    assert [k[0] for k in got] == [1]


def test_two_masks(spark):
    rows = (group("p", "abc") + group("s", "defg", start=3)
            + group("p", "abc", start=4, page=2) + group("s", "defg", page=2)
            + group("p", "abc", page=3) + group("s", "eefg", start=3, page=3)
            + group("p", "abc", page=4) + group("s", "dea", start=3, page=4)
            + group("p", "abc", page=5) + group("s", "d", start=3, page=5))
    entries = [e for p in (1, 2, 3, 4) for e in feed("abcde", page=p)] + feed("abcdef", page=5)
    got = run(spark, A.two_mask_lists, rows, entries)
    # 2 stands upside down, 3 jumps an entry, 4 repeats a link, 5 ends before the feed.
    assert {k: text for k, (r, text) in got.items()} == {(1, 1): "abcdefg"}
    assert (got[1, 1][0].prefix_mask, got[1, 1][0].n_prefix, got[1, 1][0].n_links) == ("p", 3, 7)


def test_two_masks_split_a_bucket(spark):
    """Entries of one day may stand on both sides of the seam."""
    rows = group("p", "ba") + group("s", "cdx", start=2)
    got = run(spark, A.two_mask_lists, rows, feed("abcd", buckets=[0, 0, 0, 1]))
    assert got[1, 1][1] == "bacdx"


def test_shuffled_two_masks(spark):
    rows = (group("p", "ab") + group("s", "edcxa", start=2)
            + group("p", "ab", page=2, url_dates=[day(9), day(8)]) + group("s", "edcxy", start=2, page=2, dates=[day(5), day(6), day(7), day(4), day(3)])
            + group("p", "ab", page=3) + group("s", "edxyz", start=2, page=3))
    got = run(spark, A.shuffled_two_mask_lists, rows, [e for p in (1, 2, 3) for e in feed("abcde", page=p)])
    assert {k[0]: (text, r.n_links, r.is_sorted) for k, (r, text) in got.items()} == {1: ("abedcx", 6, False), 2: ("abcdexy", 7, True)}


def test_undated_links(spark):
    groups = (group("m", "abcx", dates=[day(3), day(2), day(1), None]) + group("m", "axyz", dates=[day(3), None, day(1), day(0)], page=2)
              + group("m", "abcx", page=3))
    positions = spark.createDataFrame([(1, "m"), (2, "m")], "page_id long, mask string")
    entries = spark.createDataFrame([e for p in (1, 2, 3) for e in feed("abc", page=p)], ENTRIES)
    rows = A.with_list_dates(spark.createDataFrame(groups, GROUPS), positions, entries).collect()
    assert sorted(r.key for r in rows if r.page_id == 1) == ["a", "b", "c"] and all(r.date for r in rows if r.page_id == 1)
    assert sorted(r.key for r in rows if r.page_id == 2) == ["a", "x", "y", "z"] and not any(r.date for r in rows if r.page_id == 2)
    assert sum(r.page_id == 3 for r in rows) == 4


def threshold(n):
    return n if n <= 9 else n - 1 if n <= 19 else n - 2


def brute_categories(pages, n):
    """Sets and lists as the pages arrive; the first combination that is complete."""
    state = {}
    for page_id, level, keys in pages:
        held = frozenset(k for k in keys if k < n)
        if not (len(keys) >= 2 and 2 <= len(held) <= n - 2):
            continue
        known = state.get(held)
        state[held] = (page_id, level, keys, known[3] if known else len(state)) if not known or len(known[2]) < len(keys) else known
    cats = sorted(state.items(), key=lambda x: x[1][3])
    best = None
    for k in (2, 3):
        for combo in combinations(cats, k):
            if len({c[1][1] for c in combo}) == 1 and len(frozenset().union(*(c[0] for c in combo))) >= threshold(n):
                rank = (max(c[1][3] for c in combo), k, [c[1][3] for c in combo])
                if best is None or rank < best[0]:
                    best = rank, combo
    if best is None:
        return None
    listed = [x for c in best[1] for x in c[1][2]] + [x for x in range(n) if not any(x in c[0] for c in best[1])]
    return [c[1][0] for c in best[1]], list(dict.fromkeys(listed))


def test_categories_against_all_combinations(spark):
    rnd = random.Random(5)
    groups, entries, pages, want = [], [], [], {}
    page_id = 0
    for blog in range(160):
        n = rnd.choice([4, 6, 9, 12, 19, 20, 24, 30])
        own = []
        parts = rnd.choice([2, 3, 3, 4])
        owner = [rnd.randrange(parts) for _ in range(n + 10)]
        for _turn in range(rnd.randint(1, 8)):
            page_id += 1
            part = rnd.randrange(parts)
            keys = [k for k in range(n + 10) if (owner[k] == part) != (rnd.random() < 0.04)]
            level = 1 if rnd.random() < 0.8 else 2
            if rnd.random() < 0.15 and own:
                keys = own[-1][2] + [n + 50 + page_id]
            own.append((page_id, level, keys))
            groups += [(page_id, "m", 1, i, str(k), None, None) for i, k in enumerate(keys)]
            pages.append((page_id, blog, level, page_id))
        entries += [(blog, k, str(k)) for k in range(n)]
        want[blog] = brute_categories(own, n)
    found, listed = A.category_archives(
        spark.createDataFrame(groups, GROUPS), spark.createDataFrame(entries, "blog_id long, pos long, key string"),
        spark.createDataFrame(pages, "page_id long, blog_id long, level int, arrival long"))
    got = {r.blog_id: list(r.pages) for r in found.collect()}
    assert got == {b: w[0] for b, w in want.items() if w}
    lists = {}
    for r in sorted(listed.collect(), key=lambda r: (r.blog_id, r["index"])):
        lists.setdefault(r.blog_id, []).append(int(r.key))
    assert lists == {b: w[1] for b, w in want.items() if w}
    assert {len(p) for p in got.values()} == {2, 3} and len(got) > 20


def test_category_partners_meet_by_entries(spark):
    """No join of a blog's pages without an entry in its key."""
    empty = [spark.createDataFrame([], s) for s in (GROUPS, "blog_id long, pos long, key string", "page_id long, blog_id long, level int, arrival long")]
    found, _ = A.category_archives(*empty)
    assert found.collect() == []


def mined_links(spark, pages, entries):
    from feedlake.operators import masks as M
    from feedlake.operators import pages as P
    nodes = P.nodes(spark.createDataFrame(pages, "page_id long, url string, html string"))
    feed = spark.createDataFrame(entries, "page_id long, key string, title string")
    return nodes, M.flag_feed_links(P.links_of_nodes(nodes), feed)


def test_deep_page_ends(spark):
    """Three stars on a page nested 300 steps: the number of masks follows the steps that differ."""
    from feedlake.operators import masks as M
    inner = "".join(f"<section><ul>{''.join(f'<li><a href=/p{s}{i}>x</a></li>' for i in range(3))}</ul></section>" for s in range(3))
    outer = f"<article>{inner}</article><article>{inner.replace('/p', '/q')}</article>"
    html = "<div>" * 300 + outer + "</div>" * 300
    _, links = mined_links(spark, [(1, "https://b.example.com/", html)], [(1, "b.example.com//p00?", "t")])
    groups = M.mask_groups(links, 3).collect()
    assert len(groups) == 18 and len({r.mask for r in groups}) == 1


def test_title_positions(spark):
    from feedlake.operators import masks as M

    def page(items):
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    names = ["One", "Two", "Three"]
    link = [f'<a href="/p{i}">' for i in range(3)]
    pages = [
        page(f"{link[i]}{n}</a>" for i, n in enumerate(names)),
        page(f"{link[i]}<i>by me</i><b>{n}</b></a>" for i, n in enumerate(names)),
        page(f"<h2><em>{n}</em></h2>{link[i]}more</a>" for i, n in enumerate(names)),
        # The heading holds the link and more: the title is the heading's whole text.
        page(f"<h2>{link[i]}{n[:1]}</a>{n[1:]}</h2>" for i, n in enumerate(names)),
        page(f"{link[i]}more</a><p>{n if i else 'Other'}</p>" for i, n in enumerate(names)),
    ]
    rows = [(k, f"https://b{k}.example.com/", html) for k, html in enumerate(pages)]
    entries = [(k, f"b{k}.example.com//p{i}?", n) for k in range(len(pages)) for i, n in enumerate(names)]
    nodes, links = mined_links(spark, rows, entries)
    groups = M.mask_groups(links, 1)
    positions = M.infer_title_position(groups, nodes)
    got = {(r.page_id, r.kind, r.rel) for r in positions.collect()}
    assert got == {(0, "self", None), (1, "child", "/a[1]/b[1]"), (2, "neighbor", "/h2[1]"), (3, "neighbor", "/h2[1]")}
    titles = {(r.page_id, r.link_url[-1]): (r.title, r.title_kind) for r in M.apply_title_position(groups, positions, nodes).collect()}
    assert titles[3, "1"] == ("Two", "neighbor") and titles[1, "2"] == ("Three", "child") and titles[4, "1"] == (None, None)
