"""Lists over numbered pages: literal blogs, one case each."""

from feedlake.operators import paged_lists as L

MASK = "/html[1]/main[1]/div[1]/article[*]/a[1]"


class Blogs:
    def __init__(self):
        self.groups, self.links, self.entries, self.steps, self.jumps, self.certain = [], [], [], [], [], []

    def add(self, blog, feed, pages, last=None, mask=MASK, stars=1, newest=True, place="/html[1]/main[1]/div[1]", status=None, sure=True):
        for i, k in enumerate(pages[0]):
            self.groups.append((blog, mask, stars, i, k, len(pages[0]) + (not newest), newest))
        self.entries += [(blog, i, i, k) for i, k in enumerate(feed)]
        for n, page in enumerate(pages[1:], 2):
            for i, k in enumerate(page):
                self.links.append((blog, n, i, f"{place}/article[{i + 1}]/a[1]", f"{place.replace('[', '()[')}/article(x)[{i + 1}]/a()[1]", k))
            self.links.append((blog, n, 900, "/html[1]/nav[1]/a[1]", "/html()[1]/nav()[1]/a()[1]", f"page{n + 1}"))
        for n in range(1, len(pages) + 1):
            self.steps.append((blog, n, (status or {}).get(n, "one" if n < len(pages) else "none"), f"page{n + 1}"))
        if last:
            self.jumps.append((blog, last))
        if sure:
            self.certain.append((blog,))

    def run(self, spark):
        def df(rows, schema):
            return spark.createDataFrame(rows, schema)

        found, listed = L.paged_lists(
            df(self.groups, "blog_id long, mask string, stars int, pos long, key string, page_size long, includes_newest boolean"),
            df(self.links, "blog_id long, number long, pos long, xpath string, class_xpath string, key string"),
            df(self.entries, "blog_id long, pos long, bucket long, key string"), df(self.steps, "blog_id long, number long, status string, key string"),
            df(self.jumps, "blog_id long, number long"), df(self.certain, "blog_id long"))
        lists = {}
        for r in sorted(listed.collect(), key=lambda r: (r.blog_id, r["index"])):
            lists[r.blog_id] = lists.get(r.blog_id, "") + r.key
        return {r.blog_id: (r.pattern, r.n_pages, lists[r.blog_id]) for r in found.collect()}


def test_cases(spark):
    blogs = Blogs()
    blogs.add(1, "abcd", ["ab", "cd", "e"], last=3)
    blogs.add(2, "abcd", ["ab", "cd", "e"])
    blogs.add(3, "abcd", ["ab", "cd"])
    blogs.add(4, "abcd", ["ab", "cb", "e"])
    blogs.add(5, "abcd", ["ab", "dc", "e"])
    blogs.add(6, "abcdef", ["ab", "cd", "fe"])
    blogs.add(7, "abcd", ["ab", "cd", "e"], status={2: "multiple"})
    blogs.add(8, "abcd", ["ab", "cd", ""], last=3)
    blogs.add(9, "abcd", ["bc", "de", "f"], newest=False)
    # The list of the later pages stands elsewhere.
    blogs.add(10, "abcd", ["ab", "cd", "e"], place="/html[1]/main[1]/section[1]/div[2]")
    blogs.add(11, "abcd", ["ab", "cd", "e"], place="/html[1]/main[1]/section[1]/div[2]", sure=False)
    # A link to page three is no post.
    blogs.add(12, "abcd", ["ab", ["c", "d", "page3"], "e"])
    # Masks with classes: the same step with the class, and another class.
    classed = "/html()[1]/main()[1]/div()[1]/article(x)[*]/a()[1]"
    blogs.add(13, "abcd", ["ab", "cd", "e"], mask=classed, stars=2)
    blogs.add(14, "abcd", ["ab", "cd", "e"], mask=classed.replace("(x)", "(z)"), stars=2)
    got = blogs.run(spark)
    assert got == {
        1: ("paged_last", 3, "abcde"), 2: ("paged_next", 3, "abcde"), 3: ("paged_last", 2, "abcd"), 9: ("paged_next", 3, "abcdef"),
        10: ("paged_next", 3, "abcde"), 13: ("paged_next", 3, "abcde")}


def test_inner_part_in_two_places(spark):
    """A moved mask must be in one place only."""
    blogs = Blogs()
    blogs.add(1, "abcd", ["ab", "cd"], place="/html[1]/main[1]/div[2]")
    blogs.links.append((1, 2, 50, "/html[1]/aside[1]/article[1]/a[1]", "/html()[1]/aside()[1]/article(x)[1]/a()[1]", "other"))
    assert blogs.run(spark) == {}


def test_no_rows(spark):
    assert Blogs().run(spark) == {}
