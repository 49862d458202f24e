import os
import random
import time
from collections import Counter, defaultdict

from roadtrace.llm import html_text, sharding, url_filter

PAGE = "page_id long, url string, html string"


def test_html(frame):
    rows = [
        (1, "http://a.com/x/1", "<p>Site line</p><p>One</p>"), (2, "http://a.com/x/2", "<p>Site line</p><p>Two &amp; three</p>"), (3, "http://b.com/", "<div>Alone</div>"), (4, None, None), (5, "http://c.com/", ""),
        (6, "http://d.com/", "<nav>menu</nav><header>top</header><article><h1>T &lt;1&gt;</h1><p>A\n b<!-- x --><b> c</b></p><script>var t='</p>'</script><div class='comments'>no</div><form>f</form><p>End</article><footer>foot</footer><aside>s</aside>"),
        (3, "http://b.com/", "<div>Alone</div>"), (7, "no url", "<p>text</p>" * 3000),
    ]
    got = [(r.page_id, r.text) for r in html_text.extract(frame([(*r, "k") for r in rows], PAGE + ", key string")).collect()]
    want = [(1, "One"), (2, "Two & three"), (3, "Alone"), (3, "Alone"), (4, ""), (5, ""), (6, "T <1> A b c End"), (7, " ".join(["text"] * 3000))]
    assert sorted(got) == want
    assert html_text.extract(frame(rows, PAGE).where("false")).count() == 0


def test_html_names_in_articles(frame):
    """Whole names count, for a minor part of the article; parts of other words never; differencing decides the rest."""
    story = "<p>One long sentence of the story that goes on for a while.</p><p>And another one that ends it.</p>"
    text = "One long sentence of the story that goes on for a while. And another one that ends it."
    kept = {"search-engine": "Text about search engines", "share-price-analysis": "Shares rose.", "header-files-in-c": "Header files."}
    gone = {"ad": "Buy this", "ad-slot": "Buy that", "social share": "Tell all", "comments-area": "First!", "cookie_notice": "We bake"}
    rows, want = [], {}
    for i, (name, words) in enumerate({**kept, **gone}.items()):
        rows.append((i, f"http://h{i}.io/x", f"<article>{story}<div class='{name}'><p>{words}</p></div></article>"))
        want[i] = f"{text} {words}" if name in kept else text
    rows += [
        (20, "http://p.io/1", "<article><div id='comment-policy-article'><p>All of it.</p></div></article>"),
        (21, "http://p.io/2", f"<main><div class='share'>{story}</div></main>"),
        (22, "http://q.io/a/1", f"<main><div class='notice'><p>Our notices</p>{story}</div></main>"),
        (23, "http://q.io/a/2", "<main><div class='notice'><p>Our notices</p><p>Quite another text.</p></div></main>"),
        (24, "http://r.io/1", f"<article>{story}<div class='comments'>{story * 9}</div></article>"),
        (25, "http://r.io/2", f"<div class='site-footer'>Foot</div><div class='ad'>Buy</div><article>{story}</article>"),
        (26, "http://s.io/1", "<div class='search-engine'><p>Engines.</p></div>"),
        (27, "http://s.io/x/2", f"<article>{story}<div class=ad>Unclosed <b>advert</article>"),
    ]
    want |= {20: "All of it.", 21: text, 22: text, 23: "Quite another text.", 24: text, 25: text, 26: "Engines.", 27: text}
    assert {x.page_id: x.text for x in html_text.extract(frame(rows, PAGE)).collect()} == want


def common_lines(a, b):
    """Indices of a in one longest common subsequence, and its length, by the whole table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        got = sorted(html_text.shared(a, b))
        rest = iter(b)
        assert len(got) == common_lines(a, b) and all(any(a[i] == y for y in rest) for i in got)
    began = time.perf_counter()
    assert len(html_text.shared([1] * 20_000, [1] * 15_000)) == 15_000 and len(html_text.shared([1, 2] * 10_000, [2, 2, 1] * 7000)) > 10_000
    assert [len(html_text.lines(x)) for x in ("<a " * 200_000, "<div>" * 50_000 + "</section>" * 50_000, "<p>same</p>" * 20_000)] == [1, 0, 20_000]
    assert time.perf_counter() - began < 30


def test_html_pairs_are_brute_force(frame):
    """Pages outside <article>: the nearest URL of other lines, by plain comparison, takes its lines away."""
    r = random.Random(4)
    site = [f"Menu {i}" for i in range(6)]
    pages = []
    for i in range(40):
        own = [f"Story {i} part {k}" for k in range(r.randrange(1, 5))]
        body = site[:3] + own + site[3:] if i % 9 else site[:3] + ["Story twin"] * 4 + site[3:]
        pages.append((i, f"http://h.io/{'ab'[i % 2]}/{r.randrange(1000):03d}/{i}", "".join(f"<p>{x}</p>" for x in body), body))
    got = {x.page_id: x.text for x in html_text.extract(frame([p[:3] for p in pages], PAGE)).collect()}
    first = {}
    for i, url, _, body in sorted(pages, key=lambda p: p[1]):
        first.setdefault(tuple(body), url)
    order = sorted(first.items(), key=lambda x: x[1])
    prefix = lambda a, b: len(os.path.commonprefix([a, b]))
    for i, _, _, body in pages:
        k = next(k for k, (b, _) in enumerate(order) if list(b) == body)
        near = sorted([k + d for d in (-1, 1) if 0 <= k + d < len(order)], key=lambda j: (-prefix(order[k][1], order[j][1]), j))
        want = body
        for j in near:
            other = list(order[j][0])
            if common_lines(body, other) < 0.9 * len(body):
                gone = html_text.shared([hash(x) for x in body], [hash(x) for x in other])
                want = [x for m, x in enumerate(body) if m not in gone]
                break
        assert got[i] == " ".join(want), i


def test_html_twins_and_articles(frame):
    story, menu = "<p>A long story.</p><p>It goes on.</p>", "<div>Site</div>"
    article = lambda t, more="": f"{menu}<article><p>{t}</p><p>Quoted by all.</p></article>{more}"
    rows = [
        (1, "http://t.io/a/1", story), (2, "http://t.io/a/2", story), (3, "http://one.io/x", menu + story),
        (4, "http://q.io/n/1", article("First.", "<p>Only here.</p>")), (5, "http://q.io/n/2", article("Second.")), (6, "http://q.io/n/3", article("Third.")), (7, "http://s.io/1", article("Alone.", "<p>Beside.</p>")),
    ]
    got = {x.page_id: x.text for x in html_text.extract(frame(rows, PAGE)).collect()}
    assert got[1] == got[2] == "A long story. It goes on." and got[3] == "Site A long story. It goes on."
    assert got[4] == "First. Quoted by all. Only here." and got[5] == "Second. Quoted by all." and got[6] == "Third. Quoted by all." and got[7] == "Alone. Quoted by all."


def test_url_rules_and_tree(frame):
    urls = ["http://A.Example.com/en/7/x?q", "https://example.com/en/8", "http://x.net/de/1", "http://example.net/de/8", "http://z.org/es/", "http://z.org/es/3", "http://com/en/1", "http://notcom/en/1", None, "plain", "http://z.org", "ftp://z.org#f"]
    got = {r.page_id: r for r in url_filter.verdicts(frame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(8)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("org/es/", "block"), ("com/en/", "block"), (None, "allow")]
    assert [(got[i].host, got[i].path) for i in (0, 8, 9, 10, 11)] == [("a.example.com", "/en/7/x"), ("", ""), ("", ""), ("z.org", ""), ("z.org", "")]
    labels = frame([("h.io", f"/spam/{i}", 1) for i in range(50)] + [("h.io", f"/news/{i}", 0) for i in range(200)], "host string, path string, bad int")
    judged = url_filter.verdicts(frame([(1, "http://h.io/spam/999"), (2, "http://h.io/news/999"), (3, "http://h.io/other"), (3, "http://h.io/other")], "page_id long, url string"), labels=labels).collect()
    assert sorted((r.page_id, r.verdict) for r in judged) == [(1, "block"), (2, "allow"), (3, "allow"), (3, "allow")]
    assert url_filter.verdicts(frame([], "page_id long, url string")).count() == 0


def test_url_tree_backs_off(frame):
    """A branch without labels takes its nearest labelled ancestor's share."""
    labels = frame(
        [("bad.io", f"/en/{i}", 1) for i in range(40)] + [("good.io", f"/en/{i}", 0) for i in range(40)] + [("mix.io", f"/a/x/{i}", 1) for i in range(40)] + [("mix.io", f"/b/{i}", 0) for i in range(200)],
        "host string, path string, bad int",
    )
    urls = ["http://bad.io/de/1910", "http://bad.io/", "http://good.io/de/1", "http://mix.io/a/new/3", "http://mix.io/b/new", "http://mix.io/c", "http://unseen.io/en/1"]
    got = url_filter.verdicts(frame(list(enumerate(urls)), "page_id long, url string"), labels=labels).collect()
    assert [r.verdict for r in sorted(got)] == ["block", "block", "allow", "block", "allow", "allow", "allow"]


def test_deep_paths_differ_in_their_last_segment(frame):
    deep = "/".join("abcdefghij")
    labels = frame([("h.io", f"/{deep}/spam", 1)] * 30 + [("h.io", f"/{deep}/news", 0)] * 30, "host string, path string, bad int")
    urls = frame([(1, f"http://h.io/{deep}/spam", "k", 0.5), (2, f"http://h.io/{deep}/news", "k", 0.5)], "page_id long, url string, x_key string, x_share double")
    got = url_filter.verdicts(urls, labels=labels).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "allow"] and {(r.x_key, r.x_share) for r in got} == {("k", 0.5)}


def test_written_shards(frame, tmp_path):
    docs = frame([(i, f"t{i}") for i in range(200)])
    sharding.write_shards(docs, str(tmp_path / "s"), [1.0, 2.0])
    back = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    want = {r.doc_id: r.shard for r in sharding.assign(docs, [1.0, 2.0], [1.0, 2.0]).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want and set(want.values()) == {0, 1}


def test_shards(frame):
    docs = frame([(i, "t" * (i % 50), 1) for i in range(3000)] + [(7, "t" * 7, 1), (None, None, 1), (None, "é", 1)], "doc_id long, text string, shard int")
    rows = sharding.assign(docs, [1.0] * 16, [1.0] * 17).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert len(rows) == 3003 and set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 100 < sum(r.grown_shard == 16 for r in rows) < 260
    assert sorted(r.size for r in rows if r.doc_id is None) == [1, 3]
    weighted = Counter(r.shard for r in sharding.assign(docs, [1.0, 3.0], [1.0, 3.0]).collect())
    assert 0.70 < weighted[1] / 3003 < 0.80
    assert sharding.assign(docs.where("false"), [1.0], [1.0, 1.0]).count() == 0
