import random
import time
from collections import Counter, defaultdict

from tessera.llm import page_diff as pd_

PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><a>Menu</a></nav>"
    "<article><h1>Head &amp; line</h1><p>One <b>bold</b>\n  word&nbsp;here<br>next</p><form><input>Name</form><aside>side</aside><div class='reader-comments'>x<div>y</div></div>"
    "<p>Last &lt;p&gt;</article><div class=\"cookie notice\">We use</div><footer>&copy; me</footer></body></html>"
)


def longest(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = pd_.common_lines(a, b)
        assert len(at) == longest(a, b)
        left = iter(b)
        assert all(any(x == y for y in left) for x in (a[i] for i in at))


def test_article_without_frame():
    assert " ".join(t for t, z in pd_.lines_of(PAGE) if z == pd_.ARTICLE) == "Head & line One bold word here next Last <p>"


def test_broken_markup_ends():
    assert pd_.lines_of("<p>a < b > c</p>")[0][0] == "a < b > c"
    for page in ("", "<", "<p", "<a href='x", "<!-- open", "<script>x", "a < b > c", "<div class=ad>x", "</p></div>", "<" * 500, "<a '" * 300):
        pd_.lines_of(page)


def test_shared_lines_of_the_nearest_url_are_deleted(spark):
    frame = "<div>Welcome to the site</div>{}<div>All rights</div>"
    body = lambda i: frame.format(f"<p>Story number {i} {'text ' * 30}{i}</p>")
    rows = [(i, f"http://a.com/x/{i}", body(i)) for i in range(6)]
    rows += [(10, "http://b.com/only", body(10)), (11, None, None), (12, "http://c.com/1", PAGE), (13, "http://c.com/2", PAGE), (14, "no scheme", "<p>alone</p>"), (14, "no scheme", "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {}
    for r in pd_.main_text(spark, pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for i in range(6):
        assert got[i] == [f"Story number {i} " + "text " * 30 + str(i)], got[i]
    assert got[10][0].startswith("Welcome")
    assert got[11] == [""]
    assert got[12] == got[13] == ["Head & line One bold word here next Last <p>"]
    assert got[14] == ["alone", "alone"]  # mirrors delete nothing
    assert pd_.main_text(spark, pages.limit(0)).count() == 0


def kept(page):
    return " ".join(t for t, z in pd_.lines_of(page) if z != pd_.STRUCTURE)


def test_implied_end_tags_attributes_and_class_words():
    assert kept('<article><p class="ad">Buy now<p>Real text one<p>Real text two</article><p>after') == "Real text one Real text two after"
    assert kept('<ul><li class="share">Share<li>Real item</ul><p>Body') == "Real item Body"
    assert kept('<article><div class="legal-analysis">Law</div><section class="search-results-study">Study</section><p class="market-share">Rise</p></article>') == "Law Study Rise"
    assert kept("<div class=ad/>Buy</div><p>text") == "text"
    assert kept('<div class="ad-banner">x</div><div id="siteFooter">y</div><div class="reader-comments">z</div><p>text') == "text"
    assert kept('<table><tr><td class="ad">a<td>b<tr><td>c</table><dl><dt class="promo">d<dd>e</dl>') == "b c e"
    assert kept('<p>one <b>two<p>three</b> four<div>five</p>six') == "one two three four five six"
    assert kept("<nav><ul><li>a<li>b</nav>text") == "text"
    assert kept('<p title="a > b">x</p><p title=\'"\'>y</p><p don\'t>z</p>') == "x y z"


def test_scanning_is_linear():
    for page in ("<a " * 60_000, "<a '" * 60_000, '<a b="' * 60_000, "<" * 200_000, "<p><b>" * 40_000, "<div>" * 60_000 + "</p>" * 60_000, "<!--" * 60_000, "<a b=\"'>" * 40_000, "<script>" * 40_000, "<li><td>" * 30_000):
        began = time.perf_counter()
        pd_.lines_of(page)
        assert time.perf_counter() - began < 3, page[:20]


def brute_texts(pages):
    """{page_id: text} of pages given as (page_id, host, path, [(text, inside an article)]), by definition."""
    out = {}
    for host in {p[1] for p in pages}:
        own = sorted((p for p in pages if p[1] == host), key=lambda p: p[2])
        shared_by, n_pairs = Counter(), 0
        for i, (_, _, path, lines) in enumerate(own):
            near = []
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    n = 0
                    while n < min(len(path), len(own[j][2])) and path[n] == own[j][2][n]:
                        n += 1
                    near.append((-n, j))
            for _, j in sorted(near):
                texts, others = [t for t, _ in lines], [t for t, _ in own[j][3]]
                common = [t for t in texts if t in others]  # lines are distinct and in one order, so these are a longest common subsequence
                if texts and sum(map(len, common)) <= pd_.MIRROR * sum(map(len, texts)):
                    n_pairs += 1
                    shared_by.update(set(common))
                    break
        for page_id, _, _, lines in own:
            gone = lambda t, inside: shared_by[t] >= pd_.SURE_PAIRS and shared_by[t] >= pd_.SURE_SHARE * n_pairs if inside else shared_by[t] > 0
            out[page_id] = " ".join(t for t, inside in lines if not gone(t, inside))
    return out


def site(rng, n_pages):
    """Pages of a few hosts with frames, articles, mirrors and shared passages, as lines and as html."""
    pages, html = [], []
    passages = [f"passage {k} " + "quoted words " * 9 for k in range(3)]
    for i in range(n_pages):
        host = rng.choice(["a.com", "a.com", "a.com", "b.org", "c.net"])
        article = rng.random() < 0.97
        top, bottom = [f"welcome to {host}", f"latest on {host} {rng.randrange(3)}"], [f"about {host}"]
        body = [f"title {i}", f"story {i} " + "plain text " * rng.randint(3, 30)]
        if rng.random() < 0.3:
            body.append(rng.choice(passages).strip())
        if article and rng.random() < 0.98:
            body.append(f"share this article of {host}")
        if pages and rng.random() < 0.15:
            source = rng.choice([p for p in pages])
            lines = [(t, inside) for t, inside in source[3]]
            host = source[1]
        else:
            lines = [(t.strip(), False) for t in top] + [(t.strip(), article) for t in body] + [(t, False) for t in bottom]
        path = f"/{rng.choice(['x', 'y', 'news/2020'])}/{i:03d}"
        pages.append((i, host, path, lines))
        out, open_ = "<nav>menu</nav>", False
        for t, inside in lines:
            if inside != open_:
                out += "<article>" if inside else "</article>"
                open_ = inside
            out += f"<p>{t}"
        html.append((i, f"http://{host}{path}?q={i}", out + "<footer>foot</footer>"))
    return pages, html


def test_the_whole_query_against_its_definition(spark):
    pages, html = site(random.Random(21), 120)
    table = spark.createDataFrame(html, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in pd_.main_text(spark, table).collect()}
    want = brute_texts(pages)
    assert got == want
    assert any("share this article of a.com" in " ".join(t for t, _ in p[3]) for p in pages) and not any("share this article of a.com" in t for t in got.values())
    assert sum("passage" in t for t in got.values()) == sum(any("passage" in t for t, _ in p[3]) for p in pages)
    plain = {r["page_id"]: r["text"] for r in pd_.main_text(spark, table, differencing=False).collect()}
    assert sum(plain[i] != got[i] for i in got) > 100  # differencing decides nearly everywhere


def test_articles_of_the_drivers_pages_are_whole(spark):
    import re

    where = "/root/testdata/sf0.01"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    for r in pd_.op2_main_text(spark, where).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        assert r["text"].split() == pd_.markup.unescape(re.sub(r"<[^>]+>", " ", inner)).split() and r["n_chars"] == len(r["text"])


def test_clashing_columns_equal_urls_null_ids_and_long_pages(spark):
    from tests.llm.helpers import with_clashes

    long = "<div>frame</div><article>" + "".join(f"<p>line {i} of a long page" for i in range(60_000)) + "</article>"
    rows = [(None, "http://a.com/x", "<article><p>first page here</article><div>frame</div>"), (1, "http://a.com/x", "<div>frame</div><article><p>second page</article>"), (2, "http://a.com/x/y", long), (2, "http://a.com/x/y", long)]
    got = defaultdict(list)
    for r in pd_.main_text(spark, with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect():
        got[r["page_id"]].append(r["text"])
    assert got[None] == ["first page here"] and got[1] == ["second page"]
    assert len(got[2]) == 2 and got[2][0] == got[2][1] and got[2][0].count("line ") == 60_000 and "frame" not in got[2][0]
