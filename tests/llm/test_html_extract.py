import random
import re
import tracemalloc
from html.parser import HTMLParser

from litloom.llm import html_extract as M

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; title</title><style>p{{margin:0}}</style>
<script>var t="</p>";track(5);</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now and read a lot of advert text.</div><header><p>Site name and claim</p></header><{tag}><h1>Head &eacute;&#33;</h1><p><b>First  part
 of it.<br><p>Second &lt;b&gt; &amp; more.</p><p>{long}</p><aside>Side notes</aside><form><p>Join</p><input name=q></form><ul><li>one</li><li>two <i>and</i></ul>
<div class="comments"><p>I disagree strongly with all of this text.</p></div><p>Last <span class="sponsored">bought</span>words</p></{end}>
<div class="cookie-notice">We use cookies</div><footer>&copy; all rights</footer></body></html>"""
LONG = " ".join(["sentence number one is here."] * 20)
WANT = "\n".join(["Head é!", "First part of it.", "Second <b> & more.", LONG, "one", "two and", "Last words"])


def page(tag="article", end=None):
    return PAGE.format(tag=tag, end=end or tag.split()[0], long=LONG)


def test_blocks():
    assert M.extract(page(), ["article"]) == WANT
    assert M.extract(page('div class="post p12"', "div"), None) == WANT
    assert M.extract(None, None) == "" and M.extract("", ["article"]) == "" and M.extract("plain &amp; text", ["article"]) == "plain & text"
    assert M.extract("<article><p>cut of", ["article"]) == "cut of"
    assert M.extract("<p>a < b</p><p>c<", None) == "a < b\nc<"
    cut = page()[: page().index("Last")]
    assert M.extract(cut, ["article"]) == WANT.rpartition("\n")[0]


def test_consensus_outvotes_a_page(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i}", page('div class="post p%d"' % i, "div")) for i in range(30)]
    noisy = "<div class='promoted-links x'>no</div><div class='big'><p>" + "other stuff here. " * 60 + "</p></div><div class='post p99'><p>Short text.</p></div>"
    rows += [(50, "http://a.example/odd", noisy), (51, None, None), (52, "http://b.example/", "<p>alone</p>"), (53, "::", ""), (54, "http://a.example/odd", noisy), (None, "http://a.example/n", page())]
    pages = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, host int").repartition(4)
    for most in (M.MOST_BROADCAST, 0):
        monkeypatch.setattr(M, "MOST_BROADCAST", most)
        got = {r.page_id: (r.text, r.n_chars) for r in M.main_text(pages).collect()}
        assert len(got) == 36 and got[50] == got[54] == ("Short text.", 11)
        assert all(got[i] == (WANT, len(WANT)) for i in range(30)) and got[None][0] == WANT
        assert got[51] == ("", 0) and got[52] == ("alone", 5) and got[53] == ("", 0)
    assert M.main_text(pages.limit(0)).count() == 0


def test_random_markup_never_fails():
    r = random.Random(2)
    bits = ["<p>", "</p>", "<div class=a1>", "</div>", "<b", ">", "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "&#xZ;", "<td>", "<tr>", "<table>", "</table>", '"', "<a href='x'>", "</a>", "<![CDATA[", "]]>", "<li>", "</ul>"]
    for _ in range(2000):
        html = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert isinstance(M.extract(html, ["div.a#"]), str)


def test_minority_templates_win_on_a_large_host(spark, monkeypatch):
    """Eight templates of 3 to 40 pages; each has a teaser under the path of the largest one beside its article."""
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa"]
    counts = [40, 30, 25, 20, 15, 12, 6, 3]
    teaser = "<div class='alpha'><p>Teaser only.</p></div>"
    rows = [(1000 * k + i, f"http://hot.example/{k}/{i}", (teaser if k else "") + f"<div class='{words[k]}'><p>Story {k} {i}. {LONG}</p></div>") for k, n in enumerate(counts) for i in range(n)]
    rows += [(9999, "http://hot.example/odd", teaser + f"<div class='seen once'><p>{LONG}</p></div>")]
    # An odd page with a block of the rarest template alone.
    rows += [(9998, "http://hot.example/rare", f"<div class='never'><p>{LONG}</p></div><div class='kappa'><p>Rare story.</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for most in (M.MOST_BROADCAST, 0):
        monkeypatch.setattr(M, "MOST_BROADCAST", most)
        got = {r.page_id: r.text for r in M.main_text(pages).collect()}
        assert len(got) == len(rows) and got[9999] == "Teaser only." and got[9998] == "Rare story."
        assert all(got[1000 * k + i] == f"Story {k} {i}. {LONG}" for k, n in enumerate(counts) for i in range(n))


class Tree(HTMLParser):
    """A second reading: a tree by the standard library's tokenizer, walked recursively."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.top = ("page", {}, [])
        self.stack = [self.top]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [])
        self.stack[-1][2].append(node)
        if tag not in ("br", "hr"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        while self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def dropped(tag, attrs):
    words = set(re.findall("[a-z]+", (attrs.get("class") or "").lower()))
    if tag in ("div", "section", "ul"):
        words |= set(re.findall("[a-z]+", (attrs.get("id") or "").lower()))
    return tag in ("nav", "aside", "footer", "form", "script") or tag not in ("article", "h2") and bool(words & M.MARKS)


def walked(node, out, run):
    """Blocks under a node in page order."""
    tag, attrs, inner = node
    block = tag in ("p", "div", "section", "article", "ul", "li", "h2", "blockquote", "nav", "aside", "footer", "form")

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    if block:
        flush()
    if not dropped(tag, attrs):
        for x in inner:
            if isinstance(x, str):
                run.append(x)
            elif x[0] == "br":
                run.append(" ")
            else:
                walked(x, out, run)
    elif not block:
        pass
    if block:
        flush()
    return out


def random_page(r):
    quotes = ["'", '"']

    def attrs(names):
        q = r.choice(quotes)
        kind = r.choice(["", f" class={q}{r.choice(names)}{q}", f" id={q}{r.choice(names)}{q}", f" title={q}a > b{quotes[q == quotes[0]]}s{q}", " it's", " data-x=5'9", f" alt = {q}1{q} /x"])
        return kind

    def inline(depth):
        bits = ["word ", "a &lt; b ", "&eacute;&#33; ", "x  \n y ", "5' 9\" ", "<br>"]
        return "".join(r.choice(bits) if depth > 2 or r.random() < 0.7 else "<%s%s>%s</%s>" % ((t := r.choice(["b", "span", "i"])), attrs(["bold", "share", "ad-text", "form"]), inline(depth + 1), t) for _ in range(r.randint(1, 4)))

    def block(depth):
        t = r.choice(["p", "p", "h2", "blockquote"] + ["div", "section", "ul", "aside", "nav", "form"] * (depth < 5))
        names = ["form-and-matter", "share", "comments", "story", "c1 c2", "related"]
        body = inline(0) if t in ("p", "h2", "blockquote") else "".join(f"<li{attrs(names)}>{inline(0)}</li>" for _ in range(2)) if t == "ul" else "".join(block(depth + 1) for _ in range(r.randint(0, 4)))
        return f"<{t}{attrs(names)}>{body}</{t}>" + r.choice(["", " ", "<!-- <p>no</p> -->"])

    return "<article>" + "".join(block(0) for _ in range(r.randint(1, 6))) + "</article>"


def test_against_a_tree_walk_on_random_pages():
    r = random.Random(9)
    for _ in range(1500):
        html = random_page(r)
        assert M.extract(html, ["article"]).split("\n") == ("\n".join(walked(Tree(html).top, [], []))).split("\n"), html


def test_odd_quotes_marked_ids_and_headings():
    assert M.extract("<article><p it's>hello world</p><p>it's fine</p></article>", None) == "hello world\nit's fine"
    assert M.extract('<p title="5" tall">hello world</p><p class="x">bye</p>', None) == "hello world\nbye"
    assert M.extract('<article><p id="share-prices">Share prices fell</p><h2 id="form">Form and matter</h2></article>', None) == "Share prices fell\nForm and matter"
    assert M.extract("<div class=page><h1>T</h1><div class=content><p>some text</p></div></div>", None) == "T\nsome text"
    assert M.extract("<div class='page with-sidebar'><p>text</p></div><div class=sidebar><p>no</p></div>", None) == "text"


def test_deep_and_long_pages():
    """Memory is proportional to the page: 200,000 nested containers, and a text of 10 million characters."""
    tracemalloc.start()
    assert M.extract("<div class='a b'>" * 200_000 + "<p>deep</p>" + "</b>" * 1000, ["div.z"]) == "deep"
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    assert len(M.extract("<article><p>" + "ab " * 3_400_000 + "</p></article>", None)) == 10_199_999


def test_query_over_the_whole_table(spark):
    """The registered query against plain Python: votes counted in a dictionary, pages read one by one."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    host = lambda u: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "") or ["", ""])[1].lower()
    votes = {}
    for x in rows:
        page = M.Page(x.html or "")
        place, score = page.best()
        if score > 0:
            own = votes.setdefault(host(x.url), {})
            own[page.path(place)] = own.get(page.path(place), 0) + 1
    led = {h: [p for p, n in sorted(v.items(), key=lambda y: (-y[1], y[0])) if n >= M.SUPPORT or n >= M.LEAST_SHARE * sum(v.values())] for h, v in votes.items()}
    want = {x.page_id: (x.url, t := M.extract(x.html, led.get(host(x.url))), len(t)) for x in rows}
    got = M.op7_host_path_extraction(spark, folder).collect()
    assert len(got) == len(rows) and {r.page_id: (r.url, r.text, r.n_chars) for r in got} == want
