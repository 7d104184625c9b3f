"""Main text of web pages by consensus host paths (operator 7).

Every page scores its containers (div, section, article, main, td): the text of the blocks
a container holds itself, without links, and a share of what its inner containers hold.
The page votes for the path of its best one: the tags and classes from the top, digits
replaced, so that pages of one template agree.  Spark sums the votes for each host and
path and keeps every path that several pages of the host support (SUPPORT, or LEAST_SHARE
on small hosts), however many templates it has.  Each page is then read again with them:
its own best path if that is among the leaders, else the leader of most votes that it has
text under, else its own best.  From the chosen containers all blocks are taken but those inside menus,
headers, footers, sidebars, notices, adverts, forms and reader comments.

Votes are summed in each task first, so a large host costs one row a task and path.  The
leaders are broadcast only if they are few (MOST_BROADCAST characters), else joined by
host, the pages of a large host dealt to parts of PART_PAGES with a copy of its leaders each.

A main heading (h1) that stands before the chosen container, beside it in one that holds
it, belongs to the text if the container has none itself.

Defined cases: null html gives an empty text; a null or odd url belongs to the empty host;
markup cut off in the middle ends where it is cut; a page without containers is its
own container.  br is white space inside its block.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import cut, table
from litloom.llm.workers import over_batches

CONTAINERS = frozenset("div section article main td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary div section article main center body html header footer nav aside form fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
OUTSIDE = frozenset("nav footer aside form noscript template iframe svg button select textarea dialog menu object canvas video audio title script style head-only".split())
RAW = frozenset("script style noscript template iframe svg textarea title select object".split())
#: Words of a class or id, or a role, that mark such elements.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer "
    "form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted "
    "recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
GOOD = re.compile(r"article|content|post|entry|story|main|body|text")
#: Elements whose own name, class or id says nothing of what they hold: headings, text blocks and inline ones.
PLAIN = BLOCKS - CONTAINERS - frozenset("ul ol dl table tbody details center fieldset".split())
#: Words before a mark that turn it into a remark on the page's layout.
LAYOUT = frozenset("has with without no".split())
#: One attribute as HTML tokenizers read it: a quote opens a value after = only.
_ONE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+"""
TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ONE})*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+""", re.S)
TOLD = re.compile(r"class|id|role|hidden", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements whose text ends with their own end tag or the page; the other RAW ones need their end tag.
ENDLESS = frozenset("script style textarea title".split())
INNER_SHARE = 0.7
#: A path wins by so many votes, or by such a share of its host's.
SUPPORT = 3
LEAST_SHARE = 0.1
MOST_BROADCAST = 4_000_000
#: Pages of a large host that meet one copy of its leaders; at most MOST_LARGE hosts are large.
PART_PAGES = 5_000
MOST_LARGE = 1_000


def _marks(value: str) -> bool:
    """Whether a class or id names an element outside the main text."""
    for name in value.split():
        words = WORD.findall(name)
        if not MARKS.isdisjoint(words) and LAYOUT.isdisjoint(words):
            return True
    return False


def _attributes(tag: str, raw: str) -> tuple[str, bool]:
    """The generalised classes, and whether the attributes mark an element outside the main text.

    Ids are names of places: those of headings, paragraphs and inline elements are made of
    their words, so only the ids of structural elements mark, and no class of a heading does.
    """
    if not TOLD.search(raw):
        return "", False
    classes, marked, seen = "", False, set()
    structural = tag in CONTAINERS or tag in BLOCKS and tag not in PLAIN
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), unescape(value.strip("\"'")).lower()
        if name in seen:
            continue
        seen.add(name)
        if name == "role":
            marked |= value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            marked = True
        elif name == "id":
            marked |= structural and _marks(value)
        elif name == "class":
            marked |= tag not in HEADINGS and _marks(value)
            classes = ".".join(sorted(set(re.sub(r"\d+", "#", value).replace(">", " ").split())))
    return classes, marked


class Page:
    """blocks: (place, text, characters in links, is the main heading) of what may be main text, in page order.

    A place is a number: containers of one parent with the same tag and classes share it,
    and steps tells each one's parent and own step, so memory grows with the page alone,
    however deep it nests.  Place 0 is the page itself.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.steps: list[tuple[int, str]] = [(0, "")]
        self._place: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, bool, bool]] = []  # tag, place, outside, header
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._linked, self._in_link = 0, False
        self._heading = ""
        self._read(html)

    def _top(self):
        return self._stack[-1] if self._stack else ("", 0, False, False)

    def _push(self, tag: str, place: int, outside: bool, header: bool) -> None:
        self._stack.append((tag, place, outside, header))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop_to(self, k: int) -> None:
        for tag, *_ in self._stack[k:]:
            self._open[tag] -= 1
        del self._stack[k:]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            _, place, _, header = self._top()
            # Inside a header only the headings count.
            if text and (not header or self._heading):
                self.blocks.append((place, text, min(self._linked, len(text)), self._heading == "h1" and not header))
        self._text, self._linked = [], 0

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        unclosed = set()
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._add(html[at:lt])
            if lt == n:
                break
            found = TOKEN.match(html, lt)
            if not found:
                self._add("<")
                at = lt + 1
                continue
            at = found.end()
            if found[2]:
                tag = found[2].lower()
                if found[1]:
                    self._end(tag)
                elif tag in RAW and not found[3].endswith("/"):
                    if tag in BLOCKS:
                        self._flush()
                    close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    if close:
                        at = close.end()
                    elif tag in ENDLESS:
                        at = n
                    else:
                        unclosed.add(tag)
                    if self._text:
                        self._text.append(" ")
                elif tag not in RAW:
                    self._start(tag, found[3])
            elif html.startswith("<![CDATA[", lt):
                self._add(html[lt + 9 : at - 3].replace("&", "&amp;"))
        self._flush()

    def _add(self, text: str) -> None:
        if self._stack and self._stack[-1][2]:
            return
        self._text.append(text)
        if self._in_link:
            self._linked += len(text)

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag == "a":
            self._in_link = True
        block = tag in BLOCKS
        if block:
            self._flush()
            self._in_link = False
            self._heading = tag if tag in HEADINGS else ""
            if self._stack and self._stack[-1][0] == "p":
                self._pop_to(len(self._stack) - 1)
            if tag in ("td", "th", "tr"):
                self._close("td", ("table",))
            elif tag in ("li", "dd", "dt"):
                self._close(tag, ("ul", "ol", "dl", *CONTAINERS))
        if tag in VOID or raw.endswith("/") and tag not in CONTAINERS or tag in ("body", "html"):
            return
        _, place, outside, header = self._top()
        classes, marked = _attributes(tag, raw)
        out = outside or tag in OUTSIDE or marked and tag not in ("main", "article") or (marked and tag == "article" and "comment" in classes)
        if tag in CONTAINERS:
            key = (place, f"{tag}.{classes}" if classes else tag)
            inner = self._place.get(key)
            if inner is None:
                inner = self._place[key] = len(self.steps)
                self.steps.append(key)
            self._push(tag, inner, out, header)
        elif tag == "header":
            self._push(tag, place, out or not place, True)
        elif out and not outside:
            self._push(tag, place, True, header)
        elif tag in ("ul", "ol", "table", "dl") or outside and (block and tag != "p" or self._open.get(tag)):
            self._push(tag, place, out, header)

    def _close(self, tag: str, stop: tuple[str, ...]) -> None:
        if not self._open.get(tag):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                self._pop_to(k)
                return
            if self._stack[k][0] in stop:
                return

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        if tag in BLOCKS:
            self._flush()
            self._in_link, self._heading = False, ""
        self._close(tag, () if tag in CONTAINERS or tag in OUTSIDE or tag in ("header", "table", "ul", "ol") else tuple(CONTAINERS))

    def path(self, place: int) -> str:
        steps = []
        while place:
            place, step = self.steps[place]
            steps.append(step)
        return ">".join(reversed(steps))

    def place(self, path: tuple[str, ...]) -> int | None:
        at = 0
        for step in path:
            at = self._place.get((at, step))
            if at is None:
                return None
        return at

    def best(self) -> tuple[int, float]:
        """The place of most text: its own and a share of its inner ones'; of equal ones the least path."""
        own = [0.0] * len(self.steps)
        for place, text, linked, _ in self.blocks:
            own[place] += max(0, len(text) - 2 * linked)
        for place in range(len(own) - 1, 0, -1):  # inner places have greater numbers
            own[self.steps[place][0]] += INNER_SHARE * own[place]
        for place, (_, step) in enumerate(self.steps):
            own[place] *= 1.5 if step.startswith(("article", "main")) else 1.25 if GOOD.search(step) else 1.0
        most = max(own)
        ties = [i for i, v in enumerate(own) if v == most] if most > 0 else [0]
        return (min(ties, key=self.path) if 1 < len(ties) <= 32 else ties[0]), most

    def inside(self, chosen: int) -> list[bool]:
        """For each place whether it is the chosen one or lies in it."""
        found = [False] * len(self.steps)
        for place in range(len(found)):
            found[place] = place == chosen or (place > chosen and found[self.steps[place][0]])
        return found

    def under(self, chosen: int) -> list[str]:
        """The blocks in the chosen place, and before them a main heading that stands beside it, if it has none."""
        found = self.inside(chosen)
        own = [i for i, b in enumerate(self.blocks) if found[b[0]]]
        texts = [self.blocks[i][1] for i in own]
        if own and chosen and not any(self.blocks[i][3] for i in own):
            above, place = {0}, chosen
            while place:
                place = self.steps[place][0]
                above.add(place)
            head = next((b[1] for b in reversed(self.blocks[: own[0]]) if b[3] and b[0] in above), None)
            texts = [head, *texts] if head is not None else texts
        return texts


def ranked(leaders: list[str] | None) -> dict[str, tuple[str, ...]]:
    """Leading paths in order, each with its steps."""
    return {p: tuple(p.split(">")) if p else () for p in leaders or []}


def extract(html: str | None, leaders: list[str] | dict | None) -> str:
    page = Page(html or "")
    chosen, _ = page.best()
    ranks = leaders if isinstance(leaders, dict) else ranked(leaders)
    if ranks and page.path(chosen) not in ranks:
        filled = [False] * len(page.steps)
        for b in page.blocks:
            filled[b[0]] = True
        for place in range(len(filled) - 1, 0, -1):
            filled[page.steps[place][0]] |= filled[place]
        chosen = next((p for steps in ranks.values() if (p := page.place(steps)) is not None and filled[p]), chosen)
    return "\n".join(page.under(chosen))


def _vote(batches):
    """Votes of a task by host and path."""
    votes: dict[tuple[str, str], int] = {}
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html or "")
            place, score = page.best()
            if score > 0:
                path = page.path(place)
                votes[host, path] = votes.get((host, path), 0) + 1
        if len(votes) > 100_000:
            yield _rows(votes)
            votes = {}
    yield _rows(votes)


def _rows(votes):
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(votes.values(), pa.int64())], ["host", "path", "votes"])


def _read_again(batches, few=None):
    """With the leaders of few, {host: ranks}, or of the column leaders."""
    for batch in batches:
        hosts, ranks = batch.column("host").to_pylist(), few
        if few is None:
            ranks, column = {}, batch.column("leaders")
            for i, h in enumerate(hosts):
                if h not in ranks:
                    ranks[h] = ranked(column[i].as_py())
        text = [extract(x, ranks.get(h)) for x, h in zip(batch.column("html").to_pylist(), hosts)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def leading_paths(pages: DataFrame) -> DataFrame:
    """host, leaders, total: the paths with SUPPORT votes or with LEAST_SHARE of the host's, most votes first."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(over_batches(_vote), "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    all_votes = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    led = votes.join(all_votes, "host").where((F.col("votes") >= SUPPORT) | (F.col("votes") >= LEAST_SHARE * F.col("total")))
    leaders = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))), lambda x: x["path"])
    return led.groupBy("host").agg(leaders.alias("leaders"), F.first("total").alias("total"))


def _with_leaders(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """rows with their host's leaders; large hosts, fewer than MOST_LARGE, in parts."""
    everything = leaders.agg(F.sum("total")).first()[0] or 0
    large = leaders.where(F.col("total") > max(PART_PAGES, everything // MOST_LARGE)).select("host", F.ceil(F.col("total") / PART_PAGES).cast("int").alias("parts"))
    large = F.broadcast(large)  # each has more than a thousandth of all votes
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts).cast("int")).drop("parts")
    copies = leaders.join(large, "host", "left").select("host", "leaders", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.join(copies, ["host", "part"], "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    leaders = cut(leading_paths(pages))
    size = leaders.agg(F.sum(F.length("host") + F.length(F.array_join("leaders", " ")) + 32).alias("n")).first()["n"] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    out = "page_id long, url string, text string, n_chars long"
    if size > MOST_BROADCAST:
        return _with_leaders(rows, leaders).select("page_id", "url", "html", "host", "leaders").mapInArrow(over_batches(_read_again), out)
    few = pages.sparkSession.sparkContext.broadcast({r["host"]: ranked(r["leaders"]) for r in leaders.collect()})
    return rows.mapInArrow(over_batches(lambda batches: _read_again(batches, few.value)), out)


def op7_host_path_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_host_path_extraction": op7_host_path_extraction}
