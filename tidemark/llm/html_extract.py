"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, slices

# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
BOILER = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas dialog menu audio video map math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag ends these open elements, up to the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HOLDS_P = frozenset("table td th button object caption template html".split())
# Words in class names and ids, and roles, that name what isn't the article.
NAMED = frozenset(
    "ad ads alert adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
NAMED_IN = ("sidebar", "advert", "cookie", "newsletter", "breadcrumb")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SAFE = frozenset("html body article main".split())

#: A name that says what else is there, as has-sidebar, says nothing of the element itself.
BESIDE = re.compile(r"(?:^|[-_])(?:has|with|without|no)[-_]")
ATTRIBUTE = re.compile(r"""(?<![A-Za-z-])([A-Za-z-]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
TAG = re.compile(r"/?[A-Za-z][^\s/>]*+")
PLAIN = re.compile(r"""[^>"']*+""")
COMMA = re.compile("[,،、，]")
#: Elements that hold running text; what stands in them counts for the element around them.
PARAGRAPH = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote td th tr caption figcaption address summary hr".split())
#: Shares of a block's points that the elements around it get, nearest first.
SHARES = (1.0, 0.5, 1 / 3, 0.25, 0.2)
#: What an element's own name makes of the points in it, and of its score.
WEIGHTS = {"named": 0.2, "article": 1.25, "main": 1.25}
#: A container's sibling stays from this share of the container's score, and siblings of the elements around it
#: as long as those have this share of its score.
SIBLING, AROUND = 0.2, 0.5
#: From this share of link text a list or division in no container but the page itself is a menu.
MENU = 0.8


def _reading(tag: str, rest: str, article: bool) -> tuple[bool, bool]:
    """Whether an element is dropped by what it is, and whether its class or id names something beside the article."""
    if tag in BOILER or (tag == "header" and not article):
        return True, False
    if not rest or rest.isspace() or tag in SAFE:
        return False, False
    named = False
    for m in ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and tag not in INLINE:
            value = " ".join(x for x in value.split() if not BESIDE.search(x))
            named = named or not NAMED.isdisjoint(re.split(r"[^a-z]+", value)) or any(x in value for x in NAMED_IN)
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
    return False, named


class _Open:
    """The stack of open elements, with the depths at which each tag is open, so that no step walks the stack."""

    def __init__(self):
        self.stack, self.tags, self.at, self.blocks = [0], ["body"], {}, [0]

    def push(self, k: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(k)
        self.tags.append(tag)

    def pop(self, depth: int) -> int:
        """Close all from ``depth`` on; the first block among them, or else the first one."""
        first = next((k for k, tag in zip(self.stack[depth:], self.tags[depth:], strict=True) if tag not in INLINE), self.stack[depth])
        while len(self.stack) > depth:
            self.at[self.tags.pop()].pop()
            self.stack.pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()
        return first

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def closed_by_end(self, tag: str) -> int:
        """Depth that an end tag closes, 0 if none: inline ones only up to the block they stand in."""
        depth = self.at[tag][-1] if self.at.get(tag) else 0
        return depth if tag not in INLINE or depth > self.blocks[-1] else 0

    def closed_by_start(self, tag: str) -> list[int]:
        """Depths that a start tag closes, one after the other."""
        out = []
        ends, holds = ENDS.get(tag, ((), ()))
        if ends:
            over = self.last(holds)
            found = [self.at[t][i] for t in ends if self.at.get(t) and (i := bisect_right(self.at[t], over)) < len(self.at[t])]
            out += [min(found)] if found else []
        if tag in CLOSES_P and self.at.get("p"):
            depth = self.at["p"][-1]
            out += [depth] if depth > self.last(HOLDS_P) and (not out or depth < out[0]) else []
        return out


class _Tree:
    """Elements in page order: tag, parent, whether dropped and whether named; ``flow`` has texts and element bounds in page order.

    One pass in linear time: a search that finds nothing up to the page's end isn't made again.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.drop, self.named, self.inside = ["body"], [-1], [False], [False], [False]
        self.flow: list[tuple[int, str | None]] = [(0, None)]
        self.page, self.quotes = page, True
        self.last_end = page.rfind(">")
        open_, at, text = _Open(), 0, 0
        while 0 <= (lt := page.find("<", at)) <= self.last_end or lt >= 0 and page.startswith("<!--", lt):
            at = lt + 1
            markup = page.startswith(("!", "?"), at)
            m = None if markup else TAG.match(page, at)
            if not markup and not m:
                continue
            self._text(open_, text, lt)
            if markup:
                text = at = self._declaration(at)
                continue
            end = self._end(m.end())
            rest, text = page[m.end() : end], end + 1
            at = text
            tag = m[0].lower()
            if tag[0] == "/":
                if depth := open_.closed_by_end(tag[1:]):
                    self.flow.append((open_.pop(depth), None))
            elif tag not in ("html", "body"):
                text = at = self._element(open_, tag, rest, at)
        self._text(open_, text, len(page))

    def _text(self, open_: _Open, begin: int, end: int) -> None:
        if end > begin and not self.drop[open_.stack[-1]]:
            self.flow.append((open_.stack[-1], html.unescape(self.page[begin:end])))

    def _declaration(self, at: int) -> int:
        """Where a comment, CDATA section, doctype or instruction ends."""
        close = "-->" if self.page.startswith("!--", at) else "]]>" if self.page.startswith("![CDATA[", at) else ">"
        end = self.page.find(close, at)
        return len(self.page) if end < 0 else end + len(close)

    def _end(self, at: int) -> int:
        """Where the tag's > is: after quoted values if these are closed, else the next one."""
        page, place = self.page, at
        while self.quotes:
            place = PLAIN.match(page, place).end()
            if place >= len(page):
                self.quotes = False
            elif page[place] == ">":
                return place
            else:
                close = page.find(page[place], place + 1)
                if close < 0:
                    self.quotes = False
                place = close + 1
        return page.find(">", at)

    def _element(self, open_: _Open, tag: str, rest: str, at: int) -> int:
        for depth in open_.closed_by_start(tag):
            self.flow.append((open_.pop(depth), None))
        top, k = open_.stack[-1], len(self.tag)
        article = self.inside[top] or tag == "article"
        drop, named = _reading(tag, rest, article) if not self.drop[top] else (True, False)
        self.tag.append(tag)
        self.parent.append(top)
        self.inside.append(article)
        self.drop.append(drop)
        self.named.append(named)
        self.flow.append((k, None))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(self.page, at)
            return end.end() if end else len(self.page)
        if tag not in VOID and not (rest.endswith("/") and tag not in CLOSES_P):
            open_.push(k, tag)
        return at


def extract(page: str | None) -> str:
    """The article's text: blocks in page order, white space inside them and between them one space.

    Menus, headers, footers, sidebars, forms, scripts, styles and what is hidden are dropped by element and role. Each
    block of running text gives the elements around it points: one, one per comma, and one per 100 characters up to
    three. An element whose class or id names an advert, a notice, comments or the like weakens the points in it
    (WEIGHTS); an article or main element strengthens its own. An element's points are discounted by its share
    of link text, and the best one is taken, and with it the siblings that are headings or running text or have SIBLING
    of its score. Elements so named inside go, unless they hold the best one; so do, where the page itself is
    the container, lists and divisions of links. An empty page is empty; time grows with the length of the page,
    whatever is in it.
    """
    if not page:
        return ""
    t = _Tree(page)
    best, score, dense = _best(t)
    return _kept(t, best, score, dense) if best is not None else ""


def _best(t: _Tree) -> tuple[int | None, list[float], list[float]]:
    """The best container, None without any text, every element's score and its share of link text (-1: no text)."""
    n = len(t.tag)
    block, linked, weight = [0] * n, [False] * n, [1.0] * n
    for k in range(1, n):
        up = t.parent[k]
        block[k] = block[up] if t.tag[k] in INLINE else k
        linked[k] = linked[up] or t.tag[k] == "a"
        weight[k] = weight[up] * (WEIGHTS["named"] if t.named[k] else 1.0)
    length, commas, total, links = [0] * n, [0] * n, [0] * n, [0] * n
    for k, words in t.flow:
        if words is None or t.drop[k]:
            continue
        b, size = block[k], len(words.strip())
        length[b] += size
        commas[b] += len(COMMA.findall(words))
        total[b] += size
        if linked[k]:
            links[b] += size
    points = [0.0] * n
    for k in range(n - 1, -1, -1):
        if length[k]:
            gained = (1 + commas[k] + min(length[k] / 100, 3.0)) * weight[k]
            up = t.parent[k] if t.tag[k] in PARAGRAPH else k
            for share in SHARES:
                points[up] += gained * share
                if up <= 0:
                    break
                up = t.parent[up]
        if k:
            total[t.parent[k]] += total[k]
            links[t.parent[k]] += links[k]
    dense = [links[k] / total[k] if total[k] else -1.0 for k in range(n)]
    score = [points[k] * (1 - dense[k]) * WEIGHTS.get(t.tag[k], 1.0) if total[k] else 0.0 for k in range(n)]
    if not any(total):
        return None, score, dense
    return max((k for k in range(n) if total[k] and not t.drop[k] and t.tag[k] not in INLINE), key=lambda k: (score[k], -k)), score, dense


def _kept(t: _Tree, best: int, score: list[float], dense: list[float]) -> str:
    n = len(t.tag)
    path, up = {best: best}, best  # every element from the best one to the page, with its child on the way
    while up > 0 and (up == best or score[up] >= AROUND * score[best]):
        path[t.parent[up]] = up
        up = t.parent[up]
    keep, gone = [False] * n, [False] * n
    keep[best] = True
    on_way = set()
    up = best
    while up >= 0:
        on_way.add(up)
        up = t.parent[up]
    for k in range(n):
        up = t.parent[k]
        if k and k not in on_way and up in path and up != best and dense[k] >= 0:
            running = t.tag[k] in ("h1", "h2", "h3", "p", "blockquote", "pre") and dense[k] < 0.5
            keep[k] = running or score[k] >= max(1.0, SIBLING * score[best])
        if k:
            keep[k] = keep[k] or (keep[up] and k not in on_way)
            menu = best == 0 and dense[k] >= MENU and t.tag[k] in ("ul", "ol", "div", "section", "table", "dl")
            gone[k] = gone[up] or t.drop[k] or menu or (t.named[k] and k not in on_way)
    out = []
    for k, words in t.flow:
        if words is None:
            out.append("" if t.tag[k] in INLINE else " ")
        elif keep[k] and not gone[k]:
            out.append(words)
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with columns text and n_chars (code points); null and empty pages have an empty text.

    Rows are kept one to one; columns named text or n_chars are replaced, others pass through. No shuffle: each page
    is its own unit, read in time linear in its length, and a worker holds a slice of pages at a time.
    """
    ship(pages.sparkSession)
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars") or c == page])
    names = rows.columns
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != page], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, page):
                texts = [extract(x) for x in batch.column(page).to_pylist()]
                rest = [n for n in names if n != page]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*rest, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
