"""The main text of web pages by tree scoring.

A page becomes a tree. Subtrees that are not article text by their tag, role, visibility or the words of their class and id go first. Each paragraph
then earns points for its length and commas, less those of its links, and passes them to its ancestors: all to the nearest container, half to the next,
then a third of the level's share. A container's points, with a start for its kind, are discounted by the share of its text that stands in links.
The best container is kept (an ``article`` or ``main`` around it stands for it), with the siblings that score enough themselves or read as
sentences, and inside it all text but lists of links.

Pages are scanned in Spark tasks, each on its own, so no key is hot; the time of a page grows with its length alone.

Defined cases: null and empty html, and pages without article text, give an empty text; text without any markup is taken whole; unclosed and stray tags, quotes and
comments are read as browsers do, roughly; what follows an unfinished tag at the end is dropped; elements deeper than ``DEEPEST`` count as children of the one at that depth;
a heading in the article belongs to it, a ``header`` only where it is in the article and holds a heading; if nothing has any points, words of class and id are ignored in a second try;
repeated rows, null page_id and null url stay as they are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, scan

# Kinds of elements, and words that tell them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("#page body html article blockquote center details div main section td".split())
NOT_TEXT = set("aside audio button canvas dialog footer form head iframe input math menu nav noscript object option script select style svg template textarea title video".split())
NOT_TEXT_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENTS = set("ad ads advert advertisement comment commentlist comments disqus promo replies reply sponsored teaser".split())
NOT_TEXT_WORDS = COMMENTS | set(
    "advertising adverts alert banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer discussion footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promotion recommended related respond search share sharing sidebar signup skip social sponsor subscribe subscription toolbar".split()
)
STATES = set("has is no not with without".split())
TEXT_WORDS = set("article body content entry main post story text".split())
START = {"article": 25, "main": 25, "div": 5, "section": 5, "blockquote": 3, "pre": 3, "td": 3, "address": -3, "dd": -3, "dl": -3, "dt": -3, "li": -3, "ol": -3, "ul": -3, "th": -5}
COMMAS = re.compile("[,،、，]")
#: Which open elements a start tag closes, and which it looks no further than.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
CLOSES |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CLOSES |= {x: ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}) for x in ("tbody", "thead", "tfoot")}

DEEPEST = 512
PARAGRAPH = 25
LEVELS = 5

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<[!?/][^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: The end of each raw element.
ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}


class Tree:
    """Elements in page order: tag, parent, attributes; and the pieces of text with the element and the block that each stands in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs, self.block = ["#page"], [-1], [""], [0]
        self.pieces: list[tuple[int, bool, str]] = []
        self.links = [0]
        self._open, self._counts, self._link = [0], {}, None
        last = html.rfind(">") + 1
        at, raw = 0, None
        for m in TOKEN.finditer(html, 0, last):
            if m.start() < at:  # inside a raw element
                continue
            if m.start() > at:
                self._text(html[at : m.start()])
            at, name = m.end(), m[2]
            if name:
                name = name.lower()
                if m[1]:
                    self._close(name)
                elif self._start(name, m[3]):
                    raw = ENDS[name].search(html, at)
                    at = raw.end() if raw else len(html)
                    self._close(name)
        rest = html[max(at, last) :] if at <= last else html[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)
        self._text(html[at:last] + rest[: cut.start() if cut else None] if at < last else rest[: cut.start() if cut else None])

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._open[-1], self._link is not None, unescape(text) if "&" in text else text))

    def _break(self) -> None:
        self.pieces.append((self._open[-1], False, " "))

    def _pop(self, depth: int) -> None:
        """Close all elements from a depth on."""
        for node in self._open[depth:]:
            self._counts[self.tag[node]] -= 1
            if node == self._link:
                self._link = None
        blocks = any(self.tag[x] in BLOCKS for x in self._open[depth:])
        del self._open[depth:]
        if blocks:
            self._break()

    def _find(self, names: set[str], stops: set[str]) -> int | None:
        """Depth of the innermost open element of some names."""
        if any(self._counts.get(x) for x in names):
            for depth in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[depth]]
                if tag in names:
                    return depth
                if tag in stops:
                    return None
        return None

    def _start(self, name: str, attrs: str) -> bool:
        """Open an element; true if raw text follows."""
        if name in BLOCKS and (at := self._find({"p"}, BLOCKS - {"p"})) is not None:
            self._pop(at)
        if name in CLOSES:
            names, stops = CLOSES[name]
            while (at := self._find(names, stops)) is not None:
                self._pop(at)
        if name == "a" and self._link is not None:
            self._link = None
        if name in BLOCKS or name == "br":
            self._break()
        if name in VOID or len(self._open) >= DEEPEST:
            return name in RAW
        node, parent = len(self.tag), self._open[-1]
        self.tag.append(name)
        self.parent.append(parent)
        self.attrs.append(attrs if TELLING.search(attrs) else "")
        self.block.append(node if name in BLOCKS else self.block[parent])
        self.links.append(int(name == "a"))
        self._open.append(node)
        self._counts[name] = self._counts.get(name, 0) + 1
        if name == "a":
            self._link = node
        return name in RAW

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._break()
        if (at := self._find({name}, set() if name in BLOCKS else BLOCKS)) is not None:
            self._pop(at)
        elif name == "a":
            self._link = None

    def sums(self, values: list) -> list:
        """Each element's own value and those of all below it."""
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


def words_tell(tag: str, attrs: dict[str, str]) -> bool:
    """Whether class or id say that an element is not article text."""
    unlikely = COMMENTS if tag in ("article", "main") else NOT_TEXT_WORDS
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [x.lower() for x in WORD.findall(name)]
        if words and words[0] not in STATES and (words[0] in unlikely or words[-1] in unlikely or "".join(words) in unlikely):
            return True
    return False


def left_out(tree: Tree, by_words: bool) -> list[bool]:
    """For each element whether it is not article text, by itself or by one above it."""
    tag, parent = tree.tag, tree.parent
    known = [{k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(x)} if x else {} for x in tree.attrs]
    worded = [by_words and bool(k) and t not in ("html", "body") and words_tell(t, k) for t, k in zip(tag, known, strict=True)]
    named = [("header" in WORD.findall(f"{k.get('class', '')} {k.get('id', '')}".lower())) if k and by_words else False for k in known]
    articles = tree.sums([int((t in ("article", "main") or k.get("role") == "main") and not w) for t, k, w in zip(tag, known, worded, strict=True)])
    heads = tree.sums([int(t in HEADINGS) for t in tag])
    out, inside = [False] * len(tag), [False] * len(tag)
    for i in range(1, len(tag)):
        p, t, k = parent[i], tag[i], known[i]
        holds = articles[i] - (t in ("article", "main") and not worded[i]) > 0
        inside[i] = inside[p] or (t in ("article", "main") and not worded[i])
        gone = out[p] or (t in NOT_TEXT and not (t == "form" and holds))
        if t == "header" or named[i] and t not in ("html", "body", "article", "main"):
            gone = gone or not (holds or inside[p] and heads[i])
        if k and not gone:
            gone = "hidden" in k or (k.get("aria-hidden") or "").lower() == "true" or bool(UNSEEN.search(k.get("style") or ""))
            gone = gone or (((k.get("role") or "").lower() in NOT_TEXT_ROLES or worded[i]) and not holds)
        out[i] = gone
    return out


def scored(tree: Tree, gone: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
    """(points, link share, characters, links) of each element's whole subtree."""
    tag, parent = tree.tag, tree.parent
    n = len(tag)
    chars, linked, commas = [0] * n, [0] * n, [0] * n
    for node, link, text in tree.pieces:
        if not gone[node] and text != " ":
            size = len(" ".join(text.split()))
            if size:
                b = tree.block[node]
                chars[b] += size
                commas[b] += len(COMMAS.findall(text))
                linked[b] += size * link
    all_chars, all_linked = tree.sums(chars), tree.sums(linked)
    points = [0.0] * n
    for b in range(n):
        if chars[b] < PARAGRAPH or tag[b] in HEADINGS:
            continue
        earned = (1 + commas[b] + chars[b] / 100) * (1 - linked[b] / chars[b])
        to, level = b if tag[b] in CONTAINERS else parent[b], 0
        while to >= 0 and level < LEVELS:
            points[to] += earned / (1, 2)[level] if level < 2 else earned / (3 * level)
            to, level = parent[to], level + 1
    share = [a / c if c else 0.0 for a, c in zip(all_linked, all_chars, strict=True)]
    for i in range(n):
        if points[i] or tag[i] in ("article", "main") and all_chars[i]:
            likely = bool(tree.attrs[i]) and any(w.lower() in TEXT_WORDS for w in WORD.findall(tree.attrs[i]))
            points[i] = (points[i] + START.get(tag[i], 0) + 10 * likely) * (1 - share[i])
    links = tree.sums([x and not g for x, g in zip(tree.links, gone, strict=True)])
    return points, share, all_chars, links


def chosen(tree: Tree, gone: list[bool], points: list[float], share: list[float], chars: list[int]) -> list[int]:
    """The best container and the siblings that stay; the whole page if nothing has points."""
    tag, parent = tree.tag, tree.parent
    best = max((i for i in range(len(tag)) if not gone[i]), key=lambda i: (points[i], -i))
    if points[best] <= 0:
        return [0]
    around = best
    while around > 0 and tag[around] not in ("article", "main"):
        around = parent[around]
    if around > 0:
        best = around
    least, out = max(10, points[best] / 5), []
    told = {}  # the last characters of paragraphs beside the best
    for i in range(1, len(tag)):
        if i == best or parent[i] != parent[best] or gone[i] or best == 0:
            continue
        if around > 0:
            if tag[i] == tag[best] and points[i] >= least:
                out.append(i)
        elif points[i] >= least or tag[i] == "h1" and i < best:
            out.append(i)
        elif tag[i] == "p" and chars[i] and share[i] < 0.25 and (chars[i] > 80 or not share[i]):
            told[i] = ""
    if told:
        for node, _, text in tree.pieces:
            b = tree.block[node]
            if b in told and text.strip():
                told[b] = text.rstrip()[-1]
        out += [i for i, end in told.items() if chars[i] > 80 or end in ".!?…。"]
    return [best, *out]


def main_text(html: str | None) -> str:
    """Blocks of the article in page order, each with single spaces, joined by one space."""
    if not html or not html.strip():
        return ""
    tree = Tree(html)
    for by_words in (True, False):
        gone = left_out(tree, by_words)
        points, share, chars, links = scored(tree, gone)
        if max(points) > 0 or chars[0] and not by_words:
            break
    roots = chosen(tree, gone, points, share, chars)
    kept = [False] * len(tree.tag)
    for i in range(len(kept)):
        p = tree.parent[i]
        inner = p >= 0 and kept[p]
        lists = inner and tree.tag[i] in ("ul", "ol", "dl", "div", "section", "table") and links[i] >= 3 and share[i] > 2 / 3
        kept[i] = not gone[i] and (i in roots or inner and not lists)
    return " ".join("".join(text for node, _, text in tree.pieces if kept[node]).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def work(batches):
        for batch in batches:
            ids, urls, html = (column(batch, c) for c in ("page_id", "url", "html"))
            for lo in range(0, batch.num_rows, 256):
                texts = [main_text(x.as_py()) for x in html.slice(lo, 256)]
                yield {"page_id": ids.slice(lo, 256), "url": urls.slice(lo, 256), "text": texts, "n_chars": [len(x) for x in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return scan(rows, work, "page_id long, url string, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
