"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; each block knows its text, its linked characters, whether it is a
heading, and which region it lies in: article, suspect part of an article, boilerplate (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments), or none of these. Inline elements never cut a block.

Elements of ``BAD_ELEMENTS`` are boilerplate. Class and id decide by whole words between spaces: a word made of ``BAD_WORDS`` and
``SHAPES`` only (comment-list) makes a container boilerplate, and a paragraph, heading or item if all of its words are so. A word
that has another part too (sharing-economy), or stands beside others on a paragraph, only makes the element suspect.

Pass 1 decides blocks on their own: boilerplate regions are bad. Else link density, length and the density of
stop words (English, German, French, Spanish) give good, bad, or undecided for short blocks and
blocks between the limits. Inside an article a block is never bad for lack of stop words or length: a block that is mostly
links is bad, one without links, or a long enough one with few, is good, the others and headings are undecided. In a
suspect part the text confirms: stop words make a block good, their lack or many links bad, short blocks are undecided.
On pages in none of the four languages stop words do not count: long blocks with few links are good. The language is the one that the
html element names; if it names none, it is none of the four if stop words are rare in all blocks with few links together.
Pass 2 gives undecided blocks the label of the nearest decided neighbour in their own region (ties:
good; none decided: good in an article or a suspect part of one, else bad); an undecided heading takes the next decided block's. Both passes take time in proportion
to the page.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order
by two line feeds. Defined cases: null or empty html, and pages without good blocks, give the empty text; tags and
comments left open at the end are dropped; elements may be left open or end in ``/>``; repeated rows are treated alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kinds_of, read_table, texts_for
from .quality_classifier import STOP_WORDS

MAX_LINK_DENSITY = 0.33
MOSTLY_LINKS = 0.5  # inside an article
SHORT, LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.08, 0.15
LANGUAGES = frozenset("en de fr es".split())  # of STOP_WORDS

# Element names and class or id words.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead title tr ul""".split())
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]),
            "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr li dd dt option td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Raw elements hold no markup; their content goes with them. A start tag that ends in /> is an empty element: for svg and math
# always, as in HTML; for the others if no end tag of its own follows before the next start tag of that name.
RAW = frozenset("script style noscript template textarea iframe svg math object audio video canvas title select button".split())
BAD_ELEMENTS = frozenset("nav aside footer form menu dialog head search".split())
BAD_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors
promo promotion nav navbar navigation menu menus sidebar sidebars aside footer masthead topbar cookie cookies consent gdpr
notice notices notification popup modal overlay newsletter subscribe subscription comment comments disqus respond replies
share sharing social related recommended breadcrumb breadcrumbs pagination pager widget widgets login signup search skip
toolbar disclaimer""".split())
SHAPES = frozenset("""area article articles bar block body bottom box button buttons card cards col column container content count foot
form group head header holder icon icons inner item items label left link links list main outer panel post posts right row rows section
site slot story stories text thread title top unit wrap wrapper""".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())

_RAW_NAMES = "|".join(sorted(RAW))
_PIECE = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
|<(?:svg|math)\b(?:[^>"']|"[^"]*"|'[^']*')*+>(?:(?<=[\s"']/>)|(?<=svg/>)|(?<=math/>))
|<(?P<raw>{_RAW_NAMES})\b(?:[^>"']|"[^"]*"|'[^']*')*+>(?:(?<=/>)(?!(?:(?!<(?P=raw)\b).)*?</(?P=raw)\b)|.*?(?:</(?P=raw)\s*[^>]*>|\Z))
|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<name2>/?[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)
""".replace("\n", ""), re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[^\W\d_]+")
_LANG = re.compile(r"""(?:^|[\s"'/])(?:xml:)?lang\s*=\s*["']?\s*([a-z]+)""", re.IGNORECASE)


PLAIN, ARTICLE, BOILERPLATE, SUSPECT = range(4)


def _judge(name: str, attrs: str, in_article: bool) -> int:
    """What a block element opens by its name and attributes: BOILERPLATE, SUSPECT, or PLAIN for nothing of the kind."""
    if name in BAD_ELEMENTS or name == "header" and not in_article:
        return BOILERPLATE
    if not attrs or name in ("html", "body", "article", "main"):
        return PLAIN
    found = PLAIN
    for key, *values in _NAMED.findall(attrs):
        key, value = key.lower(), next(filter(None, values), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in BAD_ROLES:
            return BOILERPLATE
        if key in ("class", "id"):
            words = [parts for w in html.unescape(value).split() if (parts := _PART.findall(w))]
            pure = [not BAD_WORDS.isdisjoint(p) and all(x in BAD_WORDS or x in SHAPES for x in p) for p in words]
            if pure and (any(pure) if name in CONTAINERS else all(pure)):
                return BOILERPLATE
            if any(not BAD_WORDS.isdisjoint(p) for p in words):
                found = SUSPECT
    return found


class _Page:
    """Blocks of one page: [text, linked characters, heading, region]."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.text: list[str] = []
        self.linked, self.heading, self.in_link = 0, False, False
        self.stack: list[tuple[str, int]] = []  # open containers and the region inside them
        self.open: Counter[str] = Counter()  # their names
        self.lang = ""  # as the html element names it
        at = 0
        for m in _PIECE.finditer(source):
            if m.start() > at:
                self.add(source[at:m.start()])
            at = m.end()
            name = (m["name"] or (m["name2"] or "").lstrip("/")).lower()
            if name:
                self.tag(name, bool(m["end"]) or (m["name2"] or "").startswith("/"), m["attrs"] or "")
            elif (m["raw"] or "").lower() == "title":
                self.flush()
        if at < len(source):
            self.add(source[at:])
        self.flush()

    def region(self) -> int:
        return self.stack[-1][1] if self.stack else PLAIN

    def add(self, piece: str) -> None:
        self.text.append(piece)
        if self.in_link:
            self.linked += len(" ".join(html.unescape(piece).split()))

    def tag(self, name: str, closes: bool, attrs: str) -> None:
        if name == "a":
            self.in_link = not closes
        elif name == "br":
            self.text.append(" ")
        if name not in BLOCKS:
            return
        self.flush()
        if closes:
            self.close(name)
            self.in_link = False
            return
        if self.stack and name in ENDED_BY.get(self.stack[-1][0], ()):
            self.close(self.stack[-1][0])
        if name == "html" and not self.lang and (named := _LANG.search(attrs)):
            self.lang = named[1].lower()
        region, inside = self.region(), self.region()
        if region != BOILERPLATE:
            found = _judge(name, attrs, region in (ARTICLE, SUSPECT))
            if found == BOILERPLATE or found == SUSPECT and region == ARTICLE:  # outside articles the text decides anyway
                inside = found
            elif name in ("article", "main") and region == PLAIN:
                inside = ARTICLE
        if name in CONTAINERS or inside != region and name not in VOID:
            self.stack.append((name, inside))
            self.open[name] += 1
        self.heading = name in HEADINGS

    def close(self, name: str) -> None:
        if self.open[name]:
            self.flush()
            while True:
                last, _ = self.stack.pop()
                self.open[last] -= 1
                if last == name:
                    return

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.text)).split())
        if text:
            self.blocks.append((text, self.linked, self.heading, self.region()))
        self.text, self.linked, self.heading = [], 0, False


def _stop_words(text: str) -> tuple[int, int]:
    """The number of stop words and of words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def _listed(page: _Page) -> bool:
    """Is the page in a language whose stop words are known?"""
    if page.lang:
        return page.lang in LANGUAGES
    counts = [_stop_words(t) for t, linked, _, region in page.blocks if region != BOILERPLATE and linked <= MAX_LINK_DENSITY * len(t)]
    return sum(n for n, _ in counts) >= STOP_LOW * sum(n for _, n in counts)


def _first_pass(text: str, linked: int, heading: bool, region: int, listed: bool = True) -> int:
    """1 good, -1 bad, 0 undecided."""
    if region == BOILERPLATE:
        return -1
    many = linked > MAX_LINK_DENSITY * len(text)
    if region == ARTICLE:
        if heading or many and linked <= MOSTLY_LINKS * len(text):
            return 0
        return -1 if many else 1 if not linked or len(text) >= SHORT else 0
    if many:
        return -1
    if len(text) >= SHORT and not heading:
        if not listed:
            return 1 if len(text) >= LONG else 0
        n, words = _stop_words(text)
        if n >= (STOP_LOW if len(text) >= LONG or region == SUSPECT else STOP_HIGH) * words:
            return 1
        if n < STOP_LOW * words:
            return -1
    return 0


def _decided(labels: list[int], regions: list[int], step: int) -> list[int | None]:
    """For each block the last decided one before it (step 1) or the next one after it (step -1), with only its own region between."""
    out: list[int | None] = [None] * len(labels)
    last = None
    for k in range(len(labels))[::step]:
        if 0 <= k - step < len(labels) and regions[k - step] != regions[k]:
            last = None
        out[k] = last
        if labels[k]:
            last = k
    return out


def second_pass(labels: list[int], regions: list[int], headings: list[bool]) -> list[int]:
    """The labels with undecided ones filled in."""
    before, after, out = _decided(labels, regions, 1), _decided(labels, regions, -1), []
    for k, label in enumerate(labels):
        near = [j for j in ((after[k],) if headings[k] else (before[k], after[k])) if j is not None]
        out.append(label or (max((-abs(j - k), labels[j]) for j in near)[1] if near else -1 if regions[k] in (PLAIN, BOILERPLATE) else 1))
    return out


def main_text(source: str | None) -> str:
    """The main text of one page."""
    page = _Page(source or "")
    blocks = page.blocks
    listed = any(b[3] in (PLAIN, SUSPECT) for b in blocks) and _listed(page)
    labels, regions = [_first_pass(*b, listed) for b in blocks], [b[3] for b in blocks]
    good = second_pass(labels, regions, [b[2] for b in blocks])
    return "\n\n".join(b[0] for b, x in zip(blocks, good) if x > 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = texts_for(named, ("page_id",)).mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return kinds_of(found, pages, {"page_id": id_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
