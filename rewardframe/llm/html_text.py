"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block elements. Elements whose tag, class, id or role says furniture (menus,
page headers, footers, sidebars, notices, adverts, forms, reader comments) are boilerplate from the
start, unless the text speaks against the name: an element that holds most of the page's dense text (of all, or of that outside elements so named) is
no furniture if only a part of a name says so, or if it also holds a main element or the page's h1, or if
nothing else of the page is left. Comments are overruled only in the last case, by nothing else. A header beside
the paragraphs of its own element is that text's. Headings, sections and forms are not judged by their
ids, which name what they are about. Main elements are those whose tag or exact name says so.

Pass one decides the other blocks by length, link density and stop-word density: good, bad
or open. Bad are blocks of links, and outside main elements also short blocks of notable link
density, and long ones of hardly any stop words where the page has others of many (a language
without known stop words rejects nothing). Pass two lets open blocks inherit the label, good or bad,
of the nearest decided neighbour of the same region, the one before it at equal distance, and
headings that of the next; short text that stands in a div by itself, outside main elements, is good
between good neighbours only. Each main element with good text is a region (any with text, where the
page has no good text), and all else is one. Without any decided neighbour open blocks are kept,
except outside main elements where the page has such a region.

Good blocks are joined in page order by a line feed; white space inside a block becomes one space,
and character references are decoded. Nothing else is dropped or cut.

Defined results: a null or empty page gives an empty text; unclosed elements end with their parent
or the page, end tags without a start say nothing; a page cut off inside a tag, comment or script ends
there; time is linear in the page's length; tables may be empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardframe.llm.quality import STOP

SHORT = 70
LINKED, NOTABLE, DENSE, SPARSE = 0.5, 0.2, 0.2, 0.1

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object select textarea button canvas audio video".split())
RAW = frozenset("script style textarea title".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
# Words of class, id and role that mark furniture and main elements.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar rail nav navbar navigation "
    "menu menus breadcrumb breadcrumbs pagination pager footer foot masthead comment comments commentlist disqus reply replies "
    "respond social share sharing related recommended widget widgets toolbar search copyright disclaimer complementary contentinfo "
    "byads".split()
)
HEADERS = frozenset("header banner topbar masthead".split())
#: Of those, the words of reader comments.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Elements whose ids name their subject.
TITLED = HEADINGS | frozenset("html body form section article main".split())
MAINS = frozenset("main article".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Holder:
    """An element that its tag or names call furniture: the one around it, whether an exact name or the tag
    says so, whether it is of comments, whether a main element or an h1 is in it, the element
    around it if it is a header."""

    around: int
    exact: bool
    comments: bool
    beside: int
    central: bool = False


@dataclass(slots=True)
class Block:
    """``holder``: the innermost holder's number, from 1; ``home``: the element around the block's own;
    ``loose``: whether the text stands in a div, not in a paragraph, heading, item or cell."""

    text: str
    linked: int
    main: int
    holder: int
    home: int
    loose: bool
    item: bool
    heading: bool
    furniture: bool = False
    label: str = ""


def _parts(names: list[str]) -> set[str]:
    """First and last parts of compound names, without what these say they have or have not."""
    parts = set()
    for name in names:
        of = re.split(r"[-_]+", name)
        of = of[: next((i for i, w in enumerate(of) if w in ("with", "has", "no", "not")), len(of))]
        if of:
            parts |= {of[0], of[-1]}
    return parts


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[str, bool]:
    """What an element is: unseen, furniture, side (furniture by a part of a name), main or plain; and
    whether it is of comments."""
    given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    if tag in UNSEEN or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or NO_DISPLAY.search(given.get("style", "")):
        return "unseen", False
    names: list[str] = []
    parts: set[str] = set()
    if given and tag not in ("html", "body"):
        telling = given if tag not in TITLED else {k: v for k, v in given.items() if k != "id"}
        names = " ".join(telling.get(k, "") for k in ("class", "id", "role")).lower().split()
        marked = MARKED if in_main else MARKED | HEADERS
        parts = marked & _parts(names)
        names += given.get("id", "").lower().split() if tag not in HEADINGS else []
        exact = marked.intersection(names)
        if exact or parts:
            return "furniture" if exact or tag in FURNITURE else "side", not COMMENTS.isdisjoint(exact | parts)
    if tag in FURNITURE or (tag == "header" and not in_main):
        return "furniture", False
    return "main" if tag in MAINS or not MAINS.isdisjoint(names) else "plain", False


class Reader:
    """Open elements while a page is read, each as (tag, kind, number)."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.holders: list[Holder] = [Holder(0, False, False, 0)]
        self.stack: list[tuple[str, str, int]] = []
        self.places: dict[str, list[int]] = {}  # of each tag in the stack
        self.of_blocks: list[int] = []  # places of block elements in the stack
        self.held: list[int] = []
        self.pieces: list[str] = []
        self.linked = self.links = self.unseen = self.main = self.region = self.opened = 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                at = self.of_blocks[-1] if self.of_blocks else -1
                own = self.stack[at][0] if self.of_blocks else "body"
                near = [t for t, *_ in self.stack[-2:]]
                home = self.stack[at - 1][2] if at > 0 else 0
                self.blocks.append(Block(
                    text, self.linked, self.region if self.main else 0, self.held[-1] if self.held else 0, home, own == "div",
                    "li" in near, not HEADINGS.isdisjoint(near),
                ))
        self.pieces, self.linked = [], 0

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, kind, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.of_blocks.pop()
            self.links -= tag == "a"
            self.unseen -= kind == "unseen"
            self.main -= kind == "main"
            if kind in ("furniture", "side"):
                self.held.pop()

    def end(self, tag: str) -> None:
        """An end tag: closes the last such element, but an inline one no block."""
        places = self.places.get(tag)
        if places and (tag in BLOCKS or not self.of_blocks or places[-1] > self.of_blocks[-1]):
            self.close(places[-1])

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS and self.of_blocks:
            # a paragraph and the inline elements in it end where a block begins
            last = self.stack[self.of_blocks[-1]][0]
            if last == "p" or last in CLOSES.get(tag, ()):
                self.close(self.of_blocks[-1])
        kind, comments = _kind(tag, attributes, self.main > 0)
        around = self.held[-1] if self.held else 0
        if (kind == "main" or tag == "h1") and not self.unseen:
            while around and not self.holders[around].central:
                self.holders[around].central = True
                around = self.holders[around].around
        self.opened += 1
        if kind in ("furniture", "side"):
            beside = self.stack[-1][2] if tag == "header" and self.stack and self.stack[-1][0] not in ("html", "body") else 0
            self.holders.append(Holder(self.held[-1] if self.held else 0, kind == "furniture", comments, beside))
            self.held.append(len(self.holders) - 1)
        elif kind == "main":
            self.region, self.main = self.region if self.main else self.opened, self.main + 1
        self.links += tag == "a"
        self.unseen += kind == "unseen"
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.of_blocks.append(len(self.stack))
        self.stack.append((tag, kind, self.opened))


def blocks_of(page: str) -> tuple[list[Block], list[Holder]]:
    reader = Reader()
    position, end = 0, len(page)
    while position < end:
        token = TOKEN.search(page, position)
        stop = token.start() if token else end
        if stop > position and not reader.unseen:
            piece = page[position:stop]
            reader.pieces.append(piece)
            if reader.links:
                reader.linked += len(piece.strip())
        if token is None:
            break
        position = token.end()
        tag = token[2] or token[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), token[1] or token[4], token[3] or token[6] or ""
        if tag in BLOCKS:
            reader.flush()
        elif tag == "br":
            reader.pieces.append(" ")
        if closing:
            reader.end(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        reader.start(tag, attributes)
        if tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, position)
            position = over.end() if over else end
            reader.close(len(reader.stack) - 1)
    reader.flush()
    return reader.blocks, reader.holders


def _stops(text: str) -> float:
    """Share of stop words; that of a text without letters is 0."""
    words = LETTERS.findall(text.lower())
    return sum(w.encode() in STOP for w in words) / max(1, len(words))


def _judge_holders(blocks: list[Block], holders: list[Holder]) -> None:
    """Say which blocks are furniture: those in a holder whose name the text does not overrule."""
    long = [b for b in blocks if len(b.text) >= SHORT and b.linked <= NOTABLE * len(b.text)]
    prose = [b for b in long if _stops(b.text) >= DENSE] or long
    homes = {b.home for b in prose}
    named = [False] * len(holders)  # in a holder of an exact name; outer ones come before inner ones
    for i, h in enumerate(holders[1:], 1):
        named[i] = h.exact or named[h.around]
    sizes, outside, texts = ([0] * len(holders) for _ in range(3))
    for b in prose:
        sizes[b.holder] += len(b.text)
        outside[b.holder] += 0 if named[b.holder] else len(b.text)
    for b in blocks:
        texts[b.holder] += len(b.text)
    for i in range(len(holders) - 1, 0, -1):
        sizes[holders[i].around] += sizes[i]
        outside[holders[i].around] += outside[i]

    def bad(alone: bool) -> list[bool]:
        out = [False] * len(holders)
        for i, h in enumerate(holders[1:], 1):
            most = 2 * sizes[i] > sizes[0] or 2 * outside[i] > outside[0]
            spared = most and (not h.exact or h.central) and not h.comments or h.beside in homes and h.beside > 0
            out[i] = out[h.around] or not (spared or alone and most)
        return out

    judged = bad(False)
    if not any(t for t, x in zip(texts, judged) if not x):
        judged = bad(True)  # nothing would be left
    for b in blocks:
        b.furniture = judged[b.holder]


def decide(blocks: list[Block], holders: list[Holder]) -> list[Block]:
    """Label the blocks good or bad, in two passes."""
    if len(holders) > 1:
        _judge_holders(blocks, holders)
    for b in blocks:
        link_density = b.linked / len(b.text)
        if b.furniture:
            b.label = "bad"
        elif link_density > LINKED and (b.item or not b.main):
            b.label, b.furniture = "bad", b.main > 0  # a menu, whatever it is called
        elif not b.main and b.text.startswith(("©", "(c) ", "Copyright ")):
            b.label = "bad"
        elif len(b.text) < SHORT:
            b.label = "bad" if link_density > NOTABLE and not b.main else "open"
        else:
            stops = _stops(b.text)
            b.label = "good" if stops >= DENSE else "sparse" if stops < SPARSE and not b.main else "open"
    dense = any(b.label == "good" for b in blocks)
    for b in blocks:
        if b.label == "sparse":
            b.label = "bad" if dense else "open"
    mains = {b.main for b in blocks if b.main and (b.label == "good" if dense else not b.furniture)}
    regions = [b.main if b.main in mains else 0 for b in blocks]
    decided = [i for i, b in enumerate(blocks) if b.label != "open" and not b.furniture]
    labels = {i: blocks[i].label for i in decided}
    at = 0
    for i, b in enumerate(blocks):
        if b.label != "open":
            continue
        while at < len(decided) and decided[at] < i:
            at += 1
        before = [j for j in decided[max(0, at - 1) : at] if regions[j] == regions[i]]
        after = [j for j in decided[at : at + 1] if regions[j] == regions[i]]
        near = min((after if b.heading else []) or before + after, key=lambda j: abs(i - j), default=None)
        if near is not None and b.loose and not b.main and len(b.text) < SHORT and {labels[j] for j in before} != {labels[j] for j in after}:
            b.label = "bad"
            continue
        b.label = labels[near] if near is not None else "good" if b.main or not mains else "bad"
    return blocks


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text of a page, its number of blocks, and how many of them are in the text."""
    blocks = decide(*blocks_of(page or ""))
    good = [b.text for b in blocks if b.label == "good"]
    return "\n".join(good), len(blocks), len(good)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_blocks, n_kept of every row of ``pages`` (page_id, url, html)."""
    narrow = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(p.as_py()) for p in batch.column("html")]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_blocks", "n_kept"]
            )

    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks int, n_kept int")


def op3_extract(pages: DataFrame) -> DataFrame:
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
