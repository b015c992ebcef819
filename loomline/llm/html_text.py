"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by their text: link density, length and
stop-word density; blocks too short or too poor in stop words to tell are left open. In the second pass open blocks take
the label of their nearest decided neighbours, beyond a page's ends lies nothing good.

Marks are priors. An ``article`` (the one with most good text), else a ``main``, narrows the page to its blocks if it holds
a fair part of the good text; within it poverty in stop words leaves a block open, no more. Menus, forms, footers, asides
and containers named as such are furniture; one whose name only holds such a word, as in "related-work", counts where it
has a long block of prose, and else gives headings and longer blocks.

Stop words are known for English, German, French and Spanish. Where they can't judge, length and link density alone
decide: in blocks of another script, and in pages of which prose in these languages is less than a quarter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title template noscript iframe svg math select".split())
#: Raw up to the page's end where they aren't closed; the others are then ordinary tags.
OPEN_RAW_TAGS = frozenset("script style textarea title".split())
DROPPED_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words in class or id, and roles, of what isn't main text.
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent"
    " gdpr notice alert newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs masthead header footer comment comments reply replies respond disqus share sharing social"
    " related recommended recommendations widget widgets toolbar pager pagination login search copyright skip".split()
)
NOT_HINTS = frozenset("with has no without layout wrapper page".split())
# What stands beside a hint in the names of such containers.
FURNITURE = frozenset(
    "area articles bar block blocks body bottom box btn button buttons container content count div entry form group icon"
    " icons inner item items left link links list main meta news outer posts right section site slot stories title top"
    " this unit us wrap your".split()
)
# Hints that hardly are the topic of a section.
SURE_HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter"
    " subscribe popup modal overlay comment comments reply replies respond disqus".split()
)
# Hints that in an article name parts of it as well.
WEAK_HINTS = frozenset("header footer banner search login notice alert copyright skip toolbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())

# Frequent function words.
STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the"
    " their there they this to was we were which will with you",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist"
    " mit nicht noch nur oder sich sie sind so über um und von vor war was wie wird zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur mais ne nous on ou par"
    " pas pour qu que qui sa se ses son sur un une vous",
    "es": "a al como con de del el ella en entre es esta este fue ha la las le lo los más me mi no o para pero por que se"
    " ser si sin son su sus un una uno y ya",
}
STOP = [frozenset(v.split()) for v in STOP_WORDS.values()]

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.30
LINK_MAX = 0.5
KNOWN_MIN = 0.25
#: A marked article counts if it holds this share of the page's good text.
ARTICLE_MIN = 0.3
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)

RAW_END = {tag: re.compile(f"</{tag}\\b[^>]*>", re.I) for tag in RAW_TAGS}
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD_CUT = re.compile(r"[\W_]+|(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]+")
NOT_LATIN = re.compile("[^\\W\\d_A-Za-z\u00aa-\u024f\u1e00-\u1eff]")
WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    tag: str
    dropped: bool
    article: int  # number of the outermost article, 0 outside
    main: int  # likewise of a main element
    chunks: list[str] = field(default_factory=list)
    linked: int = 0
    doubt: int = 0
    text: str = ""
    label: str = ""
    density: float | None = None

    @property
    def in_article(self) -> bool:
        return bool(self.article or self.main)


@dataclass
class Frame:
    tag: str
    dropped: bool
    hinted: bool
    article: int
    main: int
    doubt: int = 0

    @property
    def in_article(self) -> bool:
        return bool(self.article or self.main)


def _hinted(attributes: str, tag: str = "", in_article: bool = False) -> tuple[bool, bool, bool]:
    """(hidden or not main text by class, id or role; hidden in any case; perhaps not main text)"""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    style = got.get("style", "").replace(" ", "").lower()
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return True, True, False
    if got.get("role", "").lower() in ROLES:
        return True, False, False
    doubt = False
    for kind in ("class", "id"):
        if kind == "id" and (tag in HEADINGS or tag in ARTICLE_TAGS):
            continue  # an anchor, named by what the text is on
        for name in got.get(kind, "").split():
            words = {w.lower() for w in WORD_CUT.split(name) if w and not w.isdigit()}
            if words & HINTS and not words & NOT_HINTS:
                whole = words <= HINTS | FURNITURE
                sure = bool(words & SURE_HINTS)
                if tag in HEADINGS or tag in ARTICLE_TAGS:
                    hinted = whole
                elif in_article:
                    hinted = whole and (sure or kind == "class" and bool(words & HINTS - WEAK_HINTS))
                else:
                    hinted = whole or sure
                if hinted:
                    return True, False, False
                doubt = doubt or whole or sure or not in_article or bool(words & {"header", "footer"})
    return False, False, doubt


def blocks(html: str) -> list[Block]:
    """Blocks that hold text, in page order."""
    out: list[Block] = []
    stack = [Frame("", False, False, 0, 0)]
    links = doubts = marks = 0
    now = Block("", False, 0, 0)

    def cut(tag: str) -> Block:
        if now.chunks:
            now.text = " ".join("".join(now.chunks).split())
            if now.text:
                out.append(now)
        top = stack[-1]
        return Block(tag, top.dropped or top.hinted, top.article, top.main, doubt=top.doubt)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        text = html[at:] if lt < 0 else html[at:lt]
        if text:
            text = unescape(text) if "&" in text else text
            now.chunks.append(text)
            if links:
                now.linked += len("".join(text.split()))
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            if lt + 1 < n and (html[lt + 1].isalpha() or html[lt + 1] == "/"):
                break  # a tag that the page's end cuts off
            now.chunks.append("<")
            at = lt + 1
            continue
        at, tag, closing = m.end(), m[1].lower(), html[lt + 1] == "/"
        if tag in RAW_TAGS:
            if not closing and not m[2].endswith("/"):
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else n if tag in OPEN_RAW_TAGS else at
            continue
        if tag == "br":
            now.chunks.append("\n")
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag in BLOCK_TAGS or not closing and tag not in VOID_TAGS and m[2].strip(" /") and _hinted(m[2], tag, stack[-1].in_article)[0]:
            links = 0 if tag in BLOCK_TAGS else links
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                now = cut(stack[-1].tag)
            elif tag in VOID_TAGS:
                now = cut(stack[-1].tag)
            else:
                top = stack[-1]
                if tag == "p" or tag == "li" and top.tag in ("p", "li") or tag in HEADINGS and top.tag == "p":
                    while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag == tag == "li"):
                        stack.pop()
                    top = stack[-1]
                hinted = hidden = doubt = False
                if m[2].strip(" /") and tag not in ("html", "body"):
                    hinted, hidden, doubt = _hinted(m[2], tag, top.in_article)
                article = tag in ARTICLE_TAGS
                marks += article
                doubts += doubt
                frame = Frame(
                    tag,
                    top.dropped or hidden or tag in DROPPED_TAGS or tag == "header" and not top.in_article,
                    # an article within a container with a misleading name counts as one
                    (top.hinted and not article) or (hinted and tag != "main"),
                    top.article or (marks if tag == "article" else 0),
                    top.main or (marks if tag == "main" else 0),
                    0 if article else top.doubt or (doubts if doubt else 0),
                )
                stack.append(frame)
                now = cut(tag)
        elif closing and len(stack) > 1 and stack[-1].tag == tag:
            stack.pop()
            now = cut(stack[-1].tag)
    cut("")
    return out


def stop_density(text: str) -> float:
    """The largest share, over the languages, of words that are stop words."""
    words = [w.lower() for w in LETTERS.findall(text)]
    return max((sum(w in s for w in words) for s in STOP), default=0) / len(words) if words else 0.0


def width(text: str) -> int:
    """Length in characters; those of Chinese, Japanese and Korean count twice."""
    return len(text) if text.isascii() else len(text) + len(WIDE.findall(text))


def in_other_script(text: str) -> bool:
    return not text.isascii() and 2 * len(NOT_LATIN.findall(text)) > sum(map(len, LETTERS.findall(text)))


def full_of_links(block: Block) -> bool:
    return block.linked > 0 and block.linked > LINK_MAX * len(block.text.replace(" ", ""))


def in_known_language(found: list[Block]) -> bool:
    """Whether prose in a language with stop words is a fair part of the long blocks."""
    known = every = 0
    for b in found:
        if not b.dropped and len(b.text) >= LENGTH_LOW and not full_of_links(b):
            b.density = stop_density(b.text)
            every += len(b.text)
            known += len(b.text) if b.density >= STOP_HIGH else 0
    return known >= KNOWN_MIN * every


def judge(block: Block, known: bool = True, marked: bool = False) -> str:
    """good, bad, or what the second pass settles: near (long, or long enough with some stop words) and short.

    In a ``marked`` article only links make a block bad."""
    if full_of_links(block):
        return "bad"
    size = width(block.text)
    if not marked and size <= LENGTH_HIGH and RIGHTS.match(block.text):
        return "bad"
    if size < LENGTH_LOW:
        return "short"
    density = stop_density(block.text) if block.density is None else block.density
    if density >= STOP_HIGH or not known or in_other_script(block.text):
        return "good" if size > LENGTH_HIGH or marked else "near"
    return "near" if density >= STOP_LOW or marked else "bad"


def settle(found: list[Block], ends: str) -> None:
    """Second pass: an open block takes the label of the nearest decided blocks before and after it; ``ends`` lies beyond
    both ends. Where the two differ, a near block and a heading before a good one are good, and all are within good ends;
    else a short block goes with the nearer, at equal distance with the good one if that has its tag."""
    labels, n = [b.label for b in found], len(found)
    before, after, last = [-1] * n, [n] * n, -1
    for i, x in enumerate(labels):
        before[i] = last
        last = i if x in ("good", "bad") else last
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in ("good", "bad") else last
    for i, b in enumerate(found):
        if labels[i] not in ("near", "short"):
            continue
        j, k = before[i], after[i]
        low, high = (labels[j] if j >= 0 else ends), (labels[k] if k < n else ends)
        if low == high:
            b.label = low
        elif ends == "good" or labels[i] == "near" or b.tag in HEADINGS and high == "good":
            b.label = "good"
        elif i - j != k - i:
            b.label = low if i - j < k - i else high
        else:
            b.label = "good" if found[j if low == "good" else k].tag == b.tag else "bad"


def label(found: list[Block], marked: bool) -> list[Block]:
    """Both passes; blocks of doubtful containers without prose are left out. With no good block all open ones are."""
    known = in_known_language(found)
    for b in found:
        b.label = judge(b, known, marked)
    if any(b.doubt for b in found):
        prose = {b.doubt for b in found if b.label == "good" and width(b.text) > LENGTH_HIGH}
        found = [b for b in found if not b.doubt or b.doubt in prose or b.label in ("good", "near") or b.tag in HEADINGS]
    undecided = [b for b in found if b.label in ("near", "short")]
    settle(found, "good" if marked else "bad")
    if not any(b.label == "good" for b in found):
        for b in undecided:
            b.label = "good"
    return found


def good_length(found: list[Block]) -> int:
    return sum(len(b.text) for b in found if b.label == "good")


def scoped(page: list[Block]) -> tuple[list[Block], bool]:
    """(the blocks that may be main text, whether a mark chose them). ``page`` has its labels.

    The article with most good text (of all: most text), else the like main element, if it holds at least
    ``ARTICLE_MIN`` of the good text; else all blocks but those of articles.
    """
    for mark in ("article", "main"):
        parts: dict[int, list[Block]] = {}
        for b in page:
            if number := getattr(b, mark):
                parts.setdefault(number, []).append(b)
        if parts:
            best = max(parts.values(), key=lambda p: (good_length(p), sum(len(b.text) for b in p)))
            rest = [b for b in page if not b.article]
            if mark == "main" or good_length(best) >= ARTICLE_MIN * (good_length(best) + good_length(rest)):
                return best, True
            page = rest
    return page, False


def labelled(html: str) -> list[Block]:
    """The blocks that may be main text, each labelled good or bad."""
    page = [b for b in blocks(html) if not b.dropped]
    found = label(page, False)
    scope, marked = scoped(page)
    return label(scope, marked) if marked or len(scope) < len(page) else found


def main_text(html: str | None) -> str:
    """The main text of a whole page: its good blocks, joined by one space. Null and empty pages have none."""
    return " ".join(b.text for b in labelled(html or "") if b.label == "good")


def extract(
    pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), slice_rows: int = 256
) -> DataFrame:
    """``keep``, text and n_chars (code points) for every page, whole. A null page is an empty one: an empty text.

    Pages are handled one by one: repeated rows and null ids stay; other columns don't enter the result. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), slice_rows):
                texts = [main_text(x.as_py()) for x in batch.column("__html").slice(i, slice_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(i, slice_rows) for k in range(len(keep))),
                        pa.array(texts, pa.string()),
                        pa.array(map(len, texts), pa.int64()),
                    ],
                    names=[*keep, "text", "n_chars"],
                )

    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
