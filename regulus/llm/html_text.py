"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block-level tags. The first pass decides
blocks from their stop-word density, length and link density, wherever they
stand; short ones that say little stay open. The second pass gives an open
block the label of the nearest decided neighbours. Elements and roles that hold
menus, forms and the like never become blocks. An element for main text is
believed only as far as the dense text of the page lies in it. Containers whose
class or id alone says that they hold something else are weighed by the density
of their text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import few
from regulus.llm.quality_rules import STOP_WORDS

#: A block of fewer characters is short; from so many on it is long.
SHORT, LONG = 70, 200
#: Densities that decide: links over all characters, stop words over all words. So many blocks of links in a row are a menu.
LINKS, STOPS, MENU = 0.5, 0.2, 2

#: Elements whose content is no text of the page (fixed values).
RAW = frozenset("script style noscript template svg math iframe object canvas video audio select textarea title".split())
#: Those that end at their end tag only; the others, where it is missing, end at the next block (fixed values).
SOLID = frozenset("script style textarea".split())
#: Those that hold blocks, or themselves, when they are in order (fixed values).
NESTING = frozenset("object noscript template".split())
#: Elements around the page's main text, and inside it (fixed values).
FURNITURE = frozenset("nav footer aside form button menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names and identifiers that mark what isn't main text (fixed values).
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices menu menus nav navbar navigation navigate "
    "sidebar sidebars breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay footer masthead header topbar widget widgets pagination pager skip toolbar".split()
)
#: Hints at what readers or sellers write, which may well read like main text (fixed values).
FOREIGN = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors cookie cookies consent gdpr comment comments commentlist disqus reply replies respond".split())
#: With one of these, a name tells about the page and not about what the element holds (fixed values).
STATES = frozenset("with without has have no not non open opened closed enabled disabled".split())
#: Words of class names that mark an element's header as part of the article (fixed values).
KEPT = frozenset("article post entry story content main body text".split())
#: Words that say what sort of box it is and nothing about what it holds (fixed values).
NEUTRAL = frozenset("list lists box boxes wrap wrapper container section area block inner outer holder panel group unit slot bar row col column item items link links icon icons thread form field top bottom left right first last main page site global primary secondary js".split())
#: Furniture that a main element inside it does not end; headings, whose links are no menu (fixed values).
SHUT = frozenset("aside footer dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
STOP = frozenset(STOP_WORDS)
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS | FURNITURE))})(?=[\s/>])", re.I)
IS_MAIN = re.compile(r"role\s*=\s*[\"']?main\b")


@dataclass
class Block:
    text: str
    inside: bool
    mark: tuple[int, bool] | None = field(default=None)  # the container that a name marks, and whether what it holds is foreign
    heading: bool = False
    label: bool | None = field(default=None)
    links: float = field(default=0.0)  # over all characters
    stops: float = field(default=0.0)  # over all words

    def measure(self, linked: int) -> None:
        self.links = linked / max(1, len(self.text) - self.text.count(" "))

    def __post_init__(self) -> None:
        words = self.text.lower().split()
        self.stops = sum(w.strip(".,;:!?\"'()") in STOP for w in words) / max(1, len(words))

    @property
    def menu(self) -> bool:
        return self.links >= LINKS and not self.heading

    @property
    def dense(self) -> bool:
        """It reads like main text by itself."""
        size = len(self.text)
        return self.links < LINKS and (size >= LONG or size >= SHORT and self.stops >= STOPS)


def furniture(name: str, attrs: str, inside: bool) -> bool:
    """The element holds something other than main text, as its kind, role or style says."""
    if name in FURNITURE or name == "header" and not inside:
        return True
    if not attrs or attrs.isspace():
        return False
    if re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "\"\"", attrs)):
        return True
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.strip().lower() in ROLES or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def hints(name: str, attrs: str, inside: bool) -> set[str]:
    """The words of an element's class and id that say it holds something other than main text.

    Inside main text a name counts only if it says nothing else: ``comment-list`` does, ``related-work`` doesn't.
    """
    found: set[str] = set()
    if name in MAIN or name in ("body", "html") or not attrs or IS_MAIN.search(attrs):
        return found
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id"):
            for one in (m[2] or m[3] or m[4] or "").split():
                words = {w.lower() for w in NAME_PARTS.findall(one)}
                if words & STATES or inside and (words - HINTS - NEUTRAL or words & KEPT and words & HINTS <= {"header", "banner"} or words & HINTS == {"header"}):
                    continue
                found |= words & HINTS
    return found


class Ends:
    """Where the content of elements that are no text of the page ends; each end tag is searched for once."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def tag(self, name: str, at: int) -> tuple[int, int] | None:
        """The next end tag of a name."""
        if name not in self.next or self.next[name] and self.next[name][0] < at:
            m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
            self.next[name] = m.span() if m else None
        return self.next[name]

    def after(self, name: str, at: int) -> int:
        over = self.tag(name, at)
        if name in SOLID:
            return over[1] if over else len(self.page)
        block = BLOCK_TAG.search(self.page, at)
        if over and block and name not in NESTING and block.start() < over[0]:
            again = re.compile(rf"<{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at, over[0])
            if again and block.start() < again.start():
                over = None  # it ends another one
        return over[1] if over else block.start() if block else at


@dataclass
class Open:
    """An element that is open: whether it is furniture, whether it is main, and what marks it."""

    name: str
    bad: bool
    good: bool
    mark: tuple[int, bool] | None


class Stack:
    """The open elements; finding one by name, and closing, take time in proportion to what is closed."""

    def __init__(self):
        self.all: list[Open] = []
        self.named: dict[str, list[int]] = {}
        self.bad: list[int] = []
        self.main = self.shut = 0

    def push(self, x: Open) -> None:
        self.named.setdefault(x.name, []).append(len(self.all))
        if x.bad:
            self.bad.append(len(self.all))
            self.shut += x.name in SHUT
        self.main += x.good
        self.all.append(x)

    def close(self, k: int) -> None:
        """Ends the elements from place k on."""
        while len(self.all) > k:
            x = self.all.pop()
            self.named[x.name].pop()
            if x.bad:
                self.bad.pop()
                self.shut -= x.name in SHUT
            self.main -= x.good

    def last(self, name: str) -> int | None:
        at = self.named.get(name)
        return at[-1] if at else None


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without furniture."""
    found: list[Block] = []
    stack, ends = Stack(), Ends(page)
    text: list[str] = []
    linked: dict[int, int] = {}  # characters in links, by block
    link: dict[int, int] | None = None  # those of the link that is open
    at = marks = 0

    def flush() -> None:
        said = " ".join("".join(text).split())
        if said:
            top = stack.all[-1] if stack.all else None
            found.append(Block(said, stack.main > 0, top.mark if top else None, bool(top) and top.name in HEADINGS))
        text.clear()

    def say(a: int, b: int) -> None:
        if a < b and not stack.bad:
            said = unescape(page[a:b])
            text.append(said)
            if link is not None and (n := len("".join(said.split()))):
                link[len(found)] = link.get(len(found), 0) + n

    def unlink(whole: bool) -> None:
        """Ends the open link; one without an end tag goes no further than the block it began in."""
        nonlocal link
        for block, n in list((link or {}).items())[: None if whole else 1]:
            linked[block] = linked.get(block, 0) + n
        link = None

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            say(at, end)
            break
        say(at, m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name == "a":
                unlink(True)
            elif name in BLOCKS or name in FURNITURE:
                flush()
                k = stack.last(name)
                if k is not None:
                    stack.close(k)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not attrs.endswith("/"):
                at = ends.after(name, at)
            continue
        if name == "a":
            unlink(False)
            link = {len(found): 0}
        if name == "br" and not stack.bad:
            text.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS or name in FURNITURE:
            flush()
            if name in MAIN:
                unlink(False)
            top = stack.all[-1].name if stack.all else ""
            if top == "p" or top == name and name in ("li", "td", "th", "tr", "dt", "dd"):
                stack.close(len(stack.all) - 1)
            inside = stack.main > 0
            bad, hint = furniture(name, attrs, inside), hints(name, attrs, inside)
            good = name in MAIN and not bad or bool(IS_MAIN.search(attrs))
            if good and stack.bad and not inside and not stack.shut:
                stack.close(stack.bad[0])  # furniture that was never closed
            mark = stack.all[-1].mark if stack.all and (stack.main or not good) else None
            if hint and not mark:
                marks += 1
                mark = marks, bool(hint & FOREIGN)
            stack.push(Open(name, bad, good, mark))
    flush()
    unlink(False)
    for i, n in linked.items():
        if i < len(found):
            found[i].measure(n)
    return found


def weighed(all_blocks: list[Block]) -> list[Block]:
    """Without containers that a name marks, unless their text is dense.

    Inside main text, density is enough; elsewhere it must outweigh that of the
    page around it. What readers and sellers write reads like main text, so a
    name that says this counts unless there is no other text.
    """
    said: dict[tuple[int, bool] | None, int] = {None: 0}
    dense: dict[tuple[int, bool] | None, int] = {None: 0}
    inside: dict[tuple[int, bool] | None, bool] = {None: True}
    for b in all_blocks:
        said[b.mark] = said.get(b.mark, 0) + len(b.text)
        dense[b.mark] = dense.get(b.mark, 0) + len(b.text) * b.dense
        inside[b.mark] = b.inside and inside.get(b.mark, True)
    kept = {m for m in said if m is None or 2 * dense[m] > said[m] and not m[1] and (inside[m] or dense[m] > dense[None])}
    if kept == {None} and not said[None]:
        kept = {m for m in said if m is None or 2 * dense[m] > said[m]}
    return [b for b in all_blocks if b.mark in kept]


def first_pass(all_blocks: list[Block]) -> None:
    """Decides what can be decided of a block from its densities and its length.

    Blocks of links in a row are a menu, inside main text as well. Where most of
    the page's dense text lies in main elements, the rest of the page is not
    main text.
    """
    held = sum(len(b.text) for b in all_blocks if b.dense and b.inside)
    elsewhere = sum(len(b.text) for b in all_blocks if b.dense and not b.inside)
    marked = any(b.inside for b in all_blocks) and held >= elsewhere
    last = max((i for i, b in enumerate(all_blocks) if b.dense), default=-1)
    run: list[Block] = []
    for b in [*all_blocks, None]:
        if b is not None and b.menu:
            run.append(b)
            continue
        if len(run) >= MENU:
            for x in run:
                x.label = False
        run = []
    for i, b in enumerate(all_blocks):
        size = len(b.text)
        if marked and not b.inside:
            b.label = False
        elif b.label is None and not (b.inside and marked) and b.menu:
            b.label = False
        elif b.label is None and not b.menu:
            if b.dense or b.inside and marked and size >= SHORT:
                b.label = True
            elif not b.inside and i > last and "©" in b.text:  # a short line after all that is dense
                b.label = False


def second_pass(all_blocks: list[Block]) -> None:
    """Open blocks inherit from the nearest decided ones, on both sides, of the same part of the page; headings rather from what follows.

    A menu inside main text says nothing about what stands beside it.
    """
    decided = [None if b.menu and b.inside else b.label for b in all_blocks]
    n = len(all_blocks)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[bool, tuple[int, bool]] = {}
        for i in order:
            side[i] = last.get(all_blocks[i].inside)
            if decided[i] is not None:
                last[all_blocks[i].inside] = (i, decided[i])
    for i, b in enumerate(all_blocks):
        if b.label is None:
            near = [(abs(i - x[0]), x[1]) for x in (before[i], after[i]) if x]
            least = min((d for d, _ in near), default=0)
            labels = {v for d, v in near if d == least}
            b.label = labels.pop() if len(labels) == 1 else True if not labels else after[i][1] if b.heading else b.inside


def decided(page: str | None) -> list[Block]:
    """The blocks of a page with their labels."""
    found = weighed(blocks(page or ""))
    first_pass(found)
    second_pass(found)
    return found


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in decided(page) if b.label)


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for each row of pages.

    A null page is an empty one, whose text is empty; broken mark-up is read as
    far as it goes, and very long or deeply nested pages in time that grows with
    their length; rows that repeat come back as often and null ids stay null;
    other columns are not looked at; an empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def each(batches):
        for b in few(batches):
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(each, f"page_id {rows.schema[0].dataType.simpleString()}, url {rows.schema[1].dataType.simpleString()}, text string, n_chars long")
