"""Operator 4: main text of pages through wrappers inferred per host as union-free regular expressions.

A page is read as a tree of block elements and text slots. In each element, neighbours of one kind become a
repeated group, and so do runs of two to four kinds that follow themselves. The expressions of a host's pages are then
aligned one after another: what both have is merged (texts that differ become slots), what one lacks becomes
optional. The result has no unions: an element is a sequence of items, each plain, optional, repeated or
both. Its text slots are labelled as main text or not by the elements around them and by what varies over the
host's pages, and pages are read by aligning them with their host's wrapper; what the alignment does not place
is judged by the elements around it alone, never dropped. Pages are aligned where they lie first, so that only
partial wrappers of a host move.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of HTML: elements dropped whole, elements without content, elements inside a line.
RAW = "script style template noscript iframe svg textarea select title object canvas math".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: An element of the first kind ends those of the second that are open in its list, table or block.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
#: Elements, and words in class, id or role, around text that is not main text.
ASIDE_TAGS = frozenset("head nav header footer aside form button menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adslot advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup share sharing "
    "social related recommended comments comment commentlist respond disqus replies pagination pager toolbar login search contentinfo complementary".split()
)
#: Words that stand beside those in a name without changing what it names (comment-list, ad-box), but not others (share-price).
NAME_WORDS = frozenset(
    "area bar block body bottom box btn button buttons column container content entry footer form group header icon icons inline inner item items "
    "left line link links list main menu module outer page pane panel post posts right row section site slot small tag text the title top unit wrap wrapper".split()
)
#: Elements and words that hold main text.
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset(("article", "main", "articlebody", "post", "entry", "story"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>|<(?P<raw>" + "|".join(RAW) + r")\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-z][\w:-]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<\Z",
    re.S | re.I,
)
ATTRS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SLOT, PARTIAL_HOSTS = "#", 2000
#: Bytes of wrappers up to which every task gets them all; beyond, pages and wrappers are joined by host.
SHARED_BYTES = 32 << 20
#: Labels of text slots: of a page without main elements, and inside main elements.
BODY, MAIN = 1, 2
#: Differing pages from which on a text they share is their host's.
FEW = 3
#: Elements nested deeper are dissolved in the one at this depth, but for a main element; asides there are left out.
DEPTH = 60


class Item:
    """An item of a wrapper: an element or group with its sequence, or a text slot (kind SLOT)."""

    __slots__ = ("kind", "optional", "repeated", "text", "items", "seen", "main")

    def __init__(self, kind: str, optional: bool = False, repeated: bool = False, text: int | None = None, items: list | None = None, seen: tuple = ()):
        self.seen = seen  # of a slot: digests of pages that have it, FEW at most
        self.kind, self.optional, self.repeated, self.text, self.items, self.main = kind, optional, repeated, text, items or [], 0

    def dump(self) -> list:
        return [self.kind, int(self.optional), int(self.repeated), self.text, [i.dump() for i in self.items], self.seen]

    @staticmethod
    def load(x: list) -> Item:
        return Item(x[0], bool(x[1]), bool(x[2]), x[3], [Item.load(i) for i in x[4]], tuple(x[5]))


class Element:
    """An element of a page; parts are Elements and texts (a list of pieces, at last a string)."""

    __slots__ = ("kind", "tag", "parts")

    def __init__(self, kind: str, tag: str):
        self.kind, self.tag, self.parts = kind, tag, []

    def add(self, text: str) -> None:
        if self.parts and isinstance(self.parts[-1], list):
            self.parts[-1].append(text)
        else:
            self.parts.append([text])


def parse(page: str) -> Element:
    """The tree of a page: block elements and texts, character references decoded, white space as one space.

    Elements inside a line are dissolved, comments and RAW elements left out; what ends too early ends at
    the end of the page.
    """
    root = Element("", "")
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # elements on the stack by tag, and those of main text
    mains = 0

    def shut(depth: int) -> None:
        nonlocal mains
        for e in stack[depth:]:
            opened[e.tag] -= 1
            mains -= _is_main(e.kind)
        del stack[depth:]
        if depth > DEPTH:
            stack[-1].add(" ")

    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].add(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            stack[-1].add(" ")
            continue
        words = "" if m["close"] or m["close2"] else _words(m["attrs"] or "")
        closes = m["close"] or m["close2"]
        if name in INLINE and not words and not (closes and stack[-1].tag == name):
            continue
        if closes:
            if opened[name]:
                shut(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == name))
            continue
        if stack[-1].tag == "p" and name not in INLINE:
            shut(len(stack) - 1)
        if name in ENDS and any(opened[tag] for tag in ENDS[name][0]):
            ended, within = ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in within:
                    break
                if stack[depth].tag in ended:
                    shut(depth)
                    break
        element = Element(f"{name}.{words}" if words else name, name)
        aside = _is_aside(element.kind, mains > 0)
        if len(stack) <= DEPTH or _is_main(element.kind) and not mains and not aside:
            stack[-1].parts.append(element)
        else:
            stack[-1].add(" ")
            if not aside:  # asides at this depth are left out, as nothing reads them
                element.parts = stack[-1].parts
        if name not in VOID:
            stack.append(element)
            opened[name] += 1
            mains += _is_main(element.kind)
    if at < len(page):
        stack[-1].add(html.unescape(page[at:]))
    _settle(root)
    return root


def _words(attrs: str) -> str:
    """The telling words of class, id and role, sorted."""
    if "=" not in attrs:
        return ""
    names = {n for m in ATTRS.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").lower().split()}
    found = set()
    for name in names:
        parts = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
        told = [w for w in parts if w in ASIDE_WORDS or w in MAIN_WORDS]
        if any(w in ASIDE_WORDS for w in told):  # an aside only if nothing else is named
            told = told if all(w in ASIDE_WORDS or w in NAME_WORDS for w in parts) else []
        found.update(told)
    return " ".join(sorted(found))


def _settle(root: Element) -> None:
    todo = [root]
    while todo:
        e = todo.pop()
        parts = [" ".join("".join(p).split()) if isinstance(p, list) else p for p in e.parts]
        e.parts = [p for p in parts if p]
        todo += [p for p in e.parts if isinstance(p, Element)]


def _about(kind: str) -> tuple[str, set[str]]:
    tag, _, words = kind.partition(".")
    return tag, set(words.split())


@lru_cache(1 << 14)
def _is_aside(kind: str, in_main: bool) -> bool:
    tag, words = _about(kind)
    return bool(words & ASIDE_WORDS) or tag in ASIDE_TAGS and not (tag == "header" and in_main)


@lru_cache(1 << 14)
def _is_main(kind: str) -> bool:
    tag, words = _about(kind)
    return tag in MAIN_TAGS or bool(words & MAIN_WORDS)


def digest(parts: list, inside: bool = False, start: int = 0) -> int:
    """A checksum of the texts and elements outside asides."""
    for p in parts:
        if isinstance(p, str):
            start = zlib.crc32(p.encode(), start)
        elif not _is_aside(p.kind, inside):
            start = zlib.crc32(b">", digest(p.parts, inside or _is_main(p.kind), zlib.crc32(f"<{p.kind}>".encode(), start)))
    return start


def expression(parts: list, page: int | None = None) -> list[tuple[Item, list]]:
    """The sequence of an element's parts as items, each with the parts it stands for.

    An element or slot stands for its repetitions; a group for a list of such sequences. page is the digest
    of the page; by default parts are all of it.
    """
    page = digest(parts) if page is None else page
    out: list[tuple[Item, list]] = []
    for p in parts:
        item = Item(SLOT, text=zlib.crc32(p.encode()), seen=(page,)) if isinstance(p, str) else Item(p.kind, items=[i for i, _ in expression(p.parts, page)])
        if out and out[-1][0].kind == item.kind:
            last, members = out[-1]
            merged = merge(last, item)
            merged.repeated = True
            out[-1] = (merged, [*members, p])
        else:
            out.append((item, [p]))
    for size in (2, 3, 4):
        at = 0
        while at + 2 * size <= len(out):
            kinds = [i.kind for i, _ in out]
            end = at + size
            while kinds[end : end + size] == kinds[at : at + size]:
                end += size
            if end > at + size:
                members = [[out[a + k] for k in range(size)] for a in range(at, end, size)]
                sequence = [i for i, _ in members[0]]
                for other in members[1:]:
                    sequence = align(sequence, [i for i, _ in other])
                group = Item("(" + "|".join(kinds[at : at + size]) + ")", repeated=True, items=sequence)
                out[at:end] = [(group, members)]
            at += 1
    return out


def merge(a: Item, b: Item) -> Item:
    seen = a.seen if len(a.seen) == FEW or a.seen == b.seen else (a.seen + tuple(p for p in b.seen if p not in a.seen))[:FEW]
    return Item(a.kind, a.optional or b.optional, a.repeated or b.repeated, a.text if a.text == b.text else None, align(a.items, b.items), seen)


def pairs(a: list[Item], b: list[Item]) -> list[tuple[int | None, int | None]]:
    """A longest common sequence of kinds: places in a and b, None for what the other lacks."""
    if [i.kind for i in a] == [i.kind for i in b]:
        return [(k, k) for k in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].kind == b[j].kind else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].kind == b[j].kind:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The union-free expression of both sequences."""
    out = []
    for i, j in pairs(a, b):
        if i is not None and j is not None:
            out.append(merge(a[i], b[j]))
        else:
            only = a[i] if j is None else b[j]
            out.append(Item(only.kind, True, only.repeated, only.text, only.items, only.seen))
    return out


def label(wrapper: list[Item], pages: int) -> None:
    """Mark the text slots of the body with BODY, of article and main elements with MAIN.

    Text beside such elements that is the same on FEW or more pages and all that have it is the host's, not
    the page's; pages count as different where their texts outside asides differ, so copies are one page.
    """

    def mark(items: list[Item], inside: bool) -> None:
        for i in items:
            if i.kind == SLOT:
                i.main = MAIN if inside else BODY if i.text is None or min(pages, len(i.seen)) < FEW else 0
            elif i.kind[0] == "(" or not _is_aside(i.kind, inside):
                mark(i.items, inside or _is_main(i.kind))

    mark(wrapper, False)


def main_text(page: str, wrapper: list[Item]) -> str:
    """The texts of a page in MAIN slots of a labelled wrapper, joined by one space; in BODY slots if it has none in MAIN."""
    out: list[tuple[int, str]] = []
    _read(expression(parse(page).parts, 0), wrapper, False, out)
    best = max((main for main, _ in out), default=MAIN)
    return " ".join(text for main, text in out if main == best)


def _read(own: list[tuple[Item, list]], wrapper: list[Item], inside: bool, out: list[tuple[int, str]]) -> None:
    """Add a page's texts with their labels; inside: of a main element."""
    match = {j: wrapper[i] for i, j in pairs(wrapper, [x for x, _ in own]) if i is not None and j is not None}
    for j, (item, members) in enumerate(own):
        held = match.get(j)
        if item.kind == SLOT:
            main = held.main if held is not None else MAIN if inside else BODY
            if main:
                out += [(main, m) for m in members]
        elif item.kind[0] == "(":
            for member in members:
                _read(member, held.items if held is not None else [], inside, out)
        elif not _is_aside(item.kind, inside):
            for member in members:
                _read(expression(member.parts, 0), held.items if held is not None else [], inside or _is_main(item.kind), out)


def host(url):
    """The host of a URL, lower-cased; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper) of pages(host, html): the expression of all of a host's pages, as JSON."""

    def emit(held: dict) -> pa.RecordBatch:
        rows = [(h, n, json.dumps([i.dump() for i in w])) for h, (n, w) in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["host", "pages", "wrapper"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, list[Item]]] = {}
        for batch in batches:
            for h, page in zip(batch.column(0), batch.column(1), strict=True):
                h, items = h.as_py(), [i for i, _ in expression(parse(page.as_py() or "").parts)]
                n, wrapper = held.get(h, (0, items))
                held[h] = (n + 1, align(wrapper, items) if n else items)
                if len(held) > PARTIAL_HOSTS:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, list[Item]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                items = [Item.load(x) for x in json.loads(row["wrapper"])]
                if held and row["host"] not in held:
                    yield emit(held)
                    held = {}
                n, wrapper = held.get(row["host"], (0, items))
                held[row["host"]] = (n + row["pages"], align(wrapper, items) if n else items)
        if held:
            yield emit(held)

    schema = "host string, pages long, wrapper string"
    parts = pages.select("host", "html").mapInArrow(partial, schema)
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(whole, schema)


def extract(pages: DataFrame, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """(page_id, url, text) of pages(page_id, url, html); text is empty where a page has no main text.

    Null html is empty. Pages without a host in their url share one wrapper. Repeated rows stay, other
    columns are ignored. Wrappers of up to shared_bytes in all go to every task, so pages do not move; beyond
    that they are joined by host, and Spark can split a frequent host in that join.
    """
    rows = pages.select("page_id", "url", F.col("html"), host(F.col("url").cast("string")).alias("host"))
    wrappers = written(infer_wrappers(rows), "wrappers")
    schema = ", ".join(f"{c} {t}" for c, t in pages.select("page_id", "url").dtypes) + ", text string"
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    shared = None
    if size <= shared_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: (r.pages, r.wrapper) for r in wrappers.toLocalIterator()})
        joined = rows.select("page_id", "url", "host", "html")
    else:
        joined = rows.join(wrappers, "host").select("page_id", "url", "host", "html", "pages", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Item]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, texts = batch.slice(at, 256), []
                hosts, html_ = part.column(2).to_pylist(), part.column(3).to_pylist()
                found = zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True) if shared is None else (shared.value[h] for h in hosts)
                for h, page, (n, wrapper) in zip(hosts, html_, found, strict=True):
                    if h not in known:
                        if len(known) > PARTIAL_HOSTS:
                            known.clear()
                        known[h] = [Item.load(x) for x in json.loads(wrapper)]
                        label(known[h], n)
                    texts.append(main_text(page or "", known[h]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, schema)
