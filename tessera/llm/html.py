"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over the tokens of a host's pages: elements in order,
each once, optional or repeated, with constant texts and text slots. It is inferred from all of the
host's pages: each page's token stream, with runs of like elements folded into repeats, has an outline;
the different outlines are aligned with each other, group by group and level by level. Where they differ,
an element that one side lacks becomes optional, and one that stands several times becomes a repeat. Each
page's texts are then counted at their places in the wrapper; where they differ, the place is a slot.

The main text of a page stands in all its articles and mains (the outermost ones, in page order), else
in its body. The wrapper says what is left out there:

- Constant texts: the wrapper tells which texts may be constant, as they are no slots; all pages of the
  host are then read along it, and those are constant that most of its different pages have.
- On hosts without articles, side groups: going down from the body into the element whose slots hold most
  text, the groups beside it (varying menus, link lists, sidebars) unless they hold the title, and, in the
  element where that ends, groups of repeated records of several slots below the text (reader comments).

Elements that are boilerplate by their nature (navigation, forms, scripts, comments, adverts ...) give no
text anywhere.

All of it takes time in proportion to a page: the scanner reads each character once, streams too long for a
table are aligned at their unique elements, and elements nested deeper than DEPTH count as parts of the one there.

Edge cases: a null or empty page has no text; a null url is a host of its own; markup that is cut off or badly nested is
read as far as it goes; of texts that stand equally often in a place none is constant; repeated rows all come out; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sliced
from tessera.shared import materialize

#: Outlines that one task aligns with each other; more of a host are aligned in groups first.
MERGED = 256
#: A text is constant if this share of the host's different pages has it. Fewer pages than PAGES do not
#: tell template from content: two versions of one page share both.
CONSTANT, PAGES = 0.8, 3
#: The share of the slots' text that an element holds to be gone into.
DOMINANT = 0.6
#: Elements nested deeper count as part of the one at this depth; tables of an alignment have so many cells at most.
DEPTH, CELLS = 100, 250_000
#: After so many tags whose quotes never close, quotes are no longer looked at on a page.
UNCLOSED = 16

# Elements without main text, elements that hold a page's main text, and inline elements.
SKIPPED = frozenset("head script style template noscript iframe object svg math canvas audio video nav footer aside form button select textarea input dialog menu".split())
HOLDERS = ("article", "main")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
# Words in a class or id, and roles, that mark boilerplate.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation
    breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
    subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies reply widget
    widgets toolbar pagination pager""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Elements that lay out a page, and with lists, those that group texts.
LAYOUT = frozenset("html body div section center table tbody tr td".split())
GROUPS = LAYOUT | frozenset("ul ol dl".split())
# Elements whose start ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"'>]+)""")


@dataclass
class Element:
    """An element with the block-level elements and texts in it; inline elements are dissolved in the texts."""

    name: str
    mark: str = ""
    boilerplate: bool = False
    children: list[Element | str] = field(default_factory=list)
    #: Boilerplate by no more than a word of its class or id.
    marked: bool = False


def _mark(name: str, attributes: str) -> tuple[str, bool, bool]:
    """What tells like-named elements apart (class, id, role), whether it marks boilerplate, and whether by words alone."""
    if not attributes or attributes.isspace():
        return "", False, False
    found = {m[1].lower(): next((x for x in m.groups()[1:4] if x is not None), "") if m[1] else "" for m in ATTRIBUTE.finditer(attributes) if m[1]}
    bare = {m[5].lower() for m in ATTRIBUTE.finditer(attributes) if m[5]}
    words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower())) - {""}
    role = found.get("role", "").lower()
    hidden = "hidden" in bare | found.keys() or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    sure = bool(role in ROLES or hidden)
    boilerplate = name not in ("html", "body", *HOLDERS) and bool(words & MARKS or sure)
    return " ".join(sorted(w for w in words if not w.isdigit())) or role, boilerplate, boilerplate and not sure


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Texts (as the first field) and tags (closing mark, name, attributes) of a page; comments and raw contents are left out."""
    at, last, unclosed, size = 0, page.rfind(">"), 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:  # no tag ends behind here, but a comment may still begin
            comment = page.find("<!--", at)
            yield page[at : comment if comment >= 0 else size], "", "", ""
            return
        if start > at:
            yield page[at:start], "", "", ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            continue
        m = TAG.match(page, start) if unclosed < UNCLOSED else None
        if m is None and (m := PLAIN_TAG.match(page, start)):
            unclosed += 1
        if m is None:
            yield "<", "", "", ""
            at = start + 1
            continue
        close, name, at = m[1], m[2].lower(), m.end()
        yield "", close, name, m[3]
        if name in RAW and not close:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size


def parse(page: str) -> Element:
    """The page as a tree of block-level elements, DEPTH levels deep."""
    root = Element("#root")
    stack, text = [root], []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of each name are open

    def flush() -> None:
        if text:
            stack[-1].children.append("".join(text))
            text.clear()

    def enter(element: Element) -> None:
        if len(stack) <= DEPTH:
            stack[-1].children.append(element)
        elif not element.boilerplate:
            element.children = stack[-1].children
        if element.name not in VOID:
            places[element.name].append(len(stack))
            stack.append(element)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().name].pop()

    for words, close, name, attributes in tokens(page):
        if words:
            text.append(words)
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif not close and attributes.strip() and (found := _mark(name, attributes))[1] and name not in VOID:
                flush()
                enter(Element(name, found[0], True, marked=found[2]))
            elif close and stack[-1].name == name:
                flush()
                leave(len(stack) - 1)
            continue
        flush()
        if close:
            if places[name]:
                depth = places[name][-1]
                # Stray ends of such elements do not end an article around them.
                if not (name in ("p", "div", "span", "section") and any(places[h] and places[h][-1] > depth for h in HOLDERS)):
                    leave(depth)
            continue
        closes = CLOSES.get(name) or ({"p"} if name not in VOID else set())
        while stack[-1].name in closes or (stack[-1].name in INLINE and len(stack) > 1):
            leave(len(stack) - 1)
        mark, boilerplate, by_words = _mark(name, attributes)
        element = Element(name, mark, boilerplate or name in SKIPPED, marked=by_words and name not in SKIPPED)
        enter(element)
        if (name in RAW or attributes.rstrip().endswith("/")) and stack[-1] is element:
            leave(len(stack) - 1)
    flush()
    relieve(root)
    return root


def relieve(root: Element) -> None:
    """Takes the mark of class words from layout containers: elements around most of a page's text, or its only articles."""

    def marked(element: Element) -> Iterator[Element]:
        for child in element.children:
            if not isinstance(child, str):
                if child.marked and child.boilerplate:
                    yield child
                elif not child.boilerplate:
                    yield from marked(child)

    def length(element: Element) -> int:
        return sum(len("".join(c.split())) if isinstance(c, str) else length(c) if c.marked or not c.boilerplate else 0 for c in element.children)

    def holds(element: Element) -> bool:
        return any(c.name in HOLDERS or holds(c) for c in element.children if not isinstance(c, str) and (c.marked or not c.boilerplate))

    whole, articles = None, None
    while found := list(marked(root)):
        if whole is None:
            whole, articles = length(root), holds(root)
        found = [e for e in found if holds(e)] if articles else found
        best = max(found, key=length, default=None)
        # Without an article elsewhere the longest element around one holds the page's text, however short.
        if best is None or not (2 * length(best) > whole or (articles and next(holders(root), None) is None)):
            return
        best.boilerplate = False


@dataclass
class Part:
    """A part of a wrapper: an element (or, without a name, a text), once, optional or repeated."""

    name: str = ""
    mark: str = ""
    optional: bool = False
    repeated: bool = False
    constant: str | None = None
    boilerplate: bool = False
    parts: list[Part] = field(default_factory=list)
    #: How often each text stood here, of a text part.
    texts: Counter = field(default_factory=Counter)
    #: Characters in slots, if texts were counted elsewhere and are not here but for the most frequent one, by its hash.
    chars: int | None = None

    @property
    def key(self) -> tuple[str, str]:
        return self.name, self.mark


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def stream(element: Element) -> list[Part]:
    """The parts of one element's content, runs of like elements folded into repeats."""
    parts: list[Part] = []
    for child in element.children:
        if isinstance(child, str):
            if not (words := clean(child)):
                continue
            part = Part(constant=words, texts=Counter((words,)))
        else:
            part = Part(child.name, child.mark, boilerplate=child.boilerplate, parts=[] if child.boilerplate else stream(child))
        fold(parts, part)
    return parts


def fold(parts: list[Part], part: Part) -> None:
    """Adds part to parts, into the last one if that is a like element."""
    if parts and part.name and parts[-1].key == part.key:
        merge(parts[-1], part)
        parts[-1].repeated = True
    else:
        parts.append(part)


def merge(a: Part, b: Part) -> Part:
    """a, made to cover b as well: differing texts become a slot."""
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    a.constant = a.constant if a.constant == b.constant else None
    a.texts.update(b.texts)
    a.parts = align(a.parts, b.parts)
    return a


def align(a: list[Part], b: list[Part]) -> list[Part]:
    """The parts that cover both streams: those of a common subsequence merge, what only one has becomes optional."""
    out: list[Part] = []
    i = j = 0
    for x, y in [*common([p.key for p in a], [p.key for p in b]), (len(a), len(b))]:
        for part in (*a[i:x], *b[j:y]):
            part.optional = True
            fold(out, part)
        if x < len(a):
            fold(out, merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence of a and b, a longest one if a table for it is not too large.

    Else the keys that stand once on either side are matched where they are in order, and what lies
    between them is aligned by itself; where there are none, each key of a takes the next like one of b.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= CELLS:
            found += [(i + x, j + y) for x, y in longest(a[i:n], b[j:m])]
        elif anchors := increasing(once(a, i, n), once(b, j, m)):
            for x, y in [*anchors, (n, m)]:
                todo.append((i, x, j, y))
                found += [(x, y)] if x < n else []
                i, j = x + 1, y + 1
        else:
            places = defaultdict(list)
            for y in range(j, m):
                places[b[y]].append(y)
            for x in range(i, n):
                own = places[a[x]]
                if (k := bisect_left(own, j)) < len(own):
                    found.append((x, own[k]))
                    j = own[k] + 1
    return sorted(found)


def longest(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by dynamic programming."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def once(keys: list, start: int, end: int) -> dict:
    """The place of each key that stands once in keys[start:end]."""
    counts = Counter(keys[start:end])
    return {k: p for p, k in enumerate(keys[start:end], start) if counts[k] == 1}


def increasing(a: dict, b: dict) -> list[tuple[int, int]]:
    """The most pairs of places of like keys that are in order on both sides."""
    pairs = sorted((p, b[k]) for k, p in a.items() if k in b)
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(ends, y)
        before.append(at[k - 1] if k else -1)
        ends[k:k + 1], at[k:k + 1] = [y], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def infer(pages: list[str]) -> Part:
    """The wrapper of pages: the first one's stream aligned with each further page, over and over what is new."""
    wrapper = Part("#root", parts=stream(parse(pages[0] if pages else "")))
    for page in pages[1:]:
        merge(wrapper, Part("#root", parts=stream(parse(page))))
    return wrapper


def outline(part: Part) -> list:
    """A part without its texts, as JSON can hold it."""
    return [part.name, part.mark, int(part.optional), int(part.repeated), int(part.boilerplate), [outline(p) for p in part.parts]]


def outlined(told: list) -> Part:
    name, mark, optional, repeated, boilerplate, parts = told
    return Part(name, mark, bool(optional), bool(repeated), None, bool(boilerplate), [outlined(p) for p in parts])


def every(part: Part) -> Iterator[Part]:
    """The parts of a part, each before its own."""
    for child in part.parts:
        yield child
        yield from every(child)


def placed(wrapper: Part, page: Part) -> Iterator[tuple[int, int, list]]:
    """For each text of a page's outline (by its number in every()) where it stands in the wrapper: the number of a part, with the path from there.

    A page's parts take the next like part each. If none is left, the first like one; if there is none at all, the path leads on below the element.
    """
    numbers = {id(p): n for n, p in enumerate(every(wrapper))}
    own = {id(p): n for n, p in enumerate(every(page))}

    def walk(inside: Part, part: Part) -> Iterator[tuple[int, int, list]]:
        at: dict[tuple, list[int]] = defaultdict(list)
        for n, p in enumerate(inside.parts):
            at[p.key].append(n)
        start = 0
        for p in part.parts:
            if not (like := at.get(p.key)):
                yield from beyond(numbers.get(id(inside), -1), p, [])
                continue
            if (k := bisect_left(like, start)) < len(like):
                start = like[k] + 1
            met = inside.parts[like[k] if k < len(like) else like[0]]
            if p.name:
                yield from walk(met, p)
            else:
                yield own[id(p)], numbers[id(met)], []

    def beyond(number: int, p: Part, path: list) -> Iterator[tuple[int, int, list]]:
        if not p.name:
            yield own[id(p)], number, [*path, ["", ""]]
        for child in p.parts:
            yield from beyond(number, child, [*path, [p.name, p.mark]])

    yield from walk(wrapper, page)


def counted(wrapper: Part, places: list[dict]) -> Part:
    """The wrapper with what was counted at its places: number, path, total, chars, and the most frequent text's n, digest and size."""
    parts = {-1: wrapper} | dict(enumerate(every(wrapper)))
    for x in sorted(places, key=lambda x: (x["number"], x["path"])):
        part = parts[x["number"]]
        for name, mark in json.loads(x["path"]):
            if (found := next((p for p in part.parts if name and p.key == (name, mark)), None)) is None:
                part.parts.append(found := Part(name, mark, optional=True))
            part = found
        part.texts = Counter({x["digest"]: x["n"], None: x["total"] - x["n"]})
        part.chars = x["chars"] - (x["size"] * x["n"] if template(part) is not None else 0)
    return wrapper


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def template(part: Part) -> str | int | None:
    """The text that may be constant, of a text part: no other texts fill as many of its places.

    Where texts differ as often, the part is a slot. Optional parts count too: how many of the host's pages
    have them is told later.
    """
    text, n = max(part.texts.items(), key=lambda x: x[1], default=(None, 0))
    return text if 2 * n > part.texts.total() else None


def candidates(part: Part, path: tuple = ()) -> Iterator[tuple]:
    """Paths of texts, with the text, that may be constant."""
    for child in part.parts:
        if child.boilerplate:
            continue
        if child.name:
            yield from candidates(child, (*path, child.key))
        elif (text := template(child)) is not None:
            yield (*path, text)


def slot_text(part: Part) -> int:
    """Characters in the slots of a part, on all pages that it comes from."""
    if part.boilerplate:
        return 0
    if part.name:
        return sum(map(slot_text, part.parts))
    if part.chars is not None:
        return part.chars
    constant = template(part)
    return sum(len(t) * n for t, n in part.texts.items() if t != constant)


def slots(part: Part) -> int:
    """How many texts a part has that are no template."""
    return 0 if part.boilerplate else sum(map(slots, part.parts)) if part.name else int(bool(part.texts) and template(part) is None)


def titled(part: Part) -> bool:
    return part.name == "h1" or any(titled(p) for p in part.parts)


def records(part: Part) -> bool:
    """Whether a part is or holds a repeated group whose every turn has several slots."""
    return part.name in GROUPS and ((part.repeated and slots(part) > 1) or any(records(p) for p in part.parts))


def sides(wrapper: Part) -> set[tuple]:
    """Paths of the groups beside and below the main text, of a host without articles."""
    found: set[tuple] = set()
    if any(True for _ in named(wrapper, HOLDERS)):
        return found
    node, path = wrapper, ()
    while True:
        groups = [p for p in node.parts if p.name in GROUPS and not p.boilerplate]
        best = max((p for p in groups if p.name in LAYOUT and not p.repeated), key=slot_text, default=None)
        if best is None or slot_text(best) < DOMINANT * slot_text(node) or not slot_text(best):
            break
        found |= {(*path, p.key) for p in groups if p.key != best.key and slot_text(p) and not titled(p)}
        node, path = best, (*path, best.key)
    whole, above = slot_text(node), 0
    for part in node.parts:
        own = slot_text(part)
        if part.name in GROUPS and records(part) and 2 * above > whole - own and 2 * own < whole:
            found.add((*path, part.key))
        above += own
    return found


def named(part: Part, names: tuple[str, ...]) -> Iterator[Part]:
    for child in part.parts:
        if not child.boilerplate:
            if child.name in names:
                yield child
            yield from named(child, names)


@dataclass(frozen=True)
class Rules:
    """What a wrapper says of a page: texts, with their paths, and the number of each; paths of side groups."""

    constant: dict[tuple, int]
    side: frozenset[tuple] = frozenset()
    #: Texts are told by their hashes.
    hashed: bool = False


def rules(wrapper: Part, pages: int = PAGES) -> Rules:
    """The rules of a wrapper of so many different pages; a few do not tell a side group."""
    return Rules({c: n for n, c in enumerate(sorted(set(candidates(wrapper)), key=str))}, frozenset(sides(wrapper) if pages >= PAGES else ()))


def dump(told: Rules) -> str:
    return json.dumps([[[n, *c] for c, n in told.constant.items()], sorted(told.side)])


@lru_cache(maxsize=256)
def undump(text: str, only: tuple[int, ...] | None = None) -> Rules:
    path = lambda p: tuple(tuple(x) if isinstance(x, list) else x for x in p)
    constant, side = json.loads(text)
    return Rules({path(c): n for n, *c in constant if only is None or n in only}, frozenset(map(path, side)), hashed=True)


def extract(page: str | None, told: Rules | None = None) -> str:
    """The main text of one page: its articles and mains, else its body, without what its host's rules tell."""
    return "\n".join(words for words, number in read(page, told) if number is None)


def read(page: str | None, told: Rules | None = None) -> Iterator[tuple[str, int | None]]:
    """The texts of a page's articles and mains, else of its body, each with its number if the rules tell it."""
    return read_tree(parse(page or ""), told)


def read_tree(root: Element, told: Rules | None = None) -> Iterator[tuple[str, int | None]]:

    def walk(element: Element, path: tuple, held: bool) -> Iterator[tuple[str, int | None]]:
        for child in element.children:
            if isinstance(child, str):
                if words := clean(child):
                    yield words, told.constant.get((*path, digest(words) if told.hashed else words)) if told and told.constant else None
            elif not child.boilerplate and (held or child.name != "header"):
                here = (*path, (child.name, child.mark))
                if not told or here not in told.side:
                    yield from walk(child, here, held)

    held = list(holders(root))
    for element, path in held or [(root, ())]:
        yield from walk(element, path, bool(held))


def holders(element: Element, path: tuple = ()) -> Iterator[tuple[Element, tuple]]:
    """The outermost articles and mains that are not boilerplate, in page order, each with its path."""
    for child in element.children:
        if isinstance(child, str) or child.boilerplate:
            continue
        here = (*path, (child.name, child.mark))
        if child.name in HOLDERS:
            yield child, here
        else:
            yield from holders(child, here)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def streams(pages: DataFrame) -> DataFrame:
    """host, page (a hash), outline, alike (a hash of its texts) and texts (where in the outline which stand, by hashes) of pages (host, html, page), written once."""
    kind = pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.int64()), ("n", pa.int32()), ("size", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            outlines, alike, texts = [], [], []
            for page in batch.column(2).to_pylist():
                tree = parse(page or "")
                root = Part("#root", parts=stream(tree))
                outlines.append(json.dumps(outline(root), separators=(",", ":")))
                alike.append(digest("\n".join(w for w, _ in read_tree(tree))))
                texts.append([{"place": k, "digest": digest(t), "n": n, "size": len(t)} for k, p in enumerate(every(root)) for t, n in p.texts.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(outlines, pa.string()), pa.array(alike, pa.int64()), pa.array(texts, kind)], names=["host", "page", "outline", "alike", "texts"])

    schema = "host string, page long, outline string, alike long, texts array<struct<place int, digest long, n int, size int>>"
    return materialize(pages.select("host", "page", "html").mapInArrow(run, schema), "streams", codec="zstd")


def aligned(outlines: DataFrame, merged: int = MERGED) -> DataFrame:
    """host and wrapper (an outline) of all outlines (host, outline), in groups of about `merged`, level by level, each in an order of its own."""

    def run(group: pa.Table) -> pa.Table:
        first, *rest = (outlined(json.loads(o)) for o in sorted(group.column("outline").to_pylist()))
        for other in rest:
            merge(first, other)
        return pa.table({"host": group.column("host").to_pylist()[:1], "outline": [json.dumps(outline(first), separators=(",", ":"))]}, schema=pa.schema([("host", pa.string()), ("outline", pa.string())]))

    while True:
        most = outlines.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        groups = -(-most // merged) or 1
        bucket = F.pmod(F.xxhash64("outline"), F.lit(groups)).alias("bucket")
        outlines = materialize(outlines.groupBy("host", bucket).applyInArrow(run, "host string, outline string").distinct(), "aligned", codec="zstd")
        if groups == 1:
            return outlines.withColumnRenamed("outline", "wrapper")


def wrappers(pages: DataFrame, merged: int = MERGED) -> DataFrame:
    """host and rules (which texts may be constant) of each host of pages (host, page, html), written once, from all of its different pages.

    Only outlines meet in tasks. Texts are counted by partial aggregates, by their hashes and their places in the wrapper.
    """
    made = streams(pages)
    shape = F.xxhash64("outline").alias("shape")
    outlines = materialize(made.select("host", "outline").distinct(), "outlines", codec="zstd")
    told = aligned(outlines, merged)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for name, key, page, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := list(placed(outlined(json.loads(wrapper)), outlined(json.loads(page)))):
                    local, numbers, paths = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([key] * len(found), pa.int64()), pa.array(local, pa.int32()), pa.array(numbers, pa.int32()), pa.array(map(json.dumps, paths), pa.string())], names=["host", "shape", "place", "number", "path"])

    places = outlines.join(told, "host").select("host", shape, "outline", "wrapper").mapInArrow(place, "host string, shape long, place int, number int, path string")
    # Equal pages share a hash; one of them is enough.
    each = made.select("host", "page", shape, "texts").dropDuplicates(["host", "page"]).select("host", "shape", F.inline("texts"))
    texts = each.groupBy("host", "shape", "place", "digest").agg(F.sum("n").alias("n"), F.max("size").alias("size")).join(materialize(places, "places", codec="zstd"), ["host", "shape", "place"])
    counts = texts.groupBy("host", "number", "path", "digest").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    best = counts.groupBy("host", "number", "path").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("size")).alias("chars"), F.max(F.struct("n", "digest", "size")).alias("b"))
    counted_places = best.groupBy("host").agg(F.collect_list(F.struct("number", "path", "total", "chars", "b.*")).alias("places"))  # as many as the wrapper has
    different = made.groupBy("host").agg(F.count_distinct("alike").alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dump(rules(counted(outlined(json.loads(w)), p or []), n)) for w, p, n in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["host", "rules"])

    rows = told.join(counted_places, "host", "left").join(different, "host").select("host", "wrapper", "places", "pages")
    return materialize(rows.mapInArrow(run, "host string, rules string"), "wrappers")


def read_all(pages: DataFrame, told: DataFrame) -> DataFrame:
    """page_id, url, host, alike (a digest of the page's texts), texts and numbers of pages (page_id, url, host, html), written once.

    Each page is read along its host's rules; the number of a text that may be constant stands at its place, else -1.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url", "host").schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [list(read(p, undump(r))) for p, r in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            texts = pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string()))
            numbers = pa.array([[-1 if n is None else n for _, n in f] for f in found], pa.list_(pa.int32()))
            alike = pa.array([hashlib.md5("\n".join(w for w, _ in f).encode("utf-8", "surrogatepass")).digest() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], alike, texts, numbers], names=["page_id", "url", "host", "alike", "texts", "numbers"])

    joined = pages.join(told, "host").select("page_id", "url", "host", "html", "rules")
    return materialize(joined.mapInArrow(run, ", ".join([*fields, "alike binary, texts array<string>, numbers array<int>"])), "lines", codec="zstd")


def constants(lines: DataFrame, least: int = PAGES, share: float = CONSTANT) -> DataFrame:
    """host and constant: the numbers of the texts that so large a share of all of a host's pages has.

    Pages of the same texts count once, so that copies of one page do not make its content constant. Only
    numbers are counted, by partial aggregates; they are as many as the wrapper has.
    """
    # -1 stands for the page itself.
    once = lines.select("host", "alike", F.array_union("numbers", F.array(F.lit(-1))).alias("numbers")).groupBy("host", "alike").agg(F.max("numbers").alias("numbers"))
    counts = once.select("host", F.explode("numbers").alias("number")).groupBy("host", "number").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("host").agg(F.collect_list(F.struct("number", "n")).alias("c"), F.max(F.when(F.col("number") == -1, F.col("n"))).alias("pages"))
    constant = F.transform(F.filter("c", lambda c: (c["number"] >= 0) & (F.col("pages") >= least) & (c["n"] >= share * F.col("pages"))), lambda c: c["number"])
    return materialize(each.select("host", constant.alias("constant")), "constants")


def main_text(pages: DataFrame, merged: int = MERGED) -> DataFrame:
    """page_id, url and text of each page."""
    html_column = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), html_column.alias("html"), host(F.col("url")).alias("host"))
    told = wrappers(rows.select("host", "html", F.xxhash64("html").alias("page")), merged)
    lines = read_all(rows, told)
    kept = F.filter(F.arrays_zip("texts", "numbers"), lambda x: ~F.array_contains("constant", x["numbers"]))
    return lines.join(constants(lines), "host").select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["texts"]), "\n").alias("text"))
