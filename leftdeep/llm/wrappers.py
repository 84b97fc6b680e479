"""Main text of web pages through wrappers inferred from pages of the same host.

A page is read as a tree of its block elements; inline markup is transparent. A wrapper
is a union-free regular expression over such trees: each element has a sequence of
items, each item one element that is required, optional, repeated or both, and a text that
is either constant or a slot. Pages are aligned with the wrapper one by one:

- adjacent siblings that look alike (tag and class words) fold into one repeated item;
- two sequences are aligned by their longest common subsequence; an item that only one
  of them has becomes optional;
- texts that differ at one place become a slot;
- a sequence of over LONGEST items becomes one repeated group of its kinds of items.

Wrappers merge like pages do, so tasks build them for their own rows and the wrappers of
a host, one a task, merge in the end; no task holds a host's pages. A wrapper keeps at most
as many items as there are kinds of places on the host's pages.

The region of the article is read off page by page, as a host may have several templates:
a page's ``article`` elements, else its ``main``, or else its body; in it, places for menus,
headers, footers, asides, adverts, forms, notices, comments and the like are closed by a
list of tags and class words. Of a header inside an article its headings stay. A class word alone
closes no element that is needed: an article or main inside is the region if it has more
text than what is open without it, and where a region has no other text, the element that
holds most of it is opened, unless all its words are on the list. What else is template
the wrapper decides: a line that is the same at its place, or somewhere in its repeated
group, on all pages that have the place, of which ENOUGH are distinct. A page's text is
what fills the other open places of its host's wrapper, a line for each block, with white
space inside a block as one space. Template lines stay where a page has nothing else, as
then nothing tells them from an article that was published several times.

A null page is empty and has no text; so has a page whose region is empty. Pages without
a host share the wrapper of the host "". Rows are independent otherwise: repeats add
nothing to a wrapper. Any number of pages may come from one host: wrappers within
BROADCAST estimated bytes are broadcast; beyond, they are joined under SALTS salts.
A page of any length is read whole, in time in proportion to it; a tag that never ends ends
at the next ``>``. An empty table gives an empty result; an existing column with the output's
name is replaced, all others, whatever their names, are kept.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leftdeep.llm.session import unused
from leftdeep.operators.strategy import plan_bytes
from leftdeep.shared import stored

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "xmp")
CLOSED_TAGS = set("head nav header footer aside form button select option dialog menu fieldset canvas audio video map".split()) | set(RAW)
#: Elements that end at the next of the listed ones.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"},
}
ENDING = set().union(*ENDED_BY.values())
LISTS = {"ul", "ol", "dl", "table", "select"}
#: Words in class, id or role that close a place.
CLOSED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus reply replies respond related recommended "
    "widget widgets toolbar pagination pager skip alert contentinfo complementary byline".split()
)
#: A search form's words: with any other word an element is about something else.
SEARCH, SEARCH_WORDS = "search", {*"search form box bar field input button site top header nav wrap wrapper container widget".split()}
#: Words of a heading's place: in an article its headings are the article's own.
HEADER_WORDS, HEADINGS = {"header", "masthead", "banner"}, set("h1 h2 h3 h4 h5 h6".split())
#: Raw elements that a slash before the end of their tag closes.
FOREIGN = ("svg", "math")
#: Regions that may hold the article, the first that a page has.
REGIONS = ("article", "main", "body")
#: Elements that their class doesn't close.
WHOLE = ("html", "body", "main")
BROADCAST, SALTS = 32 << 20, 16
#: Distinct pages from which on a line that all of them have at one place is their template;
#: two pages may share a sentence of their own.
ENOUGH = 3
#: Hosts that a task holds before it hands their wrappers on.
HOSTS = 2_000
#: Nesting beyond which a wrapper takes all lines below as one place's (regions and closed
#: places of the pages have no limit), and items of a sequence beyond which it becomes one
#: repeated group of its kinds of items.
DEEPEST, LONGEST = 100, 48
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
#: Up to the end of a tag: with quoted values, or as it comes.
QUOTED, PLAIN = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"), re.compile(r"([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
END_OF_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
SLOT = 0  # in a wrapper's node: any text


class Node:
    """An element: ``sig`` is (tag, class words); ``parts`` are texts and nodes in order."""

    __slots__ = ("parts", "sig")

    def __init__(self, sig: tuple[str, tuple[str, ...]]):
        self.sig, self.parts = sig, []


def _words(attributes: str) -> tuple[str, ...]:
    if not attributes or attributes.isspace():
        return ()
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name in ("class", "id", "role"):
            out.update(w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            out.add("[hidden]")
    return tuple(sorted(out))


def parse(page: str) -> Node:
    """The tree of block elements, whatever state the markup is in."""
    root = Node(("", ()))
    path, at = [root], 0
    text: list[str] = []
    opened: Counter[str] = Counter()
    ending: list[int] = []  # where in path lists and elements of ENDED_BY are
    quotes = sections = True  # whether quotes, and CDATA sections, have ended so far

    def cut(depth: int) -> None:
        opened.subtract(n.sig[0] for n in path[depth:])
        del path[depth:]
        while ending and ending[-1] >= depth:
            ending.pop()

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                path[-1].parts.append(joined)
            text.clear()

    while m := TOKEN.search(page, at):
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<![CDATA[":
                end = page.find("]]>", at) if sections else -1
                sections = end >= 0
                text.append(entities.escape(page[at:end]) if sections else "")
                at = end + 3 if sections else PLAIN.match(page, at).end()
            continue
        tag, rest = m[2].lower(), QUOTED.match(page, at) if quotes else None
        if rest is None:
            quotes, rest = False, PLAIN.match(page, at)
        at, attributes = rest.end(), rest[1]
        if tag == "br":
            text.append(" ")
        elif tag in RAW:
            if not m[1] and not (tag in FOREIGN and attributes.endswith("/")):
                end = END_OF_RAW[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag in INLINE:
            pass
        elif m[1]:
            flush()
            if opened[tag]:
                depth = len(path) - 1
                while path[depth].sig[0] != tag:
                    depth -= 1
                cut(depth)
        else:
            flush()
            if path[-1].sig[0] == "p" or (len(tag) == 2 and tag[0] == "h" and re.fullmatch("h[1-6]", path[-1].sig[0])):
                cut(len(path) - 1)
            if tag in ENDING:
                for i in reversed(ending):
                    own = path[i].sig[0]
                    if own in LISTS:
                        break
                    if tag in ENDED_BY[own]:
                        cut(i)
                        break
            node = Node((tag, _words(attributes)))
            path[-1].parts.append(node)
            if tag not in VOID:
                if tag in LISTS or tag in ENDED_BY:
                    ending.append(len(path))
                path.append(node)
                opened[tag] += 1
    text.append(page[at:])
    flush()
    return root


# A wrapper's node: (sig, text, items, common); text: None, a constant, or SLOT; items: a list
# of (node, optional, repeated); common: the lines that all pages with this place have there,
# each with the least ENOUGH marks of the distinct pages it was met on.


def _mark(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _common(a: dict, b: dict, beside: bool) -> dict:
    """Of two places on different pages the lines of both; of places beside each other, that
    become one repeated item, all lines."""
    if not beside:
        return {x: tuple(sorted({*a[x], *b[x]})[:ENOUGH]) for x in a if x in b}
    return a | {x: tuple(sorted({*a.get(x, ()), *pages})[:ENOUGH]) for x, pages in b.items()}


def _text(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a if a == b else SLOT


def _fold(items: list) -> list:
    """Adjacent items that look alike, as one repeated item."""
    out: list = []
    for node, optional, repeated in items:
        if out and out[-1][0][0] == node[0]:
            before = out[-1]
            out[-1] = (merge(before[0], node, True), before[1] and optional, True)
        else:
            out.append((node, optional, repeated))
    if len(out) > LONGEST:
        kinds: dict[tuple, tuple] = {}
        for node, _, _ in out:
            kinds[node[0]] = merge(kinds[node[0]], node, True) if node[0] in kinds else node
        out = [(node, True, True) for node in kinds.values()]
    return out


def _all_texts(node: Node) -> list[str]:
    out, stack = [], [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack += reversed(part.parts)
    return out


def of_page(node: Node, page: int = 0, depth: int = 0) -> tuple:
    """A page as the wrapper that fits it alone; ``page``: its mark."""
    if depth < DEEPEST:
        texts = [p for p in node.parts if isinstance(p, str)]
        items = _fold([(of_page(p, page, depth + 1), False, False) for p in node.parts if not isinstance(p, str)])
    else:
        texts, items = _all_texts(node), []
    return node.sig, ("\n".join(texts) if texts else None), items, {_mark(t): (page,) for t in texts}


def _align(a: list, b: list) -> list[tuple[int, int]]:
    """Longest common subsequence of two item lists, by how the items look."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0][0] == b[j][0][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i][0][0] == b[j][0][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def merge(a: tuple, b: tuple, beside: bool = False) -> tuple:
    """The least wrapper of this form that fits what either fits; ``beside``: two places that
    become one repeated item, not the same place on two sets of pages."""
    left, right, i, j = a[2], b[2], 0, 0
    out: list = []
    for x, y in [*_align(left, right), (len(left), len(right))]:
        out += [(n, True, r) for n, _, r in left[i:x]] + [(n, True, r) for n, _, r in right[j:y]]
        if x < len(left):
            out.append((merge(left[x][0], right[y][0], beside), left[x][1] or right[y][1], left[x][2] or right[y][2]))
        i, j = x + 1, y + 1
    return a[0], _text(a[1], b[1]), _fold(out), _common(a[3], b[3], beside)


def _places(children: list[Node], items: list) -> list[tuple | None]:
    """The wrapper's node for each of a page's children: they are folded and aligned as in
    merging; one that stays alone takes the union of the items that look like it."""
    alike: dict[tuple, list] = {}
    for node, _, _ in items:
        alike.setdefault(node[0], []).append(node)
    if len(alike) == len(items):
        return [alike[c.sig][0] if c.sig in alike else None for c in children]
    runs, run_of = [], []
    for c in children:
        if not runs or runs[-1][0][0] != c.sig:
            runs.append(((c.sig,),))
        run_of.append(len(runs) - 1)
    at = {x: items[y][0] for x, y in _align(runs, items)} if len(runs) <= LONGEST else {}
    for x, (run,) in enumerate(runs):
        if x not in at and run[0] in alike:
            alike[run[0]] = [reduce(merge, alike[run[0]])]
            at[x] = alike[run[0]][0]
    return [at.get(x) for x in run_of]


def closed(sig: tuple) -> bool:
    return sig[0] in CLOSED_TAGS or "[hidden]" in sig[1]


def shut(sig: tuple) -> bool:
    """Whether its class closes the element, if it isn't needed."""
    return not CLOSED_WORDS.isdisjoint(sig[1]) or (SEARCH in sig[1] and SEARCH_WORDS.issuperset(sig[1]))


def heads(sig: tuple) -> bool:
    """Whether the element is a heading's place: closed as such, and for nothing else."""
    return "[hidden]" not in sig[1] and HEADER_WORDS.issuperset(CLOSED_WORDS.intersection(sig[1])) and (sig[0] == "header" or (sig[0] not in CLOSED_TAGS and not HEADER_WORDS.isdisjoint(sig[1])))


class Line(NamedTuple):
    """A line outside closed places. ``fixed``: the wrapper has it as template; ``shut``: the
    innermost element around it that its class shuts (0: none); ``regions``: of those kinds
    of REGIONS it is in, the number of the region and the shut element around that."""

    text: str
    fixed: bool
    shut: int
    regions: dict[str, tuple[int, int]]


class Lines:
    """A page's lines, its shut elements (their outer ones; whether to open them at need) and
    the kinds of regions that it has in the open."""

    def __init__(self, page: Node, wrapper: tuple):
        self.lines: list[Line] = []
        self.outer, self.mixed = [0], [True]
        self.found: set[str] = set()
        number, stack = 0, [(page, wrapper, 0, 0, {}, None)]
        while stack:
            node, place, depth, around, regions, head = stack.pop()
            if isinstance(node, str):
                fixed = bool(place and place[3]) and len(place[3].get(_mark(node), ())) >= ENOUGH
                self.lines.append(Line(node, fixed, around, regions))
                continue
            (tag, words), number = node.sig, number + 1
            whole = tag in WHOLE and "article" not in regions
            if "article" in regions and head is None and heads(node.sig):
                head = around  # of what is in here only headings are open
                self.outer.append(around)
                self.mixed.append(False)
                around = len(self.outer) - 1
            elif closed(node.sig) and not whole:
                continue
            elif head is not None and tag in HEADINGS:
                around = head
            elif shut(node.sig) and not whole:
                self.outer.append(around)
                self.mixed.append(not CLOSED_WORDS.issuperset(words))
                around = len(self.outer) - 1
            kind = "main" if "main" in words and tag in ("div", "section") else tag
            if kind in REGIONS and kind not in regions:
                regions = {**regions, kind: (number, around)}
                if not around:
                    self.found.add(kind)
            if depth < DEEPEST:
                places = iter(_places([p for p in node.parts if not isinstance(p, str)], place[2] if place else []))
                below = [(p, place if isinstance(p, str) else next(places), depth + 1, around, regions, head) for p in node.parts]
            else:
                below = [(p, place, depth + 1, around, regions, head) for p in node.parts]
            stack += reversed(below)

    def of(self, kind: str | None) -> list[Line]:
        """The lines of all regions of a kind (None: of the page), less what is shut in them;
        of a region without any, those of the shut element that holds most of it."""
        own: dict[tuple[int, int], list[Line]] = {}
        for line in self.lines:
            if kind is None or kind in line.regions:
                own.setdefault(line.regions[kind] if kind else (0, 0), []).append(line)
        out = []
        for (_, base), lines in own.items():
            bare = [x for x in lines if x.shut == base]
            out += bare if _size(bare) else self._opened(lines, base) or bare
        return out

    def _opened(self, lines: list[Line], base: int) -> list[Line]:
        size: Counter[int] = Counter()
        for x in lines:
            size[x.shut] += _size([x])
        total, inner = Counter(size), {}
        for i in range(max(size), base, -1):
            if total[i]:
                total[self.outer[i]] += total[i]
                inner.setdefault(self.outer[i], []).append(i)
        at = base
        while not size[at]:
            best = max((i for i in inner.get(at, ()) if self.mixed[i]), key=lambda i: total[i], default=0)
            if 2 * total[best] <= total[at] or not best:
                return []
            at = best
        return [x for x in lines if x.shut == at]


def _size(lines: list[Line]) -> int:
    return sum(len(x.text) for x in lines if not x.fixed)


def extract(page: Node, wrapper: tuple) -> str:
    """The text in the open places of the page's regions, less the host's template."""
    lines = Lines(page, wrapper)
    kind = next((k for k in REGIONS if k in lines.found), None)
    own = lines.of(kind)
    for held in REGIONS[: REGIONS.index(kind) if kind else None]:  # a better kind, in a shut element only
        inner = lines.of(held)
        if _size(inner) > _size([x for x in own if held not in x.regions]):
            own = inner
            break
    return "\n".join([x.text for x in own if not x.fixed] or [x.text for x in own])


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _wrappers(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, wrapper) of all hosts."""

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, tuple] = {}
        for part in parts:
            for url, page in zip(part[url_col], part[html_col], strict=True):
                host, w = host_of(url), of_page(parse(page or ""), _mark(page or ""))
                own[host] = merge(own[host], w) if host in own else w
            if len(own) > HOSTS:
                yield _frame(own)
                own = {}
        yield _frame(own)

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, tuple] = {}
        for part in parts:  # sorted by host: one host is held at a time
            for host, blob in zip(part["host"], part["wrapper"], strict=True):
                if own and host not in own:
                    yield _frame(own)
                    own = {}
                w = pickle.loads(blob)
                own[host] = merge(own[host], w) if host in own else w
        yield _frame(own)

    schema = "host string, wrapper binary"
    built = pages.select(url_col, html_col).mapInPandas(build, schema)
    return built.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(join, schema)


def _frame(own: dict[str, tuple]) -> pd.DataFrame:
    return pd.DataFrame({"host": list(own), "wrapper": [pickle.dumps(w) for w in own.values()]}, dtype=object)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", salts: int = SALTS, broadcast: int = BROADCAST) -> DataFrame:
    """``pages`` with ``text_col``, the main text of each."""
    wrappers = stored(_wrappers(pages, url_col, html_col), "wrappers")
    own_host, own_wrapper, salt = (unused(pages, x) for x in ("host", "wrapper", "salt"))
    wrappers = wrappers.withColumnsRenamed({"host": own_host, "wrapper": own_wrapper})

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    @F.pandas_udf("string")
    def text(htmls: pd.Series, blobs: pd.Series) -> pd.Series:
        read: dict[bytes, tuple] = {}
        out = []
        for page, blob in zip(htmls, blobs, strict=True):
            if blob not in read:
                read[blob] = pickle.loads(blob)
            out.append(extract(parse(page or ""), read[blob]))
        return pd.Series(out, dtype=object)

    rows = pages.withColumn(own_host, host(F.coalesce(F.col(url_col), F.lit(""))))
    if plan_bytes(wrappers) <= broadcast:
        rows = rows.join(F.broadcast(wrappers), own_host)
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(url_col, html_col), F.lit(salts)))
        spread = wrappers.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        rows = rows.join(spread, [own_host, salt])
    done = rows.withColumn(text_col, text(F.coalesce(F.col(html_col), F.lit("")), F.col(own_wrapper)))
    return done.select(*[F.col(f"`{c}`") for c in pages.columns if c != text_col], F.col(text_col))
