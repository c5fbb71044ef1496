"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free expression over a host's token streams: tags in
order, text slots, and groups that are optional or repeated.  Pages are aligned
with it one by one; what their slots held tells template text (one text on all
pages) from content (varying), and where content gathers.  A page is then read
by matching it with the expression: its blocks belong to the slots they meet.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, hub_join

# HTML elements by their role.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "button", "head", "title", "object", "canvas", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
BREAK = {"br", "hr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog"}
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
KEEPS_P_OPEN = {"body", "html"}
# Names of adverts and reader comments, which vary from page to page like content does.
FOREIGN = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "disqus", "promo", "promotion", "replies", "respond", "sponsor", "sponsored"}
# Names that count only together with what the slot held.
HINTS = {
    "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pager", "pagination", "popup", "related", "recommended", "search", "share", "sharing", "sidebar", "signup", "social", "subscribe", "toolbar", "topbar", "widget",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Share of a host's content that the main container holds at least; different pages on which equal text in one slot is template text; members of a list of tokens from which it is written as one repeated group of optionals; levels of nesting that are told apart.
MAIN_SHARE, SAME_ON, LONG, DEPTH = 0.6, 3, 1_000, 100


def _role(tag: str, attrs: dict[str, str], inside_main: bool) -> int:
    """2: not main text by its element, role or state, or by name an advert or a comment; 1: its name hints at it; 0: nothing known."""
    if tag in CHROME or tag == "header" and not inside_main or attrs.get("role", "").lower() in ROLES or "hidden" in attrs:
        return 2
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return 2
    if tag in ("html", "body", "main", "article"):  # names there tell of the page
        return 0
    words = set(_PART.split(_CAMEL.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()))
    return 2 if words & FOREIGN else 1 if words & HINTS else 0


@cache
def _closes(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b", re.I)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int, int]]:
    """(path of block elements, text, characters inside links, role) of each block of text, in page order."""
    out: list[tuple[tuple[str, ...], str, int, int]] = []
    stack: list[tuple[str, str, int, bool]] = []  # tag, signature, role, inside main
    text: list[str] = []
    anchors: list[str] = []  # the part of the text inside links
    links = 0
    at, size = 0, len(page)

    def close():
        nonlocal text, anchors
        if text:
            flat = " ".join(entities.unescape("".join(text)).split())
            if flat:
                inside = " ".join(entities.unescape("".join(anchors)).split())
                free = len("".join(flat.split())) - len("".join(inside.split()))
                linked = min(len(inside), len(flat) - 1) if free else len(flat)
                out.append((tuple(s[1] for s in stack), flat, linked, stack[-1][2] if stack else 0))
            text, anchors = [], []

    silent = 0
    while at < size:
        m = _TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at and not silent:
            text.append(page[at:start])
            if links:
                anchors.append(page[at:start])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in RAW and not ending:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in SILENT:
            if ending:
                silent = max(0, silent - 1)
            elif not m[0].endswith("/>") and (tag == "head" or _closes(tag).search(page, at)):  # else it holds nothing that could be left out
                silent += 1
            continue
        if silent and tag == "body":
            silent = 0
        if tag == "a":
            links = 0 if ending else 1
        elif tag in BREAK:
            close()
        elif tag in BLOCK:
            close()
            if ending:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if stack and stack[-1][0] == "p" and tag not in KEEPS_P_OPEN:
                    stack.pop()
                shut = ENDS_ITSELF.get(tag)
                if shut and stack and stack[-1][0] in shut:
                    stack.pop()
                attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {}
                role, main = (stack[-1][2], stack[-1][3]) if stack else (0, False)
                main = main or tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
                names = [*sorted(attrs.get("class", "").split()), *(["#" + attrs["id"]] if attrs.get("id") else [])]
                name = f"{tag}.{_DIGITS.sub('0', '.'.join(names))}" if names else tag
                stack.append((tag, name, max(role, _role(tag, attrs, main)), main))
            links = 0
    close()
    return out


# A node is [signature, optional, repeated, children, slot, blocks].  A text slot has the signature "#text" and
# slot = [characters, in links, hinted, hash of its one text or None, hashes of up to SAME_ON pages]; a repeated
# group of optionals has the signature "*".  blocks numbers a page's own blocks of text; a wrapper has none.


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _same(a: list, b: list) -> bool:
    return a[0] == b[0]


def _tags(nodes: list[list]) -> list[str]:
    return [x[0] for x in nodes]


def collapse(nodes: list[list]) -> list[list]:
    """Neighbouring runs of one group (of up to three signatures) become one repeated group."""
    for size in (1, 2, 3):
        out: list[list] = []
        i = 0
        while i < len(nodes):
            group = nodes[i : i + size]
            j = i + size
            while len(group) == size and len(nodes) >= j + size and all(_same(x, y) for x, y in zip(group, nodes[j : j + size])):
                group = [_join(x, y, True) for x, y in zip(group, nodes[j : j + size])]
                j += size
            if j > i + size:
                out += group
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _join(a: list, b: list, repeated: bool = False) -> list:
    slot = None
    if a[4] is not None:
        x, y = a[4], b[4]
        slot = [x[0] + y[0], x[1] + y[1], x[2] or y[2], x[3] if x[3] == y[3] and not repeated else None, sorted({*x[4], *y[4]})[:SAME_ON]]
    return [a[0], a[1] or b[1], repeated or a[2] or b[2], align(a[3], b[3]), slot, [*a[5], *b[5]]]


def matching(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of signatures, of any length.

    Row i of the usual table is one whole number: bit j is 0 where the tail of b
    from j has one more in common with the tail of a from i than the tail from
    j + 1.  Rows are made from the last one back; each root-n-th is kept, and
    those between are made again when the walk from the front gets there.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    n, m = len(a) - low, len(b) - low
    pairs = [(k, k) for k in range(low)]
    if not n or not m:
        return pairs
    places: dict[str, int] = {}
    for j in range(m):
        places[b[low + j]] = places.get(b[low + j], 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1

    def row(i: int, after: int) -> int:
        own = after & places.get(a[low + i], 0)
        return (after + own | after - own) & full

    width = int(n**0.5) + 1
    kept, last = {n: full}, full
    for i in range(n - 1, -1, -1):
        last = row(i, last)
        if i % width == 0:
            kept[i] = last
    rows: dict[int, int] = {0: kept[0]}
    shared = m - last.bit_count()
    i = j = 0
    while i < n and j < m and shared:
        if i + 1 not in rows:
            end = min(n, (i // width + 1) * width)
            rows = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = row(k, rows[k + 1])
        if a[low + i] == b[low + j]:
            pairs.append((low + i, low + j))
            i, j, shared = i + 1, j + 1, shared - 1
        elif not rows[i] >> (m - 1 - j) & 1:
            i += 1
        else:  # the tails from j and from j + 1 are alike; which one is skipped doesn't matter, a's if that loses nothing
            tail = rows[i + 1] & ((1 << (m - j)) - 1)
            if m - j - tail.bit_count() >= shared:
                i += 1
            else:
                j += 1
    return pairs


def _group(nodes: list[list]) -> list[list]:
    """One repeated group of optionals, (a? b? ...)+, in place of the tokens."""
    own: dict[str, list] = {}
    for x in nodes:
        for y in x[3] if x[0] == "*" else [x]:
            own[y[0]] = _join(own[y[0]], y, True) if y[0] in own else [y[0], True, True, *y[3:]]
    return [["*", False, True, list(own.values()), None, []]]


def align(a: list[list], b: list[list]) -> list[list]:
    """Align two token sequences; what one lacks becomes optional, then runs become repeated groups."""
    if _tags(a) == _tags(b) and not any(x[0] == "*" for x in a):
        return [_join(x, y) for x, y in zip(a, b)]
    if any(x[0] == "*" for x in (*a, *b)):
        return _group([*a, *b])
    out: list[list] = []
    i = j = 0
    for x, y in [*matching(_tags(a), _tags(b)), (len(a), len(b))]:
        out += [[n[0], True, *n[2:]] for n in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_join(a[x], b[y]))
        i, j = x + 1, y + 1
    out = collapse(out)
    return _group(out) if len(out) > LONG else out


def tree(found: list[tuple], numbered: bool = False) -> list[list]:
    """A page's own expression, from its blocks of text; ``numbered``: with the numbers of the blocks."""
    mark = _hash(" ".join(t for _, t, _, role in found if not role))
    root: list[list] = []
    last: tuple[str, ...] = ()
    open_: list[list] = [["", False, False, root]]
    for k, (path, text, linked, role) in enumerate(found):
        path = path[:DEPTH]
        same = 0
        while same < min(len(last), len(path)) and last[same] == path[same]:
            same += 1
        if same == len(path) and same == len(last) and same:
            same -= 1  # a sibling of the same kind
        while len(open_) > same + 1:
            done = open_.pop()
            done[3][:] = collapse(done[3])
        for name in path[same:]:
            node = [name, False, False, [], None, []]
            open_[-1][3].append(node)
            open_.append(node)
        slot = [len(text) if role < 2 else 0, linked if role < 2 else 0, role == 1, _hash(text), [mark]]
        open_[-1][3].append(["#text", False, False, [], slot, [k] if numbered else []])
        last = path
    while len(open_) > 1:
        done = open_.pop()
        done[3][:] = collapse(done[3])
    return collapse(root)


class Wrapper:
    """Expression of a host, with what its text slots held."""

    def __init__(self, nodes: list[list] | None = None):
        self.nodes = nodes

    def add(self, found: list[tuple]) -> None:
        self.merge(Wrapper(tree(found)))

    def merge(self, other: Wrapper) -> None:
        if other.nodes is not None:
            self.nodes = other.nodes if self.nodes is None else align(self.nodes, other.nodes)

    def dumps(self) -> bytes:
        return json.dumps(self.nodes).encode()

    @staticmethod
    def loads(raw: bytes) -> Wrapper:
        return Wrapper(json.loads(raw))

    def rule(self) -> list:
        """The expression as [signature, children, mark]: mark 1 for slots of main text, 2 for the container, 3 for one named as main text."""
        template = lambda s: s[3] is not None and len(s[4]) >= SAME_ON
        varies = lambda s: s[3] is None and len(s[4]) > 1
        weight: dict[int, int] = {}
        found: list[tuple[int, list]] = []  # depth, element

        def weigh(node: list, depth: int) -> int:
            s = node[4]
            if s is not None:
                content = not template(s) and s[1] * 2 <= s[0] and (not s[2] or varies(s))
                out = s[0] - s[1] if content else 0
            else:
                out = sum(weigh(x, depth + 1) for x in node[3])
                if node[0] != "*":
                    found.append((depth, node))
            weight[id(node)] = out
            return out

        root = ["", False, False, self.nodes or [], None, []]
        total = weigh(root, 0)
        tag = lambda node: node[0].split(".")[0]
        named = [(d, x) for d, x in found if tag(x) in ("article", "main") and weight[id(x)] * 4 >= total]
        if named:
            most = max(weight[id(x)] for _, x in named)
            _, main = max(named, key=lambda p: (weight[id(p[1])] * 10 >= 9 * most, tag(p[1]) == "article", weight[id(p[1])], -p[0]))
        else:
            holders = [(d, x) for d, x in found if weight[id(x)] >= MAIN_SHARE * total and (not d or tag(x) not in {"p", "li", *HEADINGS})]
            _, main = max(holders, key=lambda p: (p[0], weight[id(p[1])]))
        lone = len(found) <= 2  # one block

        def keeps(s: list, parent: str) -> bool:
            if named:
                return not (s[2] and (template(s) or s[1] * 2 > s[0]))
            if total and template(s) or s[2] and not varies(s):
                return False
            return s[1] < s[0] or parent in {"p", *HEADINGS} or lone

        def write(node: list, parent: str) -> list:
            if node[4] is not None:
                return [node[0], [], int(keeps(node[4], parent))]
            name = parent if node[0] == "*" else tag(node)
            return [node[0], [write(x, name) for x in node[3]], (3 if named else 2) if node is main else 0]

        return write(root, "")


def read(rule: list, found: list[tuple]) -> list[int] | None:
    """Numbers of the blocks of main text, by matching the page with the expression; None if it lacks the container."""
    kept: list[int] = []
    seen = False

    def rest(node: list, named: bool) -> None:
        """Of tokens in the container that the expression lacks."""
        kept.extend(k for k in node[5] if found[k][3] == 0)
        for x in node[3]:
            rest(x, named)

    def walk(rules: list[list], nodes: list[list], inside: bool) -> None:
        nonlocal seen
        if len(rules) == 1 and rules[0][0] == "*":
            at = {r[0]: r for r in rules[0][1]}
            pairs = [(at.get(x[0]), x) for x in nodes]
        else:
            met = {j: rules[i] for i, j in matching([r[0] for r in rules], _tags(nodes))}
            pairs = [(met.get(j), x) for j, x in enumerate(nodes)]
        for r, x in pairs:
            if r is None:
                if inside:
                    rest(x, False)
            elif x[4] is not None:
                if inside and r[2]:
                    kept.extend(k for k in x[5] if found[k][3] < 2)
            else:
                seen = seen or r[2] > 1
                walk(r[1], x[3], inside or r[2] > 1)

    seen = rule[2] > 1
    walk(rule[1], tree(found, True), seen)
    return sorted(kept) if seen else None


def apply_rule(found: list[tuple], rule: list | None) -> str | None:
    """Text of the main blocks; None if the page has none by the rule."""
    got = read(rule, found) if rule else None
    return " ".join(found[k][1] for k in got) if got else None


def main_text(found: list[tuple], rule: list | None) -> str:
    text = apply_rule(found, rule)
    if text is None and found:  # another template than its host's: the page is its own wrapper
        text = apply_rule(found, Wrapper(tree(found)).rule())
    return text or ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


#: Hosts whose partial wrappers a task holds at once.
HOSTS = 200


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Wrapper] = {}
    count: dict[str, int] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([w.dumps() for w in held.values()], pa.binary()), pa.array([count[h] for h in held], pa.int64())], names=["host", "wrapper", "rows"])

    for b in batches:
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = blocks(page or "")
            if found:
                host = host_of(url)
                if host not in held and len(held) >= HOSTS:
                    yield out()
                    held, count = {}, {}
                held.setdefault(host, Wrapper()).add(found)
                count[host] = count.get(host, 0) + 1
    if held:
        yield out()


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    w = Wrapper()
    for raw in sorted(frame["wrapper"]):
        w.merge(Wrapper.loads(raw))
    first = frame.iloc[0]
    return pd.DataFrame({"host": [first["host"]], "salt": [first["salt"]], "wrapper": [w.dumps()], "rows": [frame["rows"].sum()]})


def _ruled(frame: pd.DataFrame) -> pd.DataFrame:
    w = Wrapper.loads(_merged(frame)["wrapper"][0])
    return pd.DataFrame({"host": [frame.iloc[0]["host"]], "rule": [json.dumps(w.rule())], "rows": [frame["rows"].sum()]})


def host_rules(pages: DataFrame) -> DataFrame:
    """``host, rule, rows``: a rule for each host, from all its pages, and their number.

    A task aligns the pages it reads into one partial wrapper a host, so that a
    host with a third of all pages sends one small row a task; these are merged
    in two rounds, dealt by 32 salts first.
    """
    schema = "host string, salt int, wrapper binary, rows long"
    partial = pages.select("url", "html").mapInArrow(_partial, "host string, wrapper binary, rows long").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32)).cast("int"))
    return partial.groupBy("host", "salt").applyInPandas(_merged, schema).groupBy("host").applyInPandas(_ruled, "host string, rule string, rows long")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules: dict[str | None, list | None] = {None: None}
    for b in batches:
        text = []
        for page, rule in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if rule not in rules:
                if len(rules) > 5000:
                    rules = {None: None}
                rules[rule] = json.loads(rule)
            text.append(main_text(blocks(page or ""), rules[rule]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page.

    The main text: blocks in the container that the host's wrapper marks, in
    slots of content.  Not content are navigation, forms and the like by element
    or role, adverts and comments by name, slots with one text on three different
    pages (outside an article or main element, or if their name hints at it), and
    lists of links.  A page that lacks the container is its own wrapper.  Elements
    that never close leave nothing out; of a very deep page the outer 100 levels
    are told apart.  A null or empty html gives an empty text; pages without a
    URL share the host ''; repeated rows stay; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rules = cut(host_rules(rows), "host-rules")

    @F.pandas_udf("string")
    def host(url: pd.Series) -> pd.Series:
        return url.map(host_of)

    joined = hub_join(rows.withColumn("host", host(F.col("url"))), rules, ["host"], "left")
    return joined.select("page_id", "url", "html", "rule").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
