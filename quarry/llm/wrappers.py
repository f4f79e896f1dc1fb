"""Main-text extraction by inferred wrappers.

The pages of a host are token streams of tags and texts. A wrapper is a union-free regular expression over them, kept as
a tree: a tag item may be optional or repeated, a text item is a constant (its hash) or a slot. It begins with one page, folds
runs of alike siblings into repeated groups, and is aligned with one page after another: equal tags are aligned along a
longest common subsequence and merged within, a tag on one side alone becomes optional, unequal numbers of alike siblings become
a repeated group, and unequal texts become a slot. A sequence of over FOLD items becomes one repeated item for each tag.

The wrapper tells where the article is (``choose_main``): the element that holds the most of the text that varies between the
pages and is not links. From the root, the way goes down as long as one element has SHARE of it, and ends where a heading
stands beside. Article and main elements that hold a fair part of the varying text are preferred. A page is read along its
host's wrapper, and the text is taken from the elements so marked, without what tag, role or class mark as menus, forms, notices and
the like, and without texts that are the same in at least MIN_CONSTANT different pages (unless most of the marked element is,
as where a host's pages are copies). Where a page has no such element, or a host no wrapper, tags and classes alone decide.

Wrappers are inferred from all pages: each task merges those it reads, and partial wrappers, which are small, are merged in
two rounds, so no task gets a hot host's pages. An item of a wrapper of over MOST items that was seen on one page alone is
forgotten, which bounds a wrapper by the host's templates. The html is read twice and is shuffled only where all wrappers together
are over BROADCAST bytes, when pages meet their wrappers in a merge join.

Defined results: null and empty html gives an empty text; a null url is a host of its own; equal pages give equal texts;
pages without tags are one block of text; an unclosed tag ends with its parent; elements nested deeper than DEPTH count as blocks
of the element at that depth; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from quarry.llm.common import pack, slices
from quarry.plans.shared import shared_table

#: Different pages of a constant, items of a sequence, items of a wrapper, depth of elements, share of the text on the way down.
MIN_CONSTANT, FOLD, MOST, DEPTH, SHARE = 5, 48, 5000, 120, 0.7
#: Bytes of all wrappers up to which they are broadcast; partial wrappers merged at once; hosts that a task holds.
BROADCAST, MERGE, HOSTS = 16 << 20, 64, 2000

# HTML's elements by what they do.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GENERIC = {"article", "body", "center", "div", "main", "section", "span", "table", "tbody", "td", "tr"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "hr"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:(?:ads?|advert\w*|adbox|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus\w*|footer|gdpr|masthead|modal|nav|navbar|"
    r"navigation|newsletter|pagination|pager|popup|sidebar|site-?header|sponsor\w*|subscribe|toolbar)(?:$|[\s_-])|"
    r"(?:banner|menu|notice|overlay|promo\w*|recommended|related|replies|respond|share|sharing|skip|social|widget)(?:$|\s|"
    r"[_-](?:area|articles?|bar|block|bottom|box|buttons?|container|content|form|icons?|items?|left|links?|list|media|nav|panel|posts?|right|section|signup|top|wrap\w*)(?:$|[\s_-])))",
    re.I,
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "note"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")


def _hidden(attributes: str) -> bool:
    return "hidden" in attributes.lower() and bool(re.search(r"(?i)(?:^|\s)hidden(?:[\s=/]|$)", _QUOTED.sub('""', attributes)))


class Node:
    """An element of a page: key (tag, class and role), boilerplate or not, and children, which are nodes or texts.

    A text is (string, in_link); an inline element leaves no node.
    """

    __slots__ = ("bad", "children", "key", "tag")

    def __init__(self, tag: str, key: str, bad: bool):
        self.tag, self.key, self.bad, self.children = tag, key, bad, []


def parse(page: str | None) -> Node:
    root = Node("", "", False)
    page, stack, links, hidden, at, deeper = page or "", [root], 0, 0, 0, 0
    until = ""
    inline_bad: list[str] = []

    def text(raw: str) -> None:
        if raw and not hidden and not inline_bad:
            stack[-1].children.append((entities.unescape(raw), links > 0))

    def close(names: set[str], stop: set[str]) -> None:
        nonlocal hidden
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                for n in stack[k:]:
                    hidden -= n.tag in SKIPPED
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while True:
        if until:
            m = re.compile(rf"</{until}\s*>", re.I).search(page, at)
            at, until = (m.end(), "") if m else (len(page), "")
            continue
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = rest.rfind("<")
            if cut >= 0 and re.match(r"</?[a-zA-Z]", rest[cut:]):
                rest = rest[:cut]  # a tag that never ends
            text(rest)
            return root
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                links -= name == "a" and links > 0
                if inline_bad and inline_bad[-1] == name:
                    inline_bad.pop()
            else:
                inline_bad.clear()
                links = 0
                if deeper and name not in ("article", "body", "html"):
                    deeper -= 1
                    stack[-1].children.append(Node("hr", "hr", False))
                else:
                    deeper = 0
                    close({name}, set())
            continue
        attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        if name in ("script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "select", "button"):
            if not m[3].endswith("/"):
                until = name
            stack[-1].children.append((" ", False))
            continue
        if name in VOID:
            if name == "hr":
                stack[-1].children.append(Node("hr", "hr", False))
            elif name in ("br", "wbr", "img"):
                text(" ")
            continue
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        bad = name in BOILERPLATE or bool(named and _NAMED.search(named)) or attributes.get("role", "").lower() in _ROLES or _hidden(m[3])
        if name in INLINE:
            links += name == "a"
            if bad and name != "a":
                inline_bad.append(name)
            elif inline_bad and inline_bad[-1] == name:
                inline_bad.append(name)
            continue
        links = 0
        inline_bad.clear()
        if name in ENDS_P:
            close({"p"}, {"article", "body", "button", "div", "li", "section", "table", "td", "th"})
        if name in ENDS_LIKE:
            close(ENDS_LIKE[name], {"ul", "ol", "dl", "table", "select"})
        if name in ("html", "body") and any(n.tag == name for n in stack):
            continue
        if name == "body":
            close({"head"}, set())
        if len(stack) > DEPTH:
            deeper += 1
            stack[-1].children.append(Node("hr", "hr", False))
            continue
        key = name + ("." + re.sub(r"\d+", "0", attributes["class"].strip()) if attributes.get("class") else "")
        node = Node(name, key, bad)
        hidden += name in SKIPPED
        stack[-1].children.append(node)
        stack.append(node)


# A wrapper item is a list. An element: [key, optional, repeated, items, [letters, linked], pages, boilerplate, main]. A text:
# ["#", optional, repeated, hash of the constant or None, different pages with it (up to MIN_CONSTANT), letters].


def wrapper_of(node: Node, page: int) -> list:
    """The wrapper of one page's element; runs of alike siblings are folded into repeated groups. page: a hash of the page."""
    items: list = []
    letters = linked = 0
    buffer: list[str] = []

    def flush() -> None:
        joined = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if joined:
            items.append(["#", False, False, xxh32_intdigest(joined), [page], len(joined)])

    for c in node.children:
        if isinstance(c, tuple):
            buffer.append(c[0])
            n = len(c[0].strip())
            letters += n
            linked += n if c[1] else 0
            continue
        flush()
        own = wrapper_of(c, page)
        letters += own[4][0]
        linked += own[4][1]
        if items and alike(items[-1], own):
            items[-1] = merged(items[-1], own)
            items[-1][2] = True
        else:
            items.append(own)
    flush()
    return [node.key, False, False, folded(items), [letters, linked], 1, node.bad, False]


def alike(a: list, b: list) -> bool:
    """Whether two items have the same key and, where the tag tells little, mostly the same keys within."""
    return a[0] == b[0] and (a[0] == "#" or a[0].split(".")[0] not in GENERIC or shaped({x[0] for x in a[3]}, {x[0] for x in b[3]}))


def shaped(a: set[str], b: set[str]) -> bool:
    return not a or not b or 2 * len(a & b) >= len(a | b)


def folded(items: list) -> list:
    """A long sequence as one repeated item for each key, in order of first appearance."""
    if len(items) <= FOLD:
        return items
    by: dict[str, list] = {}
    for item in items:
        now = by.get(item[0])
        by[item[0]] = merged(now, item) if now else item
    for item in by.values():
        item[2] = True
    return list(by.values())


def merged(a: list, b: list) -> list:
    """The wrapper of what either describes; a and b have the same key."""
    if a[0] == "#":
        same = a[3] if a[3] == b[3] else None
        return ["#", a[1] or b[1], a[2] or b[2], same, [] if same is None else sorted({*a[4], *b[4]})[:MIN_CONSTANT], a[5] + b[5]]
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3]), [a[4][0] + b[4][0], a[4][1] + b[4][1]], a[5] + b[5], a[6] or b[6], False]


def aligned(a: list, b: list) -> list:
    """Two sequences of items along a longest common subsequence of alike ones; the others become optional."""
    n, m = len(a), len(b)
    same = [[alike(x, y) for y in b] for x in a] if n != m or not all(map(alike, a, b)) else None
    if same is None:
        return [merged(x, y) for x, y in zip(a, b)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same[i][j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and same[i][j]:
            item = merged(a[i], b[j])
            i, j = i + 1, j + 1
        else:
            take_a = j >= m or (i < n and best[i + 1][j] >= best[i][j + 1])
            item = [*(a[i] if take_a else b[j])]
            item[1] = True
            i, j = (i + 1, j) if take_a else (i, j + 1)
        if out and item[0] != "#" and alike(out[-1], item):
            item = merged(out.pop(), item)
            item[2] = True
        out.append(item)
    return folded(out)


def size(item: list) -> int:
    return 1 if item[0] == "#" else 1 + sum(map(size, item[3]))


def pruned(item: list) -> list:
    """Without the optional elements that one page alone has."""
    if item[0] == "#":
        return item
    return [*item[:3], [pruned(x) for x in item[3] if x[0] == "#" or x[5] > 1 or not x[1]], *item[4:]]


def bounded(wrapper: list) -> list:
    return pruned(wrapper) if size(wrapper) > MOST else wrapper


def infer(pages: list[str]) -> list:
    """The wrapper of the pages of a host; equal pages count once as to constants."""
    found = None
    for page in pages:
        own = wrapper_of(parse(page), xxh32_intdigest(page or ""))
        found = own if found is None else bounded(merged(found, own))
    return choose_main(found or ["", False, False, [], [0, 0], 0, False, False])


def constant(item: list) -> bool:
    """Whether a text item is the host's own words."""
    return item[0] == "#" and item[3] is not None and len(item[4]) >= MIN_CONSTANT and not item[1] and not item[2]


def varying(item: list) -> int:
    """Letters of an item that vary between pages and are neither links nor boilerplate."""
    if item[0] == "#":
        return 0 if constant(item) else item[5]
    if item[6]:
        return 0
    letters, linked = item[4]
    within = sum(map(varying, item[3]))
    return within if linked < 0.5 * letters else 0


def choose_main(wrapper: list) -> list:
    """Marks the elements that hold the article (main), and appends to the wrapper whether constants in them are dropped."""
    whole = varying(wrapper)
    found: list[list] = []
    if whole:
        for tag in ("article", "main"):
            found = [x for x in _outermost(wrapper, tag) if varying(x)]
            if sum(map(varying, found)) >= 0.3 * whole:
                break
            found = []
        if not found:
            at = wrapper
            while True:
                inner = [x for x in at[3] if x[0] != "#" and not x[6] and x[0].split(".")[0] not in LEAVES]
                best = max(inner, key=varying, default=None)
                headed = any(x[0].split(".")[0] in HEADINGS for x in at[3])
                if best is None or headed or varying(best) < SHARE * varying(at):
                    break
                at = best
            found = [at]
    for item in found:
        item[7] = True
    fixed, letters = sum(map(_fixed, found)), sum(x[4][0] for x in found)
    return [*wrapper[:8], fixed < 0.5 * letters]


def _fixed(item: list) -> int:
    return (item[5] if constant(item) else 0) if item[0] == "#" else sum(map(_fixed, item[3]))


def _outermost(item: list, tag: str) -> Iterator[list]:
    for x in item[3]:
        if x[0] != "#" and not x[6]:
            if x[0].split(".")[0] == tag:
                yield x
            else:
                yield from _outermost(x, tag)


def extract(page: str | None, wrapper: list | None) -> str:
    root = parse(page)
    blocks: list[str] = []

    def visit(node: Node, item: list | None, inside: bool, repeated: bool, header: bool, mains: set[int] | None) -> None:
        """mains: the elements that hold the article by their tags, or None where the wrapper says."""
        buffer: list[str] = []
        position = 0

        def flush() -> None:
            nonlocal position
            joined = _SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if not joined:
                return
            if item:
                k = next((k for k in range(position, len(item[3])) if item[3][k][0] == "#"), None)
                if k is not None:
                    text = item[3][k]
                    position = k + 1
                    if wrapper[8] and constant(text) and not repeated and node.tag not in HEADINGS and text[3] == xxh32_intdigest(joined):
                        return
            if inside and not (header and node.tag not in HEADINGS):
                blocks.append(joined)

        for c in node.children:
            if isinstance(c, tuple):
                buffer.append(c[0])
                continue
            flush()
            own = None
            if item:
                k = matching(c, item[3], position)
                if k is None and position and len(item[3]) > 1:  # a folded sequence has one item a key
                    k = next((k for k in range(position) if item[3][k][0] == c.key and item[3][k][2]), None)
                if k is not None:
                    own = item[3][k]
                    position = max(position, k if own[2] else k + 1)
            main = bool(own and own[7]) if mains is None else id(c) in mains
            if c.bad and not main:
                continue
            if c.tag == "header" and not inside and not main and (mains != set() or not any(h in HEADINGS for h in _tags(c))):
                continue
            visit(c, own, inside or main, repeated or bool(own and own[2]), header or c.tag == "header", mains)
        flush()

    if wrapper and _marked(wrapper):
        visit(root, wrapper, wrapper[7], False, False, None)
    if not blocks:
        mains = {id(n) for n in _mains(root)}
        visit(root, wrapper, not mains, False, False, mains)
    return "\n".join(blocks)


def matching(node: Node, items: list, position: int) -> int | None:
    """The first item from a position on that an element matches, by its key and, where the tag tells little, by what is in it."""
    first = None
    for k in range(position, len(items)):
        if items[k][0] == node.key:
            if node.tag not in GENERIC or shaped({x[0] for x in items[k][3]}, {"#" if isinstance(c, tuple) else c.key for c in node.children if not isinstance(c, tuple) or c[0].strip()}):
                return k
            first = k if first is None else first
    return first


def _marked(item: list) -> bool:
    return item[0] != "#" and (item[7] or any(map(_marked, item[3])))


def _tags(node: Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, Node):
            yield c.tag
            yield from _tags(c)


def _mains(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, outside boilerplate."""
    for wanted in ("article", "main"):
        found: list[Node] = []

        def look(node: Node, found: list[Node] = found, wanted: str = wanted) -> None:
            for c in node.children:
                if isinstance(c, Node) and not c.bad:
                    if c.tag == wanted:
                        found.append(c)
                    else:
                        look(c)

        look(root)
        if found:
            return found
    return []


@lru_cache(maxsize=4096)
def _loaded(wrapper: str) -> list:
    return json.loads(wrapper)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Returns host and wrapper (JSON), one row per host."""
    rows = pages.select(host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")).where("html is not null")
    kind = "host string, part int, wrapper string"

    def partial(name: str, part: int, wrapper: list) -> pa.RecordBatch:
        packed = json.dumps(wrapper, separators=(",", ":"))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([part], pa.int32()), pa.array([packed], pa.string())], ["host", "part", "wrapper"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() // MERGE, {}
        for batch in batches:
            for own in slices(batch, 256):
                for name, page in zip(own.column("host").to_pylist(), own.column("html").to_pylist(), strict=True):
                    now = wrapper_of(parse(page), xxh32_intdigest(page))
                    held[name] = bounded(merged(held[name], now)) if name in held else now
            if len(held) > HOSTS:
                for name, wrapper in held.items():
                    yield partial(name, part, wrapper)
                held.clear()
        for name, wrapper in held.items():
            yield partial(name, part, wrapper)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper = None, None
        for batch in batches:
            for name, part, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper")), strict=True):
                own = json.loads(packed)
                if key == (name, part):
                    wrapper = bounded(merged(wrapper, own))
                    continue
                if key:
                    yield partial(*key, wrapper)
                key, wrapper = (name, part), own
        if key:
            yield partial(*key, wrapper)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merge(batches):
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps(choose_main(json.loads(batch.column("wrapper")[0].as_py())), separators=(",", ":"))])], ["host", "wrapper"])

    first = rows.mapInArrow(read, kind).repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(merge, kind)
    return first.withColumn("part", F.lit(0)).repartition("host").sortWithinPartitions("host").mapInArrow(whole, "host string, wrapper string")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST) -> DataFrame:
    """Returns _row (the row of pages without its html) and text.

    The wrappers are written and their size is checked: up to broadcast_bytes they are broadcast and pages stay where they are, else
    pages and wrappers meet in a merge join of two written sides, in which Spark splits a hot host's rows.
    """
    rows = pack(pages, _html=html).withColumn("_host", host(F.col("_row").getField(url))).withColumn("_row", F.col("_row").dropFields(html))
    kind = rows.schema["_row"].dataType.simpleString()
    wrappers = shared_table(infer_wrappers(pages, url, html))
    total = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host")).alias("n")).first()["n"] or 0
    known = None
    if total <= broadcast_bytes:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        joined = rows.select("_row", "_html", F.col("_host").alias("wrapper"))
    else:
        joined = rows.join(wrappers.hint("merge"), F.col("_host") == F.col("host"), "left").select("_row", "_html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts = []
                for page, w in zip(part.column("_html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                    w = known.value.get(w) if known else w
                    texts.append(extract(page, _loaded(w) if w else None))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    return joined.mapInArrow(run, f"_row {kind}, text string")
