"""Captured pages as trees: main content, links with their blocks, headings, tables with spans, listings and profiles.

What regular expressions cannot tell of markup is read by a parser in vectorised functions, once a page; what is made of the
parts is native again. A page that is no markup is one block of text; nulls are empty pages; tags nest to any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.labels import academic_clause
from quarry.functions.names import person_in_text, valid_person_name

# Elements without an end, elements that are no content, and classes that tell a page's furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "svg"}
CHROME = {"nav", "footer", "aside", "header", "form"}
FURNITURE = re.compile(r"(?:^|[\s_-])(?:sidebar|breadcrumbs?|menu|navbar|navigation|footer|skip)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:main-?content|page-?content|content-?area)(?:$|[\s_-])", re.I)
BLOCKS = {"li", "td", "article"}
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def all(self, skip=lambda n: False) -> Iterator[Node]:  # noqa: ANN001
        """The nodes below, in order, without what is below skipped ones."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Node)]
        while waiting:
            node = waiting.pop()
            if skip(node):
                continue
            yield node
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip=lambda n: n.tag in SILENT) -> str:  # noqa: ANN001
        parts, waiting = [], [*reversed(self.children)]
        while waiting:
            c = waiting.pop()
            if isinstance(c, str):
                parts.append(c)
            elif not skip(c):
                waiting.append(" ")
                waiting += reversed(c.children)
                parts.append(" ")
        return " ".join("".join(parts).split())

    @property
    def chrome(self) -> bool:
        named = f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}"
        return self.tag in CHROME or self.tag in SILENT or bool(FURNITURE.search(named)) or self.attributes.get("role") in ("navigation", "banner", "contentinfo")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self.now
        while at.parent and tag in ENDS and at.tag in ENDS[tag]:
            at = at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, at)
        at.children.append(node)
        self.now = at if tag in VOID else node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag: str) -> None:
        at = self.now
        while at.parent and at.tag != tag:
            at = at.parent
        if at.parent:
            self.now = at.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def closed_references(html: str) -> str:
    """The page with the ampersands escaped that begin no character reference ended by a semicolon."""
    known = lambda m: m[1] and (m[1][0] == "#" or m[1] in html5)
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", lambda m: m[0] if known(m) else f"&amp;{m[1] or ''}", html)


def tree(html: str | None, closed: bool = False) -> Node:
    """closed: character references count only where a semicolon ends them; HTML reads some, such as &amp, without one."""
    reader = _Reader()
    reader.feed(closed_references(html or "") if closed else html or "")
    reader.close()
    return reader.root


def main(root: Node) -> Node:
    """The element with the page's content: of the first kind there is, the one with most text; else the body."""
    nodes = list(root.all())
    for fits in (
        lambda n: n.tag == "main" or n.attributes.get("role") == "main", lambda n: n.tag == "article", lambda n: bool(CONTENT.search(f"{n.attributes.get('class', '')} {n.attributes.get('id', '')}")), lambda n: n.tag == "body",
    ):
        found = [n for n in nodes if fits(n)]
        if found:
            return max(found, key=lambda n: len(n.text()))
    return root


def block(node: Node) -> Node:
    """The record that a link stands in: its list item, cell or card, else its paragraph or section of 40 to 1,300 characters."""
    at, plain = node.parent, None
    while at and at.parent:
        if at.tag in BLOCKS or re.search(r"(?:^|[\s_-])card(?:$|[\s_-])", at.attributes.get("class", "")):
            return at
        if plain is None and at.tag in ("p", "div", "section") and 40 <= len(at.text()) <= 1300:
            plain = at
        at = at.parent
    return plain or node


def span(value: str, most: int | None = None) -> int:
    """Columns or rows that a cell spans: the number at the beginning of the attribute, one where there is none."""
    digits = re.match(r"\s*\+?0*([0-9]*)", value)[1]
    number = max(1, int(digits[:18] or 1))
    return number if most is None else min(number, most)


def table_cells(table: Node) -> list[list[str]]:
    """The rows of a table, in which a cell stands in every row and column that it spans."""
    rows, carried = [], {}
    for tr in (n for n in table.all(lambda n: n is not table and n.tag == "table") if n.tag == "tr"):
        cells, at = [], 0
        own = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        while own or at in carried:
            if at in carried:
                text, left = carried.pop(at)
                cells.append(text)
                if left > 1:
                    carried[at] = (text, left - 1)
                at += 1
                continue
            cell = own.pop(0)
            text = cell.text()
            # rows are only counted down; columns are written out, up to the 1,000 that HTML defines
            spans = span(cell.attributes.get("colspan", "1"), 1000), span(cell.attributes.get("rowspan", "1"))
            for _ in range(spans[0]):
                cells.append(text)
                if spans[1] > 1:
                    carried[at] = (text, spans[1] - 1)
                at += 1
        rows.append(cells)
    return rows


LINK = "array<struct<label:string,target:string,block:string,content:boolean>>"
PAGE = f"title string, main string, headings array<struct<level:int,text:string>>, links {LINK}, tables array<array<array<string>>>, refresh string"


def _page(html: str | None, base: str | None, closed: bool = False) -> dict:
    root = tree(html, closed)
    nodes = list(root.all(lambda n: n.tag in SILENT))
    content = main(root)
    inside = {id(n) for n in content.all(lambda n: n.chrome)}
    links = []
    for n in nodes:
        if n.tag == "a" and n.attributes.get("href"):
            target = urldefrag(urljoin(base or "", n.attributes["href"].strip()))[0]
            links.append({"label": n.text(), "target": target, "block": block(n).text(), "content": id(n) in inside})
    refresh = next((m[1].strip("'\" ") for n in nodes if n.tag == "meta" and n.attributes.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"url\s*=\s*(.*)$", n.attributes.get("content", ""), re.I))), None)
    return {
        "title": next((n.text() for n in nodes if n.tag == "title"), None), "main": content.text(lambda n: n.chrome), "headings": [{"level": int(n.tag[1]), "text": n.text()} for n in nodes if re.fullmatch("h[1-6]", n.tag)],
        "links": links, "tables": [table_cells(n) for n in nodes if n.tag == "table"], "refresh": urljoin(base or "", refresh) if refresh else None,
    }


def pages(rows: DataFrame, url: str = "url", html: str = "html", closed: bool = False) -> DataFrame:
    """rows with ``page``: struct of title, main text, headings, links, tables and refresh target, read by a parser in one pass.

    closed: see ``tree``.
    """

    def read(bodies: pd.Series, bases: pd.Series) -> pd.DataFrame:
        found = [_page(h, b, closed) for h, b in zip(bodies, bases, strict=True)]
        return pd.DataFrame(found, columns=["title", "main", "headings", "links", "tables", "refresh"])

    return rows.withColumn("page", F.pandas_udf(read, PAGE)(F.col(f"`{html}`"), F.col(f"`{url}`")))


def decoded_body(body: Column) -> Column:
    """Bytes of a page as text: UTF-8, else what the page declares, else Latin-1."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        said = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", data[:2048])
        for name in ("utf-8", said[1].decode() if said else "latin-1", "latin-1"):
            try:
                return data.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
        return data.decode("utf-8", "replace")

    return F.pandas_udf(lambda s: s.map(one), "string")(body)


def discovery_links(read: DataFrame, key: str) -> DataFrame:
    """(key, label, target, block, content) of all links of pages, menus too."""
    return read.select(key, F.inline("page.links"))


def listings(read: DataFrame, key: str) -> DataFrame:
    """(key, name, target, role): content links whose label is a person's name and whose record speaks of an academic title."""
    each = discovery_links(read, key).where("content")
    return each.where(valid_person_name(F.col("label")) & academic_clause(F.col("block"))).select(key, F.col("label").alias("name"), "target", F.trim(F.replace("block", "label", F.lit(""))).alias("role"))


def table_listings(read: DataFrame, key: str) -> DataFrame:
    """(key, name, title): table rows in which exactly one cell is a person's name and exactly one another an academic title."""
    rows = read.select(key, F.explode(F.flatten("page.tables")).alias("cells"))
    names = F.filter("cells", lambda c: valid_person_name(c) & ~academic_clause(c))
    titles = F.filter("cells", lambda c: academic_clause(c) & (F.length(c) <= 250))
    return rows.where((F.size(names) == 1) & (F.size(titles) == 1)).select(key, names[0].alias("name"), titles[0].alias("title"))


def profiles(read: DataFrame, key: str, name: str) -> DataFrame:
    """(key, status, heading, email, summary, labs) of pages that should be a person's.

    The page's first heading or title must hold the first and last name and be short; else the identity is not confirmed. An address counts
    only if it is the one personal one of the content, laboratories only if they are few, the summary is the content's beginning.
    """
    from quarry.functions.labels import page_emails, valid_lab_label

    heading = F.coalesce(F.filter("page.headings", lambda h: h["level"] == 1)[0]["text"], F.col("page.title"), F.lit(""))
    same = person_in_text(F.col(name), heading) & (F.length(heading) < 250)
    own = F.filter("page.links", lambda x: x["content"])
    emails = page_emails(F.col("page.main"), F.array().cast("array<string>"))
    labs = F.array_distinct(F.transform(F.filter(own, lambda x: valid_lab_label(x["label"])), lambda x: x["target"]))
    summary = F.when(F.length("page.main").between(90, 3500), F.substring("page.main", 1, 1000))
    out = read.withColumns({"status": F.when(same, "verified").otherwise("identity_not_confirmed"), "heading": heading})
    kept = lambda c: F.when(F.col("status") == "verified", c)
    return out.select(
        key, "status", "heading", kept(F.when(F.size(emails) == 1, emails[0])).alias("email"), kept(summary).alias("summary"), F.coalesce(kept(F.when(F.size(labs) <= 6, labs)), F.array().cast("array<string>")).alias("labs")
    )


def directory_labs(read: DataFrame, key: str) -> DataFrame:
    """(key, lab, target, people): content links that name a laboratory, with the other linked names of their record; records of several laboratories name nobody."""
    from quarry.functions.labels import valid_lab_label

    each = discovery_links(read, key).where("content")
    labs = each.where(valid_lab_label(F.col("label"))).select(key, "block", F.col("label").alias("lab"), "target")
    people = each.where(valid_person_name(F.col("label")) & ~valid_lab_label(F.col("label"))).groupBy(key, "block").agg(F.array_sort(F.collect_set("label")).alias("people"))
    several = labs.groupBy(key, "block").agg(F.count_distinct("target").alias("targets"))
    met = labs.join(several, [key, "block"]).join(people, [key, "block"], "left")
    return met.select(key, "lab", "target", F.when(F.col("targets") == 1, F.coalesce("people", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("people"))


def research_links(read: DataFrame, key: str, url: str) -> DataFrame:
    """(key, label, target): links to pages about research on the same host, below the page's folder."""
    from quarry.functions import urls

    each = read.select(key, F.col(url).alias("_u"), F.inline("page.links"))
    folder = F.regexp_replace(F.regexp_replace("_u", r"[?#].*$", ""), r"[^/]*$", "")
    wanted = F.col("label").rlike(r"(?i)\b(?:research|projects?|publications?|overview|about|interests)\b")
    return each.where(wanted & (urls.host(F.col("target")) == urls.host(F.col("_u"))) & F.startswith("target", folder)).select(key, "label", "target").distinct()
