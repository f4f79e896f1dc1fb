"""Links, titles and tables of captured pages, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Character references that captured pages use.
REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "#x27": "'", "#34": '"', "nbsp": " ", "#160": " ", "copy": "©", "reg": "®", "middot": "·", "bull": "•", "mdash": "—", "ndash": "–", "#8211": "–",
    "#8212": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "#8217": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "auml": "ä", "ouml": "ö",
    "uuml": "ü", "szlig": "ß", "ntilde": "ñ", "oacute": "ó", "iacute": "í", "aacute": "á", "uacute": "ú", "times": "×", "amp": "&",
}


def unescape(text: Column) -> Column:
    """Character references undone, that of the ampersand last."""
    out = text
    for name, character in REFERENCES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(character))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def plain(text: Column) -> Column:
    """Without tags, one space for each run of white space."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(text, "<[^>]*>", " ")), r"\s+", " "))


def title(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(plain(found), F.lit(""))


def resolve(base: Column, href: Column) -> Column:
    """An absolute link for absolute, scheme-relative, root-relative and document-relative references; no fragment."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_extract(F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), r"^(.*/)?", 0))
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    link = F.regexp_replace(unescape(href), "#.*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link)).when(link == "", F.regexp_replace(base, "#.*$", "")).otherwise(F.concat(folder, link))
    )


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, position, target, label): each link of each page, in order from 0."""
    attribute = r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(rf"(?is)<a\s(?:[^>]*?\s)?{attribute}[^>]*>.*?</a>"), F.lit(0))
    each = pages.select(key, url, F.posexplode(found).alias("position", "tag"))
    href = F.concat(*[F.regexp_extract("tag", rf"(?is)<a\s(?:[^>]*?\s)?{attribute}", k) for k in (1, 2, 3)])
    return each.select(key, F.col("position").cast("long").alias("position"), resolve(F.col(url), href).alias("target"), plain(F.col("tag")).alias("label"))


def table_rows(html: Column) -> Column:
    """array<array<string>>: the cells of each row of a page's tables."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain))
