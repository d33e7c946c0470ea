"""Metadata, links and text of raw HTML pages.

Patterns run in the JVM. Character references are decoded, and tags taken out, in Arrow batches: there are over two thousand
named references, and quotes inside tags are beyond a pattern that has to stay linear.
"""

from __future__ import annotations

import html as references
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
LANGUAGE_PATTERN = r"""(?is)<html[^>]*?\slang\s*=\s*["']?([^"'\s>]+)"""
NOT_PAGES = (".css", ".js", ".ico", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".csv", ".bz2", ".zip", ".epub")

# with quotes or without, in either case
HREF_PATTERN = r"""(?i)\bhref\s*=\s*(?:"[^"]*|'[^']*|[^"'\s>]+)"""
HREF_HEAD = r"""(?i)^href\s*=\s*["']?\s*"""
SCHEME_PATTERN = "^[A-Za-z][A-Za-z0-9+.-]*:"

# a comment, a declaration or the like, or a tag; quotes count only as those of an attribute's value; what has no end goes
# up to the end of the text, so nothing is read twice
_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
         |[!?][^>]*+(?:>|\Z)
         |/(?:[^A-Za-z>][^>]*+(?:>|\Z)|>)
         |(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)
          (?:[^>=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+(?:>|\Z))""", re.S | re.X)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea")}
_DROPPED = ("script", "style")


def text_of(markup: str | None) -> str | None:
    """Text of an HTML page: no tags, comments, scripts or styles, character references decoded. One pass."""
    if markup is None:
        return None
    out, at, n = [], 0, len(markup)
    while at < n:
        found = _MARKUP.search(markup, at)
        if not found:
            break
        out.append(references.unescape(markup[at:found.start()]))
        at = found.end()
        name = (found["name"] or "").lower()
        if name in _RAW and not found["close"]:
            end = _RAW[name].search(markup, at)
            stop = end.start() if end else n
            if name not in _DROPPED:
                out.append(references.unescape(markup[at:stop]))
            at = stop
    out.append(references.unescape(markup[at:]))
    return "".join(out)


@F.pandas_udf(T.StringType())
def strip_html(html: pd.Series) -> pd.Series:
    return html.map(text_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(references.unescape, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda found: [references.unescape(t) for t in found], na_action="ignore")


def unescape(text: Column) -> Column:
    """Decode all numeric and named character references; only texts that hold a ``&`` go through Python."""
    has = F.contains(text, F.lit("&"))
    return F.when(has, _decoded(F.when(has, text))).otherwise(text)


def title(html: Column) -> Column:
    return F.nullif(unescape(F.regexp_extract(html, TITLE_PATTERN, 1)), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, LANGUAGE_PATTERN, 1), F.lit(""))


def links(html: Column) -> Column:
    """Distinct link targets as meant: references decoded, fragments cut, without assets and schemes other than http(s)."""
    written = F.transform(F.regexp_extract_all(html, F.lit(HREF_PATTERN), F.lit(0)),
                          lambda x: F.regexp_replace(x, F.lit(HREF_HEAD), F.lit("")))
    has = F.exists(written, lambda x: F.contains(x, F.lit("&")))
    found = F.transform(F.when(has, _all_decoded(F.when(has, written))).otherwise(written), lambda x: F.rtrim(F.substring_index(x, "#", 1)))
    ends = "(" + "|".join(e.replace(".", r"\.") for e in NOT_PAGES) + ")$"
    other = r"(?i)^(?!https?:)" + SCHEME_PATTERN[1:]
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike(other) & ~x.rlike(ends)))


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` found on page ``base``."""
    scheme = F.regexp_extract(base, "^([A-Za-z]+:)", 1)
    origin = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_extract(page, "^(.*/)", 1)
    )
    absolute = (
        F.when(link.rlike(SCHEME_PATTERN), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )
    return F.when(absolute.rlike(r"/\.{1,2}(/|\?|$)"), _without_dot_segments(absolute)).otherwise(absolute)


def _without_dot_segments(url: Column) -> Column:
    origin = F.regexp_extract(url, "^([A-Za-z]+://[^/?#]*)", 1)
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, "([?].*)$", 1)
    segments = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    kept = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), rest)
