"""Links and citation texts by document type.

Formats are data: a mapping ``type -> (row) -> Column``, so a new loader adds its own entry.
``row`` is any callable from a field name to a Column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = Callable[[str], Column]


def doc_url(collection: Column, doc_type: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("/files/"), collection, F.lit("/"), doc_type, F.lit("/"), doc_id)


def md_link(url: Column, text: Column | None = None) -> Column:
    target = F.concat(F.lit("<"), url, F.lit('>{target="_blank"}'))
    if text is None:
        return target
    labelled = F.concat(F.lit("["), text, F.lit("](<"), url, F.lit('>){target="_blank"}'))
    return F.when(text != "", labelled).otherwise(target)


def _pdf_page(c: Column, doc: Row, page: Row) -> Column:
    number = page("page").cast("string")
    url = F.concat(doc_url(c, doc("type"), doc("doc_id")), F.lit("#page="), number)
    return F.concat(F.lit("PDF File: "), md_link(url, F.concat(F.lit("page "), number, F.lit(" of "), doc("filename"))))


def _web_page(c: Column, doc: Row, page: Row) -> Column:
    return F.concat(
        F.lit("Web page: "), md_link(page("source")),
        F.lit(" scraped "), doc("ingest_date").cast("string"),
        F.lit(" from parent URL "), md_link(doc("source")),
    )


def _pdf_document(c: Column, doc: Row) -> Column:
    return F.concat(F.lit("PDF File: "), md_link(doc_url(c, doc("type"), doc("doc_id")), doc("filename")))


def _web_document(c: Column, doc: Row) -> Column:
    return F.concat(F.lit("Web page: "), md_link(doc("source")))


PAGE_FORMATS = {"pdf": _pdf_page, "web": _web_page}
DOCUMENT_FORMATS = {"pdf": _pdf_document, "web": _web_document}


def _other(c: Column, doc: Row) -> Column:
    file = F.concat(
        F.coalesce(doc("extension"), doc("type")), F.lit(" file "),
        md_link(doc_url(c, doc("type"), doc("doc_id")), doc("filename")),
    )
    plain = F.concat(doc("type"), F.lit(" type document from "), doc("source"))
    return F.when(doc("filename").isNotNull(), file).otherwise(plain)


def page_link(collection: Column, doc: Row, page: Row, formats: dict | None = None) -> Column:
    """Citation of one page of a document."""
    out = None
    for doc_type, fmt in (PAGE_FORMATS if formats is None else formats).items():
        cond, text = doc("type") == doc_type, fmt(collection, doc, page)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return _other(collection, doc) if out is None else out.otherwise(_other(collection, doc))


def doc_link(collection: Column, doc: Row, formats: dict | None = None) -> Column:
    """Citation of a whole document."""
    out = None
    for doc_type, fmt in (DOCUMENT_FORMATS if formats is None else formats).items():
        cond, text = doc("type") == doc_type, fmt(collection, doc)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return _other(collection, doc) if out is None else out.otherwise(_other(collection, doc))


def plain_page_citation(doc: Row, page: Row) -> Column:
    """Terminal form of a page citation; NULL for types without one."""
    return F.when(
        doc("type") == "pdf",
        F.concat(F.lit("   PDF File: page "), page("page").cast("string"), F.lit(" of "), doc("source")),
    ).when(
        doc("type") == "web",
        F.concat(
            F.lit("   Web page: "), page("source"), F.lit(" scraped "), doc("ingest_date").cast("string"),
            F.lit(", top level URL: "), doc("source"),
        ),
    )


def listing_line(doc: Row) -> Column:
    return F.concat(
        F.lit("id: "), doc("doc_id"), F.lit(", source: "), doc("source"), F.lit(", type: "), doc("type"),
        F.lit(", pages: "), doc("page_count").cast("string"), F.lit(", vectors: "), doc("vector_count").cast("string"),
    )
