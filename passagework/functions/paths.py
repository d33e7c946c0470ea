"""File names, collection names, table names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def extension(path: Column) -> Column:
    """Last dotted suffix of the base name with its dot; leading dots do not start one."""
    return F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def local_path(uri: Column) -> Column:
    """A scanned file's path without the local scheme."""
    return F.regexp_replace(uri, "^file:(//)?", "")


# names become folders, so path separators, glob characters and names that readers skip are refused
_NAME = r"""[^_\-+.\s/\\*?"<>|,#:@\[\]{}=][^\s/\\*?"<>|,#:@\[\]{}=]*"""


def is_valid_collection_name(name: Column) -> Column:
    """Lower case, not empty, starting with none of ``_ - + .``, without white space and ``/ \\ * ? " < > | , # : @ [ ] { } =``."""
    return (name == F.lower(name)) & name.rlike(rf"\A{_NAME}\z")


def check_collection_name(name: str) -> str:
    """The same rule for a name at hand."""
    if name != name.lower() or not re.fullmatch(_NAME, name, re.ASCII):
        raise ValueError(f"invalid collection name {name!r}: see is_valid_collection_name")
    return name


def check_batch_name(name: str) -> str:
    """As for collections, upper case allowed."""
    if not re.fullmatch(_NAME, name, re.ASCII):
        raise ValueError(f"invalid batch name {name!r}")
    return name


def document_table_name(collection: Column, doc_type: Column) -> Column:
    return F.concat_ws(".", collection, doc_type)


def page_table_name(collection: Column, doc_type: Column) -> Column:
    return F.concat_ws(".", collection, doc_type, F.lit("pages"))


def first_match(values: Column, wanted: Column) -> Column:
    """Position of the first equal element, -1 if none."""
    return F.coalesce(F.array_position(values, wanted), F.lit(0)) - 1


def millis_to_timestamp(millis: Column) -> Column:
    return F.timestamp_millis(millis)
