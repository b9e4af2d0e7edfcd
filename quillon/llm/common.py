"""What the operators share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import Staged, cut, shared_dir, ship_package  # noqa: F401

#: ASCII white space, the only characters that part words or are deleted by normalisation. Fixed values.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
