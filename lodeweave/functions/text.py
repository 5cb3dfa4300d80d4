"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def strip_tags(html: Column) -> Column:
    """Scripts, styles and tags out, white space to one blank."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def redact_emails(text: Column, mark: str = "<email>") -> Column:
    return F.regexp_replace(text, EMAIL, mark)
