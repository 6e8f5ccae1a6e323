"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Anything that is neither a letter nor a digit, in any script.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+|[\r\n]+"
# Marks of a list item at the start of a line.
LIST_MARK = r"^(?:[-*•]|\d+[.)])\s+"


def tokens(text: Column) -> Column:
    """Lower-case words of the whole text, in order, without empties."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Sentences and lines without list marks, end marks and outer blanks."""
    parts = F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK)
    bare = lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), LIST_MARK, ""), r"[.!?]+$", "")
    trimmed = F.transform(parts, lambda s: F.trim(bare(s)))
    return F.filter(trimmed, lambda s: s != "")


def normalized_name(name: Column) -> Column:
    """Trimmed, lower case, inner blanks collapsed: the identity of an entity name."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))


def stable_id(*parts: Column) -> Column:
    """Deterministic id, so that a rerun or a retried task writes the same key.

    Every part brings its length, and null is not the empty text, so different
    parts never join to the same text.
    """

    def marked(part: Column) -> Column:
        text = part.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat_ws("|", *[marked(p) for p in parts]), 256)
