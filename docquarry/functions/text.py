"""Text functions as Spark expressions: cleaning, links, hashes, ids, sentences, trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, replacement and namespace that results depend on.
IMAGE = r"!\[.*?\]\(data:image/[^;]+;base64,[^\)]+\)"
IMAGE_REMOVED = "[IMAGE REMOVED]"
COMMENT = r"(?s)<!--.*?-->"
REFERENCE = r"^\[([^\]]+)\]:\s*(.+)$"
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"

#: Characters trimmed from the ends of chunks and sentences: Unicode White_Space, stated once for all engines.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_WHITE_CLASS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim_white(text: Column) -> Column:
    """Without Unicode white space at both ends; Spark's own trim takes spaces only."""
    return F.regexp_replace(text, f"^{_WHITE_CLASS}+|{_WHITE_CLASS}+\\z", "")


def clean_markdown(text: Column) -> Column:
    """Inline base64 images become a note, then HTML comments go; an unclosed comment stays."""
    # In (?d) mode the dot stops at a line feed alone.
    return F.regexp_replace(F.regexp_replace(text, "(?d)" + IMAGE, "\\[IMAGE REMOVED\\]"), COMMENT, "")


def normalized_lines(text: Column) -> Column:
    """Line ends as LF, and one at the end of a text that has any character."""
    lf = F.regexp_replace(text, "\r\n", "\n")
    return F.when((lf == "") | lf.endswith("\n"), lf).otherwise(F.concat(lf, F.lit("\n")))


def reference_links(text: Column) -> Column:
    """The link definition lines of a text, in order, each with a line feed."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("(?d)" + REFERENCE))
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def inject_links(text: Column) -> Column:
    """The text with all its link definitions in front, so that any part of it can resolve them."""
    return F.concat(reference_links(text), F.lit("\n\n"), text)


def content_hash(content: Column) -> Column:
    """SHA-256 of the raw bytes, 64 lower-case hex digits."""
    return F.sha2(content, 256)


def point_id(path: Column, index: Column) -> Column:
    """Version 5 UUID of ``path#index`` in the OID namespace: the same chunk place has the same id for ever."""
    name = F.encode(F.concat(path, F.lit("#"), index.cast("string")), "utf-8")
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), name))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def split_sentences(text: Column) -> Column:
    """Pieces that end after each of . ! ? or a line feed, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?\n])"), trim_white), lambda x: x != "")


def trigrams(text: Column) -> Column:
    """Distinct windows of 3 bytes; none for shorter texts."""
    raw = F.encode(text, "utf-8")
    size = F.octet_length(text)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substring(raw, i, F.lit(3)))
    return F.when(size >= 3, F.array_distinct(windows)).otherwise(F.array().cast("array<binary>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets given as arrays of distinct elements; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared)).cast("float")
