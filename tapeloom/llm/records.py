"""What the article operators share: words of a text, and hash splits of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word: a run without blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(content: str | None) -> bytes:
    return b"" if content is None else content.encode("utf-8", "replace")


def words(content: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` splits at exactly the six characters outside ``WORD``."""
    return utf8(content).split()


def lower_words(content: str | None) -> list[bytes]:
    """Words with A-Z lowered; ``bytes.lower`` leaves all other characters alone."""
    return utf8(content).lower().split()


def remainder(key: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def narrowed(articles: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names, so that other columns can't clash."""
    return articles.select(*[articles[f"`{old}`"].alias(new) for new, old in columns.items()])
