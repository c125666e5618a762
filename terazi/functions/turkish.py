"""Spelling folds for Turkish and other Latin text, as Spark columns and as DuckDB SQL with the same result."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their plain lower-case forms, derived from Unicode decompositions."""
    plain = {"ı": "i", "İ": "i", "I": "i", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ħ": "h", "Ħ": "h", "ŧ": "t", "Ŧ": "t"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch not in plain and base.isascii() and base.isalpha():
            plain[ch] = base.lower()
    plain |= {chr(c): chr(c).lower() for c in range(ord("A"), ord("Z") + 1) if chr(c) != "I"}
    return "".join(plain), "".join(plain.values())


FOLD_FROM, FOLD_TO = _fold_table()
#: the letters that occur in Turkish names of courts and sources, for SQL texts
SQL_FROM, SQL_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZıİçÇğĞöÖşŞüÜâÂîÎûÛ", "abcdefghijklmnopqrstuvwxyziiccggoossuuaaiiuu"


def fold(col: Column) -> Column:
    """Lower case without accents; dotted and dotless I are one letter. Combining marks vanish. Null stays null."""
    return F.regexp_replace(F.translate(col, FOLD_FROM, FOLD_TO), "[\\x{0300}-\\x{036F}]", "")


def spelling_key(col: Column) -> Column:
    """Key under which different spellings of a source or court name agree.

    Case, accents, spacing, punctuation and leading zeros of numbers don't count; an empty name gives null.
    """
    words = F.trim(F.regexp_replace(fold(col), "[^a-z0-9]+", " "))
    bare = F.regexp_replace(words, "(^| )0+([0-9])", "$1$2")
    return F.when(bare == "", None).otherwise(bare)


def spelling_key_sql(expr: str) -> str:
    """The same key in DuckDB SQL."""
    words = f"trim(regexp_replace(translate({expr}, '{SQL_FROM}', '{SQL_TO}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"nullif(regexp_replace({words}, '(^| )0+([0-9])', '\\1\\2', 'g'), '')"


def turkish_lower(col: Column) -> Column:
    """Lower case by Turkish rules (dotted and dotless I kept apart)."""
    return F.lower(F.translate(col, "İI", "iı"))
