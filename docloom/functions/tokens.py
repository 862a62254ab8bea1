"""Tokenising: runs of letters and digits, lower-cased, Latin accents removed."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _accent_map() -> tuple[str, str]:
    """Lower-case letters that fold to another one, and that other one, by Unicode's own tables.

    These are Latin letters with one mark, and letters whose case folding is not their lower case.
    Combining marks standing on their own are dropped: they come last and have no counterpart.
    """
    accented, plain = [], []
    for code in (*range(0xB5, 0x530), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        folded = letter.casefold() if len(letter.casefold()) == 1 else letter
        base, *marks = unicodedata.normalize("NFD", folded)
        if len(marks) == 1 and base.isascii() and base.islower():
            folded = base
        if letter.islower() and folded != letter:
            accented.append(letter)
            plain.append(folded)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(accented) + marks, "".join(plain)


_ACCENTED, _PLAIN = _accent_map()


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
