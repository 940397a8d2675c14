"""Script and sound of Han characters, from the Unicode transliterations that Spark brings along (ICU).

The tables are made once on the driver by rule, not kept here; operators send what they need to the workers.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import SparkSession

_HAN = [chr(c) for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)) for c in range(a, b)]


@lru_cache
def _changed(rule: str) -> dict[str, str]:
    """Each Han character that a transliteration changes, and what becomes of it."""
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    lines = session._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate("\n".join(_HAN)).split("\n")
    return {c: x for c, x in zip(_HAN, lines, strict=True) if c != x}


def to_simplified() -> dict[str, str]:
    """Traditional characters and their simplified form, one for one."""
    return {c: x for c, x in _changed("Hant-Hans").items() if len(x) == 1}


def to_traditional() -> dict[str, str]:
    """Simplified characters and their usual traditional form, one for one."""
    return {c: x for c, x in _changed("Hans-Hant").items() if len(x) == 1}


def _plain(reading: str) -> str:
    """A reading without its tone, in lower case; the letter ü is written v."""
    marked = unicodedata.normalize("NFD", unicodedata.normalize("NFC", reading).lower().replace("ü", "v").replace("ǖ", "v").replace("ǘ", "v").replace("ǚ", "v").replace("ǜ", "v"))
    return "".join(c for c in marked if not unicodedata.combining(c)).strip()


@lru_cache
def sounds() -> dict[str, str]:
    """The reading of each Han character in Latin letters, without tone."""
    every = {c: _plain(x) for c, x in _changed("Han-Latin").items()}
    return {c: x for c, x in every.items() if re.fullmatch("[a-z]+", x)}
