"""Character classes for Java regular expressions, made by rule from Python's Unicode data."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

#: White space as Python's str methods and \\s see it.
SPACE = r"[\x1c-\x1f\x{85}\p{IsWhite_Space}]"
#: A letter or digit that isn't a decimal digit, as Python's [^\\W\\d_].
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: A word: letters, with apostrophes inside.
WORD = rf"{LETTER}+(?:'{LETTER}+)*"
#: A word that may hold a typographic apostrophe too.
RAW_WORD = rf"{LETTER}+(?:['’]{LETTER}+)*"
#: Anything but Python's \\w, white space and the apostrophe.
PUNCTUATION = r"[^\p{L}\p{Nl}\p{No}\p{Nd}_'\x1c-\x1f\x{85}\p{IsWhite_Space}]"
#: Vowels that the restorer learns contexts for.
VOWELS = "aeiou"


@lru_cache(maxsize=1)
def combining_class() -> str:
    """A class of all characters whose canonical combining class isn't 0."""
    found, start, before = [], None, None
    for point in range(sys.maxunicode + 1):
        if unicodedata.combining(chr(point)):
            if start is None:
                start = point
            before = point
        elif start is not None:
            found.append((start, before))
            start = None
    ranges = "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in found)
    # All are from U+0300 on: that one comparison settles most characters before the ranges are gone through.
    return rf"[\x{{300}}-\x{{10ffff}}&&[{ranges}]]"
