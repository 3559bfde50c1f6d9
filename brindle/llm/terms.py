"""Terms of a text, as the collection-wide operators count them.

A term is a maximal run of letters (L), nonspacing marks (Mn), decimal digits (Nd), connector punctuation (Pc)
and hyphen-minus in the lower-cased text that holds at least one letter. A null or empty text has no terms.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache


def _ranges(accept, low: int, high: int) -> str:
    """Character class body of all code points in [low, high) that ``accept``."""
    out, start = [], None
    for code in range(low, high + 1):
        inside = code < high and accept(code)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def _is_term_char(code: int) -> bool:
    kind = unicodedata.category(chr(code))
    return kind[0] == "L" or kind in ("Mn", "Nd", "Pc") or code == 0x2D


# Planes beyond the basic one that hold letters, marks or digits: 1 to 3, and the variation selectors of plane 14; the rest is unassigned or private.
_BEYOND = ((0x10000, 0x40000), (0xE0000, 0xE1000))


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Runs in the basic plane, runs in any plane, and a test for a code point beyond the basic plane."""
    basic = _ranges(_is_term_char, 0, 0x10000)
    rest = "".join(_ranges(_is_term_char, *plane) for plane in _BEYOND)
    return re.compile(f"[{basic}]+"), re.compile(f"[{basic}{rest}]+"), re.compile("[\U00010000-\U0010ffff]")


_has_letter = re.compile(r"[^\W\d_]").search


def has_letter(piece: str) -> bool:
    # \w without digits and underscore still admits No/Nl characters, which are no letters
    return _has_letter(piece) is not None and any(unicodedata.category(c)[0] == "L" for c in piece)


class _Lettered(dict):
    """Whether a piece holds a letter, found out once for each piece."""

    def __missing__(self, piece: str) -> bool:
        self[piece] = found = has_letter(piece)
        return found


class TermSplitter:
    """Splits texts into terms; remembers which pieces hold a letter (one instance per task)."""

    LIMIT = 1 << 18  # remembered pieces; beyond it the memory starts anew, results stay the same

    def __init__(self) -> None:
        self._basic, self._any, self._astral = _patterns()
        self._known = _Lettered()

    def pieces(self, text: str | None) -> list[str]:
        """The runs of term characters, those without any letter, which are no terms, among them."""
        if not text:
            return []
        text = text.lower()
        run = self._basic if text.isascii() or not self._astral.search(text) else self._any
        return run.findall(text)

    def split(self, text: str | None) -> list[str]:
        if len(self._known) > self.LIMIT:
            self._known.clear()
        return list(filter(self._known.__getitem__, self.pieces(text)))
