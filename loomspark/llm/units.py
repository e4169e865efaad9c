"""Cutting texts where the usual byte-level pattern never matches across: at single spaces between two
characters that aren't white space (``cut``), or before spaces and line ends that follow such a character (``mark``)."""

from __future__ import annotations

import re

_UNIT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and the line end.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def cut(text: str) -> list[str]:
    """The units of a text, without the space between them; none for the empty text."""
    if not text:
        return []
    # every space stands between two other characters, none of them a line end, and there is no other white space
    if text[0] != " " != text[-1] and "  " not in text and " \n" not in text and "\n " not in text and not any(c in text for c in _OTHER):
        return text.split(" ")
    return _UNIT.split(text)


_BEFORE = re.compile(r"(?<=\S)(?=[ \n])")


def absent(texts: list[str]) -> str | None:
    """A character, no space or line end, that none of the texts holds; None if they hold all below the surrogates."""
    return next((c for c in map(chr, range(0xD800)) if c not in " \n" and not any(c in t for t in texts)), None)


def mark(text: str, sign: str) -> str:
    """The text with the sign before each space and line end that follows another character than white space, where
    the pattern always ends a match."""
    # as above, and line ends stand alone too
    if text[:1] not in " \n" and "  " not in text and " \n" not in text and "\n " not in text and "\n\n" not in text and not any(c in text for c in _OTHER):
        return text.replace(" ", sign + " ").replace("\n", sign + "\n")
    return _BEFORE.sub(lambda m: sign, text)
