"""Patterns over letters, digits and white space by Unicode, matched by the fastest engine that a text allows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

# The Unicode property White_Space, which leaves out the separators U+001C to U+001F; first those of ASCII
_SPACE_ASCII = r"\t\n\x0b\x0c\r "
SPACE = _SPACE_ASCII + "\\x85\\xa0  -     　"
_BEYOND = re.compile("[\U00010000-\U0010ffff]").search


@lru_cache(maxsize=2)
def _plane(category: str) -> str:
    """The characters of a category in the basic plane, as ranges of a character class."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    ranges: list[list[int]] = []
    for c in map(ord, regex.findall(rf"\p{{{category}}}", every)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


class Finder:
    """All matches of a pattern in a text. ``build`` makes the pattern of the classes of letters, digits and white space.

    Most texts are ASCII or within the basic plane, where the standard library's engine has the same matches in half
    the time; the others go to the engine that knows the categories.
    """

    def __init__(self, build: Callable[[str, str, str], str]):
        self._ascii = re.compile(build("A-Za-z", "0-9", _SPACE_ASCII)).findall
        self._basic = re.compile(build(_plane("L"), _plane("N"), SPACE)).findall
        self._full = regex.compile(build(r"\p{L}", r"\p{N}", SPACE)).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii(text)
        return self._full(text) if _BEYOND(text) else self._basic(text)
