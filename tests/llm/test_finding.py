"""The three engines have the same matches."""

import random

import regex

from tidewell.llm.bpe import _pattern
from tidewell.llm.finding import SPACE, Finder

ASCII = [chr(c) for c in range(128)]
BASIC = ASCII + list("éßΩжאم日本ーⅣ½²०٣\u0085\u00a0\u1680\u2003\u2028\u202f\u3000\u200b\u0301’“…_\ufeff\ud800")
FULL = BASIC + list("😀𝒜𝟘𐍈🀄")


def test_all_engines_agree():
    rng = random.Random(1)
    for build in (_pattern, lambda letters, digits, _: f"[{letters}{digits}]+"):
        find, full = Finder(build), regex.compile(build(r"\p{L}", r"\p{N}", SPACE)).findall
        for letters in (ASCII, BASIC, FULL):
            for _ in range(400):
                text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
                assert find(text) == full(text), text
    every = "".join(map(chr, range(0x10000)))
    assert find(every) == full(every)
