"""What the tests of the operators share."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n",
    "a",
    "A b",
    " lead",
    "trail ",
    "two  spaces",
    "a\nb\n\nc\t d\r\ne",
    "é ﬁ ñ ß 漢字 😀😀 　x",
    "\x00\x1c zero",
    "it's we'll 'S ''s don't,' <s> </s> <unk> <0x41> ▁x▁",
    "x" * 5000,
    "=-" * 700 + " " * 77 + "////",
    "word " * 20000,
    "a!…b x²½ 3.14 1,000 _a_b __",
]


def lower_words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)
