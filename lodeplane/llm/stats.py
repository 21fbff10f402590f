"""Statistics of a document's whole text, the inputs of the quality classifier and of the domain classifier."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

#: Names of the statistics, in order.
NAMES = ["log_chars", "log_words", "word_length", "letters", "digits", "spaces", "upper", "marks", "other_signs", "repeated_signs", "pipes", "exclaims", "distinct", "repeated", "capitals", "ends", "log_lines", "line_length", "same_lines", "long_words", "short_words", "bigram_repeats", "non_ascii", "entropy"]

LETTER, DIGIT, SPACE, MARK, SIGN = 1, 2, 3, 4, 5


@cache
def classes() -> np.ndarray:
    """For each code point of the first plane its class, plus 8 for upper case; others count as signs."""
    out = np.full(0x10001, SIGN, np.uint8)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            out[c] = LETTER + 8 * x.isupper()
        elif x.isdigit():
            out[c] = DIGIT
        elif x.isspace():
            out[c] = SPACE
        elif x in ".,;:?'\"-()":
            out[c] = MARK
    return out


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; null and empty texts give zeros. Time is in proportion to the length."""
    if not text:
        return [0.0] * len(NAMES)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = classes()[np.minimum(code, 0x10000)]
    n = len(code)
    by = np.bincount(kind, minlength=16)
    letters = by[LETTER] + by[LETTER + 8]
    sign = (kind == SIGN) | (kind == MARK)
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    ascii_ = code[code < 128]
    p = np.bincount(ascii_, minlength=128)
    p = p[p > 0] / max(1, len(ascii_))
    pairs = set(zip(words, words[1:])) if len(words) > 1 else ()
    return [
        math.log1p(n), math.log1p(len(words)), min(40.0, float(lengths.mean())), letters / n, by[DIGIT] / n, by[SPACE] / n,
        by[LETTER + 8] / max(1, letters), by[MARK] / n, by[SIGN] / n, float(np.count_nonzero(sign[1:] & (code[1:] == code[:-1]))) / n, text.count("|") / w, text.count("!") / w,
        len(set(words)) / w, sum(map(str.__eq__, words, words[1:])) / w, sum(1 for x in words if x[0].isupper()) / w, sum(1 for x in words if x[-1] in ".!?") / w,
        math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), float(np.count_nonzero(lengths > 20)) / w, float(np.count_nonzero(lengths < 3)) / w,
        1 - len(pairs) / max(1, len(words) - 1), float(np.count_nonzero(code > 127)) / n, float(-(p * np.log(p)).sum()),
    ]
