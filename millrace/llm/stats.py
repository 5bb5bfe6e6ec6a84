"""Counts of a text's structure, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import re

import numpy as np

#: Counts per text, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits",
          "n_marks", "n_stops", "n_bare")

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
CONTINUATION = bytes(range(0x80, 0xC0))
SPACES = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))
BARE = re.compile(rb"(?:^|[ \t\n\r\x0b\x0c])[^0-9A-Za-z\x80-\xff \t\n\r\x0b\x0c]+(?=[ \t\n\r\x0b\x0c]|$)")


def count_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
    # Pairs are numbered anew before the next word joins them, so that no key overflows.
    key = at[:n]
    for k in range(1, size):
        key = np.unique(key * len(numbers) + at[k:k + n], return_inverse=True)[1]
    often = np.bincount(key)[key] > 1
    hit = np.zeros(len(words), bool)
    for k in range(size):
        hit[k:k + n] |= often
    return int(hit.sum())


def structure(text: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of a text; words are parted by ASCII white space, code points are counted, not bytes."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()] if text else []
    upper = count_of(text, UPPER)
    letters = upper + count_of(text, LOWER) + count_of(text, CONTINUATION)
    return (len(words), len(text) - count_of(text, CONTINUATION) - count_of(text, SPACES), count_of(text, SYMBOLS),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), letters, upper, count_of(text, DIGITS),
            count_of(text, b"!"), count_of(text, b"."), len(BARE.findall(text)))


def shares(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Scale-free measures from an array of counts (one row for each text)."""
    c = {name: counts[:, k].astype(np.float64) for k, name in enumerate(COUNTS)}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    return {"words": c["n_words"], "word_length": c["word_chars"] / words, "symbols": c["n_symbols"] / words, "dup_lines": c["n_dup_lines"] / lines,
            "repeats": c["n_repeat_words"] / words, "upper": c["n_upper"] / np.maximum(c["n_letters"], 1), "digits": c["n_digits"] / np.maximum(c["word_chars"], 1),
            "marks": c["n_marks"] / words, "stops": c["n_stops"] / words, "bare": c["n_bare"] / words, "line_words": c["n_words"] / lines}
