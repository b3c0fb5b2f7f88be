"""Counts over one whole text, exact and linear in its length.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. All counts are taken on UTF-8 bytes, where these
separators are single bytes that occur nowhere else.
"""

from __future__ import annotations

import numpy as np

WINDOW = 5
_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper", "n_letters", "n_digits", "n_exclaim", "n_pipes", "n_stops", "n_commas", "n_short_words", "n_long_words", "n_top_word",
)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows that occur at least twice.

    ids: the number of each word, 0 to distinct - 1. Windows are numbered exactly:
    as many word numbers as 63 bits hold are joined at a time, then ranked anew.
    """
    if len(ids) <= window or distinct == len(ids):
        return 0
    count = len(ids) - window + 1
    code, size = ids[:count].astype(np.int64), max(distinct, 1)
    for k in range(1, window):
        if size * distinct >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            size = count
        code = code * distinct + ids[k : k + count]
        size *= distinct
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(code, twice))
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts named in FIELDS; all 0 for null and empty texts."""
    data = utf8(text)
    words = data.split()
    if not words:
        return (0,) * len(FIELDS)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return (
        len(words),
        int(len(data) - histogram[128:192].sum() - histogram[_SPACES].sum()),
        int(histogram[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(number)),
        len(lines),
        len(number),
        int(histogram[65:91].sum()),
        int(histogram[65:91].sum() + histogram[97:123].sum() + histogram[192:256].sum()),
        int(histogram[48:58].sum()),
        int(histogram[33]),
        int(histogram[124]),
        int(histogram[46]),
        int(histogram[44]),
        int((lengths <= 3).sum()),
        int((lengths >= 16).sum()),
        int(np.bincount(ids).max()),
    )
