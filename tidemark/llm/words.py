"""The word rule that several operators share: runs of anything but space and the controls 09 to 0D."""

from __future__ import annotations

import re

import numpy as np

#: The separators between words.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_RE = r"[^\x20\x09-\x0D]+"


def spans(text: str | bytes, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by one space, as UTF-8, with each word's start and end in it."""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    words = WORD.findall(raw.lower() if lower else raw)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    return b" ".join(words), ends - size, ends
