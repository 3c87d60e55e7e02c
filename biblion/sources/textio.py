"""Bytes to text, and places in text."""

from __future__ import annotations

import bisect
import codecs


def decode(data: bytes) -> tuple[str, str, bool]:
    """(text, encoding, had a byte-order mark): the mark, else UTF-8, GB 18030, Latin-1, in this order."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name, True
    for name in ("utf-8", "gb18030"):
        try:
            return data.decode(name), name, False
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1", False


class Lines:
    """Line and column (from 1, in code points) of an offset."""

    def __init__(self, text: str):
        self.starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1
