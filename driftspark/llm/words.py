"""Lower-case words of whole texts: runs of ASCII letters, digits and all characters above ASCII."""

from __future__ import annotations

import re
from collections.abc import Iterator

# On UTF-8 bytes with A-Z lowered; every byte of a character above ASCII is 0x80 or more.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
PIECE = 1 << 20


def word_lists(text: str | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of ``text`` (null: none) in order, as lists over pieces of about ``piece`` bytes.

    A piece ends between two words, so no word is cut and a very long text is never one list of words.
    """
    data = (text or "").encode("utf-8").lower()  # bytes.lower() changes A-Z only
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + piece)
        end = gap.start() if gap else len(data)
        yield _WORD.findall(data, at, end)
        at = end
