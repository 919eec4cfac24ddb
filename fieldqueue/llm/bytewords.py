"""Words of digits, letters and all that isn't ASCII, A-Z lower-cased, as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of words stay, A-Z as a-z; all others part words. Every byte of a character beyond ASCII belongs to a word.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split into words at once, about.
PIECE = 1 << 20


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).fill_null(b"").to_pylist()


def runs(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about `piece` bytes; a longer word is whole."""
    raw = raw.translate(WORDS)
    i = 0
    while len(raw) - i > piece and (j := raw.find(b" ", i + piece)) >= 0:
        yield raw[i:j].split()
        i = j
    yield raw[i:].split()


def grams(raw: bytes, longest: int, piece: int = PIECE) -> Iterator[list[bytes]]:
    """All runs of 1 to `longest` consecutive words of a text, joined by one space, repeats included."""
    tail: list[bytes] = []
    for words in runs(raw, piece):
        yield words
        both = tail + words
        for n in range(2, longest + 1):
            own = both[max(0, len(tail) - n + 1) :]
            yield [b" ".join(x) for x in zip(*[own[i:] for i in range(n)])]
        tail = both[len(both) - longest + 1 :] if longest > 1 else []
