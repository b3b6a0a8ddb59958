"""Terms of whole texts inside a task: bytes are mapped by a table and split, so no term is a Python string."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once; a longer text goes through in pieces cut between terms.
PIECE = 1 << 20


def term_table(digits: bool) -> bytes:
    """A-Z become a-z; a-z, all bytes of non-ASCII characters and, if asked, digits stay; every other byte becomes a space."""
    kept = {*range(128, 256), *range(ord("a"), ord("z") + 1), *(range(ord("0"), ord("9") + 1) if digits else ())}
    return bytes(b + 32 if ord("A") <= b <= ord("Z") else b if b in kept else 32 for b in range(256))


def term_pieces(text: str | None, table: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists of about `most` bytes of text each; a null text gives one empty list."""
    data, a = (text or "").encode().translate(table), 0
    while len(data) - a > most and (b := data.find(b" ", a + most)) >= 0:
        yield data[a:b].split()
        a = b
    yield data[a:].split()
