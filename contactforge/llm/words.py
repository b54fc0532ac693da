"""Words of whole texts as bytes, in blocks, so that a very long text is never one list of words."""
from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once.
BLOCK = 1 << 20


def splitter(separators: bytes) -> bytes:
    """Translation that lower-cases A-Z and turns each separator into a blank. Bytes of other characters than ASCII stay."""
    out = bytearray(range(256))
    out[65:91] = range(97, 123)
    for b in separators:
        out[b] = 32
    return bytes(out)


def word_blocks(text: bytes, table: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words between separators, in order, from about ``size`` bytes at a time; a longer word is taken whole."""
    carry: list[bytes] = []
    for start in range(0, len(text), size):
        part = text[start : start + size].translate(table)
        cut = part.rfind(b" ")
        if cut < 0:
            carry.append(part)
            continue
        carry.append(part[:cut])
        yield b"".join(carry).split()
        carry = [part[cut + 1 :]]
    if carry:
        yield b"".join(carry).split()
