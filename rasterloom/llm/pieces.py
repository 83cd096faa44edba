"""Cutting a text into the pre-tokens of the byte-level vocabularies, by whole-array operations.

The alternation of PATTERN, tried at each place in turn, comes down to a local rule for where a pre-token
begins: runs of one kind (letters, numbers, white space, other) stay together, the last white-space character
before something else begins a pre-token of its own, and if that character is a plain space the run after it
belongs to it too.  Only contractions need a second look: an apostrophe that begins a pre-token takes the
letters of a contraction with it and ends there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the splitting pattern that belongs to the rank files (public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

OTHER, LETTER, NUMBER, SPACE = range(4)

#: A single space between two characters that aren't white space always begins a pre-token.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def chunks(text: str, size: int = 1 << 18) -> Iterator[str]:
    """Parts of about `size` characters, cut only where a pre-token surely begins; one part where there is none."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size - 1)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point, from the regex library's own classes."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(what, every):
            first, last = ord(run[0][0]), ord(run[0][-1])
            table[first : last + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def starts(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in an array of code points, ascending."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[codes]
    space = kind == SPACE
    begins = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    # the last white space of a run before something else begins a pre-token; a plain space keeps the next run
    last = space[:-1] & ~space[1:]
    begins[:-1] |= last
    begins[1:] &= ~(last & (codes[:-1] == 32))
    marks = np.flatnonzero((codes == 39) & begins)
    if len(marks):
        contractions(codes, begins, marks.tolist())
    return np.flatnonzero(begins)


def contractions(codes: np.ndarray, begins: np.ndarray, marks: list[int]) -> None:
    """Correct begins for 's 't 'm 'd 're 've 'll at apostrophes that begin a pre-token."""
    n = len(codes)
    for i in marks:
        tail = "".join(map(chr, codes[i + 1 : i + 3].tolist()))
        size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            begins[i + 1 : i + 1 + size] = False
            if i + 1 + size < n:
                begins[i + 1 + size] = True


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text; joined, they are the text."""
    at = starts(codes_of(text)).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
