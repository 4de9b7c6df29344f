"""Words of many texts at once: white space found and words hashed on the bytes of whole batches."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Fixed set of the query contracts: ASCII white space divides words.
SPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
#: Fixed set of the query contracts: all of ASCII but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> _SHIFT)) * _MIX_1
    h = (h ^ (h >> _SHIFT)) * _MIX_2
    return h ^ (h >> _SHIFT)


class Words(NamedTuple):
    raw: np.ndarray  # the bytes of all texts, A-Z in lower case, each text ended by a new line
    start: np.ndarray  # of each word in raw
    end: np.ndarray
    hash: np.ndarray  # uint64
    text: np.ndarray  # position of the first word of each text, and the number of words


def coded(texts: list[str | bytes | None]) -> list[bytes]:
    return [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]


def words_of(texts: list[str | bytes | None], lower: bool = True, between: np.ndarray = _IS_SPACE) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z in lower case if asked; none for null.

    between marks the bytes that divide words, if not ASCII white space; the new line must be one of them.
    """
    parts = coded(texts)
    joined = b"\n".join(parts) + b"\n"
    joined = joined.lower() if lower else joined  # bytes.lower() changes A-Z only
    raw = np.frombuffer(joined + b"\0" * 8, np.uint8)
    space = between[raw[:-8]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    size = end - start
    chunks = np.ndarray((len(joined) + 1,), "<u8", joined + b"\0" * 8, 0, (1,))
    h = mixed((chunks[start] & _KEEP[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _MIX_2)
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        part = chunks[start[more] + at] & _KEEP[np.minimum(size[more] - at, 8)]
        h[more] = mixed(h[more] * _MIX_1 ^ part)
        at += 8
        more = more[size[more] > at]
    bounds = np.cumsum([0, *(len(c) + 1 for c in parts)])
    return Words(raw, start, end, h, np.searchsorted(start, bounds))


def batches_of_text(batches, column: str = "text", most_bytes: int = 16_000_000):
    """Slices of Arrow batches with at most about most_bytes of text, or one text."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(sizes):
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
            yield batch.slice(at, upto - at)
            at = upto
