"""Words and shingle hashes of many texts at once, over the UTF-8 bytes of an Arrow column.

A word is a maximal run of ASCII letters, digits and bytes from 0x80 on, with A-Z lower-cased. A null text counts
as an empty one. Hashes are 64-bit sums of per-byte random values times powers of an odd number, so a word's hash
comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

U = np.uint64
WORD_BYTE = np.zeros(256, bool)
for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTE[lo:hi] = True
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers, from the 0th on, of the odd number and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    out = _powers[0], _powers[1]
    if n > 4 * SLICE_BYTES:  # don't hold on to what one huge text needed
        _powers[0] = _powers[1] = np.ones(1, np.uint64)
    return out


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column laid end to end, and the offset of each text; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text each, in all ``columns`` together."""
    at = sum(as_bytes(batch.column(batch.schema.get_field_index(c)))[1] for c in columns or ("text",))
    k = 0
    while k < batch.num_rows:
        stop = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        yield batch.slice(k, stop - k)
        k = stop


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the position in the list of words at which each text begins."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = WORD_BYTE[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a text, and the number of the text that each run is of. A text
    with fewer words than that has one shingle, of all its words; one without words has none."""
    counts = np.diff(bounds)
    whole = len(hashes) - size + 1
    if whole > 0:
        run = hashes[:whole].copy()
        factor = 1
        for k in range(1, size):
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
            run += hashes[k : k + whole] * U(factor)
        text = np.repeat(np.arange(len(counts)), counts)
        same = text[:whole] == text[size - 1 :]
        run, owner = mix(run[same]), text[:whole][same]
    else:
        run, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([_short(hashes[bounds[k] : bounds[k + 1]]) for k in short], np.uint64)
        run, owner = np.concatenate([run, extra]), np.concatenate([owner, short])
    return run, owner


def _short(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * 0xD6E8FEB86659FD93 + h) % (1 << 64)
    return total


def sequence_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that are equal for texts with the same words in the same order."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ mix(place.astype(np.uint64) * U(salt) + U(salt))), out=sums[1:])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]
