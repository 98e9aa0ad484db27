"""Many short texts looked up as substrings of many long ones, byte by byte.

Each wanted text has an anchor: ``WIDTHS`` bytes of it, the widest that fits, at the
place that fewest of the other wanted texts share.  The hash of the bytes at every
position of the long texts is looked up among the anchors', and where one fits the
whole wanted text is compared.  So the work grows with the long texts and with what
is found, not with the wanted texts.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Functions that run on executors are pickled with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTHS = (1, 2, 4, 8, 16, 32)
#: Places of a wanted text that may become its anchor: every so many bytes.
STEP = 4
#: Positions, or places to compare, that are held at a time.
CHUNK = 1 << 20
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(raw: np.ndarray, first: int, count: int, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes at each of ``count`` positions; ``raw`` has 32 bytes more than its texts."""
    def words(k: int) -> np.ndarray:
        return np.ndarray((count,), "<u8", raw, first + k, (1,))

    if width < 8:
        return (words(0) & np.uint64((1 << 8 * width) - 1)) * _MIX
    h = words(0) * _MIX
    for k in range(8, width, 8):
        h ^= h >> np.uint64(29)
        h += words(k)
        h *= _MIX
    return h


def padded(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, column by column, and 32 more; n + 1 offsets)."""
    data, offs, size = [], [np.zeros(1, np.int64)], 0
    for col in columns:
        col = col.cast(pa.large_binary()).fill_null(b"")
        _, places, held = col.buffers()
        at = np.frombuffer(places, np.int64)[col.offset:col.offset + len(col) + 1]
        if len(col):
            data.append(np.frombuffer(held, np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8))
            offs.append(at[1:] - at[0] + size)
            size += int(at[-1] - at[0])
    return np.concatenate([*data, np.zeros(32, np.uint8)]), np.concatenate(offs)


@dataclass
class Wanted:
    """Texts that are looked up, with the anchors of each width: (width, distinct hashes, first and number of their
    texts in the list of texts, that list)."""

    texts: list[bytes]
    sizes: np.ndarray
    anchors: np.ndarray   # place of each text's anchor
    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def found(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(long text, wanted text) of all that are found, each once, in order."""
        data, many, out = raw.tobytes(), max(len(self.texts), 1), [np.empty(0, np.int64)]
        for width, keys, starts, counts, members in self.tables:
            likely = np.zeros(1 << _BITS, bool)
            likely[keys >> np.uint64(64 - _BITS)] = True
            for first in range(0, len(raw) - 32, CHUNK):
                h = _hashes(raw, first, min(CHUNK, len(raw) - 32 - first), width)
                at = np.flatnonzero(likely[h >> np.uint64(64 - _BITS)])
                key = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                same = keys[key] == h[at]
                at, key = at[same] + first, key[same]
                ends = np.cumsum(counts[key])
                lo = 0
                while lo < len(at):  # one position at least
                    done = ends[lo - 1] if lo else 0
                    hi = max(int(np.searchsorted(ends, done + CHUNK, "right")), lo + 1)
                    n = counts[key[lo:hi]]
                    inner = np.arange(ends[hi - 1] - done) - np.repeat(ends[lo:hi] - n - done, n)
                    text = members[np.repeat(starts[key[lo:hi]], n) + inner]
                    out.append(self._compared(data, offs, text, np.repeat(at[lo:hi], n) - self.anchors[text]))
                    lo = hi
        pairs = np.unique(np.concatenate(out))
        return pairs // many, pairs % many

    def _compared(self, data: bytes, offs: np.ndarray, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        inside = np.searchsorted(offs, begin, "right") - 1
        fits = (begin >= 0) & (begin + self.sizes[text] <= offs[np.minimum(inside + 1, len(offs) - 1)])
        inside, text, begin = inside[fits], text[fits], begin[fits]
        same = np.fromiter((data.startswith(self.texts[t], b) for t, b in zip(text.tolist(), begin.tolist())), bool, len(text))
        return np.unique(inside[same] * len(self.texts) + text[same])


def wanted(texts: list[bytes]) -> Wanted:
    """The texts with their anchors; none may be empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(texts) + bytes(32), np.uint8)
    anchors, tables = np.zeros(len(texts), np.int64), []
    for width, wider in zip(WIDTHS, [*WIDTHS[1:], 1 << 62]):
        mine = np.flatnonzero((sizes >= width) & (sizes < wider))
        if not len(mine):
            continue
        places = (sizes[mine] - width) // STEP + 1
        first = np.cumsum(places) - places
        text = np.repeat(np.arange(len(mine)), places)
        off = (np.arange(places.sum()) - first[text]) * STEP
        h = _hashes(raw, 0, len(raw) - 32, width)[starts[mine][text] + off]
        _, kind, shared = np.unique(h, return_inverse=True, return_counts=True)
        shared = shared[kind]
        least = np.flatnonzero(shared == np.minimum.reduceat(shared, first)[text])
        best = least[np.unique(text[least], return_index=True)[1]]
        anchors[mine] = off[best]
        order = np.argsort(h[best], kind="stable")
        keys, begin, count = np.unique(h[best][order], return_index=True, return_counts=True)
        tables.append((width, keys, begin, count, mine[order]))
    return Wanted(texts, sizes, anchors, tables)
