"""Words of a batch of texts by array operations on its bytes.

A batch's texts lie one after the other in one byte buffer. Word borders, word
hashes and hashes of consecutive words are found for the whole buffer at once;
nothing here makes a Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20  # texts handled at once; a longer text is handled alone
TEXTS = 256  # texts that are Python objects at once
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_MIX = (_U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F))
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=_U)


def byte_set(chars: str) -> np.ndarray:
    """256 booleans, true for the given ASCII characters."""
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


SPACES = byte_set(" \t\n\x0b\x0c\r")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string column without nulls."""
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def released(run: Callable) -> Callable:
    """``run`` over the batches of a task; a worker that waits for the next one holds no free Arrow memory."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
    return whole


def strings(texts: pa.Array, step: int = TEXTS) -> Iterator[str | None]:
    """The values of a string column, ``step`` of them as Python objects at a time."""
    for at in range(0, len(texts), step):
        yield from texts.slice(at, step).to_pylist()


def borders(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the maximal runs of ``inside`` within a text."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts, ends = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all of it."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _MIX[0]
        x = (x ^ (x >> _U(29))) * _MIX[1]
        return x ^ (x >> _U(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes, eight bytes at a step."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    size = ends - starts
    with np.errstate(over="ignore"):
        h = eights[starts].view("<u8").ravel() & _KEEP[np.minimum(size, 8)]
        h = mix(h + size.astype(_U) * _MULT)
        left, at = np.nonzero(size > 8)[0], 8
        while len(left):
            more = eights[starts[left] + at].view("<u8").ravel() & _KEEP[np.minimum(size[left] - at, 8)]
            h[left] = mix(h[left] * _MULT + more)
            at += 8
            left = left[size[left] > at]
    return h


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive values (n - width + 1 of them), by doubling."""
    if len(h) < width:
        return np.zeros(0, dtype=_U)

    def factor(w: int) -> np.uint64:
        return _U(pow(int(_MULT), w, 1 << 64))

    with np.errstate(over="ignore"):
        out, have, step, size = None, 0, h, 1
        while True:
            if width & size:
                # what is there already, followed by the next ``size`` values
                out = step if out is None else out[:len(step) - have] * factor(size) + step[have:]
                have += size
            if 2 * size > width:
                return mix(out[:len(h) - width + 1])
            step = step[:-size] * factor(size) + step[size:]
            size *= 2


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def joined(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(all words, each followed by one space; each word's place in it)."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[at + size - 1] = False
    out[keep] = data[inside]
    return out.tobytes(), at


def counted(h: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, an index of each, how often or the sum of its weights)."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1])
    if weight is None:
        n = np.diff(np.concatenate([first, [len(s)]]))
    else:
        n = np.add.reduceat(weight[order], first)
    return s[first], order[first], n.astype(np.int64)
