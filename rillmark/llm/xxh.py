"""XXH64 of many byte strings at once, after the published description of the algorithm."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def _wide(data: np.ndarray, kind: str) -> np.ndarray:
    """A number of several bytes from each place of the data."""
    return np.ndarray(len(data) - np.dtype(kind).itemsize + 1, kind, data, 0, (1,))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """The unsigned digests of data[start:start+length] for each start and length; all strings advance together."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight, four = _wide(data, "<u8"), _wide(data, "<u4")
    with np.errstate(over="ignore"):
        seed = np.uint64(seed & (2**64 - 1))
        at, left = start.astype(np.int64), length.astype(np.int64)
        out = np.full(len(at), seed + P5, np.uint64)
        big = np.flatnonzero(left >= 32)
        if len(big):
            acc = [np.full(len(big), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            live = np.arange(len(big))
            while len(live):
                here = at[big[live]]
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], eight[here + 8 * i])
                at[big[live]] += 32
                left[big[live]] -= 32
                live = live[left[big[live]] >= 32]
            mixed = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for x in acc:
                mixed = (mixed ^ _round(np.zeros(len(x), np.uint64), x)) * P1 + P4
            out[big] = mixed
        out += length.astype(np.uint64)
        for size, view in ((8, eight), (4, four), (1, data)):
            live = np.flatnonzero(left >= size)
            while len(live):
                lane, was = view[at[live]].astype(np.uint64), out[live]
                if size == 8:
                    out[live] = _turn(was ^ _round(np.zeros(len(live), np.uint64), lane), 27) * P1 + P4
                elif size == 4:
                    out[live] = _turn(was ^ (lane * P1), 23) * P2 + P3
                else:
                    out[live] = _turn(was ^ (lane * P5), 11) * P1
                at[live] += size
                left[live] -= size
                live = live[left[live] >= size]
        out = (out ^ (out >> np.uint64(33))) * P2
        out = (out ^ (out >> np.uint64(29))) * P3
        return out ^ (out >> np.uint64(32))
