"""Vectorised 64-bit hashing of byte slices and word shingles."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def padded(parts: list[bytes]) -> np.ndarray:
    """The parts one after the other as bytes, with room for reads beyond the end."""
    return np.frombuffer(b"".join([*parts, b"\0" * 40]), np.uint8)


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42, block: int = 1 << 15) -> np.ndarray:
    """XXH64 of the slices buf[start : start + length]; `buf` must reach 32 bytes past every slice."""
    if len(start) > block:
        return np.concatenate([xxh64(buf, start[i : i + block], length[i : i + block], seed, block) for i in range(0, len(start), block)])
    u8 = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    u4 = np.ndarray((len(buf) - 3,), "<u4", buf, 0, (1,))
    start, length = start.astype(np.int64), length.astype(np.int64)
    pos, seed = start.copy(), np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed + P5, np.uint64)
        far = np.flatnonzero(length >= 32)
        if len(far):
            acc = [np.full(len(far), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            left = length[far] // 32
            k = 0
            while True:
                on = np.flatnonzero(left > k)
                if not len(on):
                    break
                at = start[far[on]] + 32 * k
                for j in range(4):
                    acc[j][on] = _round(acc[j][on], u8[at + 8 * j])
                k += 1
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                v = (v ^ _round(np.uint64(0), a)) * P1 + P4
            h[far] = v
            pos[far] += 32 * left
        h += length.astype(np.uint64)
        rest = length % 32
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            if len(on):
                h[on] = _rotl(h[on] ^ _round(np.uint64(0), u8[pos[on] + 8 * k]), 27) * P1 + P4
        pos += rest // 8 * 8
        on = np.flatnonzero(rest % 8 >= 4)
        if len(on):
            h[on] = _rotl(h[on] ^ (u4[pos[on]].astype(np.uint64) * P1), 23) * P2 + P3
            pos[on] += 4
        tail = rest % 4
        for k in range(3):
            on = np.flatnonzero(tail > k)
            if len(on):
                h[on] = _rotl(h[on] ^ (buf[pos[on] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_in(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of words joined by one space each: the buffer, each word's start and end, and each text's number of words."""
    joined = padded([p + b" " for p in parts])
    used = len(joined) - 40
    end = np.flatnonzero(joined[:used] == 32)
    start = np.empty_like(end)
    if len(end):
        start[0], start[1:] = 0, end[:-1] + 1
    counts = np.fromiter((p.count(b" ") + 1 for p in parts), np.int64, len(parts))
    return joined, start, end, counts
