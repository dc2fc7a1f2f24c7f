"""SentencePiece (BPE model) encoding and decoding by suffix-array matching.

Texts are escaped as the model asks and cut where no piece can reach across (before a run of `▁` that follows
another character, and around characters no longer piece holds).  The distinct segments of a batch are
concatenated and indexed by a suffix array (sorted to the length of the longest piece); every piece's occurrence
range is found by binary search; the occurrences are the edges of a lattice, sorted by the position they end at
and relaxed in that order.

Relaxing for BPE: every prefix of a BPE encoding is the encoding of that prefix, and a sequence of pieces is the
encoding of its text exactly when each neighbouring pair is the encoding of the pair's text.  So the last piece
at a position is the one edge whose start has a last piece that it can follow; whether a pair can stand side by
side is decided by taking both pieces' merges back.  Pieces that BPE itself can't form, and segments with runs
of `▁` (whose merges all have the same score), are left to plain merging.

Defined results: null and empty texts have no pieces; characters without a piece come out as bytes; whole texts
are encoded; a null doc_id is passed through; repeated rows get equal results; an empty table gives an empty result; decoding gives the text back exactly, but for a literal `▁`, which comes
back as a space (`round_trip` is false there), and a model without byte pieces, which has its unknown piece for
such characters; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import small_batches
from kinweave.llm.token_counts import slices

SPACE = "▁"
#: Bytes of distinct segments that are indexed at a time (an index takes some 100 times as much memory).
INDEX_BYTES = 1_000_000
#: Segments that a worker remembers, and characters of them; beyond either it forgets all but the ones used most.
REMEMBERED, REMEMBERED_CHARS = 500_000, 24_000_000
#: Rows and bytes of texts that are encoded at a time.
SLICE = (4096, 8_000_000)
#: Characters that segments are cut at, the first that a text doesn't hold.
MARKS = ["\0", "\1", "\2", "\3", "\4", "\5", "\6", "\7", "\x0e", "\x0f", "\x10", "\x11", "\x12", "\x7f", "\ufdd0", "\ufdd1"]
#: Places of the table of decided pairs (a power of two).
PAIR_SLOTS = 1 << 20


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        i += 1
        if b[i - 1] < 128:
            return x, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialised protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Model:
    """Pieces, scores and kinds of a SentencePiece BPE model file, and the merges that form its pieces."""

    def __init__(self, path: str) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, self.squeeze, self.escape, kind = True, True, True, 1
        with open(path, "rb") as f:
            data = f.read()
        for tag, v in _fields(data):
            if tag == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: 1} | dict(_fields(v))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece[2], "<f4")[0]))
                self.kinds.append(piece[3])
            elif tag == 2:
                kind = dict(_fields(v)).get(3, 1)
            elif tag == 3:
                spec = dict(_fields(v))
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                if spec.get(2):
                    raise ValueError("models with a character map are not covered")
        if kind != 2 or self.squeeze or not self.escape:
            raise ValueError("a BPE model that keeps white space is needed")
        self.unknown = self.kinds.index(2)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1}
        long = [p for p in self.ids if len(p) > 1]
        # The rank of a merge is that of the piece it makes; single characters are never made.
        order = {s: r for r, s in enumerate(sorted({self.scores[self.ids[p]] for p in long}, reverse=True))}
        self.rank = np.full(len(self.pieces) + 1, -1, np.int64)
        for p in long:
            self.rank[self.ids[p]] = order[self.scores[self.ids[p]]]
        self.joined = set("".join(long))
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("pieces with ▁ after another character are not covered")
        self.cut = re.compile("(?<=[^▁])(?=▁)")
        self.left = np.arange(len(self.pieces) + 1)
        self.right = np.arange(len(self.pieces) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        for p in long:
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = self.ids[p]
        self.formed = np.zeros(len(self.pieces) + 1, bool)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.formed[i] = True
            else:
                last: list[tuple[int, int]] = []
                self.formed[i] = self.merge(p, last) == [i] and bool(last)
                if self.formed[i]:
                    self.left[i], self.right[i] = last[-1]
        self.text_bytes = [SPACE.encode() if p == SPACE else p.encode() for p in self.pieces]

    def chars(self, text: str) -> list[int]:
        """Ids of single characters; the number of pieces for those without one."""
        return [self.ids.get(c, len(self.pieces)) for c in text]

    def merge(self, text: str, made: list | None = None) -> list[int]:
        """Plain BPE: the best-scored neighbours first, the leftmost of equals."""
        ids, none = self.chars(text), len(self.pieces)
        n = len(ids)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and ids[i] != none and ids[j] != none:
                k = self.pairs.get((ids[i], ids[j]))
                if k is not None:
                    heapq.heappush(heap, (int(self.rank[k]), i, ids[i], ids[j], k))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, k = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            if made is not None:
                made.append((a, b))
            ids[i], alive[j], nxt[i] = k, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return [ids[i] for i in range(n) if alive[i]]

    def can_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves pieces a, b as they are when they stand side by side."""
        rank, limit = self.rank, 1 << 62
        while True:
            k = self.pairs.get((a, b))
            if k is not None and rank[k] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            # The later merge is taken back; of equal ones the right is later, and leaves the boundary its turn.
            if ra > rb:
                limit, a = ra, int(self.right[a])
            else:
                limit, b = rb + 1, int(self.left[b])


@lru_cache(maxsize=4)
def model_of(path: str) -> Model:
    return Model(path)


class Encoder:
    def __init__(self, model: Model) -> None:
        self.m = m = model
        use = [i for i in m.ids.values() if m.formed[i]]
        texts = [m.pieces[i].encode() for i in use]
        self.piece_id = np.array(use, np.int32)
        self.piece_len = np.array([len(t) for t in texts], np.int32)
        self.words = -(-int(self.piece_len.max()) // 8)
        wide = np.zeros((len(texts), 8 * self.words), np.uint8)
        high = np.full((len(texts), 8 * self.words), 255, np.uint8)
        for row, top, t in zip(wide, high, texts, strict=True):
            row[: len(t)] = top[: len(t)] = np.frombuffer(t, np.uint8)
        self.low, self.high = (x.view(">u8").astype(np.uint64) for x in (wide, high))
        self.slot_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.slot_ok = np.zeros(PAIR_SLOTS, bool)
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        # The ids of all known segments one after the other, where each one's begin, and in how many slices it was.
        self.store = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int32)
        self.chars = 0

    def _make_room(self) -> None:
        """Forget all but the most used half of the known segments."""
        names, size = list(self.known), np.diff(self.at)
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        length = np.cumsum([len(names[i]) for i in keep.tolist()])
        keep = keep[: int(np.searchsorted(length, REMEMBERED_CHARS // 2, "right"))]
        count = size[keep]
        total = np.cumsum(count)
        self.store = self.store[np.repeat(self.at[:-1][keep] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        self.at = np.concatenate([[0], total])
        self.uses = self.uses[keep] // 2
        self.known.clear()
        self.known.update((names[i], k) for k, i in enumerate(keep.tolist()))
        self.chars = int(length[len(keep) - 1]) if len(keep) else 0

    # -- suffix array ------------------------------------------------------------------------------------------

    def suffixes(self, buf: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes of the first n bytes, sorted by as many 8-byte words as the longest piece has; and these words."""
        u8 = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))
        sa = np.arange(n, dtype=np.int64)
        key = u8[:n].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sa, key = sa[order], key[order]
        group = np.concatenate([[False], key[1:] == key[:-1]])  # equal to the one before, so far
        for w in range(1, self.words):
            tied = group.copy()
            tied[:-1] |= group[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            block = np.cumsum(~group[at])
            more = u8[sa[at] + 8 * w].astype(np.uint64)
            order = np.lexsort((more, block))
            sa[at], more, block = sa[at[order]], more[order], block[order]
            same = np.concatenate([[False], (more[1:] == more[:-1]) & (block[1:] == block[:-1])])
            group[at] = same & group[at]
        return sa, u8

    def _bounds(self, sa: np.ndarray, u8: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of every row of `want` among the suffixes at once."""
        lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(sa), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            place, less, same = sa[mid], np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for w in range(self.words):
                have, need = u8[place + 8 * w].astype(np.uint64), want[open_, w]
                less |= same & (have < need)
                same &= have == need
                if not same.any():
                    break
            go = less | same if right else less
            lo[open_[go]], hi[open_[~go]] = mid[go] + 1, mid[~go]

    # -- lattice -----------------------------------------------------------------------------------------------

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`can_follow` of pairs, remembered in a table."""
        key = a.astype(np.int64) << 32 | b
        slot = ((key * 0x9E3779B97F4A7C1 >> 20) ^ key) & (PAIR_SLOTS - 1)
        out, miss = self.slot_ok[slot], self.slot_key[slot] != key
        if miss.any():
            new, back = np.unique(key[miss], return_inverse=True)
            ok = np.fromiter((self.m.can_follow(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))
            out[miss] = ok[back]
            where = slot[miss]
            self.slot_key[where], self.slot_ok[where] = key[miss], ok[back]
            # Of pairs that want one slot the last stays, key and answer together.
            self.slot_ok[where] = self.slot_ok[where] & (self.slot_key[where] == key[miss]) | ok[back] & (self.slot_key[where] == key[miss])
        return out

    def lattice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of segments without runs of ▁, one after the other, and their sizes; unknown characters come out
        as the number of pieces."""
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        buf = np.frombuffer(b"\xff".join(raw) + b"\xff" * (8 * self.words + 8), np.uint8)
        n = int(size.sum() + len(raw) - 1)
        begin = np.cumsum(size + 1) - size - 1
        sa, u8 = self.suffixes(buf, n)
        # Suffixes from a piece's bytes to its bytes followed by the largest ones: its occurrence range.
        first, last = self._bounds(sa, u8, self.low, False), self._bounds(sa, u8, self.high, True)
        times = last - first
        start = sa[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        piece, length = np.repeat(self.piece_id, times), np.repeat(self.piece_len, times)
        # A character without a piece is an edge of its own.
        heads = np.flatnonzero((buf[:n] < 0x80) | (buf[:n] >= 0xC0) & (buf[:n] < 0xFF))
        single = np.zeros(n, bool)
        width = np.where(buf[heads] < 0x80, 1, np.where(buf[heads] < 0xE0, 2, np.where(buf[heads] < 0xF0, 3, 4)))
        for w in (1, 2, 3, 4):
            pick = length == w
            one = np.zeros(n, bool)
            one[start[pick]] = True
            single[heads[width == w]] = one[heads[width == w]]
        lone = ~single[heads]
        start = np.concatenate([start, heads[lone]])
        piece = np.concatenate([piece, np.full(lone.sum(), len(self.m.pieces), np.int32)])
        length = np.concatenate([length, width[lone].astype(np.int32)])
        # Edges by the place they end at, counted within their segment.
        where = np.repeat(begin, size + 1)[: n + 1]
        end = start + length
        rel = end - where[start]
        order = np.argsort(rel.astype(np.uint16) if rel.max(initial=0) < 65536 else rel, kind="stable")
        start, end, piece, rel = start[order], end[order], piece[order], rel[order]
        tail = np.full(n + 1, -1, np.int64)  # the last piece of the prefix that ends here
        back = np.zeros(n + 1, np.int64)
        opening = np.zeros(n + 1, bool)
        opening[begin] = True
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rel)) + 1, [len(rel)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            first_piece = opening[s]
            before = tail[s]
            ok = first_piece.copy()
            ask = np.flatnonzero(~first_piece & (before >= 0))
            if len(ask):
                ok[ask] = self._follow(before[ask], p[ask])
            tail[e[ok]], back[e[ok]] = p[ok], s[ok]
        # Walk all segments back at once.
        at, seg = begin + size, np.arange(len(raw))
        got_seg, got_piece, got_at = [], [], []
        while True:
            on = at > begin[seg]
            at, seg = at[on], seg[on]
            if not len(at):
                break
            got_seg.append(seg)
            got_piece.append(tail[at])
            got_at.append(at)
            at = back[at]
        s, p, e = np.concatenate(got_seg), np.concatenate(got_piece), np.concatenate(got_at)
        # Places rise with segments, so sorting by place sorts by segment too.
        return p[np.argsort(e)].astype(np.int32), np.bincount(s, minlength=len(raw))

    # -- texts -------------------------------------------------------------------------------------------------

    def _bytes_for_unknown(self, ids: np.ndarray, text: str) -> np.ndarray:
        out: list[int] = []
        i = 0
        for k in ids.tolist():
            if k == len(self.m.pieces):
                own = text[i].encode()
                # Without byte pieces, neighbouring unknown characters are one unknown piece.
                out += [self.m.byte_ids[b] for b in own] if self.m.byte_ids else [] if out[-1:] == [self.m.unknown] else [self.m.unknown]
                i += 1
            else:
                out.append(k)
                i += len(self.m.pieces[k])
        return np.array(out, np.int32)

    def _learn(self, segments: list[str]) -> None:
        """Encode segments that aren't known yet."""
        plain: list[str] = []
        size = 0
        for s in segments:
            if not s or SPACE * 2 in s:
                self._remember([s], self._whole([self.m.merge(s)], [s]))
                continue
            plain.append(s)
            size += len(s) + 1
            if size > INDEX_BYTES:
                self._learn_plain(plain)
                plain, size = [], 0
        if plain:
            self._learn_plain(plain)

    def _learn_plain(self, part: list[str]) -> None:
        ids, n = self.lattice(part)
        lacking = np.zeros(len(part), bool)
        owner = np.repeat(np.arange(len(part)), n)
        lacking[owner[ids == len(self.m.pieces)]] = True
        end = np.cumsum(n)
        for i in np.flatnonzero(lacking).tolist():
            self._remember([part[i]], self._whole([ids[end[i] - n[i] : end[i]]], [part[i]]))
        self._remember([t for t, x in zip(part, lacking.tolist(), strict=True) if not x], (ids[~lacking[owner]], n[~lacking]))

    def _whole(self, rows: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [self._bytes_for_unknown(np.array(r, np.int32), t) for r, t in zip(rows, texts, strict=True)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def _remember(self, segments: list[str], found: tuple[np.ndarray, np.ndarray]) -> None:
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments)), strict=True))
        self.fresh.append(found)

    def segments(self, texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray]:
        """Segments of the escaped texts (which may begin with empty ones), and where each text's begin and end.

        `mark` is a character that none of the texts has.
        """
        texts = pc.fill_null(texts, "")
        if self.m.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        # Cut before each run of spaces (and ▁, which is the same) after another character, and around barriers.
        texts = pc.replace_substring(pc.replace_substring(texts, " ", SPACE), "\n", f"{mark}\n{mark}") if "\n" not in self.m.joined else pc.replace_substring(texts, " ", SPACE)
        texts = pc.replace_substring_regex(texts, f"([^▁\\x{{{ord(mark):x}}}])(▁)", f"\\1{mark}\\2")
        parts = pc.split_pattern(texts, mark)
        return parts.values, parts.offsets.to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin and end."""
        all_ids, all_n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part in slices(texts, *SLICE):
            odd = np.flatnonzero(pc.fill_null(pc.match_substring(part, MARKS[0]), False).to_numpy(zero_copy_only=False))
            if not len(odd):
                ids, n = self._encode_slice(part, MARKS[0])
            else:
                ids, n = self._encode_odd(part, odd)
            all_ids.append(ids)
            all_n.append(n)
        n = np.concatenate(all_n)
        return np.concatenate(all_ids), np.concatenate([[0], np.cumsum(n)])

    def _encode_odd(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A slice in which the texts at `odd` hold the usual mark: each goes with the first mark it has not."""
        by: dict[str | None, list[int]] = {MARKS[0]: np.setdiff1d(np.arange(len(texts)), odd).tolist()}
        for i in odd.tolist():
            t = texts[i].as_py()
            by.setdefault(next((m for m in MARKS if m not in t), None), []).append(i)
        rows: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for mark, own in by.items():
            if mark is None:
                for i in own:
                    rows[i] = self.encode_text(texts[i].as_py())
            elif own:
                ids, n = self._encode_slice(texts.take(pa.array(own)), mark)
                for i, r in zip(own, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    rows[i] = r
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def _encode_slice(self, texts: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        values, at = self.segments(texts, mark)
        coded = values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = (at - at[0]).astype(np.int64)
        if not len(coded):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if self.known and (len(self.known) + len(new) > REMEMBERED or self.chars + sum(map(len, new)) > REMEMBERED_CHARS):
            self._make_room()
            new = [w for w in words if w not in self.known]
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self._learn(new)
        if self.fresh:
            self.store = np.concatenate([self.store, *(ids for ids, _ in self.fresh)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate([n for _, n in self.fresh]))])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
            self.chars += sum(map(len, new))
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.uses[place] += 1
        place = place[coded.indices.to_numpy()]
        start, count = self.at[place], self.at[place + 1] - self.at[place]
        total = np.cumsum(count)
        ids = self.store[np.repeat(start - (total - count), count) + np.arange(total[-1])]
        total = np.concatenate([[0], total])
        return ids, total[at[1:]] - total[at[:-1]]

    def encode_text(self, text: str | None) -> np.ndarray:
        """One text that holds every mark, cut in Python."""
        if not text:
            return np.zeros(0, np.int32)
        escaped = (SPACE if self.m.dummy_prefix else "") + text.replace(" ", SPACE)
        out = [np.zeros(0, np.int32)]
        for s in self.m.cut.split(escaped):
            ids = np.array(self.m.merge(s), np.int32) if SPACE * 2 in s else self.lattice([s])[0]
            out.append(self._bytes_for_unknown(ids, s))
        return np.concatenate(out)


class Decoder:
    def __init__(self, model: Model) -> None:
        self.m = model
        raw = []
        for i, p in enumerate(model.pieces):
            kind = model.kinds[i]
            raw.append(bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " \u2047 ".encode() if kind == 2 else p.replace(SPACE, " ").encode())
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Bytes of each text; text i has the ids at[i] to at[i + 1]."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.at[ids] - total[:-1], size) + np.arange(total[-1])]
        begin, end = total[at[:-1]], total[at[1:]]
        if self.m.dummy_prefix and len(data):
            # The space that encoding put before the text.
            led = (end > begin) & (data[np.minimum(begin, len(data) - 1)] == 32)
            keep = np.ones(len(data), bool)
            keep[begin[led]] = False
            data = data[keep]
            lost = np.concatenate([[0], np.cumsum(led)])
            edge = np.concatenate([begin, end[-1:]]) - lost
        else:
            edge = total[at]
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids, and round_trip: whether decoding the ids gives the text's bytes back."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        encoder, decoder = Encoder(model), Decoder(model)
        for b in batches:
            ids_of, texts_of = b.column(0), b.column(1).cast(pa.large_string())
            done = 0
            for part in slices(texts_of, *SLICE):
                ids, at = encoder.encode(part)
                again = decoder.decode(ids, at)
                same = pc.equal(again, pc.fill_null(part, "").cast(pa.large_binary()))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids_of.slice(done, len(part)), pa.array(np.diff(at), pa.int64()), lists, same], names=["doc_id", "n_pieces", "ids", "round_trip"])
                done += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids.

    Null ids give an empty text, ids of bytes that are no UTF-8 a replacement character; a null doc_id is passed
    through, repeated rows stay, extra columns are ignored, an empty table gives an empty result.
    """
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model_of(path))
        for b in batches:
            lists = b.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            text = decoder.decode(lists.values.to_numpy()[at[0] : at[-1]], at - at[0])
            fixed = pa.array([t.decode("utf-8", "replace") for t in text.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), fixed], names=["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
