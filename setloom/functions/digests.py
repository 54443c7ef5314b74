"""MD5 of short texts about pairs of numbers, for many pairs at once: rows are arrays, a step of the digest is a few operations on them."""

from __future__ import annotations

from math import floor, sin

import numpy as np

#: Pairs that are worked on at once, so that what a step needs stays near the processor.
BATCH = 1 << 15
_K = [np.uint32(floor(abs(sin(k + 1)) * 2**32)) for k in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_WORD = [lambda k: k, lambda k: (5 * k + 1) % 16, lambda k: (3 * k + 5) % 16, lambda k: 7 * k % 16]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def leading_bits(words: list[np.ndarray | int]) -> np.ndarray:
    """The first 64 bits of the MD5 digests of texts of one block, given as its 16 padded words."""
    n = len(next(w for w in words if isinstance(w, np.ndarray)))
    a, b, c, d = (np.full(n, x) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        turn = k // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif turn == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:  # c ^ (b | ~d)
            np.invert(d, out=t)
            t |= b
            t ^= c
        word = words[_WORD[turn](k)]
        t += a
        if isinstance(word, np.ndarray):
            t += _K[k]
            t += word
        else:
            t += np.uint32((int(_K[k]) + word) & 0xFFFFFFFF)
        by = _TURNS[turn][k % 4]
        np.left_shift(t, np.uint32(by), out=u)
        t >>= np.uint32(32 - by)
        t |= u
        t += b
        a, d, c, b, t = d, c, b, t, a
    a += _START[0]
    b += _START[1]
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()


class _Texts:
    """Numbers as decimal texts, each followed by some more text."""

    def __init__(self, ids: np.ndarray, end: bytes):
        texts = np.char.add(ids.astype("S20"), end)
        self.size = np.char.str_len(texts)
        self.bytes = texts.view(np.uint8).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.uint8)

    def words(self, at: int, closed: bool) -> list[np.ndarray | None]:
        """The words of a block of which the texts begin at byte ``at``, none where all are 0; if ``closed``, with the bit that ends a
        message."""
        out = np.zeros((len(self.size), 56), np.uint8)
        width = min(self.bytes.shape[1], 56 - at)
        out[:, at : at + width] = self.bytes[:, :width]
        if closed:
            out[np.arange(len(out)), at + self.size] = 0x80
        return [np.ascontiguousarray(w, np.uint32) if w.any() else None for w in out.view("<u4").T]


class PairMarks:
    """Marks of pairs by the MD5 of ``row,column,seed``, and of ``column,row,seed``: of two digests, the less has the higher mark,
    as far as their first 52 bits differ."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, seed: int):
        self._first = [_Texts(x, b",") for x in (rows, columns)]
        self._second = [_Texts(x, f",{seed}".encode()) for x in (columns, rows)]
        self._words: dict[tuple[int, int], list[np.ndarray | None]] = {}

    def of(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._one(0, i, j), self._one(1, j, i)

    def _of(self, turned: int, at: int) -> list[np.ndarray | None]:
        if (turned, at) not in self._words:
            self._words[turned, at] = self._second[turned].words(at, True) if at else self._first[turned].words(0, False)
        return self._words[turned, at]

    def _one(self, turned: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.empty(len(first))
        sizes = self._first[turned].size[first]
        for at in np.unique(sizes).tolist():
            same = sizes == at
            some = slice(None) if same.all() else np.flatnonzero(same)
            out[some] = self._marks(turned, at, first[some], second[some])
        return out

    def _marks(self, turned: int, at: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.empty(len(first))
        begin, end, size = self._of(turned, 0), self._of(turned, at), self._second[turned].size
        for s in range(0, len(first), BATCH):
            f, g = first[s : s + BATCH], second[s : s + BATCH]
            words: list[np.ndarray | int] = []
            for x, y in zip(begin, end, strict=True):
                some = [w.take(k) for w, k in ((x, f), (y, g)) if w is not None]
                words.append(some[0] | some[1] if len(some) == 2 else some[0] if some else 0)
            words += [((at + size.take(g)) * 8).astype(np.uint32), 0]
            out[s : s + BATCH] = (1 << 52) - (leading_bits(words) >> np.uint64(12)).astype(np.float64)
        return out
