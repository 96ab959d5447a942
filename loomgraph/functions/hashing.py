"""Randomness that depends on keys alone: the same in every run, partitioning and engine."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(*keys: Column | str) -> Column:
    """A whole number below 2 ** 32 from the first eight hex digits of md5 over the keys as text, joined by '|'."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket(n: int, *keys: Column | str) -> Column:
    """md5_number below n (the modulus bias is under n / 2 ** 32)."""
    return F.pmod(md5_number(*keys), F.lit(n))


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1.0)) * (1 << 32)) for i in range(64)]


def _md5_heads(words: list) -> np.ndarray:
    """md5_number of messages of one block; words: its 16 words, arrays or numbers."""
    n = next(len(x) for x in words if not isinstance(x, int))
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f = np.empty(n, np.uint32)
    for i in range(61):  # the last three steps do not touch the first word
        turn = i >> 4
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] & 15
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        fixed = isinstance(words[g], int)
        f += np.uint32(_SINES[i] + (words[g] if fixed else 0) & 0xFFFFFFFF)
        if not fixed:
            f += words[g]
        s = _TURNS[turn][i & 3]
        np.left_shift(f, np.uint32(s), out=a)
        np.right_shift(f, np.uint32(32 - s), out=f)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(0x67452301)
    return b.byteswap().astype(np.int64)


def md5_numbers(*keys: np.ndarray, tail: str = "", stretch: int = 1 << 14) -> np.ndarray:
    """md5_number of rows of whole numbers and a last key that is the same for all, without text: a step of md5 at a time for a stretch of rows."""
    keys = [np.asarray(k, np.int64) for k in keys]
    out = np.empty(len(keys[0]), np.int64)
    end = f"|{tail}".encode() if tail else b""
    for k in range(0, len(out), stretch):
        part = [x[k : k + stretch] for x in keys]
        lengths = [np.searchsorted(_TENS, x, "right") for x in part]
        shape = np.zeros(len(part[0]), np.int64)
        for x, n in zip(part, lengths):
            shape = np.where((shape < 0) | (x < 0), -1, shape * 20 + n)
        for one in np.unique(shape).tolist():
            at = np.flatnonzero(shape == one)
            size = sum(int(n[at[0]]) for n in lengths) + len(keys) - 1 + len(end)
            if one < 0 or size > 55:
                texts = ("|".join(map(str, row)).encode() + end for row in zip(*(x[at].tolist() for x in part)))
                out[k + at] = [int.from_bytes(hashlib.md5(t).digest()[:4], "big") for t in texts]
                continue
            text = np.zeros((64, len(at)), np.uint32)
            pos = 0
            for i, (x, n) in enumerate(zip(part, lengths)):
                if i:
                    text[pos] = ord("|")
                    pos += 1
                rest, n = x[at], int(n[at[0]])
                for j in range(pos + n - 1, pos - 1, -1):
                    less = rest // 10
                    text[j] = rest - 10 * less + 48
                    rest = less
                pos += n
            for x in (*end, 0x80):
                text[pos] = x
                pos += 1
            words: list = [text[j] | text[j + 1] << np.uint32(8) | text[j + 2] << np.uint32(16) | text[j + 3] << np.uint32(24) for j in range(0, pos, 4)]
            words += [0] * (16 - len(words))
            words[14] = 8 * size
            out[k + at] = _md5_heads(words)
    return out


#: A number has as many digits as there are powers here that it reaches; zero has one.
_TENS = np.array([-(1 << 63)] + [10**k for k in range(1, 19)], np.int64)


def _digits(numbers: np.ndarray, sizes: np.ndarray, at: int, last: bytes) -> np.ndarray:
    """Words (a row for each four bytes) of a text with the number from byte `at` on, then `last`, else zeros."""
    text = np.zeros((len(numbers), (at + 20 + len(last) + 3) // 4 * 4), np.uint8)
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        rest = numbers[of]
        for j in range(at + n - 1, at - 1, -1):
            less = rest // 10
            text[of, j] = rest - 10 * less + 48
            rest = less
        text[of, at + n : at + n + len(last)] = list(last)
    return np.ascontiguousarray(text.view("<u4").T)


class PairNumbers:
    """md5_numbers of pairs (source, end) whose ends are a fixed array, with a tail of up to 14 bytes: the text of an end is laid out once for each length of what stands before it."""

    def __init__(self, ends: np.ndarray, tail: str = ""):
        self.ends, self.sizes = ends, np.searchsorted(_TENS, ends, "right")
        self.tail, self.end = tail, f"|{tail}".encode() if tail else b""
        self.plain = bool(len(ends)) and int(ends.min()) >= 0
        self.words: dict[int, np.ndarray] = {}

    def of(self, sources: np.ndarray, row: np.ndarray, place: np.ndarray, stretch: int = 1 << 15) -> np.ndarray:
        """The numbers of the pairs (sources[row], ends[place])."""
        if not self.plain or int(sources.min()) < 0:
            return md5_numbers(sources[row], self.ends[place], tail=self.tail)
        sizes = np.searchsorted(_TENS, sources, "right")
        before = _digits(sources, sizes, 0, b"|")
        shape = (sizes * 20)[row] + self.sizes[place]
        out = np.empty(len(place), np.int64)
        for one in np.flatnonzero(np.bincount(shape)).tolist():
            n, size = one // 20, one // 20 + 1 + one % 20 + len(self.end)
            if n not in self.words:
                self.words[n] = _digits(self.ends, self.sizes, n + 1, self.end + b"\x80")
            after, at = self.words[n], np.flatnonzero(shape == one)
            for k in range(0, len(at), stretch):
                some = at[k : k + stretch]
                r, p = row[some], place[some]
                words: list = [before[j][r] | after[j][p] if 4 * j <= n else after[j][p] for j in range(size // 4 + 1)]
                words += [0] * (16 - len(words))
                words[14] = 8 * size
                out[some] = _md5_heads(words)
        return out
