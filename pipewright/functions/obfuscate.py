"""Row ids and versions as text that does not tell their order: the Blowfish permutation of 64-bit numbers, then 14 characters.

The cipher's initial tables are the binary digits of pi after the point. Whole Arrow batches are enciphered at once.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits and separators of the text form.
DIGITS = "23456789abcdefghijkmnpqrstuvwxyz"
MARKS = "-._~"


@functools.cache
def _pi_words(n: int) -> tuple[int, ...]:
    """The first n 32-bit words of pi's fraction, by Machin's formula."""
    spare = 64
    one = 1 << (32 * n + spare)

    def arctan_of_inverse(x: int) -> int:
        power, total, k, sign = one // x, 0, 1, 1
        while power:
            total += sign * (power // k)
            power, k, sign = power // (x * x), k + 2, -sign
        return total

    fraction = (4 * (4 * arctan_of_inverse(5) - arctan_of_inverse(239)) - 3 * one) >> spare
    return tuple((fraction >> (32 * (n - 1 - i))) & 0xFFFFFFFF for i in range(n))


class Cipher:
    def __init__(self, key: bytes):
        if not key:
            raise ValueError("the key is empty")
        words = _pi_words(18 + 4 * 256)
        repeated = (key * (72 // len(key) + 1))[:72]
        self.p = np.array(words[:18], np.uint64) ^ np.frombuffer(repeated, ">u4").astype(np.uint64)
        self.s = np.array(words[18:], np.uint64).reshape(4, 256)
        p, s = self.p.tolist(), self.s.tolist()
        left = right = 0
        for table in (p, *s):
            for i in range(0, len(table), 2):
                left, right = _block(p, s, left, right)
                table[i], table[i + 1] = left, right
        self.p, self.s = np.array(p, np.uint64), np.array(s, np.uint64)

    def _run(self, values: np.ndarray, p: np.ndarray) -> np.ndarray:
        n = values.astype(np.int64).view(np.uint64).byteswap()
        left, right = _block(list(p), self.s, n >> np.uint64(32), n & np.uint64(0xFFFFFFFF))
        return ((left << np.uint64(32)) | right).byteswap().view(np.int64)

    def encrypt(self, values: np.ndarray) -> np.ndarray:
        return self._run(values, self.p)

    def decrypt(self, values: np.ndarray) -> np.ndarray:
        return self._run(values, self.p[::-1])


def _block(p, s, left, right):
    """Sixteen rounds over one pair of numbers or over arrays of pairs."""
    whole = type(p[0])(0xFFFFFFFF)
    a, b, c, low = (type(p[0])(v) for v in (24, 16, 8, 255))
    for k in range(16):
        left = left ^ p[k]
        f = ((s[0][left >> a] + s[1][(left >> b) & low]) & whole) ^ s[2][(left >> c) & low]
        left, right = right ^ ((f + s[3][left & low]) & whole), left
    return right ^ p[17], left ^ p[16]


def shown(n: int) -> str:
    """The text of an enciphered number: three groups of four base-32 digits, the least first, and two marks."""
    n &= (1 << 64) - 1
    four = lambda v: "".join(DIGITS[(v >> k) & 31] for k in (15, 10, 5, 0))
    return four(n) + MARKS[(n >> 60) & 3] + four(n >> 20) + MARKS[n >> 62] + four(n >> 40)


def number_of(text: str) -> int | None:
    """The number that ``shown`` gives as this text, or None."""
    if len(text) != 14 or text[4] not in MARKS or text[9] not in MARKS or any(c not in DIGITS for c in text[:4] + text[5:9] + text[10:]):
        return None
    four = lambda t: sum(DIGITS.index(c) << k for c, k in zip(t, (15, 10, 5, 0), strict=True))
    n = four(text[:4]) | four(text[5:9]) << 20 | four(text[10:]) << 40 | MARKS.index(text[4]) << 60 | MARKS.index(text[9]) << 62
    return n - (1 << 64) if n >> 63 else n


def obfuscated(ids: Column, key: bytes, tag: str) -> Column:
    """Ids as ``tag-xxxx.xxxx.xxxx``; null stays null."""
    cipher = Cipher(key)

    # a nullable long would reach pandas as a double and lose digits, so it goes as text
    @F.pandas_udf("string")
    def exact(s: pd.Series) -> pd.Series:
        there = s.notna().to_numpy()
        out = np.full(len(s), None, object)
        numbers = np.array([int(x) for x in s[there]], np.int64)
        out[there] = [f"{tag}-{shown(n)}" for n in cipher.encrypt(numbers).tolist()]
        return pd.Series(out)

    return exact(ids.cast("string"))


def clear(text: str, key: bytes, tag: str) -> int | None:
    """The id of an obfuscated text, or None if it is not one of this tag."""
    n = number_of(text.removeprefix(f"{tag}-")) if text.startswith(f"{tag}-") else None
    return None if n is None else int(Cipher(key).decrypt(np.array([n]))[0])
