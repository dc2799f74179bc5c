"""MD5 of many short messages at once, in numpy."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
#: Messages worked on together: a few arrays of them fit a core's cache.
BATCH = 32_768


def _first_words(prefix: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """First four bytes (little-endian) of the MD5 of prefix and each number, all of as many digits; a message is a block of up to 55 bytes."""
    size, n = len(prefix) + digits, len(numbers)
    fixed = bytearray(prefix + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    words: list = np.frombuffer(bytes(fixed), "<u4").tolist()
    rest = numbers.astype(np.uint32)
    for at in range(size - 1, len(prefix) - 1, -1):
        rest, digit = np.divmod(rest, np.uint32(10))
        words[at // 4] = words[at // 4] + ((digit + np.uint32(48)) << np.uint32(8 * (at % 4)))
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three rounds do not reach the first word
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
            word = words[i]
        elif kind == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
            word = words[(5 * i + 1) % 16]
        elif kind == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
            word = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
            word = words[7 * i % 16]
        t += a
        if isinstance(word, int):
            t += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            t += word
            t += np.uint32(_SINES[i])
        by = _SHIFTS[kind][i % 4]
        np.right_shift(t, np.uint32(32 - by), out=u)
        t <<= np.uint32(by)
        t |= u
        t += b
        a, d, c, b, t = d, c, b, t, a
    return b + np.uint32(0x67452301)


def leading(prefix: bytes, count: int) -> np.ndarray:
    """The first eight hexadecimal digits, as a number, of md5(prefix followed by i in decimal) for i from 0 to count - 1; prefix has up to 45 bytes."""
    if len(prefix) > 45 or count > 10**9:
        raise ValueError("a message must fit one block")
    out, start, digits = np.empty(count, np.uint32), 0, 1
    while start < count:
        stop = min(count, start + BATCH, 10**digits)
        out[start:stop] = _first_words(prefix, np.arange(start, stop, dtype=np.uint32), digits)
        start = stop
        digits += start == 10**digits
    return out.byteswap()
