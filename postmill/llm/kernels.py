"""Array kernels that the text operators use inside Spark tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Characters of one vectorised step; a longer text forms a step of its own.
STEP_CHARS = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def slices(texts: list[str], step_chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about ``step_chars`` characters."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > step_chars:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def code_points(text: str) -> np.ndarray:
    """A text's code points; an unpaired surrogate counts as one."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Position-independent 64-bit digests of spans of one code array.

    A span's digest is the scrambled polynomial of its symbols, taken from the
    difference of two running sums and shifted back by the odd base's inverse
    modulo 2**64, so a batch of spans costs one pass. Long spans can be chosen
    so that such polynomials agree; with ``exact`` those of more than ``LONG``
    symbols get a cryptographic digest, one by one.
    """

    LONG = 64

    BASE = 0xD6E8FEB86659FD93
    INVERSE = pow(BASE, -1, 1 << 64)
    SYMBOLS = mix(np.arange(0x10000, dtype=np.uint64) + GOLDEN)
    POWERS: dict[int, np.ndarray] = {}

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        symbols = self.SYMBOLS[np.minimum(codes, 0xFFFF)]
        high = np.flatnonzero(codes > 0xFFFE)
        symbols[high] = mix(codes[high].astype(np.uint64) + GOLDEN)
        symbols *= self.powers(self.BASE, len(codes))
        self.inverse = self.powers(self.INVERSE, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(symbols, out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        """The first ``n`` powers, remembered up to the longest array so far."""
        known = cls.POWERS.get(base)
        if known is None or len(known) < n:
            known = np.full(max(n, STEP_CHARS + 1), np.uint64(base))
            known[0] = 1
            cls.POWERS[base] = np.multiply.accumulate(known, out=known)
        return known[:n]

    def digests(self, starts: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
        poly = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        out = mix(poly + mix((ends - starts).astype(np.uint64)))
        if exact:
            for i in np.flatnonzero(ends - starts > self.LONG).tolist():
                span = self.codes[starts[i] : ends[i]].tobytes()
                out[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
        return out


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    padded = np.concatenate(([True], is_space(codes), [True]))
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return change[::2], change[1::2]


def is_space(codes: np.ndarray) -> np.ndarray:
    return SPACE[np.minimum(codes, 0xFFFF)]


SPACE = np.zeros(0x10000, bool)
SPACE[[c for c in range(0x10000) if chr(c).isspace()]] = True
ALPHA = np.zeros(0x10000, bool)
ALPHA[[c for c in range(0x10000) if chr(c).isalpha()]] = True


def has_letter(codes: np.ndarray) -> bool:
    """Whether a letter is among the code points, those above the BMP included."""
    low = codes[codes < 0x10000]
    if ALPHA[low].any():
        return True
    return any(chr(c).isalpha() for c in set(codes[codes >= 0x10000].tolist()) if c <= 0x10FFFF)
