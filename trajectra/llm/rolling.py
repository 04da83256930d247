"""Polynomial hashing and winnowing over concatenated sequences, in numpy.

A batch of documents is laid end to end in one array of units (bytes or word
hashes) so that one vectorised pass hashes every k-gram of the batch.  Rolling hashes are
``sum(unit[j] * BASE**j) mod 2**64`` read off prefix sums, so any substring's hash is
two look-ups and a multiplication.  Long strings can be built that such a sum can't tell
apart (a Thue-Morse string of 1,024 units and its complement), so it only brings substrings
together that are then compared.  What stands for a word or a shingle by itself, `word_hashes`
and `tuple_hashes`, chains a mixing step instead and has no such strings.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64; the table grows by doubling."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _tables[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """prefix[i] hashes units[:i]; one longer than units."""
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(units)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of units[start:end], independent of where the span stands."""
    shift = powers(INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * shift[start])


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every k-gram, in order."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = prefix_hashes(units)
    return mix((prefix[k:] - prefix[:n]) * powers(INVERSE, n))


def tuple_hashes(units: np.ndarray, k: int) -> list[np.ndarray]:
    """[j - 1]: the hash of the j units from every position on, for j from 1 to k.

    Unit after unit enters a mixing step, so no arithmetic between units can cancel.
    """
    out = [mix(units + np.uint64(0x2545F4914F6CDD1D))]
    for j in range(1, k):
        out.append(mix(out[-1][: max(0, len(units) - j)] * np.uint64(BASE) + units[j:]))
    return out


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of every string data[first:last]: the sum of its mixed 8-byte pieces, each with its place."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from every place on
    count = (last - first + 7) >> 3
    begin = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(begin, count)
    at = np.repeat(first, count) + 8 * place
    left = np.minimum(np.repeat(last, count) - at, 8).astype(np.uint64)
    piece = eight[at] & (TOP >> (np.uint64(64) - np.uint64(8) * left))
    piece = mix(piece ^ mix(place.astype(np.uint64) + np.uint64(BASE)))
    return mix(np.add.reduceat(piece, begin) + (last - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


PRIME = (1 << 31) - 1
#: Bases of the two hashes that `context_hashes` joins.
BASES = (1_234_577_801, 987_654_337)
_fields: dict[int, np.ndarray] = {}


def _field_powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo PRIME."""
    table = _fields.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), PRIME)) % np.uint64(PRIME)])
    _fields[base] = table
    return table[:n]


def context_hashes(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] by polynomials over a prime field, one for each of BASES.

    Unlike a sum modulo 2**64 it has no long strings that cancel.  Spans of up to 2**24 units.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    prime = np.uint64(PRIME)
    for base, shift in zip(BASES, (0, 32)):
        own = units.astype(np.uint64)
        if units.dtype.itemsize > 4:  # each base reads its half of a wide unit
            own = (own >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
        own = (own + np.uint64(1)) % prime * _field_powers(base, len(units)) % prime
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
        value = (prefix[end] - prefix[start]) % prime * _field_powers(pow(base, -1, PRIME), len(units) + 1)[start] % prime
        out = (out << np.uint64(31)) + value
    return mix(out)


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """True where a hash is the least of some run of w neighbours (all ties count).

    Which positions of a run are chosen depends on the run's hashes alone, so two equal
    runs choose the same offsets.
    """
    n = len(hashes)
    if n < w:
        return np.zeros(n, dtype=bool)
    low = _sliding(hashes, w, np.minimum)
    padded = np.zeros(n + w - 1, dtype=np.uint64)
    padded[w - 1 : n] = low
    return _sliding(padded, w, np.maximum) == hashes


class Batch:
    """Documents laid end to end: units, and for each document its first unit and length."""

    def __init__(self, parts: list[np.ndarray], dtype):
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        self.units = np.concatenate(parts).astype(dtype) if len(parts) else np.zeros(0, dtype)

    def owner(self) -> np.ndarray:
        """The document of every unit."""
        return np.repeat(np.arange(len(self.length)), self.length)

    def room(self) -> np.ndarray:
        """Units from each position to its document's end."""
        return np.repeat(self.start + self.length, self.length) - np.arange(len(self.units))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes outside the white-space set.

    breaks: positions at which a word must end even without white space (document starts).
    Bytes below 0x80 never occur inside a longer UTF-8 sequence, so byte runs are words.
    """
    solid = ~SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def words_of(texts: list[bytes]) -> tuple[Batch, np.ndarray, np.ndarray]:
    """Word-hash batch of texts, with the byte offsets (inside its own text) of every word."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    first, last = word_spans(data, starts)
    hashes = word_hashes(data, first, last)
    cut = np.searchsorted(first, starts)
    batch = Batch([], np.uint64)
    batch.units, batch.start, batch.length = hashes, cut[:-1], np.diff(cut)
    base = np.repeat(starts[:-1], batch.length)
    return batch, first - base, last - base
