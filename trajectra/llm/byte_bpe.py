"""Byte-level BPE by the ranks of a vocabulary file: encoding of whole texts, and decoding.

Texts are cut into pre-tokens over arrays of character classes.  Then two tiers: a minimal
perfect hash (levels of collision-free bits, numbered by their rank) names the one vocabulary
entry that a pre-token can be, and its bytes are compared; a pre-token that is none is merged
from its bytes, which form a linked list, by a heap of (rank, place).
Operators: `encoded` and its inverse `decoded`.

The pattern of the pre-tokens is fixed (contractions, letters, numbers, others, white space); the classes of
characters are asked of the installed tokenizer library, whose Unicode tables decide.

Cases: a null or empty text has no tokens; texts of any length are encoded whole (long ones in
stretches that end where a pre-token must end); rows without doc_id and repeated rows are rows like others; an empty table
gives an empty result; other columns are ignored.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm.common import CHUNK_CHARS, documents, in_batches

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Slots a level has for each key that is left.
GAMMA = 2.0
#: A heap entry is a rank and, in its low bits, a place.
PLACES = (1 << 40) - 1
#: Merged pre-tokens in each of the two generations that a worker remembers.
REMEMBERED = 250_000
_U = np.uint64
_MIX = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))
_NEW_PART = re.compile(r"(?<=[^\s]) ")


def vocabulary(path: str) -> list[tuple[bytes, int]]:
    """(bytes, rank) of a rank file: base64 and number on each line."""
    with open(path, "rb") as file:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, file)]


@cache
def character_classes() -> bytes:
    """The class of every code point, by the tokenizer library's own \\p{L}, \\p{N} and \\s."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        single = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(single.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out.tobytes()


def pretokens(codes: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin, in one array of code points; begins: where each text does."""
    n = len(codes)
    kind = classes[codes]
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 3, bool)
    first[begins] = first[n:] = True
    cut |= first[:n]
    # the last of a run of white space before something else stands alone, or leads it if it is a space
    after = np.flatnonzero(cut[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]) + 1
    cut[after - 1] = True
    cut[after[codes[after - 1] == 32]] = False
    # contractions: an apostrophe that begins a pre-token, and the letters after it
    quote = np.flatnonzero(cut & (codes == 39))
    quote = quote[~first[quote + 1]]
    one = codes[quote + 1]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    rest = quote[~first[quote + 2]]
    one, two = codes[rest + 1], codes[rest + 2]
    long = rest[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    cut = np.concatenate([cut, np.ones(3, bool)])
    cut[short + 1] = cut[long + 1] = False
    cut[short + 2] = cut[long + 3] = True
    return np.flatnonzero(cut[:n])


def _hashed(table: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix."""
    with np.errstate(over="ignore"):
        h = np.full(len(table), _U(0x9E3779B97F4A7C15) * _U(table.shape[1] + 1), np.uint64)
        for column in table.T:
            h = (h ^ column) * _U(0x100000001B3)
            h ^= h >> _U(29)
    return h


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + _U(level + 1) * _U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> _U(33))) * _MIX[0]
        h = (h ^ (h >> _U(33))) * _MIX[1]
    return ((h ^ (h >> _U(33))) % _U(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: key -> its number among n."""

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        left, before = np.unique(keys), 0
        if len(left) < len(keys):
            raise ValueError("two keys are equal")
        while len(left):
            size = max(1, int(GAMMA * len(left)))
            at = _at(left, len(self.bits), size)
            bits = np.bincount(at, minlength=size) == 1
            self.bits.append(bits)
            self.ranks.append((before + np.cumsum(bits) - 1).astype(np.int32))
            before += int(bits.sum())
            left = left[~bits[at]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1, or any number, for what was no key."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = _at(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks that piece's bytes are merged to: always the least rank of a neighbouring pair, from the left.

    A part is named by its first byte's place; two neighbours have as many bytes as two entries at most.
    """
    n, get, push, pop = len(piece), ranks.get, heapq.heappush, heapq.heappop
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1, -1]
    heap = [rank << 40 | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        top = pop(heap)
        i = top & PLACES
        if pair[i] != top >> 40:
            continue  # one of the two has been merged since
        gone = after[i]
        end = after[i] = after[gone]
        pair[gone] = pair[i] = -1
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]])
            if rank is not None:
                pair[i] = rank
                push(heap, rank << 40 | i)
        left = before[i]
        if left >= 0:
            rank = pair[left] = get(piece[left:end], -1)
            if rank >= 0:
                push(heap, rank << 40 | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Both tiers over one vocabulary; holds arrays only, so it can be broadcast."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        if {bytes([b]) for b in range(256)} - {t for t, _ in entries}:
            raise ValueError("a byte-level vocabulary has every byte")
        self.entries, self.classes = entries, np.frombuffer(character_classes(), np.uint8)
        tokens = [t for t, _ in entries]
        self.sizes = np.array([len(t) for t in tokens])
        self.flat, self.longest = np.frombuffer(b"".join(tokens), np.uint8), int(self.sizes.max())
        self.places = np.cumsum(self.sizes) - self.sizes
        keys = np.zeros(len(tokens), np.uint64)
        for size in np.unique(self.sizes):
            own = np.flatnonzero(self.sizes == size)
            keys[own] = _hashed(np.lib.stride_tricks.sliding_window_view(self.flat, size)[self.places[own]])
        self.hash = PerfectHash(keys)
        self.entry = np.zeros(len(tokens), np.int64)
        self.entry[self.hash(keys)] = np.arange(len(tokens))
        self.rank = np.array([r for _, r in entries], np.int32)
        self.ranks: dict[bytes, int] = {}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"ranks": {}, "known": {}, "older": {}}

    def found(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, like) of stretches of data: the rank of one that is an entry, else -1 and the first stretch with the same bytes."""
        out, like = np.full(len(starts), -1, np.int32), np.arange(len(starts))
        order = np.argsort(np.minimum(sizes, 256).astype(np.int16), kind="stable")
        present, first = np.unique(sizes[order], return_index=True)
        for size, own in zip(present.tolist(), np.split(order, first[1:])):
            if size > self.longest:
                break
            table = np.lib.stride_tricks.sliding_window_view(data, size)[starts[own]]
            keys = _hashed(table)
            entry = self.entry[self.hash(keys)]
            # what was no key has the bytes of no entry; its number may be any
            alike = np.flatnonzero(self.sizes[entry] == size)
            alike = alike[(np.lib.stride_tricks.sliding_window_view(self.flat, size)[self.places[entry[alike]]] == table[alike]).all(axis=1)]
            out[own[alike]] = self.rank[entry[alike]]
            rest = np.flatnonzero(out[own] < 0)
            _, lead, of = np.unique(keys[rest], return_index=True, return_inverse=True)
            lead = rest[lead[of]]
            same = (table[rest] == table[lead]).all(axis=1)
            like[own[rest[same]]] = own[lead[same]]
        return out, like

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        data = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begins = np.cumsum(lengths) - lengths
        codes = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        starts = pretokens(codes, begins[lengths > 0], self.classes)
        raw = data.encode()
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=at[1:])
        low, high = at[starts], at[np.append(starts[1:], len(codes))]
        rank, like = self.found(np.frombuffer(raw, np.uint8), low, high - low)
        missed = np.flatnonzero(rank < 0)
        leads, of = np.unique(like[missed], return_inverse=True)
        parts = [self.merge(raw[a:b]) for a, b in zip(low[leads].tolist(), high[leads].tolist())]
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        counts = np.ones(len(starts), np.int64)
        counts[missed] = sizes[of]
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), np.int32)
        whole = rank >= 0
        ids[ends[whole] - 1] = rank[whole]
        if len(missed):
            flat, begin, own = np.frombuffer(b"".join(parts), np.int32), np.cumsum(sizes) - sizes, sizes[of]
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            ids[np.repeat(ends[missed] - own, own) + within] = flat[np.repeat(begin[of], own) + within]
        of = np.searchsorted(starts, np.append(begins, len(codes)))
        upto = np.append(0, ends)[of]
        return ids, np.diff(upto)

    def merge(self, piece: bytes) -> bytes:
        """The ids of a pre-token that is no entry, as 32-bit numbers; short ones are remembered while they recur."""
        found = self.known.get(piece)
        if found is None:
            if not self.ranks:
                self.ranks = dict(self.entries)
            found = self.older.get(piece) or array("i", merged(piece, self.ranks)).tobytes()
            if len(piece) <= self.longest:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, by chunks of about CHUNK_CHARS characters; longer texts go by stretches."""
        owners, chunk, held = [], [], 0
        out: list[list[np.ndarray]] = [[] for _ in texts]

        def done() -> None:
            ids, counts = self.pieces(chunk)
            for owner, part in zip(owners, np.split(ids, np.cumsum(counts)[:-1])):
                out[owner].append(part)
            owners.clear()
            chunk.clear()

        for k, text in enumerate(texts):
            for part in stretches(text):
                owners.append(k)
                chunk.append(part)
                held += len(part)
                if held >= CHUNK_CHARS:
                    done()
                    held = 0
        if chunk:
            done()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in out]


def stretches(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    """text in parts of `most` characters or somewhat more; each but the first begins with the first white space after something else."""
    at = 0
    while len(text) - at > most and (cut := _NEW_PART.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the tokens of every row of docs(doc_id, text) by the rank file at path (read by the driver; its entries are broadcast)."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and (end == begin or held + len(texts[end]) <= 4 * CHUNK_CHARS):
                    held += len(texts[end])
                    end += 1
                ids = shared.value.encode(texts[begin:end])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], names=["doc_id", "ids"])
                begin = end

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows with data (binary): the bytes that their ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast({r: t for t, r in vocabulary(path)})
    place = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.__getitem__
        for batch in batches:
            column = batch.column(place)
            data = pa.array([b"".join(map(of, column[i].values.to_numpy(zero_copy_only=False).tolist())) for i in range(len(column))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], names=[*batch.schema.names, "data"])

    kept = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{kept}, data binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = decoded(encoded(documents(spark, sf_dir), path), path)
    digits = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
