"""Byte-level BPE against the tokenizer library, fill-in-middle against slices, periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.llm import byte_bpe, fim, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, n long, words_ string, h_ long, ids string, form string, runs string, data string, output string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, "y", "z", "r", "d", "o") for d, t in rows], SCHEMA)


def corpus():
    r = random.Random(3)
    bits = ["a", "the ", " word", "'s", "'ll", "'re", "'x", " ", "  ", "\n", "\t\t", "12", "é", "漢字", "!", "??", "\x1c", "\x85", "😀", "　", "​", "\0", "²", "<P", "<S>", "x y "]
    out = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(120)]
    out += [(200 + i, " ".join(r.choice("ab") for _ in range(r.randrange(40)))) for i in range(60)]
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (7, out[7][1]), (None, "some text some text"), (None, None), (-4, "x " * 30), (304, "long text " * 20_000), (305, "abcdefgh" * 3_000)]
    return out


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    entries = byte_bpe.vocabulary(path)
    return path, byte_bpe.Encoder(entries), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(entries), special_tokens={})


def test_encoded(spark, tokenizer):
    path, _, library = tokenizer
    rows = corpus()
    made = byte_bpe.decoded(byte_bpe.encoded(table(spark, rows).repartition(3), path), path).collect()
    got = sorted(((r["doc_id"] or 0, bytes(r["data"]), r["ids"]) for r in made), key=lambda r: r[:2])
    want = sorted(((d or 0, (t or "").encode(), library.encode_ordinary(t or "")) for d, t in rows), key=lambda r: r[:2])
    assert got == want
    empty = byte_bpe.decoded(byte_bpe.encoded(table(spark, rows).limit(0), path), path)
    assert empty.columns == ["doc_id", "ids", "data"] and not empty.count()


def test_every_character_and_chunks(tokenizer, monkeypatch):
    _, encoder, library = tokenizer
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c} {c}1" for c in every[::7] + every[:3000])
    assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 40)
    texts = [t for _, t in corpus()[:180] if t] + [text[:20_000]]
    assert list("".join(byte_bpe.stretches(texts[-1], 40))) == list(texts[-1])
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_misses_are_compared(tokenizer, monkeypatch):
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    number = byte_bpe.PerfectHash(keys)
    assert sorted(number(keys).tolist()) == list(range(len(keys)))
    # what is no entry is told from the entry of its number by its bytes, and equal hashes by theirs
    _, encoder, library = tokenizer
    monkeypatch.setattr(encoder, "hash", lambda keys: np.zeros(len(keys), np.int64))
    monkeypatch.setattr(byte_bpe, "_hashed", lambda rows: np.zeros(len(rows), np.uint64))
    text = "several words of a text, zyxq qzyx and words"
    assert encoder.encode([text])[0].tolist() == sum((list(x) for x in (byte_bpe.merged(p.encode(), dict(encoder.entries)) for p in re.findall(r" ?\w+|,", text))), [])


def test_merge_order():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"aa": 3, b"ab": 1, b"aab": 0, b"abab": 2}
    for piece in [b"aaa", b"aaab", b"abab", b"aabab", b"ababab", b"bbaa", b"a"]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merged(piece, ranks) == [ranks[p] for p in parts]


@pytest.mark.parametrize("unit", ["points", "words"])
@pytest.mark.parametrize("every", [1, 3, 256])
def test_cuts(unit, every, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 16)
    for _, text in corpus():
        text = (text or "")[:2000]
        data, starts = text.encode(), list(range(len(text))) if unit == "points" else [m.start() for m in WORD.finditer(text)]
        made, n = fim.counted(data, unit, every), len(starts)
        assert made.total == (n, len(data), len(text))
        for k in range(n + 1):
            at = len(text) if k == n else 0 if k == 0 else starts[k]
            assert fim.cut(data, made, k, unit, every) == (len(text[:at].encode()), at)


def middle(doc, text):
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rows = corpus()
    made = fim.fill_in_middle(table(spark, rows).repartition(3)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((r["doc_id"] or 0, r["back"], r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"]) for r in made)
    want = sorted((d or 0, t or "", *(x or 0 if i in (2, 3) else x for i, x in enumerate(middle(d, t or "")))) for d, t in rows)
    assert got == want
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    words = fim.fill_in_middle(table(spark, rows), unit="words").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(r["back"] for r in words) == sorted(t or "" for _, t in rows)
    assert not fim.fill_in_middle(table(spark, rows).limit(0)).count()


def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.append((s, i - s + q, q))
            i += 1
    return sorted((a for a in found if not any(b[2] < a[2] and b[0] <= a[0] and b[0] + b[1] >= a[0] + a[1] for b in found)), key=lambda r: (r[0], r[2]))


def test_runs(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 50)
    r = random.Random(8)
    texts = []
    for k in range(900):
        w = [bytes([97 + r.randrange(1 + k % 4)]) for _ in range(r.randrange(50))]
        for _ in range(r.randrange(4)):
            root = [bytes([97 + r.randrange(1 + k % 4)]) for _ in range(r.randrange(1, 9))]
            at = r.randrange(len(w) + 1)
            w[at:at] = root * r.randrange(2, 9) + root[: r.randrange(len(root))]
        texts.append(w * r.choice([1, 1, 1, 5]))
    got = [x for i in range(0, 900, 45) for x in runs.runs(texts[i : i + 45])]
    want = [plain_runs(w) for w in texts]
    assert [[tuple(x) for x in g.tolist()] for g in got] == want
    assert sum(map(len, want)) > 2000


def test_runs_of_documents(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK_WORDS", 100)
    rows = [(d, t) for d, t in corpus() if len(t or "") < 10_000] + [(i, " ".join(random.Random(i).choice("abcdefghij") for _ in range(90))) for i in range(500, 600)]
    made = runs.periodic_runs(runs.repeated(table(spark, rows)).repartition(3)).collect()
    got = sorted((r["doc_id"] or 0, bytes(r["collapsed"]), r["n_words"], [tuple(x) for x in r["runs"]]) for r in made)
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        want.append((d or 0, " ".join(x for i, x in enumerate(w) if i not in gone).encode(), n, found))
    assert got == sorted(want)
    assert not runs.periodic_runs(table(spark, rows).limit(0)).count()


def test_long_periodic_text():
    found = [x.tolist() for x in runs.runs([[b"a"] * 30_000, [b"a", b"b", b"c"] * 8_000])]
    assert found == [[[0, 30_000, 1]], [[0, 24_000, 3]]]


@pytest.mark.parametrize("operator", ["bytes", "words"])
def test_contexts_with_equal_hashes_in_two_tasks(spark, operator, monkeypatch):
    """What is not repeated stays, however rows fall into tasks; between tasks, digests of units stand for contexts, not their polynomial hashes."""
    from trajectra.llm import repeats, substring_seed, substring_suffix

    r = random.Random(9)
    if operator == "bytes":
        head = "".join(r.choice("abcdefgh") for _ in range(104))
        texts = [head + first + "".join(r.choice("abcdefgh") for _ in range(75)) for first in "xy"]
        run, column, gone = substring_suffix.drop_repeated_bytes, "n_removed", 104
    else:
        head = [f"w{r.randrange(900)}" for _ in range(15)]
        texts = [" ".join(head + [first] + [f"v{r.randrange(900)}" for _ in range(11)]) for first in "xy"]
        run, column, gone = substring_seed.drop_repeated_words, "n_removed", 15
    monkeypatch.setattr(repeats, "context_hashes", lambda units, start, end: np.zeros(len(start), np.uint64))
    for parts in (1, 2):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(parts, "doc_id")
        # Python workers don't see the patch, so the anchors are also taken in this process, below
        assert {x["doc_id"]: x[column] for x in run(docs).collect()} == {0: 0, 1: gone}
    batch = substring_suffix._load(texts)
    key, context, at, left, right = repeats._anchors(batch, 100, 20)
    shown = repeats._digests(batch.units, at, left, right, np.arange(len(at)))
    spans = {batch.units[p - a : p + b].tobytes() + b"%d,%d" % (a, b) for p, a, b in zip(at, left, right)}
    assert len(set(shown.values())) == len(spans)
