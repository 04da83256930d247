"""Personal data by a character BiLSTM-CRF beside the base patterns.

`trained` fits a tagger (see tagger) on labelled spans: the base matches and written-in
personal data of many forms, in stretches of a bounded sample of the corpus's own texts.
`found` cuts every whole text into windows of WINDOW characters that overlap by OVERLAP,
decodes them all, and reconciles the windows globally: each character takes the tag of the
window in whose inside it lies deeper, so a span over a border is read in one piece.  Spans
of the model are added where they stand clear of the base spans and pass an exact check of
their form; base spans always stay.

Operators: `personal_data` (spans and counts) and `masked` (texts with the spans replaced).

Cases: a null or empty text has no spans; texts of any length are read whole; rows with null
or repeated doc_ids are rows like others; an empty table gives an empty result (the model is
then fitted on written-in data alone); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajectra.llm.common import chunks, documents, in_batches, release
from trajectra.llm.tagger import LETTER, OTHER, PAD, Tagger

NUMBERS, STRINGS = ("n_email", "n_ip", "n_card", "n_phone"), ("base_sha256", "spans", "masked")
KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP = 512, 32
#: Windows that are decoded at a time.
BLOCK = 1024
#: Documents of the corpus that the tagger's training stretches are taken from at most, and the
#: longest stretch of each; it begins at a hashed place of the whole text.
SAMPLE, SAMPLE_CHARS = 256, 4000
TRAIN_WINDOWS, TRAIN_LENGTH, EPOCHS = 3600, 72, 14

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What an added span has to look like, in full.
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,}\s?(?:@|\[at\]|\(at\)|\{at\}|\sat\s)\s?[A-Za-z0-9-]{2,}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{2,})+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){2}[\x20._/-]{1,3}[0-9]{1,7}"),
    "phone": re.compile(r"(?:00|\+)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}"),
}
_WORD = re.compile(r"[A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, by start and kind; in time proportional to the text."""
    out = []
    at = text.find("@")
    if at >= 0:
        out += [(m.start(), 0, m.end()) for m in _around(EMAIL, text, at)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _ips(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out)


def _ips(text: str) -> Iterator[re.Match]:
    """The matches of IP, each looked for once from where a run of digits begins.

    A match begins at the first digit of its run or, after a match, right behind it, so no
    run of digits is read more than twice.
    """
    at = 0
    while run := DIGITS.search(text, at):
        m = IP.match(text, run.start()) if text.startswith(".", run.end()) else None
        if m:
            yield m
        at = m.end() if m else run.end()


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _around(pattern: re.Pattern, text: str, at: int):
    """Leftmost non-overlapping matches, looked for only where an @ stands."""
    done = 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = pattern.match(text, begin) if begin < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def char_classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.minimum(code, LETTER).astype(np.uint8)
    high = np.flatnonzero(code >= LETTER)
    if len(high):
        other = (code[high] < 0xC0) | (code[high] >= 0x2000) & (code[high] < 0x3000)
        out[high[other]] = OTHER
    return out


def _written(random: np.random.Generator) -> tuple[str, int]:
    """A made-up string and the tag it should get (0: looks alike but is no personal data)."""
    num = lambda n: "".join(map(str, random.integers(0, 10, n)))
    word = lambda: "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(3, 9)))
    pick = lambda *x: x[int(random.integers(len(x)))]
    kind = int(random.integers(0, 7))
    if kind == 0:
        local = pick(word(), f"{word()}.{num(2)}", f"{word()}_{word()}", f"{word()}.{word()}", f"{word()}+{word()}")
        host = f"{pick(word(), 'mail' + num(1))}{pick('', '.' + word())}"
        at, dot = pick(("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "))
        return f"{local}{at}{host.replace('.', dot)}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'es')}", 1
    if kind == 1:
        return pick(".", ".", ".", "[.]").join(str(int(x)) for x in random.integers(1, 256, 4)), 2
    if kind == 2:
        digits = f"4{num(14)}"
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return pick("", "", " ", "-", ".").join(digits[i : i + 4] for i in range(0, 16, 4)), 3
    if kind == 3:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 {a}.{b}.{c}", f"+1 ({a}) {b}-{c}"), 4
    hexed = "".join(random.choice(list("0123456789abcdef"), int(random.integers(16, 41))))
    return pick(f"{num(1)}.{num(1)}", f"{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"${num(2)}.{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", hexed, f'token = "{hexed}"', f"password={hexed[:18]}", f"AKIA{num(2)}{word().upper()}{num(4)}", f"v{num(1)}.{num(2)}.{num(1)}", f"#{num(5)}", f"{num(3)},{num(3)}", word() + num(2), f"{num(7)}", "*** ### $$$", "THE!! AND!!", "| a | b |"), 0


def trained(texts: list[str], windows: int = TRAIN_WINDOWS, length: int = TRAIN_LENGTH, epochs: int = EPOCHS, seed: int = 11) -> Tagger:
    """A tagger fitted on stretches of texts with their base matches and written-in strings."""
    random = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["some plain words, and more of them. "]
    chars, gold = np.full((windows, length), PAD, np.uint8), np.zeros((windows, length), np.int64)
    for w in range(windows):
        text = texts[int(random.integers(len(texts)))]
        spans = base_spans(text)
        at = int(random.integers(max(1, len(text) - length)))
        if spans and random.random() < 0.5:
            at = max(0, spans[int(random.integers(len(spans)))][0] - int(random.integers(length)))
        piece = text[at : at + length]
        tags = np.zeros(len(piece), np.int64)
        for start, kind, end in spans:
            tags[max(0, start - at) : max(0, end - at)] = kind + 1
        if random.random() < 0.85 and not tags.any():
            for _ in range(int(random.integers(1, 3))):
                cut = piece.find(" ", int(random.integers(max(1, len(piece)))))
                cut = len(piece) if cut < 0 else cut
                if 0 < cut < len(tags) and tags[cut - 1] and tags[cut - 1] == tags[cut]:
                    continue
                put, tag = _written(random)
                put_, tags_ = f" {put}", np.concatenate([[0], np.full(len(put), tag)])
                piece = piece[:cut] + put_ + piece[cut:]
                tags = np.concatenate([tags[:cut], tags_, tags[cut:]])
        shift = int(random.integers(max(1, len(piece) - length + 1)))
        piece, tags = piece[shift : shift + length], tags[shift : shift + length]
        chars[w, : len(piece)], gold[w, : len(piece)] = char_classes(piece), tags
    model = Tagger(len(KINDS) + 1)
    model.fit(np.ascontiguousarray(chars.T), np.ascontiguousarray(gold.T), epochs)
    return model


def tagged(model: Tagger, texts: list[str], window: int = WINDOW, overlap: int = OVERLAP) -> list[list[tuple[int, int, int]]]:
    """The model's spans (start, kind, end) of every text, windows reconciled."""
    stride, half = window - overlap, overlap // 2
    sizes = [len(t) for t in texts]
    count = [max(1, -(-(n - overlap) // stride)) for n in sizes]
    first = np.concatenate([[0], np.cumsum(count)]).astype(int)
    grid, used = np.full((first[-1], window), PAD, np.uint8), np.zeros(first[-1], int)
    for i, text in enumerate(texts):
        own = char_classes(text)
        for k in range(count[i]):
            part = own[k * stride : k * stride + window]
            grid[first[i] + k, : len(part)], used[first[i] + k] = part, len(part)
    tags = np.zeros(grid.shape, np.int8)
    order = np.argsort(used, kind="stable")  # windows of like length are decoded together
    for at in range(0, len(order), BLOCK):
        own = order[at : at + BLOCK]
        if longest := used[own[-1]]:
            tags[own, :longest] = model.decode(np.ascontiguousarray(grid[own, :longest].T)).T
    tags[np.arange(window) >= used[:, None]] = 0
    marked = np.flatnonzero(tags.any(axis=1))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i in np.unique(np.searchsorted(first, marked, side="right") - 1).tolist():
        whole = np.zeros(count[i] * stride + overlap, np.int8)
        for k in range(count[i]):
            lo, hi = (half if k else 0), (window - half if k < count[i] - 1 else window)
            whole[k * stride + lo : k * stride + hi] = tags[first[i] + k, lo:hi]
        whole = whole[: sizes[i]]
        edge = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1], [True]])) if len(whole) else np.zeros(0, int)
        out[i] = [(int(a), int(whole[a]) - 1, int(b)) for a, b in zip(edge[:-1], edge[1:]) if whole[a]]
    return out


def _added(text: str, base: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's spans that stand clear of the base spans and pass the exact check."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in spans:
        while start < end and not (_WORD.match(text[start]) or kind == 3 and text[start] in "+("):
            start += 1
        while end > start and not _WORD.match(text[end - 1]):
            end -= 1
        own = text[start:end]
        clear = (not start or not _WORD.match(text[start - 1])) and (end == len(text) or not _WORD.match(text[end])) and all(e <= start or end <= s for s, _, e in base + out)
        digits = _digits(own)
        if not clear or not FORMS[KINDS[kind]].fullmatch(own):
            continue
        if kind == 1 and any(int(p) > 255 for p in re.findall(r"[0-9]+", own)) or kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
            continue
        out.append((start, kind, end))
    return out


def spans_of(model: Tagger, texts: list[str]) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of every text."""
    for text, spans in zip(texts, tagged(model, texts)):
        base = base_spans(text)
        yield base, sorted(base + _added(text, base, spans)) if spans else base


def _fitted(docs: DataFrame, sample: int) -> Tagger:
    """A tagger fitted on a stretch of each of `sample` documents; only these stretches reach the driver."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    drawn = known.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(sample)
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64(F.lit(23), "doc_id"), room.cast("long")).cast("int") + 1
    cut = known.join(F.broadcast(drawn), "doc_id").select("doc_id", F.substring(F.col("text"), begin, F.lit(SAMPLE_CHARS)).alias("text"))
    rows = cut.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    model = trained([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    release()
    return model


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _run(docs: DataFrame, keep: list[Column], sample: int) -> DataFrame:
    """Columns k0, k1, ... (keep, passed through as they are) and what is found in text."""
    model = docs.sparkSession.sparkContext.broadcast(_fitted(docs, sample))
    rows = in_batches(docs).select(*[c.alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema[:-1]] + [T.StructField(n, T.LongType()) for n in NUMBERS] + [T.StructField(n, T.StringType()) for n in STRINGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks(texts):
                out = []
                for text, (base, spans) in zip(texts[a:b], spans_of(model.value, texts[a:b])):
                    kinds = [k for _, k, _ in spans]
                    out.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans), _masked(text, spans)))
                columns = list(zip(*out))
                made = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
                kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, masked per row of docs(doc_id, text)."""
    return _run(docs, [F.col("doc_id")], sample).withColumnRenamed("k0", "doc_id")


def masked(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with every span of text replaced by its kind, and n_chars (if there) of the new text.

    A null text stays null.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = _run(docs, [F.col("text").isNull(), *(F.col(f"`{c}`") for c in rest)], sample)
    text = F.when(~F.col("k0"), F.col("masked"))
    own = {"text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"k{i + 1}") for i, c in enumerate(rest)}
    return found.select(*[own[c].alias(c) for c in docs.columns])


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op2_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).drop("masked")
