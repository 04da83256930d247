"""Fill-in-middle: a text is cut at two of its units and its parts change places.

While a text's units are counted, block by block over its UTF-8 bytes, every so many units a
checkpoint of (unit, byte, code point) is recorded.  A cut looks its checkpoint up by binary
search and rescans the few units from there, so no text is ever decoded or held as a list of
characters.  A unit is a code point, or a word with the white space after it.
Operators: `fill_in_middle` and its inverse `restored`.

Cases: a null text is an empty one, and empty texts and texts that hold a marker stay plain; a row
without doc_id is cut as if its doc_id were written as nothing; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm.common import documents, in_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints, and bytes that are counted at a time.
EVERY, BLOCK = 256, 1 << 20
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, checkpoints long, output binary"
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _points(block: np.ndarray, before: int | None) -> np.ndarray:
    """Which bytes begin a code point."""
    return (block & 0xC0) != 0x80


def _words(block: np.ndarray, before: int | None) -> np.ndarray:
    """Which bytes begin a word; white space at the start belongs to the first one."""
    space = _SPACES[block]
    out = ~space
    out[1:] &= space[:-1]
    out[:1] &= before is None or bool(_SPACES[before])
    return out


UNITS = {"points": _points, "words": _words}


@dataclass
class Checkpoints:
    """Units, bytes and code points before every EVERY-th unit, and those of the whole text."""

    units: list[int]
    bytes: list[int]
    points: list[int]
    total: tuple[int, int, int]


def counted(data: bytes, unit: str = "points", every: int = EVERY) -> Checkpoints:
    """The checkpoints of data, in one pass over blocks."""
    view, begins = np.frombuffer(data, np.uint8), UNITS[unit]
    made, units, points = Checkpoints([0], [0], [0], (0, 0, 0)), 0, 0
    for at in range(0, len(view), BLOCK):
        block = view[at : at + BLOCK]
        starts = np.flatnonzero(begins(block, int(view[at - 1]) if at else None))
        marked = starts[-units % every :: every]
        upto = np.cumsum(_points(block, None)) if unit != "points" else None
        for k, place in enumerate(marked.tolist()):
            number = units + (-units % every) + k * every
            if number:
                made.units.append(number)
                made.bytes.append(at + place)
                made.points.append(points + int(upto[place]) - 1 if upto is not None else number)
        units += len(starts)
        points += int(upto[-1]) if upto is not None else len(starts)
    made.total = (units, len(data), points)
    return made


def cut(data: bytes, made: Checkpoints, k: int, unit: str = "points", every: int = EVERY) -> tuple[int, int]:
    """(bytes, code points) before unit k; those of the whole text if it has k units."""
    if k >= made.total[0]:
        return made.total[1:]
    if k == 0:
        return 0, 0
    c = bisect_right(made.units, k) - 1
    at, points, left = made.bytes[c], made.points[c], k - made.units[c]
    while True:
        block = np.frombuffer(data[at : at + 4 * every], np.uint8)
        starts = np.flatnonzero(UNITS[unit](block, data[at - 1] if at else None))
        if left < len(starts):
            return at + int(starts[left]), points + int(_points(block[: starts[left]], None).sum())
        left, at, points = left - len(starts), at + len(block), points + int(_points(block, None).sum())


def transformed(data: bytes, name: str, seed: int, plain: int, spm: int, every: int, unit: str) -> tuple:
    """(n, form, prefix_chars, middle_chars, checkpoints, output) of one text."""
    made = counted(data, unit, every)
    n = made.total[0]
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))
    if n == 0 or h3 % 100 >= 100 - plain or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, len(made.units), data
    (a, before), (b, upto) = (cut(data, made, k, unit, every) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    view = memoryview(data)
    form = "spm" if h4 % 100 < spm else "psm"
    order = (p, view[:a], s, view[b:], m, view[a:b]) if form == "psm" else (s, view[b:], p, view[:a], m, view[a:b])
    return n, form, before, upto - before, len(made.units), b"".join(order)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, every: int = EVERY, unit: str = "points") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, checkpoints, output of docs(doc_id, text).

    n counts units; of 100 texts about `plain` stay as they are, and of the others spm of 100
    have their suffix first.  The cuts follow from the seed and doc_id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py()
                rows.append((doc, *transformed(data, "" if doc is None else str(doc), seed, plain, spm, every, unit)))
                held += len(data)
                if held > 8 * BLOCK:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    plain_rows = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain_rows.mapInArrow(run, RESULT).withColumn("output", F.col("output").cast("string"))


def _batch(rows: list) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("checkpoints", pa.int64()), ("output", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output came from: its parts between the markers, put in order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    in_order = lambda p, m, s: F.concat(F.get(parts, F.lit(p)), F.get(parts, F.lit(m)), F.get(parts, F.lit(s)))
    return F.when(form == "psm", in_order(1, 3, 2)).when(form == "spm", in_order(2, 3, 1)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same from plain substrings.
SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, substr(x, 1, a) AS p, substr(x, a + 1, b - a) AS m, substr(x, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM o
"""
