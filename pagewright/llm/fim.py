"""Fill-in-the-middle: texts are cut into prefix, middle and suffix and put together in another order, by a numpy kernel over
the UTF-8 buffers of an Arrow batch.

All rows of a slice are cut at once. A table of 256 entries gives each byte's class; a second, of pairs of classes, says where
between two adjacent bytes a unit begins. The running sum of these marks over the buffer, less its value where a document
begins, numbers the units of each document, and one search in the running sum finds the bytes of all cuts. Where a row is cut
and how it is put together follows from a hash of its id, so a repeated run gives the same output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle; of 100 rows, how many are rearranged, and of 100 of these, how many have
#: the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
REARRANGED, SUFFIX_FIRST = 90, 20

#: Bytes of text that the kernel takes at a time (a longer text alone).
BYTES = 4 << 20

#: Classes of bytes: later bytes of a character, line breaks, other blanks, all else.
LATER, BREAK, BLANK, OTHER = range(4)


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = LATER
    table[[0x0A, 0x0D]] = BREAK
    table[[0x09, 0x0B, 0x0C, 0x20]] = BLANK
    return table


def boundaries(unit: str) -> np.ndarray:
    """boundaries[4 * class of a byte + class of the next]: whether a unit begins between them. char: a code point; word: a
    word with the blanks behind it; line: a line with its breaks."""
    table = np.zeros((4, 4), np.uint8)
    if unit == "char":
        table[:, [BREAK, BLANK, OTHER]] = 1
    elif unit == "word":
        table[[BREAK, BLANK], OTHER] = 1
    elif unit == "line":
        table[BREAK, [BLANK, OTHER]] = 1
    else:
        raise ValueError(f"unit must be char, word or line, not {unit!r}")
    return table.ravel()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings without nulls."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def running(marks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sum of marks with a 0 before it, its value at each document's start)."""
    total = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
    np.cumsum(marks, out=total[1:])
    return total, total[at[:-1]].astype(np.int64)


def cut_all(raw: np.ndarray, at: np.ndarray, h: np.ndarray, unit: str, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> dict[str, np.ndarray]:
    """h: four rows of hashes. n, units before each of two cuts, bytes and code points at them, and the form (0 plain,
    1 prefix first, 2 suffix first), for all documents together."""
    classes = byte_classes()[raw]
    start, end = at[:-1], at[1:]
    marks = np.zeros(len(raw), np.uint8)
    if len(raw):
        marks[1:] = boundaries(unit)[4 * classes[:-1] + classes[1:]]
        marks[start[end > start]] = 1
    total, base = running(marks, at)
    n = total[end] - base
    k = np.sort(h[:2] % (n + 1), axis=0)
    # the byte where unit k begins; behind the last unit that is the document's end
    found = np.where(k < n, np.searchsorted(total, base + k + 1, "left") - 1, end)
    chars, first = (total, base) if unit == "char" else running(classes != LATER, at)
    marked = np.zeros(len(n), bool)
    if len(raw) > 2:
        hits = np.flatnonzero((raw[:-2] == PREFIX[0]) & (raw[2:] == PREFIX[2]) & np.isin(raw[1:-1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)]))
        doc = np.searchsorted(at, hits, "right") - 1
        marked[doc[hits + 3 <= end[doc]]] = True
    plain = (end == start) | marked | (h[2] % 100 >= rearranged)
    return {"n": n, "cuts": found, "chars": chars[found] - first, "form": np.where(plain, 0, np.where(h[3] % 100 < suffix_first, 2, 1))}


FORMS = ("plain", "psm", "spm")


def put_together(raw: np.ndarray, at: np.ndarray, cut: dict[str, np.ndarray]) -> pa.Array:
    view, parts, sizes = memoryview(raw), [], []
    for s, e, a, b, form in zip(at[:-1].tolist(), at[1:].tolist(), *cut["cuts"].tolist(), cut["form"].tolist(), strict=True):
        if form == 0:
            parts.append(view[s:e])
        elif form == 1:
            parts += (PREFIX, view[s:a], SUFFIX, view[b:e], MIDDLE, view[a:b])
        else:
            parts += (SUFFIX, view[b:e], PREFIX, view[s:a], MIDDLE, view[a:b])
        sizes.append(e - s + 9 * (form > 0))
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])


def slices(texts: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """start, rows: runs of rows of `most` bytes or one row."""
    _, at = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi - lo
        lo = hi


def fill_in_middle(docs: DataFrame, unit: str = "char", rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, n, form, prefix_chars, middle_chars, output, one row for each input row.

    n counts the text's units; prefix_chars and middle_chars are code points, null where the form is plain. A null text
    counts as empty; empty texts, and those that hold a mark, stay plain. A null doc_id is hashed as an empty string; rows
    that repeat a doc_id are cut by the same hash, each by its own text. Whole texts of any length are read. An empty table
    gives an empty result. Columns beyond doc_id and text are not read, so that their names can't clash.
    """
    boundaries(unit)  # an unknown unit is told here
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            for lo, rows in slices(text):
                part = batch.slice(lo, rows)
                raw, at = buffers(text.slice(lo, rows))
                h = np.stack([part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)])
                cut = cut_all(raw, at, h, unit, rearranged, suffix_first)
                plain = cut["form"] == 0
                chars = [pa.array(x.astype(np.int64), pa.int64(), mask=plain) for x in (cut["chars"][0], cut["chars"][1] - cut["chars"][0])]
                form = pa.DictionaryArray.from_arrays(pa.array(cut["form"], pa.int8()), list(FORMS)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cut["n"].astype(np.int64)), form, *chars, put_together(raw, at, cut)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text", *hashes).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: str = "form", output: str = "output") -> Column:
    """The exact text, from form and output alone: a text that holds a mark is never rearranged, so marks part the output."""
    parts = F.split(output, "<[PSM]>", -1)
    rebuilt = F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(rebuilt)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 x AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
 y AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
 z AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM z
"""
