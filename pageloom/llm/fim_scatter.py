"""Fill-in-the-middle documents by displacement scatter.

A document is cut twice, into prefix, middle and suffix, and put together anew with a
mark before each part. All texts of a batch are one run of bytes. The cuts, found by
scanning for the first bytes of characters, divide it into stretches that move as one;
a difference array holds, where a stretch begins, by how much more its bytes move than
those before. Its cumulative sum is every byte's displacement, and one numpy scatter
puts all bytes of all documents in their places. Reading works the other way round:
the marks that are found in the output say where each stretch lies, and one gather with
the inverse displacements restores the texts.

Memory: a slice of a batch (4 MB of text, or one longer text) with its output, and the
displacements of a window of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrow_texts import slices, text_array, text_bytes
from pageloom.llm.tables import plain_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARK = 3  # bytes of a mark
#: bytes whose displacements are made at a time
WINDOW = 1 << 20


def nth_heads(data: np.ndarray, ranks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the characters numbered ``ranks`` (ascending); the end for one behind the last."""
    out = np.full(len(ranks), len(data), np.int64)
    passed = done = 0
    for lo in range(0, len(data), window):
        heads = np.flatnonzero((data[lo : lo + window] & 0xC0) != 0x80)
        upto = int(np.searchsorted(ranks, passed + len(heads)))
        out[done:upto] = lo + heads[ranks[done:upto] - passed]
        passed, done = passed + len(heads), upto
    return out


def characters(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of every text."""
    n, some = np.zeros(len(ends) - 1, np.int64), np.flatnonzero(np.diff(ends))
    if len(some):
        n[some] = np.add.reduceat((data & 0xC0) != 0x80, ends[some], dtype=np.int64)
    return n


def displacements(
    total: int, begins: np.ndarray, shifts: np.ndarray, window: int = WINDOW
) -> Iterator[tuple[int, np.ndarray]]:
    """Window by window, the place to which each of ``total`` places is mapped.

    Stretch k starts at ``begins[k]`` (ascending, the first at 0) and moves by ``shifts[k]``."""
    steps = np.diff(shifts, prepend=0)
    carry = 0
    for lo in range(0, total, window):
        hi = min(lo + window, total)
        a, b = np.searchsorted(begins, (lo, hi))
        change = np.zeros(hi - lo, np.int64)
        np.add.at(change, begins[a:b] - lo, steps[a:b])
        change[0] += carry
        shift = np.cumsum(change, out=change)
        carry = int(shift[-1])
        shift += np.arange(lo, hi)
        yield lo, shift


def marks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every mark; none reaches over the end of a text."""
    kinds = [m[1] for m in (PREFIX, SUFFIX, MIDDLE)]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], kinds))
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + _MARK <= ends[row + 1]
    return at[inside], row[inside]


def scattered(
    data: np.ndarray, ends: np.ndarray, cuts: np.ndarray, plain: np.ndarray, spm: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and places of the outputs. ``cuts`` has two places per text, the smaller first."""
    begins = np.column_stack([ends[:-1], cuts])
    p, m, s = np.diff(np.column_stack([begins, ends[1:]]), axis=1).T
    to = np.concatenate([[0], np.cumsum(np.diff(ends) + 3 * _MARK * ~plain)])
    o = to[:-1]
    # psm: <P>prefix<S>suffix<M>middle, spm: <S>suffix<P>prefix<M>middle
    p_at = np.where(plain, o, o + _MARK + np.where(spm, s + _MARK, 0))
    m_at = np.where(plain, o + p, o + 3 * _MARK + p + s)
    s_at = np.where(plain, o + p + m, o + _MARK + np.where(spm, 0, p + _MARK))
    out = np.empty(int(to[-1]), np.uint8)
    shifts = np.column_stack([p_at, m_at, s_at]) - begins
    for lo, place in displacements(len(data), begins.ravel(), shifts.ravel()):
        out[place] = data[lo : lo + len(place)]
    for mark, at in ((PREFIX, p_at), (MIDDLE, m_at), (SUFFIX, s_at)):
        for k in range(_MARK):
            out[at[~plain] - _MARK + k] = mark[k]
    return out, to


def gathered(data: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and places of the texts that the outputs were made of: the inverse of ``scattered``."""
    at, row = marks(data, ends)
    at, row = at[~plain[row]], row[~plain[row]]
    cut = np.flatnonzero(~plain)
    if not np.array_equal(row, np.repeat(cut, 3)):
        raise ValueError("an output without exactly one mark of each kind")
    at = at.reshape(-1, 3)
    stop = np.column_stack([at[:, 1:], ends[cut + 1]])
    order = np.argsort(np.array([{ord("P"): 0, ord("M"): 1, ord("S"): 2}.get(b, 3) for b in range(256)])[data[at + 1]], axis=1)
    begin = np.take_along_axis(at + _MARK, order, axis=1)
    size = np.take_along_axis(stop, order, axis=1) - begin
    # a plain text is one stretch and two empty ones
    source = np.repeat(ends[:-1, None], 3, axis=1)
    length = np.column_stack([np.diff(ends), np.zeros((len(plain), 2), np.int64)])
    source[cut], length[cut] = begin, size
    begins = np.concatenate([[0], np.cumsum(length.ravel())])
    out = np.empty(int(begins[-1]), np.uint8)
    for lo, place in displacements(len(out), begins[:-1], source.ravel() - begins[:-1]):
        out[lo : lo + len(place)] = data[place]
    return out, begins[::3]


def _draws(seed: int) -> list[Column]:
    """Four numbers from a document's number: the first groups of eight digits of a hash."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digits = F.sha2(named, 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    Of the documents, ``percent`` in a hundred are cut, and of those ``spm_percent`` begin
    with the suffix. ``n`` is the text's code points. A text that is empty or null, or holds
    a mark, stays as it is (``plain``; no cuts, empty output for null). A row without doc_id
    draws as for an empty one. Repeated rows get equal results; other columns are left out;
    an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = text_bytes(b.column(1))
            h = [c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]
            for lo, hi in slices(ends):
                own, places = data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                n = characters(own, places)
                plain = (n == 0) | (h[2][lo:hi] % 100 >= percent)
                plain[marks(own, places)[1]] = True
                spm = ~plain & (h[3][lo:hi] % 100 < spm_percent)
                at = np.sort(np.column_stack([k[lo:hi] % (n + 1) for k in h[:2]]), axis=1)
                before = np.cumsum(n) - n
                cuts = nth_heads(own, (before[:, None] + at).ravel()).reshape(-1, 2)
                out, to = scattered(own, places, cuts, plain, spm)
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                sizes = [pa.array(x, "int64", mask=plain) for x in (at[:, 0], at[:, 1] - at[:, 0])]
                columns = [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(form, "string"), *sizes]
                yield pa.RecordBatch.from_arrays([*columns, text_array(out, to)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = plain_columns(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), *_draws(seed)
    )
    return texts.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``form`` and ``output``, and whatever else) and the exact text that each
    output was made of, as ``restored``. A null output gives an empty text; an output that
    doesn't have the marks of its form is an error."""
    rows = rows.drop("restored").withColumn("output", F.coalesce("output", F.lit("")))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = text_bytes(b.column(names.index("output")))
            plain = np.array([f not in ("psm", "spm") for f in b.column(names.index("form")).to_pylist()], bool)
            for lo, hi in slices(ends):
                out, to = gathered(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], plain[lo:hi])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, text_array(out, to)], [*names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, restored string")
