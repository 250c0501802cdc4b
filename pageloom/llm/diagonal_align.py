"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both cut the same bytes, so a text's alignment is given by the byte offsets at which
tokens end. As long as both end together, token i of the one is token i + shift of the
other. Such a stretch is skipped as a whole: after its first ends, which are compared one
by one, probes of doubling length compare the two arrays of ends at the current shift,
then halve to find where the stretch stops. There, tokens are stepped through one by one
up to the next common end: an irregular group, which changes the shift. Texts of a slice
lie one behind another in the same arrays; a text's end is a common end, so no group
leaves its text.

Every two tokens that share bytes are a link. How often each pair of ids is linked is
counted over all texts, first in the tasks, and each text is then scored by the counts
of its own links."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrow_texts import slices, text_bytes
from pageloom.llm.tables import plain_columns, stored
from pageloom.llm.transducer_bpe import byte_letters

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: bytes of text whose tokens are held at a time; a longer text is held alone
SLICE_BYTES = 1 << 20
#: counts of pairs are sent to every task up to this size; beyond it Spark shuffles
COUNTS_BYTES, COUNT_BYTES = 96 << 20, 32

#: ends of a stretch that are compared one by one before it is probed
NEAR = 16

# Fixed value: how the byte-level tokenizer splits a text.
PATTERN = public_tokenizers.PATTERN


@dataclass
class Sides:
    """The two tokenizers' files, as a task needs them."""

    byte_json: str
    piece_model: bytes

    @classmethod
    def read(cls, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> Sides:
        with open(byte_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
            return cls(a.read(), b.read())


class ByteSide:
    """Ids of a text with a space before it, by the byte-level tokenizer.

    Where the ids follow the order of the merges, the same vocabulary serves as ranks to
    a faster library, which splits and merges every text alike."""

    def __init__(self, stored_json: str):
        model = json.loads(stored_json)["model"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = {i: bytes(map(byte.__getitem__, t)) for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        as_ranks = all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges))
        ranks = {b: i for i, b in self.bytes.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if as_ranks else None
        self.exact = tokenizers.Tokenizer.from_str(stored_json)
        self.exact.encode_special_tokens = True  # their texts are text like any other
        self.exact.no_truncation()
        self.exact.no_padding()

    def __call__(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            return self.fast.encode_to_numpy(" " + text)
        return np.array(self.exact.encode(" " + text, add_special_tokens=False).ids, np.int64)


class PieceSide:
    """Ids of a text by the piece tokenizer, which adds the space itself."""

    def __init__(self, model: bytes):
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.encode.id_to_piece(i) for i in range(self.encode.get_piece_size())]
        self.bytes = {
            i: bytes([int(n[3:5], 16)]) if self.encode.is_byte(i) else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        }

    def __call__(self, text: str) -> list[int]:
        return self.encode.encode(text)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self(text), np.int64)


def stretch(ea: list[int], eb: list[int], i: int, j: int) -> int:
    """How many ends from ``ea[i]`` and ``eb[j]`` on are the same, place by place."""
    n, step = 0, NEAR
    while (part := ea[i + n : i + n + step]) and part == eb[j + n : j + n + step]:
        n += len(part)
        step *= 2
    while step > 1:
        step //= 2
        part = ea[i + n : i + n + step]
        if len(part) == step and part == eb[j + n : j + n + step]:
            n += step
    return n


def runs_and_links(ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one stretches (i, j, length), and the links (i, j) of the groups between them.

    ``ea`` and ``eb`` ascend and have the same last end."""
    i = j = 0
    runs: list[int] = []
    links: list[int] = []
    size = len(ea)
    ea, eb = [*ea, -1], [*eb, -2]  # no end: a stretch stops there
    while i < size:
        a, b = ea[i], eb[j]
        if a == b:
            first, shift = i, j - i
            near = i + NEAR
            while a == b and i < near:
                i += 1
                a, b = ea[i], eb[i + shift]
            if a == b:
                i += stretch(ea, eb, i, i + shift)
            j = i + shift
            runs += (first, first + shift, i - first)
            continue
        while a != b:
            links += (i, j)
            if a < b:
                i += 1
                a = ea[i]
            else:
                j += 1
                b = eb[j]
        links += (i, j)
        i += 1
        j += 1
    return np.array(runs, np.int64).reshape(-1, 3), np.array(links, np.int64).reshape(-1, 2)


def aligned(docs: DataFrame, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs) for every row of ``docs``, over its whole text.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3``: between common ends, the ids of the byte-level
    tokenizer and those of the piece tokenizer. ``pairs`` has (a, b, n) for each pair of ids
    that the text links n times. Null and empty texts, and texts that one of the two doesn't
    keep byte by byte, have no tokens: zeros, an empty ``groups``, no pairs. Repeated rows
    stay repeated; other columns are left out; an empty table gives no rows. Both files are
    read on the driver and broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        sides = (ByteSide(sent.value.byte_json), PieceSide(sent.value.piece_model))
        tables = [_table(s.bytes) for s in sides]
        for b in batches:
            ends = text_bytes(b.column(1))[1]
            for lo, hi in slices(ends, SLICE_BYTES):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                columns = _slice_columns(texts, sides, tables)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"]
    sent = docs.sparkSession.sparkContext.broadcast(Sides.read(byte_path, piece_path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = plain_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, pairs array<struct<a: int, b: int, n: int>>",
    )


def _table(pieces: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All ids' bytes behind one another; by id: their number, and the id as text in front
    of each separator."""
    n = max(pieces) + 1
    data = [pieces.get(i, b"") for i in range(n)]
    names = [np.array([f"{i}{sep}" for i in range(n)], object) for sep in ",|;"]
    return np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64), names


def _joined(ids: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens behind one another, and where each ends."""
    data, length, _ = table
    size = length[ids]
    ends = np.cumsum(size)
    start = (np.cumsum(length) - length)[ids]
    return data[np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)], ends


def _slice_columns(texts: list[str], sides: tuple, tables: list) -> list[pa.Array]:
    n_docs = len(texts)
    none = np.zeros(0, np.int64)
    ids = [[side.ids(text) if text else none for text in texts] for side in sides]
    count = np.array([[len(x) for x in own] for own in ids], np.int64).reshape(2, n_docs)
    a, b = (np.concatenate([none, *own]) for own in ids)
    kept = np.array([bool(text) for text in texts], bool)
    for x, table, n in zip((a, b), tables, count, strict=True):
        data, ends = _joined(x, table)
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])].tolist()
        for d, text in enumerate(texts):
            if kept[d]:
                kept[d] = data[stops[d] : stops[d + 1]].tobytes() == b" " + text.encode()
    if not kept.all():
        a, b = (x[np.repeat(kept, n)] for x, n in zip((a, b), count, strict=True))
        count *= kept
    ends = [np.cumsum(t[1][x]) for t, x in zip(tables, (a, b), strict=True)]
    runs, odd = runs_and_links(*(e.tolist() for e in ends))
    i, j, size = runs.T
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    one_i, one_j = np.repeat(i, size) + step, np.repeat(j, size) + step
    # a token is the last of its group where both end
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[one_i], last_b[one_j] = True, True
    common = ends[0][odd[:, 0]] == ends[1][odd[:, 1]]
    last_a[odd[common, 0]], last_b[odd[common, 1]] = True, True

    doc_a = np.repeat(np.arange(n_docs), count[0])
    groups = np.bincount(doc_a[last_a], minlength=n_docs)
    link_i, link_j = np.concatenate([one_i, odd[:, 0]]), np.concatenate([one_j, odd[:, 1]])
    n_a, n_b = len(tables[0][1]), len(tables[1][1])
    key = (doc_a[link_i] * n_a + a[link_i]) * n_b + b[link_j]
    key, times = np.unique(key, return_counts=True)
    pairs = pa.StructArray.from_arrays(
        [pa.array(x, pa.int32()) for x in (key // n_b % n_a, key % n_b, times)], ["a", "b", "n"]
    )
    stops = np.searchsorted(key, np.arange(n_docs + 1) * (n_a * n_b)).astype(np.int32)
    lines = _lines(a, b, last_a, last_b, count, tables)
    longs = [pa.array(x, pa.int64()) for x in (count[0], count[1], groups)]
    return [*longs, pa.array(lines, "string"), pa.ListArray.from_arrays(pa.array(stops), pairs)]


def _lines(a, b, last_a, last_b, count: np.ndarray, tables: list) -> list[str]:
    """The groups of every text, written out."""
    at_a, at_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    # tokens of the other side that come before a token: those of groups before its own,
    # for the piece side also those of its own
    before_a = np.concatenate([[0], at_b])[np.cumsum(last_a) - last_a]
    before_b = at_a[np.cumsum(last_b) - last_b] if len(at_a) else np.zeros(0, np.int64)
    out = np.empty(len(a) + len(b), object)
    (_, _, name_a), (_, _, name_b) = tables
    out[np.arange(len(a)) + before_a] = np.where(last_a, name_a[1][a], name_a[0][a])
    out[np.arange(len(b)) + before_b] = np.where(last_b, name_b[2][b], name_b[0][b])
    stops = np.concatenate([[0], np.cumsum(count.sum(axis=0))])
    words = out.tolist()
    return ["".join(words[lo:hi])[:-1] for lo, hi in zip(stops[:-1], stops[1:], strict=True)]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best) out of ``aligned`` rows: in how many links of the corpus a pair of ids
    is linked, and whether no other pair of the same b is linked more often."""
    links = rows.select(F.explode("pairs").alias("p")).select("p.a", "p.b", "p.n")
    counted = links.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``aligned``; columns of them may be left out or added, but for ``pairs``), with
    (n_links, n_best, count_sum) in place of ``pairs``: a row's links, those whose count is the highest of
    their b, and the sum of their counts. A row without pairs gets zeros.

    The rows are written to the shared folder, so that no text is cut twice. The counts have a
    row for each pair of ids that occurs, however many documents there are; they are broadcast
    if their rows, which are counted, fit ``COUNTS_BYTES``, else joined by a shuffle."""
    names = [c for c in rows.columns if c != "pairs"]
    rows = stored(rows)
    counts = stored(pair_counts(rows).select("a", "b", F.col("n").alias("_count"), "best"))
    if counts.count() * COUNT_BYTES <= COUNTS_BYTES:
        counts = F.broadcast(counts)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    links = numbered.select("_row", *[f"`{c}`" for c in names], F.explode_outer("pairs").alias("_p"))
    links = links.select("*", F.col("_p.a").alias("a"), F.col("_p.b").alias("b"), F.col("_p.n").alias("_n")).drop("_p")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    joined = links.join(counts, ["a", "b"], "left")
    summed = joined.groupBy("_row", *[f"`{c}`" for c in names]).agg(
        total("_n").alias("n_links"),
        total(F.when(F.col("best"), F.col("_n"))).alias("n_best"),
        total(F.col("_n") * F.col("_count")).alias("count_sum"),
    )
    return summed.drop("_row")
