"""Benchmark decontamination: size-partitioned MinHash containment search.

A benchmark item is a small set of word shingles, a document a large one. The items
are partitioned by size. A partition's sketch length follows from its largest size:
a document that holds at least ``SHARE`` of an item lacks so few of its shingles that
one of the item's ``sketch`` smallest hashes must be in the document. So a document's
hashes are looked up in the partitions' sketches, smaller documents than a partition
needs skip it, and each item found is verified by its shingles themselves. The search
misses nothing and doesn't depend on how long a document is."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.simhash import shingle_hashes
from pageloom.llm.tables import plain_columns

WORDS = 5
SHARE = 0.8
#: items are broadcast in blocks of about so many bytes of text
BLOCK_BYTES = 16 << 20


def shingles(text: bytes, n: int = WORDS) -> set[bytes]:
    """Runs of n lower-case words; all words if there are fewer; none of an empty text."""
    words = text.lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def needed(size: int, share: float) -> int:
    return ceil(share * size - 1e-9)


class Index:
    """Sketches and shingles of one block of items."""

    def __init__(self, items: list[tuple[object, bytes]], n: int, share: float):
        self.n, self.share = n, share
        self.ids = [i for i, _ in items]
        self.sets = [shingles(t, n) for _, t in items]
        partitions: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, text) in enumerate(items):
            if self.sets[k]:
                level = len(self.sets[k]).bit_length()
                largest = (1 << level) - 1
                sketch = largest - needed(largest, share) + 1
                for h in np.unique(shingle_hashes(text, n))[:sketch].tolist():
                    partitions[level][h].append(k)
        # smallest document a partition needs, its hashes, and their items
        self.partitions = [
            (needed(1 << (level - 1), share), np.array(sorted(at), "u8"), at) for level, at in sorted(partitions.items())
        ]

    def candidates(self, hashes: np.ndarray) -> set[int]:
        found: set[int] = set()
        for least, keys, at in self.partitions:
            if len(hashes) >= least:
                place = np.searchsorted(keys, hashes)
                place[place == len(keys)] = 0
                for h in set(hashes[keys[place] == hashes].tolist()):
                    found.update(at[h])
        return found

    def hits(self, text: bytes) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the text holds."""
        found = self.candidates(shingle_hashes(text, self.n))
        if not found:
            return []
        own = shingles(text, self.n)
        shared = [(k, len(self.sets[k] & own)) for k in sorted(found)]
        return [(k, s) for k, s in shared if s >= needed(len(self.sets[k]), self.share)]


def _indexes(items: DataFrame, block_bytes: int, n: int, share: float):
    """A broadcast index for each block of items; blocks follow a hash of the item, so
    each is bounded however many items there are."""
    known = plain_columns(items, "item_id", "text").where("text IS NOT NULL").select(
        "item_id", F.col("text").cast("binary").alias("text")
    )
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = [(r.item_id, bytes(r.text)) for r in part.collect()]
        yield items.sparkSession.sparkContext.broadcast(rows)


def contained(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that holds at
    least ``share`` of an item's distinct shingles.

    One pass over the documents for each block of items, without a shuffle. Null and
    empty texts hold nothing and are held by nothing; an item of fewer than n words is
    held only by a text of exactly these words; repeated rows give repeated rows; an
    empty table on either side gives no rows."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_item long, containment double"
    texts = plain_columns(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    out = None
    for block in _indexes(items, block_bytes, n, share):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, to = Index(block.value, n, share), None
            for b in batches:
                to = b.schema.field(0).type
                rows = [
                    (b.column(0)[j].as_py(), index.ids[k], s, len(index.sets[k]), s / len(index.sets[k]))
                    for j, t in enumerate(b.column(1))
                    for k, s in index.hits(t.as_py() or b"")
                ]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                arrays = [pa.array(cols[0], to), pa.array(cols[1], item_type), *(pa.array(c, "int64") for c in cols[2:4]), pa.array(cols[4], "float64")]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        item_type = _arrow_type(items, "item_id")
        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def without_items(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle."""
    at = docs.columns.index("text")
    for block in _indexes(items, block_bytes, n, share):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block.value, n, share)
            for b in batches:
                clean = [not index.hits((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(at)]
                yield b.filter(pa.array(clean, "bool"))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
