"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Every node knows, besides its children, where to go when
the next byte doesn't fit (failure link) and how many pieces are finished by going
there (popped count). Reading a word is then one step per byte, and gives the number
of pieces of greedy longest match without building a piece. Words are split from the
text at white space; equal words of a batch are counted once."""

from __future__ import annotations

import base64
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import plain_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: nodes; a vocabulary beyond it is refused rather than broadcast
MAX_NODES = 20_000_000


class Automaton:
    """Two roots: 0 for a word's first piece, 1 for the pieces that continue it."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        whole: set[int] = set()
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                if piece:
                    whole.add(self._insert(root, piece))
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for byte, v in children.get(u, ()):
                self._link(u, byte, v, v in whole)
                queue.append(v)

    def _insert(self, node: int, piece: bytes) -> int:
        for byte in piece:
            key = node << 8 | byte
            if key not in self.next:
                self.next[key] = len(self.fail)
                self.fail.append(-1)
                self.popped.append(0)
                if len(self.fail) > MAX_NODES:
                    raise ValueError(f"the vocabulary needs more than {MAX_NODES} nodes")
            node = self.next[key]
        return node

    def _link(self, u: int, byte: int, v: int, whole: bool) -> None:
        if whole:  # the node's own text is a piece: finish it, go on behind it
            self.fail[v], self.popped[v] = 1, 1
            return
        z, n = self.fail[u], self.popped[u]
        while z >= 0 and (z << 8 | byte) not in self.next:
            n += self.popped[z]
            z = self.fail[z]
        if z >= 0:
            self.fail[v], self.popped[v] = self.next[z << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if it can't be put together from pieces; 0 if empty."""
        if not word:
            return 0
        step, fail, popped = self.next, self.fail, self.popped
        node = n = 0
        for byte in word:
            to = step.get(node << 8 | byte)
            while to is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = step.get(node << 8 | byte)
            node = to
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuing pieces out of a file of byte pieces and ranks.

    A piece that starts with a space begins a word, without that space; the others
    without white space continue one. Single bytes do both."""
    with open(path, "rb") as file:
        pieces = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    initial = {p[1:] for p in pieces if p[:1] == b" "}
    continuing = {p for p in pieces if p[:1] != b" "}
    single = {p for p in pieces if len(p) == 1}
    clean = lambda ps: sorted(p for p in ps if p and not p.isspace())
    return clean(initial | single), clean(continuing | single)


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) for every row of ``docs``, over its whole text.

    Words are the runs of bytes other than white space. Null and empty texts have no
    words; repeated rows stay repeated; an empty table gives no rows. The vocabulary's
    file is read on the driver and broadcast: its size is bounded by ``MAX_NODES``."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Automaton(*pieces.value).count
        for b in batches:
            known: dict[bytes, int] = {}
            rows = []
            for t in b.column(1):
                text = t.as_py() or b""
                words = text.split()
                n = 0
                for word, times in Counter(words).items():
                    if (k := known.get(word)) is None:
                        k = known[word] = count(word)
                    n += k * times
                rows.append((len(text), len(words), n))
            sizes = [pa.array([r[i] for r in rows], "int64") for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *sizes], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = plain_columns(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")
