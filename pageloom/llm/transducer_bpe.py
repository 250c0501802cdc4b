"""Byte-pair encoding through a minimal acyclic transducer of frequent words.

Words are counted over all documents, and the most frequent ones are compiled, with the
ids that the merges give them, into one automaton that shares common beginnings and
common endings. Its arcs carry numbers whose sum along a word's path is the word's own
number, and that leads to its ids. The file is memory-mapped by every worker: the
workers of a machine share its pages. The distinct words of a slice of texts walk
through it in step, one array operation per letter. A word it doesn't hold is merged
exactly; which words it holds changes speed only, never a result.

Decoding joins the texts of the ids by one space, as a tokenizer without a decoder does."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.arrow_texts import list_array, slices, text_bytes
from pageloom.llm.tables import plain_columns, stored
from pageloom.plans.checkpoints import shared_dir

MODEL = public_tokenizers.path("word_bpe_49k.json")
#: words compiled into the automaton, and the bytes of the longest of them
LEXICON_WORDS, LEXICON_BYTES = 200_000, 48
#: words a worker remembers beyond the automaton, and words it counts before it hands them on
MEMORY, COUNTED = 100_000, 150_000
#: bytes of a word up to which its ranks are searched as a list, not as a heap
SHORT = 64
#: bytes of text encoded at a time, and ids whose texts are joined at a time
SLICE_BYTES, DECODED = 1 << 20, 250_000

# How the tokenizer splits a normalised text, and the end of a word.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def unicode_rules() -> tuple[dict[str, str], dict[str, str]]:
    """The code points of letters, digits and white space, as ranges, and the lower-case
    letters that the interpreter doesn't know.

    Unicode tables differ by version; these are the tokenizers library's own."""
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    every = "".join(points)

    def ranges(kind: str) -> str:
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(kind), "removed", invert=True)
        runs: list[list[int]] = []
        for c in sorted(ord(c) for found, _ in split.pre_tokenize_str(every) for c in found):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(rf"\U{lo:08x}-\U{hi:08x}" for lo, hi in runs)

    kinds = {"letter": ranges(r"\p{L}"), "digit": ranges(r"\p{N}"), "space": ranges(r"\s")}
    own = tokenizers.normalizers.Lowercase().normalize_str("\n".join(points)).split("\n")
    # the line feed itself left an empty line and one more
    own[10:12] = ["\n"]
    return kinds, {c: low for c, low in zip(points, own, strict=True) if c.lower() != low}


@dataclass
class Model:
    """What the tokenizer's file says: ids by piece, merges by pair of ids, special texts."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> rank, merged id
    special: dict[str, int]
    kinds: dict[str, str]
    lower: dict[str, str]
    texts: list[str] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # id of each byte, at a word's end
    starts: list[int] = field(default_factory=list)  # id of each byte elsewhere

    @classmethod
    @cache
    def read(cls, path: str = MODEL) -> Model:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        ids = stored["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in stored["model"]["merges"]]
        merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        texts = [""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in [*ids.items(), *special.items()]:
            texts[i] = text
        letters = byte_letters()
        ends, starts = [ids[c + WORD_END] for c in letters], [ids[c] for c in letters]
        return cls(ids, merges, special, *unicode_rules(), texts, ends, starts)


class Splitter:
    """Words of a text: normalised, without white space, special texts whole."""

    def __init__(self, model: Model):
        self.special = model.special
        self.any_special = re.compile("|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) or r"(?!)")
        # the same pattern for texts of more and fewer planes: a class of few planes is faster
        self.words = re.compile(SPLIT.format(**model.kinds)).findall
        basic = {k: re.sub(r"\\U(?!0000)\w+-\\U\w+", "", v) for k, v in model.kinds.items()}
        self.basic_words = re.compile(SPLIT.format(**basic)).findall
        self.ascii_words = re.compile(SPLIT.format(letter="a-z", digit="0-9", space=r"\t-\r ")).findall
        self.beyond_basic = re.compile("[\U00010000-\U0010ffff]").search
        self.lower = model.lower
        self.any_lower = re.compile(f"[{''.join(map(re.escape, model.lower))}]" if model.lower else r"(?!)")
        # one range holds them all, and is found faster
        span = map(re.escape, (min(model.lower), max(model.lower))) if model.lower else ()
        self.maybe_lower = re.compile(f"[{'-'.join(span)}]" if model.lower else r"(?!)").search

    def __call__(self, text: str) -> list[str]:
        if "<|" not in text or not self.any_special.search(text):
            return self._plain(text)
        out, done = [], 0
        for found in self.any_special.finditer(text):
            out += self._plain(text[done : found.start()])
            out.append(found.group())
            done = found.end()
        return out + self._plain(text[done:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text.lower())
        # letter by letter, so a final sigma is no special case
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if self.maybe_lower(text):
            text = self.any_lower.sub(lambda m: self.lower[m.group()], text)
        text = text.lower()
        return (self.words if self.beyond_basic(text) else self.basic_words)(text)


class Merger:
    """Exact merges: always the pair of lowest rank, the leftmost of equals."""

    def __init__(self, model: Model):
        self.model = model
        self.rank_of = {pair: rank for pair, (rank, _) in model.merges.items()}.get
        self.merged = [m for _, m in model.merges.values()]  # by rank

    def __call__(self, word: str) -> list[int]:
        model = self.model
        if word in model.special:
            return [model.special[word]]
        data = word.encode()
        if not data:
            return []
        piece = [model.starts[b] for b in data]
        piece[-1] = model.ends[data[-1]]
        return self._short(piece) if len(piece) <= SHORT else self._long(piece)

    def _short(self, piece: list[int]) -> list[int]:
        """A list of the ranks of all neighbours, kept up to date."""
        rank_of, none = self.rank_of, len(self.merged)
        ranks = [rank_of(pair, none) for pair in zip(piece, piece[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            piece[i] = self.merged[low]
            del piece[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((piece[i - 1], piece[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((piece[i], piece[i + 1]), none)
        return piece

    def _long(self, piece: list[int]) -> list[int]:
        """A heap of places over a linked list: a word of n bytes takes n log n steps."""
        n, rank_of = len(piece), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((piece[i], piece[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # the place has changed since
            if piece[i] < 0 or j >= n or rank_of((piece[i], piece[j])) != rank:
                continue
            piece[i], piece[j] = self.merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((piece[i], piece[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of((piece[h], piece[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in piece if p >= 0]


def compiled(entries: Iterable[tuple[bytes, list[int]]]) -> np.ndarray:
    """The minimal acyclic transducer of sorted, distinct, non-empty words, as one array.

    Words are added in order; what is left of the last word's path, from its end up, is
    replaced by an equal state wherever there is one. Layout: four sizes, then arc keys
    (state * 256 + byte, ascending), arc targets, arc numbers, whether each state ends a
    word, where each word's ids start, and the ids. The start is state 0."""
    arcs: list[dict[int, int]] = [{}]  # of every state, by byte in ascending order
    final = [False]
    free: list[int] = []  # states that were replaced
    register: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, byte = path.pop()
            state = arcs[parent][byte]
            equal = register.setdefault((final[state], *arcs[state].items()), state)
            if equal != state:
                arcs[parent][byte] = equal
                free.append(state)

    path: list[tuple[int, int]] = []  # (parent, byte) on the way to the last word's end
    last, where, ids = b"", [0], []
    for word, own in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(path, same)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[same:]:
            path.append((state, byte))
            if free:
                new = free.pop()
                arcs[new], final[new] = {}, False
            else:
                new = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][byte] = state = new
        final[state] = True
        last = word
        ids += own
        where.append(len(ids))
    settle(path, 0)

    # states that are left, children before parents, and the number of words behind each
    order, words, seen, stack = [], {}, {0}, [(0, iter(arcs[0].values()))]
    while stack:
        state, rest = stack[-1]
        child = next((c for c in rest if c not in seen), None)
        if child is None:
            stack.pop()
            order.append(state)
            words[state] = final[state] + sum(words[c] for c in arcs[state].values())
        else:
            seen.add(child)
            stack.append((child, iter(arcs[child].values())))
    name = {state: k for k, state in enumerate(reversed(order))}
    keys, targets, numbers, ends = [], [], [], []
    for state in reversed(order):
        ends.append(final[state])
        passed = int(final[state])
        for byte, child in arcs[state].items():
            keys.append(name[state] << 8 | byte)
            targets.append(name[child])
            numbers.append(passed)
            passed += words[child]
    parts = [keys, targets, numbers, ends, where, ids]
    sizes = [len(keys), len(ends), len(where) - 1, len(ids)]
    return np.concatenate([np.array(p, np.int64) for p in [sizes, *parts]])


class Lexicon:
    """A compiled transducer, read in place."""

    def __init__(self, array: np.ndarray):
        arcs, states, self.words, ids = map(int, array[:4])
        cuts = np.cumsum([4, arcs, arcs, arcs, states, self.words + 1, ids])
        self.keys, self.targets, self.numbers, self.final, self.where, self.ids = (
            array[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        )

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.int64, mode="r"))

    def numbers_of(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that isn't listed. All words go in step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, data = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive, letter = np.flatnonzero(size), 0
        while len(alive) and len(self.keys):
            key = state[alive] << 8 | data[start[alive] + letter]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.targets[arc]
            number[alive] += self.numbers[arc]
            letter += 1
            alive = alive[size[alive] > letter]
        listed = (state >= 0) & (size > 0) & (len(self.keys) > 0)
        listed[listed] = self.final[state[listed]] == 1
        return np.where(listed, number, -1)


def word_counts(docs: DataFrame, model: Model) -> DataFrame:
    """(word, n) over all texts of ``docs``; added up in the tasks before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counted = Splitter(sent.value), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counted), "string"), pa.array(list(counted.values()), "int64")], ["word", "n"]
            )

        for b in batches:
            for text in b.column(0):
                counted.update(split(text.as_py()))
                if len(counted) > COUNTED:
                    yield out()
                    counted.clear()
        if counted:
            yield out()

    sent = docs.sparkSession.sparkContext.broadcast(model)
    parts = plain_columns(docs, "text").where("text != ''").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, words: int) -> list[str]:
    """At most ``words`` of the most frequent words of a (word, n) table that can be read twice.

    How many words there are of each order of magnitude, in sixteenths of a doubling, says
    from which one on they fit; only those words reach the driver, no other ranks."""
    size = F.floor(16 * F.log2("n")).cast("int")
    room, least = words, None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r.n
        if room < 0:
            break
        least = r["size"]
    return [] if least is None else [r.word for r in counts.where(size >= least).select("word").collect()]


def lexicon_file(docs: DataFrame, model: Model, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of ``docs``; the name of a file every worker finds.

    Words of over ``LEXICON_BYTES`` bytes, and those that occur once, are left to the merges, so
    what reaches the driver is bounded by the two parameters. The file goes to the
    shared folder, and from there to the executors, also to those that start later."""
    counts = stored(word_counts(docs, model).where((F.octet_length("word") <= LEXICON_BYTES) & (F.col("n") > 1)))
    merge = Merger(model)
    array = compiled(sorted((w.encode(), merge(w)) for w in frequent(counts, words)))
    return _sent_file(docs.sparkSession, f"lexicon-{uuid4().hex}.bin", array.tobytes())


def _sent_file(spark: SparkSession, name: str, content: bytes) -> str:
    folder, context = shared_dir(spark), spark.sparkContext
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()
    context.addFile(path.toString())
    return name


def encoded(docs: DataFrame, path: str = MODEL, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``, over its whole text.

    The ids are those of the tokenizers library for the same file without added special
    tokens, truncation or padding; special texts within a text are their one id. Null and
    empty texts have no ids; repeated rows stay repeated; an empty table gives no rows;
    columns other than doc_id and text are left out. The model's file is read on the
    driver and broadcast. Makes one pass over the texts for the word counts first."""
    model = Model.read(path)
    file = lexicon_file(docs, model, words)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon.mapped(SparkFiles.get(file))
        split, merge = Splitter(sent.value), Merger(sent.value)
        merged: dict[str, list[int]] = {}
        for b in batches:
            ends = text_bytes(b.column(1))[1]
            for lo, hi in slices(ends, SLICE_BYTES):
                known: defaultdict[str, int] = defaultdict()
                known.default_factory = known.__len__  # a new word gets the next number
                number = known.__getitem__
                lines = [
                    np.fromiter(map(number, split(t.as_py())), np.int64) for t in b.column(1).slice(lo, hi - lo)
                ]
                start, size, ids = _ids_of(list(known), lexicon, merge, merged)
                used = np.concatenate(lines)
                sizes = size[used]
                # all places of one word's ids, then the next word's
                place = np.repeat(start[used] - (np.cumsum(sizes) - sizes), sizes)
                place += np.arange(len(place))
                row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
                per_row = np.bincount(row, weights=sizes, minlength=len(lines)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), list_array(ids[place], per_row)], ["doc_id", "ids"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = plain_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _ids_of(
    words: list[str], lexicon: Lexicon, merge: Merger, merged: dict[str, list[int]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word's ids start, how many they are, and all ids one after another."""
    number = lexicon.numbers_of([w.encode() for w in words])
    start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    listed = number >= 0
    start[listed] = lexicon.where[number[listed]]
    size[listed] = lexicon.where[number[listed] + 1] - start[listed]
    more: list[int] = []
    for k in np.flatnonzero(~listed):
        own = merged.get(words[k])
        if own is None:
            own = merge(words[k])
            if len(words[k]) <= LEXICON_BYTES:
                if len(merged) >= MEMORY:
                    merged.clear()
                merged[words[k]] = own
        start[k], size[k] = len(lexicon.ids) + len(more), len(own)
        more += own
    return start, size, np.concatenate([lexicon.ids, np.array(more, np.int64)])


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` (with ``ids``, and whatever else) and the text of their ids as ``decoded``: special
    tokens too, one space between. Null or no ids give an empty text; an id the model
    doesn't have is an error."""
    rows = rows.drop("decoded")
    names = rows.columns
    sent = rows.sparkSession.sparkContext.broadcast(Model.read(path).texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = sent.value.__getitem__
        for b in batches:
            lists = b.column(names.index("ids"))
            ends = np.cumsum([0, *pc.list_value_length(lists).fill_null(0).to_numpy()])
            for lo, hi in slices(ends, DECODED):
                own = list(map(text, lists.slice(lo, hi - lo).flatten().to_numpy().tolist()))
                places = (ends[lo : hi + 1] - ends[lo]).tolist()
                out = [" ".join(own[x:y]) for x, y in zip(places, places[1:])]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(out, "string")], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, decoded string")
