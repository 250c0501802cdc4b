"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into segments; the number of set bits per segment
makes it a point on a small grid. The Manhattan distance of two points is never
more than the Hamming distance of their fingerprints, so every link lies within
that distance on the grid. Each point is entered into its own cell and the cells
one step away; two points within distance two then share a cell. Pairs from a cell
are verified on the bits.

A cell with more than ``DENSE`` fingerprints isn't paired up: its fingerprints go on
to the finest grid, one bit a segment, where sharing a cell already proves a link
and a cell is linked as a star. That is as exact, and linear."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.graph import components
from pageloom.llm.tables import beside, plain_columns, stored

SEED = 42
SEGMENTS = 16
MAX_BITS = 2
DENSE = 32


def shingle_hashes(text: bytes, n: int, lower: bool = True) -> np.ndarray:
    """XXH64 of each run of n words (space-joined), of all words if there are fewer, of nothing if none."""
    words = (text.lower() if lower else text).split()
    if not words:
        return np.empty(0, "u8")
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], "u8")
    starts = [0, *(ends[:-1] + 1).tolist()]
    one = xxhash.xxh64_intdigest
    spans = zip(starts, ends[n - 1 :].tolist(), strict=False)
    return np.fromiter((one(flat[a:b], SEED) for a, b in spans), "u8", len(words) - n + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed number; 0 for none."""
    counts = np.zeros(64, "i8")
    for part in np.array_split(hashes, max(1, len(hashes) >> 16)):
        bits = np.unpackbits(part.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="i8")
    on = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(on.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fp) for every row. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(shingle_hashes(t.as_py() or b"", words)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps, "int64")], ["doc_id", "text_hash", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = plain_columns(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary")
    )
    return texts.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def _cells(segments: int) -> str:
    """SQL: the cells of a fingerprint, as hashes of popcounts: its own and those one step away."""
    width = 64 // segments
    counts = ", ".join(
        f"bit_count(shiftrightunsigned(fp, {s * width}) & {(1 << width) - 1}L)" for s in range(segments)
    )
    # a cell's number: its counts as digits, moved up by one so that -1 fits
    base = width + 3
    power = ", ".join(f"{base**s}L" for s in range(segments))
    digits = f"aggregate(zip_with(array({counts}), array({power}), (c, p) -> (c + 1) * p), 0L, (a, x) -> a + x)"
    steps = f"array({', '.join(f'{d * base**s}L' for s in range(segments) for d in (-1, 1))}, 0L)"
    if 64 % segments or base**segments >= 2**63:
        raise ValueError("segments must divide 64, and a cell fit into 63 bits")
    return f"transform(array({digits}), n -> transform({steps}, d -> n + d))[0]"


#: SQL: the fingerprint and each fingerprint that differs from it in one bit
_FLIPS = "concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))"


def links(fps: DataFrame, segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """(a, b): enough pairs of fingerprints at ``MAX_BITS`` or fewer bits to connect
    whatever such pairs connect. ``fps`` has distinct ``fp``.

    Each fingerprint makes 2 * segments + 1 rows of two numbers, whatever the data."""
    cells = fps.select("fp", F.explode(F.expr(_cells(segments))).alias("cell"))
    counted = stored(
        cells.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1")
    )
    light = counted.where(F.col("n") <= dense)
    a, b = light.select(F.col("fp").alias("a"), "cell"), light.select(F.col("fp").alias("b"), "cell")
    near = a.join(b, "cell").where(f"a < b AND bit_count(a ^ b) <= {MAX_BITS}").select("a", "b")
    crowd = counted.where(F.col("n") > dense).select("fp").distinct()
    flips = stored(crowd.select("fp", F.explode(F.expr(_FLIPS)).alias("cell")))
    stars = (
        flips.join(flips.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "cell")
        .where("a < fp")
        .select("a", F.col("fp").alias("b"))
    )
    return near.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 5, segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id, text_hash) for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over links. Equal
    fingerprints count once from here on, so a group of copies, however large, is one
    point. Null and empty texts share fingerprint 0. Repeated rows stay repeated; a
    null doc_id is never the smallest (null if a component has no other); an empty
    table gives no rows."""
    fps = stored(fingerprints(docs, words))
    points = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(points.select("fp"), segments, dense), "a", "b")
    classes = points.join(joined, points.fp == joined.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    classes = stored(classes)
    ids = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = classes.join(ids, "component").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id", "text_hash")


# --- similarity of 0.8 and more
#
# Candidates are the links of the fingerprints, as in near_duplicates. At a similarity of 0.8,
# 64-bit fingerprints differ in about ten bits, though, and within ten bits lie as many chance
# pairs as there are documents squared, on any grid of popcounts. So bands of minimum hashes
# add candidates, and fingerprints put the texts of a large bucket in order. They count a
# repeated shingle as often as it occurs, the similarity once, so they can't rule out a pair.
# Both leave some pairs out. What they join goes on as one class, and the classes are compared
# by lists of the texts' least shingles, of which no similar pair has less than one in common.

BANDS, ROWS = 16, 5
SIMILAR = 0.8
#: texts in a band's bucket that are compared each with each
CROWD = 16
#: texts in a shingle's list that are compared each with each
LISTED = 32
#: a text's listed shingles: so many times as make sure that a similar text has one of them
SURPLUS = 1.25

_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int] | None:
    """A number per band of ``ROWS`` minimum hashes; None for a text without words."""
    if not len(hashes):
        return None
    least = np.full(len(_FACTORS), np.iinfo("u8").max, "u8")
    for first in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[first : first + 4096, None] * _FACTORS).min(axis=0), out=least)
    mixed = np.zeros(BANDS, "u8")
    for column in least.reshape(BANDS, ROWS).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view("i8").tolist()


def least(hashes: np.ndarray, share: float) -> tuple[int, np.ndarray]:
    """How many different shingles a text has, and its least ones, which go into the lists."""
    distinct = np.unique(hashes)
    size = len(distinct)
    enough = size - ceil(share * size - 1e-9) + 1
    return size, distinct[: ceil(SURPLUS * enough)].view("i8")


def sketches(docs: DataFrame, words: int, share: float = SIMILAR) -> DataFrame:
    """(doc_id, text_hash, fp, bands, size, least) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t.as_py() or b"", words) for t in b.column(2)]
            fps, found = [simhash(h) for h in hashes], [bands(h) for h in hashes]
            sizes, leasts = zip(*[least(h, share) for h in hashes], strict=True) if hashes else ((), ())
            columns = [b.column(0), b.column(1), pa.array(fps, "int64"), pa.array(found, pa.list_(pa.int64()))]
            columns += [pa.array(sizes, "int64"), pa.array(leasts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "bands", "size", "least"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = f"doc_id {kind}, text_hash long, fp long, bands array<long>, size long, least array<long>"
    return _texts(docs).mapInArrow(run, marks)


def _texts(docs: DataFrame) -> DataFrame:
    return plain_columns(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary")
    )


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", words)).view("i8") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The (a, b) whose sets are as similar as ``share``."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    sized = both.select("a", "b", F.expr("size(sa) + size(sb)").alias("total"), F.expr("size(array_intersect(sa, sb))").alias("n"))
    return sized.where(f"n >= {share} * (total - n)").select("a", "b")


def _prefixes(crowd: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(token, node, size, pos): the shingles that may be the first a text has in common
    with one as similar as ``share``, in one order of all shingles, the rarest first."""
    mine = sets.join(crowd.select("node"), "node").select("node", F.size("shingles").alias("size"), "shingles")
    tokens = mine.select("node", "size", F.explode("shingles").alias("token"))
    often = stored(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
    ordered = tokens.join(often, "token").groupBy("node", "size").agg(
        F.sort_array(F.collect_list(F.struct("often", "token"))).alias("known")
    )
    # shingles that no other text has come before these
    return ordered.select("node", "size", "known", F.posexplode("known").alias("k", "x")).select(
        F.col("x.token").alias("token"), "node", "size", F.expr("size - size(known) + k + 1").alias("pos")
    ).where(f"size - pos + 1 >= {share} * size")


def _crowd_classes(crowd: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(old, new): what the components of ``crowd`` (node, score, component) become when
    all pairs of its texts as similar as ``share`` are linked.

    Texts are listed by the shingles of their prefixes: two that are similar are in a list
    together. A short list is paired up. In a longer one, a text is taken out and compared
    with all of the list that isn't in its class yet, then 4, 16 and so on, the best
    connected ones first, until the list is one class or empty. So the original of many
    edits joins them in one round, and no pair is left out."""
    labels = stored(crowd.select("node", "component", F.col("component").alias("old"), "score"))
    entries = stored(_prefixes(crowd, sets, share))
    turns = 1
    while True:
        marked = entries.join(labels.select("node", "component", "score"), "node")
        marked = stored(marked)
        lists = marked.groupBy("token").agg(
            F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")
        )
        lists = stored(lists.where("x <> y").select("token", "n"))
        if not lists.head(1):
            break
        live = stored(marked.join(lists, "token"))
        # those taken out: one of each part of a list, all of a short one
        part = F.when(F.col("n") <= CROWD, F.col("node")).otherwise(F.expr(f"pmod(xxhash64(node, {turns}), {turns})"))
        out = live.groupBy("token", part.alias("part")).agg(F.max(F.struct("score", "node", "size", "pos", "component")).alias("m"))
        out = stored(out.select("token", "m.*").drop("score"))
        a = out.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "pos", "component")])
        most = "(1 + least(size_a - pos_a, size - pos))"
        fits = f"component <> component_a AND {most} >= {share} * (size_a + size - {most})"
        pairs = live.join(a, "token").where(fits).select(
            F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")
        )
        new = _verified(stored(pairs.distinct()), sets, share)
        side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        joined = components(new.join(side("a"), "a").join(side("b"), "b"), "ca", "cb").select(
            F.col("node").alias("component"), F.col("component").alias("joined")
        )
        labels = stored(
            labels.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"), "old", "score")
        )
        entries = stored(live.join(out.select("token", "node"), ["token", "node"], "left_anti").select("token", "node", "size", "pos"))
        turns *= 4
    return labels.groupBy("old").agg(F.min("component").alias("new"))


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): texts with equal or linked fingerprints. Of the texts of one fingerprint each goes
    with the first, and the first ones of linked fingerprints go together."""
    known = texts.where("bands IS NOT NULL").select("node", "fp")
    points = stored(known.groupBy("fp").agg(F.min("node").alias("head")))
    equal = known.join(points, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    end = lambda fp, head: points.select(F.col("fp").alias(fp), F.col("head").alias(head))
    near = links(points.select("fp")).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    return equal.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _sets_of(docs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the texts in ``nodes``, each read from its first document."""
    firsts = beside(stored(texts.select("node", "first").join(nodes, "node")))
    source = _texts(docs).withColumnRenamed("text_hash", "node")
    bodies = source.join(firsts, (source["node"] == firsts["node"]) & source["doc_id"].eqNullSafe(firsts["first"])).select(
        source["node"], "text"
    )
    return stored(_shingle_sets(bodies, words).dropDuplicates(["node"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _relabelled(classes: DataFrame, moved: DataFrame) -> DataFrame:
    """``classes`` with the components that ``moved`` (old, new) names replaced."""
    m = moved.select(F.col("old").alias("component"), "new")
    return stored(
        classes.join(m, "component", "left").select("node", "first", F.coalesce("new", "component").alias("component"))
    )


def _lists(texts: DataFrame, joined: DataFrame) -> DataFrame:
    """(token, node, size, component, n): the least shingles of every text that are in the list
    of a text of another class too; n texts are in the list."""
    known = beside(joined)
    listed = texts.join(known, "node", "left").select(
        "node", "size", F.coalesce("component", "node").alias("component"), F.explode("least").alias("token")
    )
    token = Window.partitionBy("token")
    counted = listed.select(
        "*", F.count("*").over(token).alias("n"), F.min("component").over(token).alias("x"), F.max("component").over(token).alias("y")
    )
    return counted.where("x <> y").drop("x", "y")


def _listed_classes(
    texts: DataFrame, classes: DataFrame, joined: DataFrame, sets_of: Callable[[DataFrame], DataFrame], share: float
) -> DataFrame:
    """``classes`` (node, first, component) after all pairs of texts as similar as ``share`` are
    linked, those that are in different classes so far; ``joined`` is the part of the classes
    that has links.

    The texts' least shingles (see ``least``) are listed by shingle. What two texts have in
    common is in both their lists, or is not listed by one of them. Lists of up to ``LISTED``
    texts are paired up, and a pair is verified if what it has in common there, what it may have
    in longer lists and what is not listed could make it similar. A text that could have all it
    has in common with a similar one in longer lists goes on to ``_crowd_classes``, which
    leaves out no pair of such texts."""
    shared = stored(_lists(texts, joined))
    long = shared.where(F.col("n") > LISTED)
    hot = stored(long.groupBy("node").agg(F.count("*").alias("hot"), F.sum("n").alias("score"), F.max("size").alias("size")))
    fewest = f"ceil({share} * size)"  # shingles of a similar text
    crowd = hot.where(f"hot > {SURPLUS - 1} * ({fewest} - ceil({share} * {fewest}) + 1) OR hot >= {fewest}")
    end = lambda x: shared.where(F.col("n") <= LISTED).select(
        "token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "component")]
    )
    apart = f"component_a < component_b AND size_a >= {share} * size_b AND size_b >= {share} * size_a"
    pairs = end("a").join(end("b"), "token").where(apart).groupBy("node_a", "node_b").agg(
        F.count("*").alias("n"), F.any_value("size_a").alias("size_a"), F.any_value("size_b").alias("size_b")
    )
    known = beside(hot.select("node", "hot"))
    for x in "ab":
        pairs = pairs.join(known.select(F.col("node").alias(f"node_{x}"), F.col("hot").alias(f"hot_{x}")), f"node_{x}", "left")
    rest = lambda x: f"greatest(0, size_{x} - ceil({SURPLUS} * (size_{x} - ceil({share} * size_{x}) + 1)))"
    most = f"n + least(coalesce(hot_a, 0), coalesce(hot_b, 0)) + greatest({rest('a')}, {rest('b')})"
    near = pairs.withColumn("most", F.expr(most)).where(f"most >= {share} * (size_a + size_b - most)")
    near = stored(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
    sets = sets_of(_ends(near).union(crowd.select("node")).distinct())
    side = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    links = _verified(near, sets, share).join(side("a"), "a").join(side("b"), "b")
    classes = _relabelled(classes, components(links, "ca", "cb").select(F.col("node").alias("old"), F.col("component").alias("new")))
    if not crowd.head(1):
        return classes
    crowd = stored(crowd.join(classes, "node").select("node", "score", "component"))
    return _relabelled(classes, _crowd_classes(crowd, sets, share))


def similar(docs: DataFrame, words: int = 5, share: float = SIMILAR) -> DataFrame:
    """(doc_id, text_hash, component_id): classes of documents connected by texts whose
    sets of shingles have a Jaccard similarity of ``share`` or more.

    Equal texts are one from the start. Texts whose fingerprints are equal or linked (at
    ``MAX_BITS`` or fewer bits, by the segment popcounts) are candidates, and so are texts that
    share a band: in a bucket of up to ``CROWD`` all of them, in a larger one each with the bucket's
    first and with its neighbours in order of fingerprint and of number. Candidates are verified
    by their shingles. Of what that leaves apart no pair is left out: ``_listed_classes`` finds
    all that are similar.
    Null and empty texts are equal to their like and similar to nothing."""
    marks = stored(sketches(docs, words, share))
    one = ["fp", "bands", "size", "least"]
    texts = marks.groupBy(F.col("text_hash").alias("node")).agg(
        F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in one]
    )
    texts = stored(texts)
    entries = texts.select("node", "fp", F.posexplode("bands").alias("band", "key")).select(
        "node", "fp", F.xxhash64("band", "key").alias("cell")
    )
    cell = Window.partitionBy("cell")
    shared = stored(
        entries.select("node", "fp", "cell", F.count("*").over(cell).alias("n")).where("n > 1")
    )
    small, large = shared.where(F.col("n") <= CROWD), shared.where(F.col("n") > CROWD)
    end = lambda df, x: df.select("cell", F.col("node").alias(x))
    each = end(small, "a").join(end(small, "b"), "cell").where("a < b")
    heads = large.groupBy("cell").agg(F.min("node").alias("head"))
    chained = [
        large.join(heads, "cell").select("head", "node"),
        large.select(F.lag("node").over(cell.orderBy("fp", "node")).alias("head"), "node"),
        large.select(F.lag("node").over(cell.orderBy("node")).alias("head"), "node"),
    ]
    pairs = each.select("a", "b")
    for c in chained:
        pairs = pairs.unionByName(
            c.where("head <> node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
        )
    near = stored(pairs.unionByName(_fingerprint_pairs(texts)).distinct())
    sets_of = lambda nodes: _sets_of(docs, texts, nodes, words)
    joined = stored(components(_verified(near, sets_of(_ends(near)), share), "a", "b"))
    classes = stored(
        texts.join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    )
    classes = _listed_classes(texts, classes, joined, sets_of, share)
    ids = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = classes.join(ids, "component").select(F.col("node").alias("text_hash"), "component_id")
    return marks.join(labels, "text_hash").select("doc_id", "text_hash", "component_id")


def without_copies(docs: DataFrame, words: int = 5, share: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each class of ``similar``, the one with the smallest doc_id.

    Rows that repeat the doc_id and text of the document that stays are that document,
    and stay too; rows without a doc_id always stay. A document is told by doc_id and
    a hash of its text, so one doc_id with two texts is judged for each."""
    found = similar(docs, words, share)
    gone = beside(stored(found.where("doc_id <> component_id").select("doc_id", "text_hash").distinct()))
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")
