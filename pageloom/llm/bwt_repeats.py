"""Removal of repeated text by merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document
with a smaller id. Sorting all suffixes of a corpus to find these strings is not
needed: they are sought where they can be.

1. Every window of ``LENGTH`` bytes picks the smallest hash of the ``ANCHOR``-byte
   strings in it. Equal windows pick equal anchors, so windows that repeat share an
   anchor, and all documents' anchors, grouped by value, show which of them occur in
   two documents. Nothing that repeats is lost.
2. Each such anchor's surroundings (all windows that contain it) go to the task that
   owns the anchor's value. Equal surroundings are one string from then on, owned by
   the smallest document.
3. Where an anchor has several surroundings, shards of them get a Burrows-Wheeler
   transform each, and the transforms are merged: the interleave of the shards starts
   arbitrary and is refined, two symbols a round. After ``LENGTH`` rounds suffixes are
   in order by as many symbols, and the boundaries found on the way delimit the
   repeated intervals. No suffix is sorted against another shard's.
4. The ranges found go back to the documents.

Exact copies of a whole text are told by two hashes beforehand, so a group of copies,
however large, is one text. Within a group of documents (``dealt``) an anchor is listed
once and equal surroundings are one, so what is everywhere is one entry per group."""

from __future__ import annotations

import hashlib
import pickle
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import beside, plain_columns, stored

LENGTH = 50
ANCHOR = 26
#: bytes of a document that are hashed at once; pieces overlap, so no window is lost
PIECE = 1 << 20
#: symbols of a shard, and of the shards that are merged at once (whole anchors): what a
#: round reads and writes then stays in a processor's cache
SHARD, MERGE = 1 << 16, 1 << 18
#: text bytes to a bucket of anchors
BUCKET_BYTES = 8 << 20

_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- anchors


def _string_hashes(text: bytes) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes at each place, from overlapping 8-byte words."""
    m = len(text) - ANCHOR + 1
    word = lambda at: np.ndarray((m,), "<u8", text, at, (1,))
    h = word(0) * _C1
    for at in (8, 16, ANCHOR - 8):
        h ^= h >> np.uint64(29)
        h += word(at)
        h *= _C2
    h ^= h >> np.uint64(32)
    h *= _C3
    h ^= h >> np.uint64(29)
    return h


def _sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of a text."""
    places, hashes = [], []
    w = LENGTH - ANCHOR + 1
    for first in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        part = text[first : first + PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        h = _string_hashes(part)
        least = _sliding(h, w, np.minimum)
        pad = np.zeros(w - 1, "u8")
        chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), w, np.maximum) == h)
        places.append(chosen + first)
        hashes.append(h[chosen])
    if not places:
        return np.empty(0, "i8"), np.empty(0, "u8")
    at, once = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[once]


# --- Burrows-Wheeler transforms


def _suffix_order(symbols: np.ndarray, strings: int) -> np.ndarray:
    """Order of the suffixes of end-marked strings, by doubling; end mark k is smaller than k + 1."""
    rank = symbols.astype("i8") + strings
    ends = np.flatnonzero(symbols == 0)
    rank[ends] = np.arange(len(ends))
    h, n = 1, len(symbols)
    while True:
        key = rank * (n + strings + 300)
        key[: n - h] += rank[h:] + 1
        key[ends] = np.arange(len(ends))  # nothing follows an end mark
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank = np.empty(n, "i8")
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(transform, suffix order) of one shard; symbols are bytes + 1, end marks 0."""
    symbols = np.frombuffer(b"".join(s + b"\0" for s in strings), "u1").astype("u2") + 1
    symbols[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
    order = _suffix_order(symbols, len(strings))
    return _before(symbols, strings, 1)[order], order


def _before(symbols: np.ndarray, strings: list[bytes], steps: int) -> np.ndarray:
    """The symbol so many places before each, around the end of its own string."""
    sizes = np.array([len(s) + 1 for s in strings])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    return symbols[first + (np.arange(len(symbols)) - first - steps) % size]


def merged_classes(shards: list[list[bytes]], depth: int = LENGTH) -> np.ndarray:
    """A number for each suffix of the shards, end marks included, in their order of
    writing: equal for suffixes that agree in ``depth`` symbols, else different.

    A round puts the suffixes, in the order known by h symbols, behind the one or two
    symbols before them: they are then in order by h + 1 or h + 2."""
    parts = [transform(s) for s in shards]
    sizes = [len(o) for _, o in parts]
    one = np.concatenate([b for b, _ in parts])
    two = []
    for (bwt, order), strings in zip(parts, shards, strict=True):
        symbols = np.empty_like(bwt)
        symbols[order] = bwt  # by place: the symbol before
        two.append(_before(symbols, strings, 1)[order])
    two = np.concatenate(two)
    dense = np.unique(one)  # 0, the end mark, stays 0
    one, two = (np.searchsorted(dense, x).astype("u4") for x in (one, two))
    base = len(dense)
    pair = np.where(two == 0, 0, two * base + one)  # what begins with an end mark is that end mark
    step = "u2" if base * base <= 1 << 16 else "u4"
    interleave = np.repeat(np.arange(len(shards), dtype="u1" if len(shards) <= 256 else "u2"), sizes)
    places = np.concatenate([o + first for (_, o), first in zip(parts, np.cumsum([0, *sizes[:-1]]), strict=True)])
    block = np.zeros(len(one), "i4")
    rounds = [(one.astype("u2"), one == 0)] * (depth % 2) + [(pair.astype(step), (pair == 0) | (one == 0))] * (depth // 2)
    for codes, ended in rounds:
        by_shard = np.argsort(interleave, kind="stable")
        code, ends = np.empty_like(codes), np.empty_like(ended)
        code[by_shard], ends[by_shard] = codes, ended
        order = np.argsort(code, kind="stable")
        interleave, behind, code = interleave[order], block[order], code[order]
        # strings that end here all differ, and follow each other as their shards do
        at = np.flatnonzero(ends[order])
        interleave[at] = interleave[at][np.lexsort((interleave[at], code[at]))]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (behind[1:] != behind[:-1])
        fresh[at] = True
        block = np.cumsum(fresh, dtype="i4")
    classes = np.empty(len(one), "i4")
    classes[places] = block[np.argsort(interleave, kind="stable")]
    return classes


#: stands for an anchor in a string; no byte of a text in UTF-8
_ANCHOR_BYTE = b"\xff"


def _smaller_owner(strings: list[tuple[bytes, int]], owner: np.ndarray) -> dict[int, np.ndarray]:
    """By number of string, where it has windows that also start in one with a smaller owner.

    A string is an anchor's surroundings and the anchor's place in them. All its windows
    contain the anchor, so the anchor becomes one symbol, and windows are equal if their
    symbols and their anchors are."""
    depth = LENGTH - ANCHOR + 1
    number: dict[bytes, int] = {}
    anchor = np.array([number.setdefault(s[at : at + ANCHOR], len(number)) for s, at in strings])
    short = [s[:at] + _ANCHOR_BYTE + s[at + ANCHOR :] for s, at in strings]
    shards: list[list[bytes]] = [[]]
    size = 0
    for s in short:
        if size > SHARD:
            shards.append([])
            size = 0
        shards[-1].append(s)
        size += len(s) + 1
    lengths = np.array([len(s) + 1 for s in short])
    classes = merged_classes(shards, depth)
    # places of windows, and of these the ones that are not alone in their class
    string = np.repeat(np.arange(len(short)), lengths)
    first = np.cumsum(lengths) - lengths
    start = np.arange(len(classes)) - first[string]
    at = np.flatnonzero((start < (lengths - depth)[string]) & (np.bincount(classes)[classes] > 1))
    string, start = string[at], start[at]
    key = classes[at].astype("i8") * len(number) + anchor[string]
    order = np.lexsort((owner[string], key))
    string, start, key = string[order], start[order], key[order]
    run = _runs(key)
    least = np.repeat(owner[string[run]], np.diff(np.append(run, len(key))))
    gone = np.flatnonzero(owner[string] > least)
    gone = gone[np.lexsort((start[gone], string[gone]))]
    string, start = string[gone], start[gone]
    run = _runs(string)
    return dict(zip(string[run].tolist(), np.split(start, run[1:]), strict=True)) if len(run) else {}


# --- what travels: arrays in few rows


def _packed(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpacked(cells) -> list[tuple]:
    return [pickle.loads(zstandard.decompress(c.as_py())) for c in cells]


def _table(rows: list[tuple], **columns: pa.DataType) -> pa.Table:
    cells = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.table([pa.array(c, k) for c, k in zip(cells, columns.values(), strict=True)], list(columns))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.empty(0, "i8")
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the hash's lower half, as one number."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _texts(group: pa.Table):
    """(did, tag, text) of a group's documents, whole copies left out."""
    columns = (group[c].to_pylist() for c in ("did", "tag", "copy"))
    for did, tag, copy, text in zip(*columns, group["text"], strict=True):
        if not copy:
            yield did, tag, text.as_py()


def _listed(buckets: int):
    """A group's anchors, each once, bucket by bucket."""

    def run(group: pa.Table) -> pa.Table:
        found = [_codes(anchors(text)[1], buckets) for _, _, text in _texts(group)]
        code = np.unique(np.concatenate([np.empty(0, "u8"), *found]))
        parts = np.split(code, _runs(code >> np.uint64(32))[1:]) if len(code) else []
        p = group["p"][0].as_py()
        rows = [(int(c[0]) >> 32, p, _packed((c & np.uint64(0xFFFFFFFF)).astype("u4"))) for c in parts]
        return _table(rows, slot=pa.int32(), p=pa.int32(), codes=pa.binary())

    return run


def _repeated(bucket: pa.Table) -> pa.Table:
    """Of a bucket's anchors those that two groups of documents have, group by group."""
    p = bucket["p"].to_pylist()
    lists = [codes for (codes,) in _unpacked(bucket["codes"])]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    again = values[counts > 1]
    slot = bucket["slot"][0].as_py()
    rows = [(g, slot, _packed(np.intersect1d(c, again, assume_unique=True))) for g, c in zip(p, lists, strict=True)]
    return _table(rows, p=pa.int32(), slot=pa.int32(), codes=pa.binary())


def _surrounded(buckets: int):
    """A group's repeated anchors with their surroundings, bucket by bucket.

    Equal surroundings in the group are sent once, for the smallest document; the others'
    are known to go (kind 1)."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return _table([], slot=pa.int32(), kind=pa.int32(), p=pa.int32(), found=pa.binary())
        docs = list(_texts(group))
        found = [anchors(text) for *_, text in docs]
        codes = [_codes(h, buckets) for _, h in found]
        # repeated in this group, or between groups
        own = np.concatenate([np.empty(0, "u8"), *map(np.unique, codes)])
        values, counts = np.unique(own, return_counts=True)
        far = [c.astype("u8") | np.uint64(s << 32) for s, (c,) in zip(answers["slot"].to_pylist(), _unpacked(answers["codes"]), strict=True)]
        wanted = np.unique(np.concatenate([values[counts > 1], *far]))
        # anchor, surroundings, its place in them[, document] -> document, places
        owner: dict[tuple, list] = {}
        gone: list[tuple] = []
        for (did, tag, text), (at, _), code in zip(docs, found, codes, strict=True):
            place = np.searchsorted(wanted, code)
            hit = np.flatnonzero((place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == code)) if len(wanted) else []
            first = np.maximum(at[hit] - (LENGTH - ANCHOR), 0).tolist()
            last = np.minimum(at[hit] + LENGTH, len(text)).tolist()
            for c, lo, hi, x in zip(code[hit].tolist(), first, last, at[hit].tolist(), strict=True):
                key = (c, text[lo:hi], x - lo)
                has = owner.get(key)
                if has is None:
                    owner[key] = [did, tag, lo]
                elif has[0] == did and has[1] == tag:
                    has.append(lo)
                elif has[0] < did:
                    gone.append((did, tag, lo, hi))
                elif has[0] == did:
                    owner.setdefault((*key, tag), [did, tag]).append(lo)
                else:
                    gone += [(has[0], has[1], x, x + hi - lo) for x in has[2:]]
                    owner[key] = [did, tag, lo]
        p = group["p"][0].as_py()
        slots: dict[int, list] = {}
        for (c, text, inside, *_), (did, tag, *places) in owner.items():
            slots.setdefault(c >> 32, []).append((text, inside, did, tag, places))
        rows = [(s, 0, p, _packed(x)) for s, x in slots.items()]
        if gone:
            rows.append((p % buckets, 1, p, _packed(gone)))
        return _table(rows, slot=pa.int32(), kind=pa.int32(), p=pa.int32(), found=pa.binary())

    return run


def _ranges(bucket: pa.Table) -> pa.Table:
    """Of a bucket's surroundings the bytes that go, group by group."""
    gone: dict[int, list[tuple]] = {}
    owners: dict[tuple, int] = {}  # surroundings, the anchor's place in them -> smallest document
    seen: list[tuple] = []
    for kind, p, (found,) in zip(bucket["kind"].to_pylist(), bucket["p"].to_pylist(), _unpacked(bucket["found"]), strict=True):
        if kind:
            gone.setdefault(p, []).extend(found)
            continue
        for text, inside, did, tag, places in found:
            key = (text, inside)
            has = owners.get(key)
            owners[key] = did if has is None or did < has else has
            seen.append((key, p, did, tag, places))
    # merge the transforms of anchors with several surroundings, whole anchors at a time
    several: dict[bytes, list[tuple]] = {}
    for text, inside in owners:
        several.setdefault(text[inside : inside + ANCHOR], []).append((text, inside))
    windows: dict[tuple, np.ndarray] = {}
    group: list[tuple] = []
    size = 0
    rest = [several[anchor] for anchor in sorted(several) if len(several[anchor]) > 1]
    for k, strings in enumerate(rest):
        group += strings
        size += sum(len(text) for text, _ in strings)
        if size >= MERGE or k == len(rest) - 1:
            found = _smaller_owner(group, np.array([owners[g] for g in group]))
            windows |= {group[n]: starts for n, starts in found.items()}
            group, size = [], 0
    for key, p, did, tag, places in seen:
        if owners[key] < did:
            spans = [(0, len(key[0]))]
        elif key in windows:
            starts = windows[key]
            breaks = np.flatnonzero(np.diff(starts) > LENGTH)
            if len(breaks):
                firsts, lasts = starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]
                spans = list(zip(firsts.tolist(), (lasts + LENGTH).tolist(), strict=True))
            else:
                spans = [(int(starts[0]), int(starts[-1]) + LENGTH)]
        else:
            continue
        gone.setdefault(p, []).extend((did, tag, lo + a, lo + z) for lo in places for a, z in spans)
    rows = [(p, _packed(np.array(x, "i8").reshape(-1, 4))) for p, x in gone.items()]
    return _table(rows, p=pa.int32(), ranges=pa.binary())


def _cut(text: bytes, ranges: np.ndarray | None) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what is left)."""
    if ranges is None:
        return 0, 0, text
    order = np.argsort(ranges[:, 0], kind="stable")
    lo, hi = ranges[order, 0], np.maximum.accumulate(ranges[order, 1])
    first = np.append(True, lo[1:] > hi[:-1])
    starts, ends = lo[first].tolist(), hi[np.append(np.flatnonzero(first)[1:] - 1, len(hi) - 1)].tolist()
    left = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))
    return len(text) - len(left), len(starts), left


def without_repeats(docs: DataFrame, buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    ``kept`` is what is left, as bytes, or null without ``with_text``. Null texts are empty. A null doc_id comes after
    all others; rows with one doc_id don't count against each other, whether repeated or
    with different texts. An empty table gives no rows.

    ``buckets`` of anchors grow with the text, so that a bucket stays as large as it is."""
    spark = docs.sparkSession
    rows = plain_columns(docs, "doc_id", "text").select(
        F.expr("coalesce(CAST(doc_id AS BIGINT), 9223372036854775807)").alias("did"),
        F.expr("CAST(xxhash64(text) & 2147483647 AS INT)").alias("tag"),
        F.expr("CAST(coalesce(text, '') AS BINARY)").alias("text"),
        "doc_id",
    )
    if buckets is None:
        total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)

    whole = F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))
    named = rows.where(F.length("text") >= LENGTH).select("did", "tag", whole.alias("whole"))
    firsts = named.groupBy("whole").agg(F.min("did").alias("least"))
    copies = stored(named.join(firsts, "whole").where("did > least").select("did", "tag").distinct())
    marked = rows.join(beside(copies).withColumn("copy", F.lit(True)), ["did", "tag"], "left")

    # three steps read the texts as they are dealt here; all take the same columns, so the
    # shuffle is made once and used three times
    group = F.expr(f"CAST(pmod(xxhash64(did, tag), {buckets}) AS INT)").alias("p")
    dealt = marked.select(group, "doc_id", "did", "tag", "copy", "text").repartition(buckets, "p")
    listed = dealt.groupBy("p").applyInArrow(_listed(buckets), "slot int, p int, codes binary")
    repeated = listed.groupBy("slot").applyInArrow(_repeated, "p int, slot int, codes binary")
    around = dealt.groupBy("p").cogroup(repeated.groupBy("p")).applyInArrow(
        _surrounded(buckets), "slot int, kind int, p int, found binary"
    )
    ranges = around.groupBy("slot").applyInArrow(_ranges, "p int, ranges binary")

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        gone: dict[tuple, list] = {}
        for (rows,) in _unpacked(found["ranges"]):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            start = _runs(rows[:, 0], rows[:, 1])
            for part in np.split(rows, start[1:]):
                if len(part):
                    gone.setdefault((int(part[0, 0]), int(part[0, 1])), []).append(part[:, 2:])
        out = []
        columns = (group[c].to_pylist() for c in ("doc_id", "did", "tag", "copy"))
        for doc_id, did, tag, copy, text in zip(*columns, group["text"], strict=True):
            text = text.as_py()
            spans = gone.get((did, tag))
            cut = (len(text), 1, b"") if copy else _cut(text, np.concatenate(spans) if spans else None)
            out.append((doc_id, len(text), cut[0], cut[1], hashlib.sha256(cut[2]).hexdigest(), cut[2] if with_text else None))
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
        return _table(out, doc_id=group.schema.field("doc_id").type, **kinds)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("p").cogroup(ranges.groupBy("p")).applyInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
