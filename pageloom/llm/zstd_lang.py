"""Language identification by compression.

Each language has a sample of its texts as a raw-content dictionary for zstandard. A
text is encoded with every dictionary; the language whose dictionary makes it smallest
is chosen. A long text is encoded in pieces, all of them, so that it is the dictionary
that helps and not what the text has said before. Where the best two sizes are close,
the choice is marked as rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import hash_share, plain_columns

#: bytes of a language's dictionary; what it holds is the whole fitting sample
DICTIONARY_BYTES = 64 << 10
#: texts a language's dictionary is filled from, about
SAMPLE_TEXTS = 256
#: languages at most, so that the driver gathers a bounded sample
MAX_LANGUAGES = 256
PIECE_BYTES = 1 << 10
#: the shortest match counts three bytes: much of what tells languages apart is short
LEVEL, MIN_MATCH = 6, 3
#: sizes closer than this part of the smallest are too close to tell
MARGIN = 0.01
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words with single spaces; digits, marks and line ends say nothing of a language."""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def dictionaries(
    labelled: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, sample_texts: int = SAMPLE_TEXTS
) -> dict[str, bytes]:
    """language -> dictionary, from rows with text and lang (nulls of either are left out).

    The sample is bounded by the parameters: texts are chosen by hash, about
    ``sample_texts`` of each language, and the dictionary takes of them, in order of
    hash, as many bytes as it holds. The different texts of each language are counted
    before, so that nothing but the sample travels, and a language with few texts is
    learned from all of them, however often each is repeated. More than
    ``MAX_LANGUAGES`` languages are an error."""
    rows = plain_columns(labelled, "text", "lang").where("text <> '' AND lang IS NOT NULL")
    # by sketches, which are exact or nearly so where there are few
    different = F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("count")
    sizes = rows.groupBy("lang").agg(different).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, sample_texts / r["count"])])[F.col("lang")]
    cut = (
        rows.where(hash_share("text") <= share)
        .groupBy("lang", F.xxhash64("text").alias("place"))
        .agg(F.min(F.substring(F.col("text").cast("binary"), 1, dictionary_bytes)).alias("text"))
    )
    found: dict[str, bytearray] = {}
    seen: set[tuple[str, bytes]] = set()
    for r in cut.orderBy("lang", "place").toLocalIterator():
        have, text = found.setdefault(r.lang, bytearray()), letters(bytes(r.text).decode("utf-8", "ignore"))
        if len(have) < dictionary_bytes and text and (r.lang, text) not in seen:
            seen.add((r.lang, text))
            have += text + b" "
    return {lang: bytes(sample[:dictionary_bytes]) for lang, sample in sorted(found.items()) if sample}


class Classifier:
    def __init__(self, samples: dict[str, bytes], level: int = LEVEL, piece: int = PIECE_BYTES):
        self.langs, self.piece, self.coders = list(samples), piece, []
        for sample in samples.values():
            content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                level, dict_size=len(sample), source_size=piece, min_match=MIN_MATCH,
                write_content_size=False, write_dict_id=False,
            )
            content.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i : i + self.piece] for i in range(0, len(text), self.piece)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected). The score falls from 1 to 1 / languages as the
        others' sizes come near the smallest; of equal sizes the first language in
        order is taken."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(letters(text))
        best = min(sizes)
        # each percent that another is larger counts as one bit
        score = 1 / sum(2.0 ** (-100 * (s - best) / best) for s in sizes)
        second = min((s for k, s in enumerate(sizes) if k != sizes.index(best)), default=2 * best + 1)
        return self.langs[sizes.index(best)], score, second - best < margin * best


def identified(docs: DataFrame, samples: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``, from its text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is everything
    if nothing was learned. Only letters count, in lower case. Repeated rows stay
    repeated; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Classifier(shared.value).predict
        for b in batches:
            rows = [predict(t.as_py(), margin) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            kinds = ("string", "float64", "bool")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain_columns(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )
