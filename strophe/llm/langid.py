"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample texts. A text, in lower
case and with what isn't letters as single spaces, is cut into pieces of ``PIECE`` bytes, every piece is compressed with each dictionary, and the
language whose sizes add up to least is chosen. Pieces, rather than one long stream, keep
a long text from being its own dictionary. The score is the margin to the second
language, relative to the second's size and scaled to 0..1; where it is under
``min_score`` the answer counts as rejected. Texts to identify are read whole.

The sample to learn from is bounded: per language at most SAMPLE_DOCS labelled documents, those
of smallest hash, which share DICTIONARY bytes evenly. Of each, the first 2 * DICTIONARY /
(documents found) characters are read, twice its share, since the halves of a sample that ``learn``
compares fill whole dictionaries too. So what reaches the driver is at most languages * 2 *
DICTIONARY characters.

The margin under which a text is rejected is learned from the same labelled documents by
``learn``: each half of them is scored with dictionaries of the other half, once with all
languages and once without the text's own, and the margin is the one that tells the two
apart best, a text of a known language rejected counting REJECTED times one of an unknown
language accepted. Without three languages none can be left out, and MIN_SCORE holds.

Defined results: a null, empty or letterless text is 'und' with score 0 and is rejected.
Equal sizes go to the language first in code point order, score 0. Without any labelled
row everything is 'und'.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import with_fields

SAMPLE_DOCS = 100
DICTIONARY = 64 << 10
PIECE = 512
LEVEL = 6
#: Letters only: everything between them counts as one space.
BETWEEN = re.compile(r"[\W\d_]+")
#: A relative margin of this much or more scores 1.
FULL_MARGIN = 0.25
#: The margin where none can be learned.
MIN_SCORE = 0.05
#: How many accepted texts of unknown languages one rejected text of a known one is worth.
REJECTED = 20
NONE = "und"


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """{lang: sample bytes} of rows doc_id, text, lang."""
    return _joined(_picked(labelled))


def learn(labelled: DataFrame) -> tuple[dict[str, bytes], float]:
    """The dictionaries of rows doc_id, text, lang, and the margin learned from the same rows."""
    texts = _picked(labelled)
    return _joined(texts), margin(*scores(texts))


def scores(texts: dict[str, list[bytes]]) -> tuple[list[float], list[float]]:
    """Scores of the texts when their language is known, and when it is left out.

    No text is scored with a dictionary that it is part of: the halves of a language's texts,
    taken in turn, score each other.
    """
    known, unknown = [], []
    for half in (0, 1):
        made = {lang: _coder(sample) for lang, sample in _joined({lang: found[1 - half :: 2] for lang, found in texts.items() if found[1 - half :: 2]}).items()}
        if len(made) < 3:
            return [], []
        for lang in sorted(made):
            others = [coder for x, coder in sorted(made.items()) if x != lang]
            for text in texts[lang][half::2]:
                if text.strip():
                    known.append(_closest(text, [made[x] for x in sorted(made)])[1])
                    unknown.append(_closest(text, others)[1])
    return known, unknown


def margin(known: list[float], unknown: list[float]) -> float:
    """The least score to accept: with it the share of known texts rejected, times REJECTED, and
    that of unknown ones accepted have the least sum. It lies midway between the scores next to it."""
    if not known:
        return MIN_SCORE
    cuts = sorted({0.0, *known, *unknown, 1.0})
    known, unknown = sorted(known), sorted(unknown)
    cost = [REJECTED * bisect_left(known, x) / len(known) + 1 - bisect_left(unknown, x) / len(unknown) for x in cuts]
    k = cost.index(min(cost))
    return (cuts[max(k - 1, 0)] + cuts[k]) / 2


def _picked(labelled: DataFrame) -> dict[str, list[bytes]]:
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    cut = usable.select("lang", "doc_id", F.substring("text", 1, 2 * DICTIONARY).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    picked = cut.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_DOCS)
    share = F.floor(2 * DICTIONARY / F.count("*").over(Window.partitionBy("lang"))).cast("int")
    picked = picked.select("lang", "_n", F.substr("text", F.lit(1), share).alias("text"))
    texts: dict[str, list] = {}
    for row in picked.orderBy("lang", "_n").collect():
        texts.setdefault(row["lang"], []).append(normalised(row["text"]))
    return texts


def _joined(texts: dict[str, list[bytes]]) -> dict[str, bytes]:
    out = {}
    for lang, found in texts.items():
        share = max(64, DICTIONARY // len(found))
        out[lang] = b"\n".join(x[:share] for x in found)[:DICTIONARY]
    return out


def identify(docs: DataFrame, samples: dict[str, bytes], min_score: float = MIN_SCORE) -> DataFrame:
    """Adds lang_pred, score and rejected to ``docs``, which has a text column; columns of these
    names are replaced."""
    langs, docs = sorted(samples), docs.drop("lang_pred", "score", "rejected")

    def run(batches):
        coders = [_coder(samples[x]) for x in langs]
        for batch in batches:
            found = [_best(text, coders) for text in batch.column(place).to_pylist()]
            preds = pa.array([langs[k] if k is not None else NONE for k, _ in found], pa.string())
            scores = [s for _, s in found]
            more = [preds, pa.array(scores, pa.float64()), pa.array([k is None or s < min_score for k, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    place = docs.columns.index("text")
    return docs.mapInArrow(run, with_fields(docs, "lang_pred string, score double, rejected boolean"))


def _dictionary(sample: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return made


def _coder(sample: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(sample), write_checksum=False, write_content_size=False, write_dict_id=False)


def normalised(text: str) -> bytes:
    return BETWEEN.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def _best(text: str | None, coders: list) -> tuple[int | None, float]:
    if not text or not coders or not any(map(str.isalpha, text)):
        return None, 0.0
    return _closest(normalised(text), coders)


def _closest(data: bytes, coders: list) -> tuple[int, float]:
    sizes = [0] * len(coders)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        for k, coder in enumerate(coders):
            sizes[k] += len(coder.compress(piece))
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    if len(order) == 1:
        return 0, 1.0
    least, second = sizes[order[0]], sizes[order[1]]
    return order[0], min(1.0, (second - least) / second / FULL_MARGIN)


def learnable(doc_id: Column) -> Column:
    """Documents a model may learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(True))
