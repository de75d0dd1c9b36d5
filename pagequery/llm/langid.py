"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, with_fields

#: Bound of the sample that a dictionary is made of: documents for each language, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 400
#: Texts are encoded in blocks of so many bytes, so that the dictionary counts throughout a long text.
BLOCK = 2048
#: Up to so many bytes a text is short; fillers for it, and their size.
SHORT, FILLERS, SPOKEN = 256, 4, 768
#: Below this lead over the second smallest encoding, as a share of it, a prediction counts as rejected.
MARGIN = 0.01
UNKNOWN = "und"


def learn(docs: DataFrame, learnable: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null lang of the `learnable` rows that have a letter.

    From each language at most about `sample_docs` documents are taken, by a hash of their text, and of each a slice of
    at most `sample_chars` characters that begins at a hashed place; so the dictionaries are bounded, and equal runs
    learn equal ones. Equal texts count once. Languages are counted over all rows. An empty table gives no language.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_docs / n))))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1
    sample = rows.where((place < share[F.col("lang")] * F.lit(1 << 30)) & F.col("text").rlike(r"\p{L}"))
    found: dict[str, set[str]] = {}
    for r in sample.select("lang", F.lower(F.substring("text", start.cast("int"), F.lit(sample_chars))).alias("part")).distinct().collect():
        found.setdefault(r.lang, set()).add(r.part)
    return {lang: " ".join(sorted(parts)).encode() for lang, parts in sorted(found.items())}


class Encoders:
    """The compressors of each language, made once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        plain = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        self.long, self.short = [], []
        for lang in self.langs:
            whole = dictionaries[lang]
            tail = min(len(whole) // 4, SPOKEN * FILLERS)
            fillers = [whole[i : i + tail // FILLERS] for i in range(0, tail - FILLERS + 1, max(tail // FILLERS, 1))][:FILLERS]
            self.long.append(self._coder(whole, zstandard.ZstdCompressionParameters.from_level(5, source_size=BLOCK, dict_size=len(whole), **plain)))
            deep = self._coder(whole[tail:] or b" ", zstandard.ZstdCompressionParameters.from_level(12, source_size=SHORT + SPOKEN, dict_size=len(whole), min_match=3, **plain))
            self.short.append((deep, [(f, len(deep(f))) for f in fillers]))

    @staticmethod
    def _coder(content: bytes, parameters):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress

    def sizes(self, text: bytes) -> list[float]:
        """The encoded size of the whole text for each language, in blocks.

        zstandard stores a text of a few words as it is, and sizes are whole bytes. So a short text is encoded behind
        fillers, text of the language that its dictionary lacks, which set the codes of letters and matches; its size is what it
        adds to theirs, on average.
        """
        if len(text) <= SHORT:
            return [max(sum(len(deep(f + text)) - alone for f, alone in fillers) / max(len(fillers), 1), 0.1) for deep, fillers in self.short]
        return [float(sum(len(f(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))) for f in self.long]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected, replacing columns of those names.

    lang_pred is the language with the smallest encoding of the whole lower-cased text (ties: the first by name), 'und' where text is
    null or has no letter, or no language was learned; score is the softmax share of its relative size (1 for a single language, 0
    for 'und'), and rejected marks a lead of less than `margin`, and 'und'. Only the text is read; rows repeated are
    predicted alike, and an empty table gives an empty result.
    """
    schema = with_fields(docs.schema, ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"))
    kept = [f.name for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score", "rejected")]
    at = len(kept)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            buf, off = packed(batch.column(at))
            text, lettered = buf.tobytes(), batch.column(at + 1).to_pylist()
            langs, scores, rejected = [], [], []
            for i, has in enumerate(lettered):
                if not has or not encoders.langs:
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                sizes = np.array(encoders.sizes(text[off[i] : off[i + 1]]))
                k = int(sizes.argmin())
                rest = np.delete(sizes, k)
                langs.append(encoders.langs[k])
                scores.append(float(1 / np.exp(-40 * (sizes / sizes[k] - 1)).sum()))
                rejected.append(bool(len(rest) and rest.min() - sizes[k] < margin * rest.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*kept, "lang_pred", "score", "rejected"])

    text = F.col("text").cast("string")
    plain = docs.select(*[F.col(f"`{c}`") for c in kept], F.lower(text).alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__lettered"))
    return plain.mapInArrow(of, schema)
