"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample texts. A text is
reduced to its words and cut into blocks, each block is compressed with every dictionary, and the
language with the smallest sum wins; nothing else is learned or looked at. A
text is rejected when the runner-up is too close.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import in_batches

#: Sample texts a language at most, and bytes of them that a dictionary holds: the bound of the training sample.
SAMPLE_DOCS, DICTIONARY_BYTES = 96, 64 << 10
LEVEL, BLOCK = 6, 2048
#: Saved bytes over the runner-up, as a share of the smallest sum, below which a text is rejected.
MIN_MARGIN = 0.02
UNKNOWN = "und"
LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), re.compile(r"[\W\d_]+")

PREDICTED = T.StructType().add("lang_pred", "string").add("score", "double").add("lang_margin", "double").add("lang_rejected", "boolean")


def sample(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", seed: int = 42) -> dict[str, list[str]]:
    """Texts a language for its dictionary: at most ``SAMPLE_DOCS`` non-empty ones, first in a seeded hash order.

    No sample text is longer than a dictionary. The window keeps that many rows a language in every task before any shuffle.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = df.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.substr(text_col, F.lit(1), F.lit(DICTIONARY_BYTES)).alias("text"), order.alias("h")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = rows.withColumn("r", rank).where(F.col("r") <= SAMPLE_DOCS)
    out: dict[str, list[str]] = {}
    for r in picked.select("lang", "r", "text").sort("lang", "r").toLocalIterator():
        out.setdefault(r.lang, []).append(r.text)
    return out


def dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """Raw dictionary content a language: equal bytes for all, each text once, so that none wins by size."""
    held = {}
    for lang, texts in samples.items():
        parts = dict.fromkeys(map(plain, texts))
        share = max(1024, DICTIONARY_BYTES // max(1, len(parts)))
        held[lang] = b"\n".join(p[:share] for p in parts)
    size = max(DICTIONARY_BYTES // 8, min([DICTIONARY_BYTES, *map(len, held.values())]))
    return {lang: content[-size:] for lang, content in held.items()}


def plain(text: str) -> bytes:
    """Lower-cased words by single spaces, marks and digits left out, a word that repeats at once written once."""
    return " ".join(w for w, _ in groupby(NOT_LETTERS.sub(" ", text.lower()).split())).encode("utf-8", "surrogatepass")


class Classifier:
    """Compressors of every language; ``sizes`` gives the compressed bytes of a text by language."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score within 0..1, margin, rejected)."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sorted(s for i, s in enumerate(sizes) if i != best)
        margin = (others[0] - sizes[best]) / sizes[best] if others else 1.0
        weight = sum(math.exp(-min(700.0, (s - sizes[best]) * math.log(2))) for s in sizes)
        return self.langs[best], 1 / weight, margin, margin < MIN_MARGIN


def predict(df: DataFrame, content: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``df`` without its text and with lang_pred, score, lang_margin and lang_rejected for each whole text.

    Null texts, texts without a letter, and every text when there is no
    dictionary are ``und`` with score 0 and rejected. Other rows always name the
    nearest language; ``lang_rejected`` says that the margin is too narrow.
    """
    taken = {f.name for f in PREDICTED.fields}
    others = [c for c in df.columns if c != text_col and c.lower() not in taken]
    schema = T.StructType([*df.select(*others).schema.fields, *PREDICTED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(content)
        for batch in batches:
            rows = [classifier.predict(t.as_py()) for t in batch.column(text_col)]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            found = list(zip(*rows, strict=True)) if rows else [[]] * 4
            columns = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], schema.fieldNames())

    return in_batches(df.select(*others, text_col), run, schema)
