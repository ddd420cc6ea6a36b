"""Tokens, analyzers and stems as column expressions.

``plain``: NFKC, case-folded runs of letters and digits, none over 40
characters; long tokens take no position. ``english``: possessives removed,
the same tokens, stop words removed after positions are given (they leave
gaps), Porter stems. Only NFKC with case folding runs in Python, batch by
batch, and only for texts that need it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from trawl.functions import porter
from trawl.operators.session import bounded_batches

MAX_TOKEN = 40
TOKEN, WORD = r"[\p{L}\p{N}]+", r"[\p{L}\p{N}_]+"
ANALYZERS = ("plain", "english")
# The usual 33 English stop words of the Lucene family.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that",
    "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def fold(text: str) -> str:
    """NFKC, then full case folding."""
    return unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def normalized(text: Column, exact: bool = True) -> Column:
    """Folded text. ``exact=False`` stays in the JVM and is equal for NFKC text whose only special case fold is ß."""
    return _fold_udf(text) if exact else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column, exact: bool = True) -> Column:
    """Array of plain tokens; null text gives none."""
    found = F.regexp_extract_all(normalized(F.coalesce(text, F.lit("")), exact), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) <= MAX_TOKEN)


def without_possessives(text: Column) -> Column:
    """``'s`` or ``’s`` after a word character and before a word's end removed."""
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N}_])['’]s(?![\p{L}\p{N}_])", "")


def words(text: Column) -> Column:
    """The word array of duplicate detection: lower case, underscores kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


@F.pandas_udf(StringType())
def stem_udf(terms: pd.Series) -> pd.Series:
    return terms.map(porter.stem)


def positions(docs: DataFrame, analyzer: str = "plain", id_col: str = "doc_id", text_col: str = "text", exact: bool = True) -> DataFrame:
    """(doc_id, pos, term) of every kept token."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}; known are {', '.join(ANALYZERS)}")
    text = F.col(text_col)
    source = without_possessives(F.coalesce(text, F.lit(""))) if analyzer == "english" else text
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(source, exact)).alias("pos", "term"))
    if analyzer == "english":
        # Each task stems its own batches; the cache in ``porter`` makes a repeated term one lookup.
        out = out.where(~F.col("term").isin(*STOP_WORDS)).withColumn("term", stem_udf("term"))
    return out


def grouped(docs: DataFrame, analyzer: str = "plain", id_col: str = "doc_id", text_col: str = "text", exact: bool = True) -> DataFrame:
    """(doc_id, terms, tfs, positions): the kept tokens of each row by term, as arrays; no shuffle. Rows without tokens have empty ones."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}; known are {', '.join(ANALYZERS)}")
    text = F.col(text_col)
    source = without_possessives(F.coalesce(text, F.lit(""))) if analyzer == "english" else text
    numbers = ArrayType(IntegerType())
    schema = StructType().add("doc_id", docs.schema[id_col].dataType).add("terms", ArrayType(StringType())).add("tfs", numbers).add("positions", ArrayType(numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if analyzer == "english":
                names = words.to_pylist()
                keep = np.array([w not in STOP_WORDS for w in names], bool)[code]
                code, row, pos = code[keep], row[keep], pos[keep]
                stems = pa.array([porter.stem(w) for w in names], pa.string()).dictionary_encode()
                code, words = stems.indices.to_numpy().astype(np.int64)[code], stems.dictionary
            key = row * max(1, len(words)) + code
            order = np.argsort(key, kind="stable")
            key, row, code = key[order], row[order], code[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(first, len(key)).astype(np.int32)
            spans = pa.array(np.searchsorted(row[first], np.arange(len(sizes) + 1)).astype(np.int32))
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order].astype(np.int32)))
            columns = (words.take(pa.array(code[first])), pa.array(np.diff(ends)), places)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.ListArray.from_arrays(spans, c) for c in columns)], schema.names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), tokens(source, exact).alias("_t")).mapInArrow(run, schema)


def analyze(text: str, analyzer: str = "plain") -> list[tuple[int, str]]:
    """(position, term) of a query text, on the driver."""
    import regex

    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}; known are {', '.join(ANALYZERS)}")
    if analyzer == "english":
        text = regex.sub(r"(?<=[\p{L}\p{N}_])['’]s(?![\p{L}\p{N}_])", "", text)
    found = [t for t in regex.findall(TOKEN, fold(text)) if len(t) <= MAX_TOKEN]
    pairs = list(enumerate(found))
    if analyzer == "english":
        pairs = [(i, porter.stem(t)) for i, t in pairs if t not in STOP_WORDS]
    return pairs
