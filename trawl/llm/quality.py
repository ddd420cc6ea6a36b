"""Quality rules: base rules and n-gram perplexity bands.

A modified Kneser-Ney model of character 5-grams, one per language, is counted
by Spark over all documents that read like text. Characters are those of the
text (case, digits and white space folded), so what is gathered grows with the
corpus and its scripts and has no bound. Counts, discounts and interpolated
probabilities are joins and aggregates of the n-gram tables; the finished model
is a sorted array of 64-bit n-gram hashes beside an array of their
log-probabilities for each order, and the weights of the contexts likewise. Up
to a checked size the arrays are broadcast; beyond it, blocks of documents of
one language ask the model table for the n-grams that they hold, by a shuffle
join on hashes, with the same result. A document is rejected when its mean
log-perplexity leaves the band of its language, whose width is measured from all
documents and widens for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import checkpointed, collect_garbage, free_name, in_batches, joined_labels, row_key, without_keys

ORDER = 5
#: A document passes within this many standard deviations of its language's median.
BAND_WIDTH = 6.0
#: Longer texts have no narrower band than this, in nats per character.
LEAST_SIGMA = 0.02
#: Models of all languages together are broadcast up to this size (12 bytes an n-gram), asked by blocks of documents beyond.
BROADCAST_BYTES = 96 << 20
BROADCAST_ROWS = 10_000
#: Characters of one language in a block of documents.
BLOCK_CHARS = 32 << 20
#: Characters that are counted, and that are scored at once.
COUNT_CHARS, SCORE_CHARS = 1 << 18, 1 << 16
#: Name of documents without a language.
NO_LANG = "und"
SYMBOL_CHARS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Stands before the first character of a text.
PAD = 2

BASE = T.StructType().add("n_words", "long").add("word_chars", "long").add("n_symbols", "long").add("n_dup_lines", "long").add(
    "n_repeat_words", "long").add("base_failed", "boolean")
SCORE = T.StructType().add("nll", "double").add("nll_var", "double").add("n_scored", "long")

_TABLE: list[np.ndarray] = []
#: Multipliers of the characters of an n-gram, the last one first.
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64)) for j in range(ORDER)]


def _folds() -> np.ndarray:
    """Each code point below 65536 folded: lower case, digits as 0, white space as a space, controls as U+FFFD."""
    out = np.arange(65536, dtype=np.uint32)
    for point in range(65536):
        c = chr(point)
        low = c.lower()
        if c.isspace():
            out[point] = 32
        elif c.isdigit():
            out[point] = 48
        elif point < 32:
            out[point] = 0xFFFD
        elif len(low) == 1:
            out[point] = ord(low)
    return out


def folded(text: str) -> np.ndarray:
    """Folded code points of a text."""
    if not _TABLE:
        _TABLE.append(_folds())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = _TABLE[0][np.minimum(points, 65535)]
    return np.where(points > 65535, points, small) if len(points) and points.max() > 65535 else small


def pieces(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in stretches of about ``size`` characters: (points, begins, lengths, texts).

    A stretch joins parts, each of which follows the ORDER - 1 points before it;
    part i has ``lengths[i]`` characters of text ``texts[i]`` from ``begins[i]``
    of the points on. A longer text spans several stretches.
    """
    pads = np.full(ORDER - 1, PAD, np.uint32)
    parts: list[np.ndarray] = []
    spans: list[tuple[int, int, int]] = []
    held = 0
    for t, text in enumerate(texts):
        points = folded(text)
        for a in range(0, len(points), size):
            part = points[a : a + size]
            parts += [pads if a == 0 else points[a - ORDER + 1 : a], part]
            spans.append((held + ORDER - 1, len(part), t))
            held += ORDER - 1 + len(part)
            if held >= size:
                yield np.concatenate(parts), *np.array(spans).T
                parts, spans, held = [], [], 0
    if spans:
        yield np.concatenate(parts), *np.array(spans).T


def positions(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all characters of the parts of a stretch."""
    shift = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(lengths.sum())


def gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """For n = 0 to ORDER the 64-bit hashes of the n-grams that end at each point; the first n - 1 are of no use."""
    wide = points.astype(np.uint64) + np.uint64(1)
    out = [np.zeros(len(wide), np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            h = out[-1].copy()
            h[n - 1 :] += wide[: len(wide) - n + 1] * FACTORS[n - 1]
            out.append(h)
    return out


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits are as even as their low ones."""
    with np.errstate(over="ignore"):
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def base_rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    found = text.encode("utf-8", "surrogatepass").split()
    n = len(found)
    chars = len(text) - sum(map(text.count, SPACE))
    marks = sum(map(text.count, SYMBOL_CHARS))
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            repeated += line in seen
            seen.add(line)
    covered = 0
    if n > 8:
        h = np.fromiter(map(hash, found), np.int64, n).view(np.uint64)
        with np.errstate(over="ignore"):
            runs = np.zeros(n - 7, np.uint64)
            for i in range(8):
                runs = runs * np.uint64(0x9E3779B97F4A7C15) + (h[i : n - 7 + i] ^ (h[i : n - 7 + i] >> np.uint64(29)))
        sorted_runs = np.sort(runs)
        if (sorted_runs[1:] == sorted_runs[:-1]).any():
            _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
            often = counts[inverse] > 1
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, np.flatnonzero(often), 1)
            np.add.at(steps, np.flatnonzero(often) + 8, -1)
            covered = int((np.cumsum(steps[:n]) > 0).sum())
    return n, chars, marks, repeated, covered, n < 20 or 100 * covered > 30 * n


def reference_like(text: str) -> bool:
    """Whether a text may teach the model: it passes the base rules and has at most one symbol in ten words."""
    n, _, marks, _, _, failed = base_rules(text)
    return not failed and 10 * marks <= n


def count_ngrams(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n): ORDER-grams of the whole of every ``reference_like`` text; null texts have none, null languages are ``und``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
            return keys, counts, np.concatenate([p[2] for p in parts])[first]

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text and reference_like(text):
                    by_lang.setdefault(lang or NO_LANG, []).append(text)
            for lang, texts in by_lang.items():
                for points, begins, lengths, _ in pieces(texts, COUNT_CHARS):
                    at = positions(begins, lengths)
                    hashes = gram_hashes(points)[ORDER][at]
                    order = np.argsort(hashes)
                    hashes = hashes[order]
                    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                    grams = points[at[order[first]][:, None] + np.arange(1 - ORDER, 1)]
                    mine = held.setdefault(lang, [])
                    mine.append((hashes[first], np.diff(np.append(first, len(hashes))), grams))
                    if len(mine) >= 8:
                        held[lang] = [merged(mine)]
        for lang, parts in held.items():
            _, counts, grams = merged(parts)
            for i in range(0, len(counts), 1 << 16):
                text = np.ascontiguousarray(grams[i : i + (1 << 16)]).view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text), pa.array(counts[i : i + (1 << 16)])], ["lang", "gram", "n"])

    parts = in_batches(df.select(F.col(lang_col).cast("string"), F.col(text_col)), run, "lang string, gram string, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language(lang_col: str) -> Column:
    """The name of a row's model: null and empty languages are ``und``."""
    return F.coalesce(F.nullif(F.col(lang_col).cast("string"), F.lit("")), F.lit(NO_LANG))


def discounts(levels: dict[int, DataFrame]) -> DataFrame:
    """(lang, k, d1, d2, d3): Chen and Goodman's discounts of counts 1, 2 and more at each order; one row a language and order."""
    every = None
    for k, df in levels.items():
        part = df.select("lang", F.lit(k).alias("k"), "n")
        every = part if every is None else every.union(part)
    few = every.groupBy("lang", "k").agg(*(F.greatest(F.lit(1), F.count_if(F.col("n") == i)).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}") for i in (1, 2, 3)]
    return few.select("lang", "k", *(F.greatest(F.lit(0.05 * i), F.least(F.lit(float(i)), x)).alias(f"d{i}") for i, x in zip((1, 2, 3), d, strict=True)))


def train(counted: DataFrame) -> DataFrame:
    """(lang, k, gram, value): interpolated modified Kneser-Ney from ORDER-gram counts.

    For k from 1 to ORDER: the log-probability of the last character of a k-gram
    after the others. For -k: the log of the weight that its context (k - 1
    characters) leaves to the lower order. For 0: the log of the share of a
    character that no text holds. Lower orders count distinct predecessors. Each
    step is an aggregate or a join of n-gram tables, keyed by language and n-gram.
    """
    levels = {ORDER: checkpointed(counted)}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = checkpointed(levels[k + 1].groupBy("lang", F.substr("gram", F.lit(2), F.lit(k)).alias("gram")).agg(F.count("*").alias("n")))
    collect_garbage(counted.sparkSession)
    cut = checkpointed(discounts(levels))
    # One row a language and order.
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
    below = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("low")).withColumn("rest", F.lit(""))
    out = [below.select("lang", F.lit(0).alias("k"), F.col("rest").alias("gram"), F.log("low").alias("value"))]
    for k, counts in sorted(levels.items()):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        here = counts.join(cut.where(F.col("k") == k).drop("k"), "lang")
        context = F.substr("gram", F.lit(1), F.lit(k - 1))
        here = here.select("lang", "gram", "n", context.alias("context"), F.substr("gram", F.lit(2), F.lit(k - 1)).alias("rest"), d.alias("d"))
        group = Window.partitionBy("lang", "context")
        here = here.withColumns({"total": F.sum("n").over(group), "left": F.sum("d").over(group)})
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("left") / F.col("total") * F.col("low")
        made = checkpointed(here.join(below, ["lang", "rest"]).select("lang", "gram", "context", (F.col("left") / F.col("total")).alias("weight"), p.alias("p")))
        out.append(made.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("value")))
        weights = made.groupBy("lang", "context").agg(F.first("weight").alias("weight"))
        out.append(weights.select("lang", F.lit(-k).alias("k"), F.col("context").alias("gram"), F.log("weight").alias("value")))
        below = made.select("lang", F.col("gram").alias("rest"), F.col("p").alias("low"))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.maximum(0, np.abs(k := batch.column(1).to_numpy()) - (k < 0))
            h = np.zeros(len(k), np.uint64)
            grams = batch.column(2).to_pylist()
            for n in range(1, ORDER + 1):
                if len(at := np.flatnonzero(size == n)):
                    points = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
                    h[at] = _one_by_one(points.reshape(-1, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spread(h).view(np.int64)), batch.column(3)], ["lang", "k", "hash", "value"])

    return in_batches(every.select("lang", "k", "gram", F.col("value").cast("float")), run, "lang string, k int, hash bigint, value float")


def _one_by_one(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points."""
    n = grams.shape[1]
    with np.errstate(over="ignore"):
        return sum((grams[:, n - 1 - j].astype(np.uint64) + np.uint64(1)) * FACTORS[j] for j in range(n))


class Table:
    """Values of sorted 64-bit hashes: high bits tell where to look, and few steps find the hash or that there is none."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values, self.last = hashes, values, len(hashes) - 1
        bits = max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether each was found)."""
        if self.last < 0:
            return np.zeros(len(h), np.float32), np.zeros(len(h), bool)
        at = self.first[(h >> self.shift).astype(np.int64)]
        beyond = at > self.last
        at = np.minimum(at, self.last)
        here = self.hashes[at]
        behind = np.flatnonzero((here < h) & (at < self.last))
        while len(behind):
            at[behind] += 1
            here[behind] = now = self.hashes[at[behind]]
            behind = behind[(now < h[behind]) & (at[behind] < self.last)]
        return self.values[at], (here == h) & ~beyond


class Model:
    """A language's arrays; ``log_probabilities`` looks the longest n-grams up first and the shorter ones of those not found."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.floor = float(levels[0][1][0]) if 0 in levels and len(levels[0][1]) else 0.0
        none = (np.empty(0, np.uint64), np.empty(0, np.float32))
        self.tables = {k: Table(*levels.get(k, none)) for k in range(-ORDER, ORDER + 1) if k}

    def log_probabilities(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P of the characters at these indices after the ORDER - 1 points before each."""
        hashes = gram_hashes(points)
        out = np.zeros(len(at))
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            value, found = self.tables[k].find(spread(hashes[k][at[left]]))
            out[left[found]] += value[found]
            left = left[~found]
            if not len(left):
                return out
            weight, known = self.tables[-k].find(spread(hashes[k - 1][at[left] - 1]) if k > 1 else spread(np.zeros(len(left), np.uint64)))
            out[left[known]] += weight[known]
        out[left] += self.floor
        return out


def levels_of(table: pa.Table) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(lang, k, hash, value) rows as sorted arrays by language and order."""
    if not table.num_rows:
        return {}
    lang = table.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    which, k = lang.indices.to_numpy(), table.column("k").to_numpy()
    hashes, values = table.column("hash").to_numpy().view(np.uint64), table.column("value").to_numpy()
    order = np.lexsort((hashes, k, which))
    out: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    edges = np.flatnonzero(np.diff(which[order]) | np.diff(k[order])) + 1
    for part in np.split(order, edges):
        out.setdefault(names[which[part[0]]], {})[int(k[part[0]])] = (hashes[part], values[part])
    return out


def rows_of(texts: list[str], langs: list[str | None], model_of) -> list[tuple]:
    """Per text the base rules, nll (mean, nats per character), its variance, and n_scored; ``model_of`` gives a language's Model or None."""
    means: list[tuple[float | None, float | None]] = [(None, None)] * len(texts)
    by_lang = sorted((lang or NO_LANG, i) for i, lang in enumerate(langs) if texts[i])
    for lang, group in groupby(by_lang, key=lambda x: x[0]):
        model, index = model_of(lang), [i for _, i in group]
        if model is None:
            continue
        sums = np.zeros((2, len(index)))
        for points, begins, lengths, which in pieces([texts[i] for i in index], SCORE_CHARS):
            p = model.log_probabilities(points, positions(begins, lengths))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            np.add.at(sums[0], which, np.add.reduceat(p, starts))
            np.add.at(sums[1], which, np.add.reduceat(p * p, starts))
        for j, i in enumerate(index):
            mean = sums[0, j] / len(texts[i])
            means[i] = (-mean, max(0.0, sums[1, j] / len(texts[i]) - mean * mean))
    return [(*base_rules(t), *means[i], len(t)) for i, t in enumerate(texts)]


_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.int64()]


def _with_rows(batch, others: list[str], rows: list[tuple]) -> list:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
    return [*(batch.column(c) for c in others), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))]


def score(df: DataFrame, model: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without its text and with the base rules, nll, its variance and n_scored.

    Null texts count as empty; empty texts have a null nll. New columns replace columns of the same name.
    """
    new = [*BASE.fields, *SCORE.fields]
    taken = {f.name for f in new}
    others = [c for c in df.columns if c.lower() not in taken and c != text_col]
    schema = T.StructType([*df.select(*others).schema.fields, *new])
    wanted = df.select(*dict.fromkeys([*others, text_col, lang_col]))
    if model.count() * 12 > BROADCAST_BYTES:
        return _score_by_blocks(wanted, model, text_col, lang_col, others, schema)
    shared = df.sparkSession.sparkContext.broadcast(levels_of(model.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Model | None] = {}

        def model_of(lang: str) -> Model | None:
            if lang not in known:
                known[lang] = Model(shared.value[lang]) if lang in shared.value else None
            return known[lang]

        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            rows = rows_of(texts, batch.column(lang_col).cast(pa.string()).to_pylist(), model_of)
            yield pa.RecordBatch.from_arrays(_with_rows(batch, others, rows), schema.fieldNames())

    return in_batches(wanted, run, schema)


def _score_by_blocks(df: DataFrame, model: DataFrame, text_col: str, lang_col: str, others: list[str], schema: T.StructType) -> DataFrame:
    """``score`` for models of any size: documents in blocks of one language, each of which fetches the n-grams that it holds."""
    lang = language(lang_col)
    sizes = df.groupBy(lang.alias("_block_lang")).agg(F.ceil(F.sum(F.length(text_col)) / BLOCK_CHARS).alias("_parts"), F.count("*").alias("held"))
    rows = checkpointed(df.withColumns({"_block_lang": lang, "_key": row_key(df)}))
    rows = joined_labels(rows, checkpointed(sizes), "_block_lang").withColumn("_salt", F.pmod("_key", F.greatest(F.coalesce("_parts", F.lit(1)), F.lit(1))))
    rows = rows.drop("_parts", "_key")

    def asked(table: pa.Table) -> pa.Table:
        found: dict[int, np.ndarray] = {}
        texts = [t for t in table.column(text_col).to_pylist() if t]
        for points, begins, lengths, _ in pieces(texts, COUNT_CHARS):
            at, hashes = positions(begins, lengths), gram_hashes(points)
            for k in range(ORDER + 1):
                for kind, h in ((k, hashes[k][at]), (-k, hashes[k - 1][at - 1] if k > 1 else hashes[0][at])):
                    found[kind] = np.union1d(found.get(kind, np.empty(0, np.uint64)), h)
        name, salt = table.column("_block_lang")[0].as_py(), table.column("_salt")[0].as_py()
        k = np.concatenate([np.empty(0, np.int32), *(np.full(len(h), i, np.int32) for i, h in found.items())])
        h = spread(np.concatenate([np.empty(0, np.uint64), *found.values()]))
        return pa.table({"lang": pa.array([name] * len(k), pa.string()), "salt": pa.array([salt] * len(k), pa.int64()), "k": pa.array(k, pa.int32()), "hash": pa.array(h.view(np.int64))})

    wanted = rows.groupBy("_block_lang", "_salt").applyInArrow(asked, "lang string, salt bigint, k int, hash bigint")
    answers = wanted.join(model, ["lang", "k", "hash"])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = levels_of(right)
        models = {name: Model(x) for name, x in levels.items()}
        texts = [t or "" for t in left.column(text_col).to_pylist()]
        made = rows_of(texts, left.column(lang_col).cast(pa.string()).to_pylist(), models.get)
        return pa.Table.from_arrays(_with_rows(left, others, made), schema.fieldNames())

    return rows.groupBy("_block_lang", "_salt").cogroup(answers.groupBy("lang", "salt")).applyInArrow(scored, schema)


def judged(scored: DataFrame, lang_col: str = "lang", width: float = BAND_WIDTH) -> DataFrame:
    """``scored`` with ppl_low, ppl_high (perplexity band of the document) and kept: false outside, or when base rules failed.

    A language's band is its median nll, the spread between its documents and
    the variance a character, over those that pass the base rules.
    """
    rows = scored.withColumn("_lang", language(lang_col))
    fine = F.col("nll").isNotNull() & ~F.col("base_failed")
    quarters = F.percentile_approx(F.when(fine, F.col("nll")), [0.25, 0.5, 0.75], 10000)
    limits = rows.groupBy("_lang").agg(quarters.alias("q"), F.avg(F.when(fine, F.col("nll_var"))).alias("_v"), F.count("*").alias("held"))
    spread_ = F.greatest(F.lit(LEAST_SIGMA), (F.col("q")[2] - F.col("q")[0]) / 1.349)
    limits = checkpointed(limits.select("_lang", "held", F.col("q")[1].alias("_m"), spread_.alias("_s"), "_v"))
    out = joined_labels(rows, limits, "_lang")
    half = width * F.sqrt(F.col("_s") * F.col("_s") + 2 * F.col("_v") / F.greatest(F.col("n_scored"), F.lit(1)))
    inside = F.col("nll").between(F.col("_m") - half, F.col("_m") + half)
    out = out.withColumns({
        "ppl_low": F.exp(F.col("_m") - half), "ppl_high": F.exp(F.col("_m") + half),
        "kept": ~F.col("base_failed") & F.coalesce(inside, F.lit(True)),
    })
    return out.drop("_lang", "_m", "_s", "_v")


def quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", width: float = BAND_WIDTH) -> DataFrame:
    """``df`` without its text and with base rules, perplexity and verdict for every row.

    A language none of whose documents can teach a model has base rules only.
    Repeated rows each get a row and count each time. Null languages are scored
    by a model of their own. An empty table gives no rows. Texts are whole and
    scored once; the scores are checkpointed.
    """
    model = checkpointed(train(count_ngrams(df, text_col, lang_col)))
    collect_garbage(df.sparkSession)
    scored = checkpointed(score(df, model, text_col, lang_col))
    collect_garbage(df.sparkSession)
    return judged(scored, lang_col, width)


def kept(df: DataFrame, text_col: str = "text", lang_col: str = "lang", width: float = BAND_WIDTH) -> DataFrame:
    """The rows of ``df`` that ``quality`` keeps, as they are: texts are read again and not moved, only the keys of rejected rows are."""
    key = free_name(df, "key")
    rows = quality(df.select(text_col, lang_col, row_key(df).alias(key)), text_col, lang_col, width)
    return without_keys(df, rows.where(~F.col("kept")).select(key).distinct())
