"""BM25 ranking over the postings table, one query or many."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from trawl.functions.text import analyze
from trawl.operators import query as q
from trawl.operators.index import Index, document_length
from trawl.operators.session import bounded_batches

#: Asked (query, term) rows that are sent to every task; more of them join the postings.
SENT_TERMS = 1_000_000
#: Cells of the table documents x queries that a task fills at once.
CELLS = 2_000_000


def lucene_length(n: Column) -> Column:
    """A length as one byte keeps it: exact below 24, above it four significant bits of the rest, rounded down."""
    rest = n - 24
    shift = F.greatest(F.length(F.bin(rest)) - 4, F.lit(0)).cast("int")
    kept = F.transform(F.array(F.struct(rest.cast("long").alias("r"), shift.alias("s"))), lambda x: F.call_function("shiftleft", F.call_function("shiftright", x["r"], x["s"]), x["s"]))[0]
    return F.when(n < 24, n.cast("long")).when(rest < 8, n.cast("long")).otherwise(24 + kept)


def idf(df: Column, n_docs: int) -> Column:
    return F.log(1 + (F.lit(n_docs) - df + 0.5) / (df + 0.5))


def norm(length: Column, average: float, k1: float, b: float, lucene_norms: bool) -> Column:
    """k1 (1 - b + b length / average); the average is of exact lengths, the length quantized when asked for."""
    seen = lucene_length(length) if lucene_norms else length
    return F.lit(k1) * (F.lit(1 - b) + F.lit(b) * seen / F.lit(average))


def scores(index: Index, weights: dict[str, int], k1: float = 0.9, b: float = 0.4, lucene_norms: bool = True) -> DataFrame:
    """(doc_id, score) of documents that hold any weighted term.

    The terms are literals of the scan, so only their row groups are read; the
    documents join on their id.
    """
    n, tokens = index.sizes()
    terms = sorted(weights)
    rows = index.postings.where(F.col("term").isin(terms)).select("term", "doc_id", "tf")
    frequency = {r.term: r.df for r in index.lexicon.where(F.col("term").isin(terms)).select("term", "df").collect()}
    factor = F.lit(0.0)
    for t in terms:
        if t in frequency:
            factor = F.when(F.col("term") == t, F.lit(weights[t]) * idf(F.lit(frequency[t]), n)).otherwise(factor)
    dl = index.docs.select("doc_id", norm(F.col("length"), tokens / max(1, n) or 1.0, k1, b, lucene_norms).alias("_norm"))
    part = factor * F.col("tf") / (F.col("tf") + F.col("_norm"))
    return rows.join(dl, "doc_id").groupBy("doc_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best, ties to the smaller id; ``digits`` rounds before ordering."""
    value = F.round("score", digits).alias("score") if digits is not None else F.col("score")
    return scored.select("doc_id", value).orderBy(F.desc("score"), "doc_id").limit(k)


def search(index: Index, text: str, k: int = 10, candidates: DataFrame | None = None, exclude: list[int] | None = None, digits: int | None = None, **parameters) -> DataFrame:
    """BM25 of a bag of words; quotes and operators are not read."""
    weights = Counter(t for _, t in analyze(text, index.analyzer))
    if not weights:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).where("false")
    scored = scores(index, weights, **parameters).where("score > 0")
    if candidates is not None:
        scored = scored.join(candidates.select("doc_id"), "doc_id", "left_semi")
    if exclude:
        scored = scored.where(~F.col("doc_id").isin(exclude))
    return top(scored, k, digits)


def ranked_search(index: Index, text: str, k: int = 10, priors: DataFrame | None = None, prior_weight: float = 0.0, k1: float = 1.2, b: float = 0.75, lucene_norms: bool = True, digits: int | None = None) -> DataFrame:
    """The product's search: phrases, OR and exclusions decide who qualifies, BM25 of the positive terms who comes first.

    ``priors`` (doc_id, prior) adds prior_weight times the prior to documents that match.
    """
    groups = q.parse(text, index.analyzer)
    weights = Counter(t for g in groups if not g[0].negated for c in g for t in c.terms)
    if not weights:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).where("false")
    scored = scores(index, weights, k1, b, lucene_norms).where("score > 0")
    if any(len(g) > 1 or c.negated or len(c.terms) > 1 for g in groups for c in g):
        scored = scored.join(q.search(index, text), "doc_id", "left_semi")
    if priors is not None and prior_weight:
        scored = scored.join(priors, "doc_id", "left").select("doc_id", (F.col("score") + F.lit(prior_weight) * F.coalesce("prior", F.lit(0.0))).alias("score"))
    return top(scored, k, digits)


def prior(nodes: DataFrame, kind: str | None) -> DataFrame | None:
    """(doc_id, prior) from nodes (id, rank, in_degree): ln(rank N) or ln(1 + in-degree)."""
    if kind in (None, "none"):
        return None
    if kind == "indegree":
        return nodes.select(F.col("id").alias("doc_id"), F.log1p("in_degree").alias("prior"))
    if kind == "pagerank":
        n = nodes.count()
        return nodes.select(F.col("id").alias("doc_id"), F.log(F.col("rank") * n).alias("prior"))
    raise ValueError(f"unknown prior {kind!r}; known are none, pagerank and indegree")


def batch(index: Index, query_terms: DataFrame, k: int = 1000, k1: float = 0.9, b: float = 0.4, lucene_norms: bool = True, remove_self: bool = False, digits: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) of many queries at once: query_terms (qid, term) joins the postings on the term.

    ``remove_self`` drops the document whose id is the query's.
    """
    n, tokens = index.sizes()
    average = tokens / max(1, n) or 1.0
    asked = query_terms.groupBy("qid", "term").agg(F.count("*").alias("w")).join(index.lexicon.select("term", "df"), "term")
    asked = asked.select("qid", "term", (F.col("w") * idf(F.col("df"), n)).alias("w"))
    sent = asked.limit(SENT_TERMS + 1).toArrow()
    if sent.num_rows <= SENT_TERMS:
        scored = _best_by_task(index, sent, asked, k, lambda length: norm(length, average, k1, b, lucene_norms), remove_self, digits)
    else:
        scored = _joined(index, asked, lambda length: norm(length, average, k1, b, lucene_norms), remove_self, digits)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _joined(index: Index, asked: DataFrame, normed, remove_self: bool, digits: int | None) -> DataFrame:
    """(qid, doc_id, score) of all pairs that share a term, by joins."""
    hits = index.postings.select("term", "doc_id", "tf").join(asked, "term")
    if remove_self:
        hits = hits.where("qid <> doc_id")
    dl = index.docs.select("doc_id", normed(F.col("length")).alias("_norm"))
    scored = hits.join(dl, "doc_id").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("tf") / (F.col("tf") + F.col("_norm"))).alias("score"))
    return scored.withColumn("score", F.round("score", digits)) if digits is not None else scored


class Lists(NamedTuple):
    """Asked (query, term, weight) by term: ``begins`` says where a term's queries begin."""

    qids: pa.Array
    terms: pa.Array
    begins: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, sent: pa.Table) -> Lists:
        qids, terms = pc.unique(sent.column("qid")), pc.unique(sent.column("term"))
        term = pc.index_in(sent.column("term"), terms).to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        query = pc.index_in(sent.column("qid"), qids).to_numpy().astype(np.int64)[order]
        return cls(qids, terms, np.searchsorted(term[order], np.arange(len(terms) + 1)), query, sent.column("w").to_numpy()[order])

    def cells(self, held: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each asked (document, term, query): the document's row, the place among all terms of the documents, the place in the lists."""
        sizes = np.diff(held.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        code = pc.fill_null(pc.index_in(held.flatten(), self.terms), -1).to_numpy().astype(np.int64)
        met = np.flatnonzero(code >= 0)
        code = code[met]
        many = self.begins[code + 1] - self.begins[code]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begins[code], many)
        return np.repeat(row[met], many), np.repeat(met, many), at


def holding(index: Index, wanted: DataFrame) -> DataFrame:
    """(qid, doc_id) of the documents that hold all distinct terms of a query; wanted (qid, term)."""
    asked = wanted.distinct()
    sent = asked.withColumn("w", F.lit(1)).limit(SENT_TERMS + 1).toArrow()
    if sent.num_rows > SENT_TERMS:
        size = asked.groupBy("qid").agg(F.count("*").alias("_n"))
        met = index.postings.select("term", "doc_id").join(asked, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("_m"))
        return met.join(size, "qid").where("_m = _n").select("qid", "doc_id")
    docs = index.by_document().select("doc_id", "terms")
    schema = StructType().add("qid", wanted.schema["qid"].dataType).add("doc_id", docs.schema["doc_id"].dataType)
    lists = Lists.of(sent)
    size = np.bincount(lists.query, minlength=len(lists.qids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(size)))
        for whole in batches if len(size) else ():
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                row, _, at = lists.cells(b.column("terms"))
                met = np.bincount(row * len(size) + lists.query[at], minlength=b.num_rows * len(size)).reshape(b.num_rows, len(size))
                doc, query = np.nonzero(met == size)
                yield pa.RecordBatch.from_arrays([lists.qids.take(pa.array(query)), b.column("doc_id").take(pa.array(doc))], schema.names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up of the shortest decimal form, as Spark's ``round``."""
    scaled = x * 10.0**digits
    down = np.floor(scaled)
    part = scaled - down
    out = (down + (part > 0.5)) / 10.0**digits
    for i in np.flatnonzero(np.abs(part - 0.5) <= 1e-15 * scaled + 1e-9):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _best_by_task(index: Index, sent: pa.Table, asked: DataFrame, k: int, normed, remove_self: bool, digits: int | None) -> DataFrame:
    """(qid, doc_id, score): of each task's documents the ``k`` best of every query.

    Documents are read row by row with all their terms, so their scores are whole
    where they lie and only the best of a task move on.
    """
    docs = index.by_document().select("doc_id", "terms", "tfs", normed(document_length(F.col("tfs"))).alias("_norm"))
    schema = StructType().add("qid", asked.schema["qid"].dataType).add("doc_id", docs.schema["doc_id"].dataType).add("score", DoubleType())
    lists = Lists.of(sent)
    qids = lists.qids

    def pruned(best):
        """The first ``k`` of each query in (query, doc_id, score) arrays, and the least score that still counts."""
        query, doc, score = best
        doc_rank = np.asarray(pc.rank(doc, tiebreaker="dense")).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
        at = np.lexsort((doc_rank, -score, query))
        first = np.searchsorted(query[at], np.arange(len(qids)))
        nth = np.arange(len(at)) - first[query[at]]
        at = at[nth < k]
        least = np.zeros(len(qids))
        full = np.flatnonzero(np.bincount(query[at], minlength=len(qids)) >= k)
        last = np.searchsorted(query[at], full, side="right") - 1
        least[full] = score[at][last]
        return (query[at], doc.take(pa.array(at)), score[at]), least

    def table(b: pa.RecordBatch) -> np.ndarray:
        """Scores of documents x queries."""
        row, met, at = lists.cells(b.column("terms"))
        tf = b.column("tfs").flatten().to_numpy()[met].astype(float)
        part = lists.weight[at] * tf / (tf + b.column("_norm").to_numpy()[row])
        return np.bincount(row * len(qids) + lists.query[at], part, minlength=b.num_rows * len(qids)).reshape(b.num_rows, len(qids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least, waiting, held = None, np.zeros(len(qids)), [], 0
        step = max(1, CELLS // max(1, len(qids)))
        for whole in batches if len(qids) else ():
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                score = table(b)
                if remove_self:
                    own = pc.index_in(b.column("doc_id"), qids.cast(b.column("doc_id").type)).to_pandas()
                    mine = np.flatnonzero(own.notna())
                    score[mine, own.to_numpy()[mine].astype(np.int64)] = 0.0
                if digits is not None:
                    score = rounded(score.ravel(), digits).reshape(score.shape)
                row, query = np.nonzero((score > 0) & (score >= least))
                if len(row):
                    waiting.append((query, b.column("doc_id").take(pa.array(row)), score[row, query]))
                    held += len(row)
                if held > CELLS:
                    best, least = pruned(_stacked(waiting if best is None else [best, *waiting]))
                    waiting, held = [], 0
        if waiting or best is not None:
            (query, doc, score), _ = pruned(_stacked(waiting if best is None else [best, *waiting]))
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(query)), doc, pa.array(score)], schema.names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _stacked(parts: list[tuple]) -> tuple:
    return np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
