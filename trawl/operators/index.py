"""The positional inverted index as tables.

``forward(doc_id, terms, tfs, positions)``, a row a document, ``postings(term,
doc_id, tf, positions)``, which is the same sorted by term and document,
``docs(doc_id, url, title, length, raw_bytes, text)``, ``lexicon(term, df, cf)``
and ``meta(key, value)``. Parquet's statistics on the sorted files do what skip
tables do elsewhere; a term's columns are read one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import text as tx
from trawl.operators import ordered

SKIP_MIN_DF, SKIP_EVERY = 1024, 128


def with_doc_ids(df: DataFrame, *order: str) -> DataFrame:
    """Dense ``doc_id`` from 0 in the given order: ranks within range partitions plus the counts of those before."""
    ordered = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = ordered.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    from trawl.operators.session import checkpointed

    numbered = checkpointed(numbered)
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    # One row a partition.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = numbered.join(F.broadcast(starts.drop("_n")), "_p")
    return placed.withColumn("doc_id", F.col("_start") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_start", "_first")


def forward(docs: DataFrame, analyzer: str = "plain", text_col: str = "text", exact: bool = True) -> DataFrame:
    """(doc_id, terms, tfs, positions), a row a document; rows of one id are one document. Only ids that stand on several rows are shuffled."""
    rows = tx.grouped(docs, analyzer, text_col=text_col, exact=exact)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    if repeated.isEmpty():
        return rows
    same = unfolded(rows.join(repeated, "doc_id", "left_semi")).groupBy("term", "doc_id").agg(
        F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    merged = same.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf", "positions")).alias("z"))
    merged = merged.select("doc_id", F.col("z.term").alias("terms"), F.col("z.tf").alias("tfs"), F.col("z.positions").alias("positions"))
    return rows.join(repeated, "doc_id", "left_anti").unionByName(merged)


def unfolded(forward_rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) of ``forward`` rows."""
    each = forward_rows.select("doc_id", F.inline(F.arrays_zip("terms", "tfs", "positions")))
    return each.select(F.col("terms").alias("term"), "doc_id", F.col("tfs").cast("bigint").alias("tf"), "positions")


def postings(docs: DataFrame, analyzer: str = "plain", text_col: str = "text", exact: bool = True) -> DataFrame:
    """(term, doc_id, tf, positions)."""
    return unfolded(forward(docs, analyzer, text_col, exact))


def document_length(tfs: Column) -> Column:
    return F.aggregate(tfs, F.lit(0).cast("bigint"), lambda total, x: total + x)


def lexicon(posting_rows: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return posting_rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_lengths(docs: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """(doc_id, length): kept tokens, 0 for documents without any."""
    counted = posting_rows.groupBy("doc_id").agg(F.sum("tf").alias("_l"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("_l", F.lit(0)).alias("length"))


def vbyte_size(x: Column) -> Column:
    """Bytes of a non-negative number in 7-bit groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def vbyte_encode(numbers: Column) -> Column:
    """An array of non-negative numbers as bytes: 7 bits a byte, low ones first, the top bit on all but a number's last byte."""
    byte = lambda x, i, last: F.lpad(F.hex(F.shiftrightunsigned(x, 7 * i).bitwiseAND(127).bitwiseOR(0 if last else 128)), 2, "0")

    def one(x: Column) -> Column:
        size = vbyte_size(x)
        out = F.lit("")
        for n in range(9, 0, -1):
            out = F.when(size == n, F.concat(*(byte(x, i, i == n - 1) for i in range(n)))).otherwise(out)
        return out

    return F.unhex(F.array_join(F.transform(numbers, one), ""))


def vbyte_decode(data: Column) -> Column:
    """The numbers of ``vbyte_encode``."""
    digits = F.regexp_extract_all(F.hex(data), F.lit("((?:[89A-F][0-9A-F])*[0-7][0-9A-F])"), F.lit(1))
    low = lambda hexes, i: F.conv(F.substr(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseAND(127)

    def number(hexes: Column) -> Column:
        at = F.sequence(F.lit(0), (F.length(hexes) / 2).cast("int") - 1)
        # The last byte is the highest.
        return F.aggregate(F.reverse(at), F.lit(0).cast("bigint"), lambda total, i: F.shiftleft(total, 7) + low(hexes, i))

    return F.transform(digits, number)


def gap_rows(posting_rows: DataFrame) -> DataFrame:
    """(range, term, doc_id, gap): each document's distance from the one before, from 0, in ``dealt`` ranges."""
    rows = ordered.dealt(posting_rows.select("term", "doc_id"), ["term"], ["doc_id"])
    before = ordered.previous(rows, ["term"], ["doc_id"], "doc_id", "before")
    return before.select(ordered.RANGE, "term", "doc_id", (F.col("doc_id") - F.coalesce("before", F.lit(0))).alias("gap"))


def docid_gaps(posting_rows: DataFrame) -> DataFrame:
    """(term, doc_id, gap)."""
    return gap_rows(posting_rows).drop(ordered.RANGE)


def from_gaps(gaps: DataFrame) -> DataFrame:
    """(term, doc_id) again, by running sums in document order; rows of ``gap_rows`` lie in that order."""
    rows = gaps if ordered.RANGE in gaps.columns else ordered.dealt(gaps, ["term"], ["doc_id"])
    return ordered.running_sum(rows.withColumnRenamed("doc_id", "at"), ["term"], ["at"], "gap", "doc_id").select("term", "doc_id")


def position_gaps(positions: Column) -> Column:
    """First position, then distances."""
    return F.transform(positions, lambda p, i: F.when(i == 0, p).otherwise(p - F.get(positions, i - 1)))


def skip_points(posting_rows: DataFrame, lex: DataFrame, min_df: int = SKIP_MIN_DF, every: int = SKIP_EVERY) -> DataFrame:
    """(term, n, doc_id): every ``every``-th document of the frequent terms."""
    often = posting_rows.join(lex.where(F.col("df") >= min_df).select("term"), "term", "left_semi")
    rows = ordered.row_numbers(ordered.dealt(often.select("term", "doc_id"), ["term"], ["doc_id"]), ["term"], ["doc_id"], "n")
    return rows.select("term", (F.col("n") - 1).alias("n"), "doc_id").where(F.col("n") % every == 0)


def index_stats(docs: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """One row: docs, tokens, terms, postings, uncompressed_bytes, avg_doc_length."""
    lex = lexicon(posting_rows).agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum("cf"), F.lit(0)).alias("tokens"))
    n = docs.agg(F.count("*").alias("docs"))
    both = n.crossJoin(lex)  # one row each
    return both.select(
        "docs", "tokens", "terms", "postings", (4 * (2 * F.col("postings") + F.col("tokens"))).alias("uncompressed_bytes"),
        (F.col("tokens") / F.greatest(F.lit(1), F.col("docs"))).alias("avg_doc_length"),
    )


@dataclass
class Index:
    """An opened index. ``analyzer`` is that of its documents and so of its queries."""

    postings: DataFrame
    docs: DataFrame
    lexicon: DataFrame
    analyzer: str = "plain"
    n_docs: int | None = None
    tokens: int | None = None
    exact: bool = True
    forward: DataFrame | None = None
    #: The documents without their lengths, of which ``docs`` is made.
    source: DataFrame | None = None

    def by_document(self) -> DataFrame:
        """(doc_id, terms, tfs), a row a document with tokens."""
        if self.forward is not None:
            return self.forward.select("doc_id", "terms", "tfs")
        held = self.postings.groupBy("doc_id").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("z"))
        return held.select("doc_id", F.col("z.term").alias("terms"), F.col("z.tf").alias("tfs"))

    def sizes(self) -> tuple[int, int]:
        """(documents, tokens), counted once."""
        if self.n_docs is None or self.tokens is None:
            row = self.docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
            self.n_docs, self.tokens = row.n, row.t
        return self.n_docs, self.tokens

    def term(self, term: str) -> tuple[int, int] | None:
        """(df, cf) of a term, or None."""
        row = self.lexicon.where(F.col("term") == term).first()
        return (row.df, row.cf) if row else None

    def doc(self, doc_id: int) -> dict | None:
        row = self.docs.where(F.col("doc_id") == doc_id).first()
        return row.asDict() if row else None


def build(docs: DataFrame, analyzer: str = "plain", exact: bool = True, keep_text: bool = True) -> Index:
    """Index of docs (doc_id, text and, when they have them, url and title). The title precedes the text.

    Documents keep their texts unless told otherwise."""
    if analyzer not in tx.ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    cols = set(docs.columns)
    body = F.coalesce(F.col("text"), F.lit(""))
    full = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), body) if "title" in cols else body
    told = docs.withColumn("raw_bytes", F.octet_length(body)).drop(*([] if keep_text else ["text"]))
    by_doc = forward(docs.withColumn("_full", full), analyzer, "_full", exact)
    rows = unfolded(by_doc)
    return Index(rows, described(told, by_doc), lexicon(rows), analyzer, exact=exact, forward=by_doc, source=told)


def described(docs: DataFrame, forward_rows: DataFrame) -> DataFrame:
    """``docs`` with their ``length``."""
    lengths = forward_rows.select("doc_id", document_length(F.col("tfs")).alias("_l"))
    rest = [c for c in docs.columns if c not in ("length", "raw_bytes")]
    return docs.join(lengths, "doc_id", "left").select(*rest, F.coalesce("_l", F.lit(0)).alias("length"), "raw_bytes")


def save(index: Index, path: str) -> None:
    """Write the tables over what is there. Texts are read into ``forward`` once, the other tables are made of that.

    Postings are dealt by ranges of (term, doc_id), so a frequent term spans files."""
    spark = index.docs.sparkSession
    by_doc = index.forward if index.forward is not None else index.by_document()
    by_doc.write.mode("overwrite").parquet(f"{path}/forward")
    by_doc = spark.read.parquet(f"{path}/forward")
    unfolded(by_doc).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    described(index.docs if index.source is None else index.source, by_doc).write.mode("overwrite").parquet(f"{path}/docs")
    lexicon(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/lexicon")
    n, tokens = Index(index.postings, spark.read.parquet(f"{path}/docs"), index.lexicon).sizes()
    meta = [("analyzer", index.analyzer), ("docs", str(n)), ("tokens", str(tokens)), ("exact", str(index.exact)), ("forward", "True")]
    spark.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    meta = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
    read = spark.read.parquet
    return Index(read(f"{path}/postings"), read(f"{path}/docs"), read(f"{path}/lexicon"), meta["analyzer"], int(meta["docs"]), int(meta["tokens"]), meta["exact"] == "True",
                 read(f"{path}/forward") if "forward" in meta else None)
