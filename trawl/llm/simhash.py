"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two
fingerprints within the radius share at least one variant, so one shuffle on
variants finds every link without comparing fingerprints pairwise. With an even
radius two holders of one variant are within the radius of each other, so the
members of a variant are linked in a chain and no link is lost; each link is
verified by its Hamming distance all the same. Documents are
first reduced to distinct fingerprints (exact copies never meet), and the
components are found over those by alternating large-star and small-star
rounds with checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import checkpointed, free_name, in_batches, joined_labels, row_key, without_keys

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` lower-cased words, repeats included; shorter texts are one run."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    n = max(1, len(found) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(found[i : i + n] for i in range(shingle))))
    return np.fromiter((digest(x, SEED) for x in runs), np.uint64, n)


def majority(h: np.ndarray, bits: int = 64) -> int:
    """Bit i is 1 when over half of the hashes have it; no hash gives 0."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        block = h[i : i + 65536]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return int(ones) & ((1 << bits) - 1)


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3, bits: int = 64, out: str = "fp") -> DataFrame:
    """``df`` without its text and with ``out``: the signed 64-bit fingerprint of each text. Null texts count as empty."""
    others = [c for c in df.columns if c != text_col]
    schema = df.select(*others).schema.add(out, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((majority(shingle_hashes(t.as_py(), shingle), bits) for t in batch.column(text_col)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(made.view(np.int64))], [*others, out])

    return in_batches(df.select(*others, text_col), run, schema)


def variant_masks(bits: int, half: int) -> list[int]:
    """XOR masks of the ball of radius ``half``, as signed 64-bit numbers."""
    masks = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(words: DataFrame, bits: int = 64, radius: int = 2) -> DataFrame:
    """(a, b): fingerprints that follow each other among the holders of one variant.

    ``words`` has distinct (fp). A variant has at most as many holders as its
    ball of half the radius has points, so no window is large, and all of them
    are within the radius of each other, so the chain loses no link.
    """
    if radius % 2 or not 0 < bits <= 64:
        raise ValueError("radius must be even and bits within 1..64")
    masks = F.array(*(F.lit(m).cast("bigint") for m in variant_masks(bits, radius // 2)))
    spread = words.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = spread.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star rounds until nothing changes, O(log n)
    of them in practice; each is checkpointed to the shared folder.
    """
    edges = checkpointed(edges.select("a", "b"))
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = checkpointed(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = state


def rooted(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``root``: that of their ``key`` in ``roots`` (node, root), or the key itself."""
    held = rows.groupBy(key).agg(F.count("*").alias("held"))
    named = roots.select(F.col("node").alias("_node"), "root")
    labels = held.join(named, F.col(key) == F.col("_node"), "left").select(key, "held", F.coalesce("root", key).alias("root"))
    return joined_labels(rows, checkpointed(labels), key)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id) per row: the smallest id reachable over links, the row's own included.

    ``bits`` is at most 64 and ``radius`` even. Repeated rows and exact copies
    share a component. Null and blank texts have fingerprint 0 and link like any
    other. A null id never becomes a component's id unless all its ids are null.
    An empty table gives an empty result.
    """
    docs = checkpointed(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle, bits))
    prints = docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("held"))
    roots = components(links(prints.select("fp"), bits, radius))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "held", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = checkpointed(named.join(best, "root").select("fp", "held", "component_id"))
    return joined_labels(docs, labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key) of each row, ``key`` the hash of the whole row."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(df).alias("key"))


def one_per_root(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` with one row per root of ``rows`` (id, key, root): the smallest id that is not null, then the smallest key.

    ``key`` tells rows apart that share an id or have none; of rows that are
    equal in every column one stays. Only keys are shuffled, and the rows that
    are in the table more than once.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    best = checkpointed(rows.groupBy("root").agg(first).select(F.col("best.key").alias("key")))
    every = rows.groupBy("key").agg(F.count("*").alias("n"))
    gone = checkpointed(every.join(best, "key", "left_anti").select("key"))
    twice = checkpointed(every.where("n > 1").join(best, "key", "left_semi").select("key"))
    if twice.isEmpty():
        return without_keys(df, gone)
    key = free_name(df, "key")
    again = df.withColumn(key, row_key(df)).join(twice.toDF("_twice"), F.col(key) == F.col("_twice"), "left_semi")
    return without_keys(df, gone.union(twice)).unionByName(again.dropDuplicates([key]).drop(key))


def keep_representatives(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 2
) -> DataFrame:
    """``df`` with one row per component: the one with the smallest id, whether or not other components hold rows with this id.

    A row whose id is null is kept only where a component has no other id.
    """
    docs = checkpointed(fingerprints(keyed(df, id_col, text_col), "text", shingle, bits))
    roots = components(links(docs.select("fp").distinct(), bits, radius))
    return one_per_root(df, rooted(docs, roots, "fp").select("id", "key", "root"))
