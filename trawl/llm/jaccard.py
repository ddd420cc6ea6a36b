"""Near duplicates by the exact Jaccard similarity of shingle sets: the form of near-dedup for a similarity threshold.

SimHash balls come first: nodes whose fingerprints (the majority of a set's
hashes) are within two bits meet by one shuffle of variants and are linked in
chains. Balls alone can't serve: at a similarity of 0.8 two 64-bit fingerprints
differ in about ten bits, and the half radius that would catch nearly all such
pairs has billions of variants. Prefix filtering finds the pairs beyond: with
all shingles in one order, two sets of similarity s or more share one of the
first ``n - ceil(s n) + 1`` shingles of each. Shingles that a sample of the texts shows to be frequent come last, so
that a passage in many documents is hardly ever among the first; the order only
decides the cost, never the result. Where two sets first meet, their positions
bound the overlap still possible. Few holders of a shingle are compared with each
other; many are compared with one head, and then all that are not yet connected
to it with every holder of another component, so no pair that could link is left
out. Holders of a frequent shingle are dealt over salts by its estimated count,
so no task sees all of them. Counts of the shingles by hash bound the difference
of two sets from below and spare most pairs the shuffle of their sets, which
decide all others, those of the balls among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import checkpointed, collect_garbage, in_batches, joined_labels
from trawl.llm.simhash import SEED, components, keyed, links, majority, one_per_root, rooted

#: Frequent shingles are counted in one of so many texts, from so many of these on; the most frequent are known to all tasks.
SAMPLE, OFTEN, MOST_FREQUENT = 16, 4, 1 << 20
#: Bits of the filters that tell which shingles are frequent (2 MB) and which sets are compared (8 MB).
KNOWN_BITS, FILTER_BITS = 1 << 24, 1 << 26
#: Holders of one shingle that are compared with each other at once, and that meet in a task, about.
FEW, PER_SALT = 16, 64
#: Classes of hashes whose shingles are counted in a text, up to the largest signed byte.
CLASSES, MOST = 128, 127
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 20


def prefix_length(n: int, similarity: float) -> int:
    """Shingles of a set of ``n`` one of which every set of this similarity shares."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Lower-cased byte plus one; 0 for white space. UTF-8 has no byte 255.
_BYTES = np.array([0 if b in b" \t\n\x0b\x0c\r" else b + (32 if 65 <= b <= 90 else 0) + 1 for b in range(255)] + [255], np.uint8)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64).cumprod()])
    return _POWERS


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words up to each text's end) of texts that lie one after the other in ``data``.

    A word's hash is a polynomial of its bytes: each byte is multiplied by the
    power of its place, and sums from start to start are taken at once.
    """
    value = _BYTES[data]
    word = value > 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = ends[:-1][ends[:-1] < len(data)]
    # A text begins a word of its own even where the one before ends without white space.
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    upto = np.searchsorted(starts, ends)
    if not len(starts):
        return np.empty(0, np.uint64), upto
    # What precedes the first word is white space.
    value, word = value[starts[0] :], word[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(value)) - np.repeat(starts, np.diff(np.append(starts, len(value))))
    place[~word] = 0
    return _mixed(np.add.reduceat(value * _powers(int(place.max()) + 1)[place], starts)), upto


def _block_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    with np.errstate(over="ignore"):
        words, upto = word_hashes(data, offsets[1:] - offsets[0])
        hashes = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
        for j in range(shingle):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(hashes)]
        hashes = _mixed(hashes)
    digest, a = xxhash.xxh64_intdigest, 0
    for b in upto.tolist():
        node = digest(words[a:b].tobytes(), SEED)
        if b - a < shingle:
            yield node, np.array([node] if b > a else [], np.uint64)
        else:
            h = np.sort(hashes[a : b - shingle + 1])
            fresh = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=fresh[1:])
            yield node, h[fresh]
        a = b


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, sorted distinct shingle hashes) of each text.

    ``node`` is a 64-bit hash of the lower-cased words, so texts that differ in
    case (A-Z) and white space only are one node. Texts of fewer words than a
    shingle are one shingle, null and blank ones none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        limit = (upto[begin - 1] if begin else 0) + BLOCK_BYTES
        end = max(begin + 1, int(np.searchsorted(upto, limit, side="right")))
        yield from _block_sets(texts.slice(begin, end - begin), shingle)
        begin = end


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind, copy=False)))


def frequent(df: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts of a sample hold, sorted, and how many texts hold each; copies within a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = []
            for node, h in shingle_sets(batch.column(0), shingle):
                if node not in seen:
                    seen.add(node)
                    sets.append(h)
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    sample = df.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)
    counted = in_batches(sample, run, "h bigint, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    top = counted.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


class Order:
    """The common order of shingles: rare ones by hash, then the frequent by count."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray]):
        self.hashes, self.counts = known
        self.bits = np.zeros(KNOWN_BITS, bool)
        self.bits[(self.hashes % np.uint64(KNOWN_BITS)).astype(np.int64)] = True

    def prefix(self, h: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """(the first shingles of a set of sorted distinct hashes, counts of those that are frequent: the last ones)."""
        size = prefix_length(len(h), similarity)
        maybe = np.flatnonzero(self.bits[(h % np.uint64(KNOWN_BITS)).astype(np.int64)])
        if not len(maybe):
            return h[:size], np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        real = self.hashes[at] == h[maybe]
        maybe, counts = maybe[real], self.counts[at[real]]
        rare = np.delete(h, maybe)
        if len(rare) >= size:
            return rare[:size], np.empty(0, np.int64)
        order = np.lexsort((h[maybe], counts))[: size - len(rare)]
        return np.concatenate([rare, h[maybe][order]]), counts[order]


def prefixes(df: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``df`` without its text and with node, fp (64-bit SimHash of the set), n (distinct shingles), counts by class, prefix,
    and parts: over how many salts the holders of each frequent shingle (the last ones of the prefix) are dealt."""
    others = [c for c in df.columns if c != text_col]
    schema = df.select(*others).schema.add("node", T.LongType()).add("fp", T.LongType()).add("n", T.LongType()).add("counts", T.ArrayType(T.ByteType()))
    schema = schema.add("prefix", T.ArrayType(T.LongType())).add("parts", T.ArrayType(T.IntegerType()))
    shared = df.sparkSession.sparkContext.broadcast(frequent(df, text_col, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(shared.value)
        for batch in batches:
            nodes, prints, sizes, fronts, parts = [], [], [], [], []
            counts = np.empty((batch.num_rows, CLASSES), np.int8)
            for row, (node, h) in enumerate(shingle_sets(batch.column(text_col), shingle)):
                counts[row] = np.minimum(np.bincount((h % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), MOST)
                nodes.append(node)
                prints.append(majority(h))
                sizes.append(len(h))
                front, often = order.prefix(h, similarity)
                fronts.append(front.view(np.int64))
                parts.append((often * SAMPLE + PER_SALT - 1) // PER_SALT)
            counted = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * CLASSES), pa.array(counts.reshape(-1)))
            columns = [_signed(nodes), _signed(prints), pa.array(sizes, pa.int64()), counted, _lists(fronts, np.int64), _lists(parts, np.int32)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], schema.fieldNames())

    return in_batches(df.select(*others, text_col), run, schema)


def in_balls(found: DataFrame) -> DataFrame:
    """(a, b): nodes that meet by SimHash; ``found`` has node and fp.

    The least node of a fingerprint meets its others, and those of fingerprints
    that follow each other among the holders of a variant.
    """
    nodes = checkpointed(found.select("node", "fp").dropDuplicates(["node"]))
    tops = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("top"), F.count("*").alias("held")))
    same = joined_labels(nodes, tops.where("held > 1"), "fp").select(F.col("top").alias("a"), F.col("node").alias("b")).where("a <> b")
    near = checkpointed(links(tops.select("fp")))
    for x in ("a", "b"):
        near = near.join(tops.select(F.col("fp").alias(x), F.col("top").alias(f"top_{x}")), x)
    return checkpointed(same.union(near.select("top_a", "top_b")))


def sets_of(df: DataFrame, text_col: str, shingle: int, nodes: DataFrame) -> DataFrame:
    """(node, set) of the texts whose node is in ``nodes``; a filter of fixed size spares the others their shuffle."""
    slot = F.pmod("node", F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(pmod(node, {FILTER_BITS}), 64) as int))")
    words = nodes.groupBy(F.floor(slot / 64).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            found, parts = [], []
            for node, h in shingle_sets(batch.column(0), shingle):
                at = node % FILTER_BITS
                if int(bits[at >> 6]) >> (at & 63) & 1 and node not in seen:
                    seen.add(node)
                    found.append(node)
                    parts.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([_signed(found), _lists(parts, np.int64)], ["node", "set"])

    return in_batches(df.select(text_col), run, "node bigint, set array<bigint>").dropDuplicates(["node"])


def viable(a: str, b: str, similarity: float) -> Column:
    """Whether two sets that first meet at these positions can be similar enough."""
    overlap = F.least(F.col(f"{a}.n") - F.col(f"{a}.i"), F.col(f"{b}.n") - F.col(f"{b}.i"))
    return overlap / (F.col(f"{a}.n") + F.col(f"{b}.n") - overlap) >= similarity - 1e-9


def verified(pairs: DataFrame, df: DataFrame, nodes: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the Jaccard similarity or more, exactly."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}")), x)
    apart = F.aggregate(F.zip_with("c_a", "c_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, x: t + x)
    # Sets of this similarity differ in at most this share of their sizes.
    pairs = checkpointed(pairs.where(apart <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6).select("a", "b"))
    told = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(df, text_col, shingle, told)
    first, second = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(second, "b").join(first, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return checkpointed(both.where(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b"))


def similar_roots(df: DataFrame, found: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that are connected to others by pairs of the similarity; ``found`` is ``prefixes`` of ``df``."""
    balls = in_balls(found)
    collect_garbage(df.sparkSession)
    nodes = found.select("node", "n", "prefix", "parts").dropDuplicates(["node"])
    counts = found.select("node", "n", "counts").dropDuplicates(["node"])
    rare = F.size("prefix") - F.size("parts")
    spread = nodes.select("node", "n", "parts", rare.alias("rare"), F.posexplode("prefix").alias("i", "shingle"))
    often = F.get("parts", F.col("i") - F.col("rare"))
    spread = spread.select("shingle", "node", "n", "i", F.when(F.col("i") >= F.col("rare"), often).otherwise(F.lit(1)).alias("parts"))
    spread = spread.withColumn("salt", F.pmod("node", F.col("parts").cast("bigint")).cast("int"))
    group = Window.partitionBy("shingle", "salt")
    counted = spread.withColumns({"held": F.count("*").over(group), "least": F.min("n").over(group)})

    def reach(least: Column) -> Column:
        """A set that can't reach the smallest of the others has no partner here."""
        return (F.col("n") - F.col("i")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6 >= least

    split = F.col("parts") > 1
    held = checkpointed(counted.where(split | (F.col("held") > 1) & reach(F.col("least"))).drop("least"))
    few, many = (held.where(c).drop("held") for c in (~split & (F.col("held") <= FEW), split | (F.col("held") > FEW)))

    def met(x: DataFrame, y: DataFrame, on: list[str], differ: str) -> DataFrame:
        both = x.alias("x").join(y.alias("y"), on).where(differ).where(viable("x", "y", similarity))
        return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    # The head is the set with the fewest shingles of its own, which is like the others more often than they are like each other.
    salts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    heads = many.groupBy("shingle").agg(
        F.min_by(F.struct("node", "n", "i"), F.struct("i", "n", "node")).alias("h"), F.min("n").alias("least"), F.max("parts").alias("parts"), F.count("*").alias("all")
    ).where("all > 1")
    heads = checkpointed(heads)
    many = checkpointed(many.join(heads.select("shingle", "least", salts), ["shingle", "salt"]).where(reach(F.col("least"))).drop("least"))
    starts = heads.select("shingle", "h.*", salts)
    pairs = met(few, few, ["shingle"], "x.node < y.node").union(met(starts, many, ["shingle", "salt"], "x.node <> y.node"))
    collect_garbage(df.sparkSession)
    near = verified(balls.union(pairs), df, counts, text_col, shingle, similarity)
    label = components(near)
    collect_garbage(df.sparkSession)
    if many.isEmpty():
        return label
    # The rest: holders outside the component of their head meet every holder of another component.
    label = checkpointed(label).withColumnRenamed("node", "node_")
    named = many.join(label, many["node"] == label["node_"], "left").select(*many.columns, F.coalesce("root", "node").alias("root"))
    named = checkpointed(named)
    of_head = heads.select("shingle", "parts", F.col("h.node").alias("top")).join(label, F.col("top") == F.col("node_"), "left")
    of_head = of_head.select("shingle", salts, F.coalesce("root", "top").alias("head_root"))
    apart = checkpointed(named.join(of_head, ["shingle", "salt"]).where("root <> head_root").drop("head_root", "salt"))
    if apart.isEmpty():
        return label.withColumnRenamed("node_", "node")
    rest = met(apart.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), named, ["shingle", "salt"], "x.root <> y.root")
    return components(near.union(verified(rest, df, counts, text_col, shingle, similarity)))


def keep_representatives(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``df`` with one row per component of texts of this similarity: the one with the smallest id.

    Null and blank texts are one node; a null id is taken only where a component
    has no other, and rows that share an id are told apart by the rest of the
    row. Very long texts are whole. An empty table gives no rows.
    """
    rows = keyed(df, id_col, text_col)
    found = checkpointed(prefixes(rows, "text", shingle, similarity))
    collect_garbage(df.sparkSession)
    roots = similar_roots(rows, found, "text", shingle, similarity)
    collect_garbage(df.sparkSession)
    return one_per_root(df, rooted(found.select("id", "key", "node"), roots, "node").select("id", "key", "root"))
