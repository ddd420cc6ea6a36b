"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest distinct hashes of a text's
word shingles. Sketches of parts merge into the sketch of the whole, and two of
them estimate resemblance, containment and the number of distinct shingles.
All of it is built-in functions: no Python runs where the texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import words

K, SHINGLE = 128, 5
#: Ranges of ids over which the order of documents is found.
ID_RANGES = 256


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """xxHash64 of each run of ``shingle`` lower-cased words; shorter texts are one run, texts without words none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        run = lambda i: F.xxhash64(*(w[i + F.lit(j)] for j in range(shingle)))
        many = F.transform(F.sequence(F.lit(0), n - F.lit(shingle)), run)
        return F.when(n >= shingle, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    # A one-element transform holds the words for all uses without splitting twice.
    return F.transform(F.array(words(F.lower(text))), of)[0]


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, sorted.

    Long arrays are first cut to the hashes below a bound that all but surely
    holds k of them; where it doesn't, all are sorted, so the result is exact.
    """

    def of(h: Column) -> Column:
        share = F.lit(3.0 * k) / F.greatest(F.size(h), F.lit(1))
        bound = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * F.lit(2.0**64) - F.lit(2.0**63)).cast("bigint"))
        few = F.transform(F.array(bound), lambda b: F.sort_array(F.array_distinct(F.filter(h, lambda x: x <= b))))[0]
        tried = lambda s: F.when((F.size(s) >= k) | (share >= 1), F.slice(s, 1, k)).otherwise(F.slice(F.sort_array(F.array_distinct(h)), 1, k))
        return F.transform(F.array(few), tried)[0]

    return F.transform(F.array(hashes), of)[0]


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The text's bottom-k sketch; null counts as empty, whose sketch is empty."""
    return bottom(shingle_hashes(F.coalesce(text, F.lit("")), shingle), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches describe."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest that both hold. Two empty sketches give 1."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch isn't full."""
    reach = (s[k - 1].cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    union = distinct_shingles(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_text(s: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def range_of(x: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most x, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def followers(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id) in ascending order of distinct non-null ids; the first follows the last.

    Only ids move: they are dealt into ranges between quantiles, ordered within
    each, and a range's first id, which is its lower bound, follows the range before.
    """
    ids = df.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    marks = [i / ID_RANGES for i in range(1, ID_RANGES)]
    low, found = ids.agg(F.min("id"), F.percentile_approx("id", marks, 10000)).first()
    bounds = sorted({b for b in (found or []) if b > low})
    dealt = ids.withColumn("r", range_of(F.col("id"), bounds))
    after = F.lead("id").over(Window.partitionBy("r").orderBy("id"))
    # Bounds are ids of the table, each the smallest of its range.
    first = F.element_at(F.array(*(F.lit(b) for b in [*bounds, low])), F.col("r") + 1) if low is not None else F.lit(None)
    return dealt.select("id", F.coalesce(after, first).alias("next_id"))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4, k: int = K) -> DataFrame:
    """(id, text, sketch, edited, next_sketch) per row: edited has the last 1/share of the text replaced by as many
    of the next document's first code points (all when it has fewer).

    The next document is that of the next larger id (the first after the last);
    of rows that repeat an id, the one with the smallest text. Rows with a null
    id are edited with nothing and have no next sketch. Texts are shuffled once,
    heads of a quarter of their length once.
    """
    every = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Both joins below read these rows by id, and so share one shuffle of the texts.
    docs = every.where("id is not null")
    pairs = followers(df, id_col)
    lengths = docs.groupBy("id").agg(F.max(F.length("text")).alias("most"))
    asked = pairs.join(lengths, "id").select(F.col("next_id").alias("id"), F.col("id").alias("asker"), F.floor(F.col("most") / share).cast("int").alias("size"))
    one = docs.join(asked, "id").select("asker", "size", "text")
    heads = one.select("asker", F.substr("text", F.lit(1), F.col("size")).alias("head"), sketch(F.col("text"), k).alias("next_sketch"), F.xxhash64("text").alias("h"))
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("head", "h"))).where("n = 1").drop("n", "h")
    own = docs.join(heads, docs["id"] == heads["asker"]).select("id", "text", "head", "next_sketch")
    alone = every.where("id is null").select("id", "text", F.lit("").alias("head"), F.lit(None).cast("array<bigint>").alias("next_sketch"))
    own = own.union(alone)
    size = F.length("text")
    cut = F.floor(size / share).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - cut), F.coalesce(F.substr("head", F.lit(1), cut), F.lit("")))
    return own.select("id", "text", sketch(F.col("text"), k).alias("sketch"), edited.alias("edited"), "next_sketch")
