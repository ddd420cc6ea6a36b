"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. The flow routes
each pattern's words to its sources' targets; the first pass over a pattern is
free and each repetition costs one more than the last, so repeats are used as
evenly and as late as the targets allow. A pattern then takes a whole number of
passes over all its documents and one more over those first in a seeded order,
which a cutoff describes: it is found from sums of hash ranges and of the
documents of one range, and applied where the documents lie. No document is
moved or collected; the driver sees one row a pattern. Sources that share no
document are settled without a flow, so there may be any number of them.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import checkpointed, joined_labels, local_rows

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: Rows of a plan, one a set of sources, that are sent to every task; longer plans meet the documents in a shuffle.
BROADCAST_ROWS = 10_000
#: Hash ranges in which a cutoff is sought, as bits: at least, and so many that about this many documents fall into one.
RANGE_BITS, RANGE_DOCS = 10, 1 << 17
#: Stands for a null source; sorts after every code point.
NULL_SOURCE = "\U0010ffff\U0010ffff"


def targets(sizes: dict[str, int], total: float, weights: tuple = WEIGHTS, most: float = MAX_PASSES) -> dict[str, float]:
    """Shares of ``total`` by weight (sources in code point order, weights repeating), none above ``most`` times its
    source's size; the excess is shared again by weight among the others until none is above."""
    order = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set[str] = set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        base = sum(weight[s] for s in free)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / base for s in order}
        above = {s for s in free if out[s] > most * sizes[s]}
        if not above:
            return out
        capped |= above


def min_cost_flow(supply: list[int], members: list[list[int]], demand: list[int], passes: int = MAX_PASSES) -> list[list[int]]:
    """Words that pattern p gives to its member sources (in their order), by successive shortest paths.

    Pattern p gives up to ``supply[p]`` words at cost 0, as many again at cost
    1, and so on; source s takes up to ``demand[s]``. The flow is largest, then cheapest.
    """
    p, s = len(supply), len(demand)
    source, sink = p + s, p + s + 1
    graph: list[list[int]] = [[] for _ in range(p + s + 2)]
    to, room, price = [], [], []

    def edge(a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(w)
        return len(to) - 2

    for i in range(p):
        for k in range(passes):
            edge(source, i, supply[i], k)
    given = [[edge(i, p + j, passes * supply[i], 0) for j in members[i]] for i in range(p)]
    for j in range(s):
        edge(p + j, sink, demand[j], 0)
    potential = [0] * len(graph)
    while True:
        best: list[float] = [float("inf")] * len(graph)
        came = [-1] * len(graph)
        best[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in graph[x]:
                if room[e] and (n := d + price[e] + potential[x] - potential[to[e]]) < best[to[e]]:
                    best[to[e]], came[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if came[sink] < 0:
            return [[room[e ^ 1] for e in row] for row in given]
        potential = [a + (b if b < float("inf") else best[sink]) for a, b in zip(potential, best, strict=True)]
        push, x = None, sink
        while x != source:
            push = room[came[x]] if push is None else min(push, room[came[x]])
            x = to[came[x] ^ 1]
        x = sink
        while x != source:
            room[came[x]] -= push
            room[came[x] ^ 1] += push
            x = to[came[x] ^ 1]


def routed(supply: list[int], members: list[list[int]], demand: list[int], passes: int = MAX_PASSES) -> list[list[int]]:
    """``min_cost_flow`` of each group of sources that documents connect; a source whose documents have no other needs none."""
    parent = list(range(len(demand)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for row in members:
        for j in row[1:]:
            parent[find(j)] = find(row[0])
    groups: dict[int, list[int]] = {}
    for i, row in enumerate(members):
        groups.setdefault(find(row[0]), []).append(i)
    out: list[list[int]] = [[] for _ in members]
    for group in groups.values():
        if len(group) == 1 and len(members[group[0]]) == 1:
            i = group[0]
            out[i] = [min(passes * supply[i], demand[members[i][0]])]
            continue
        held = sorted({j for i in group for j in members[i]})
        place = {j: k for k, j in enumerate(held)}
        flow = min_cost_flow([supply[i] for i in group], [[place[j] for j in members[i]] for i in group], [demand[j] for j in held], passes)
        for i, row in zip(group, flow, strict=True):
            out[i] = row
    return out


def pattern(sources: Column) -> Column:
    """The sorted distinct sources of an array; null members and null or empty arrays count as the null source."""
    named = F.transform(sources, lambda s: F.coalesce(s.cast("string"), F.lit(NULL_SOURCE)))
    some = F.array_sort(F.array_distinct(named))
    return F.when(F.size(sources) > 0, some).otherwise(F.array(F.lit(NULL_SOURCE)))


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(id_col: str, seed: int) -> tuple[Column, Column]:
    """Hash and tie of the seeded order; null ids are one id."""
    return F.xxhash64(F.lit(seed), F.col(id_col)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def plan(df: DataFrame, size: Column, sources: Column, id_col: str = "doc_id", weights: tuple = WEIGHTS, seed: int = 42) -> DataFrame:
    """One row a set of sources: mix_names, mix_source_size, mix_target, mix_whole passes and the cutoff (mix_key, mix_tie) of one more.

    Reads ``df`` three times, so ``size`` should be a column rather than made of texts.
    """
    key, tie = _order(id_col, seed)
    rows = df.select(size.cast("long").alias("mix_size"), pattern(sources).alias("mix_pattern"), key.alias("k"), tie.alias("t"))
    spark = df.sparkSession
    sums = rows.groupBy("mix_pattern").agg(F.sum("mix_size").alias("n"), F.count("*").alias("held")).collect()
    sums = sorted((tuple(r.mix_pattern), int(r.n or 0), r.held) for r in sums)
    sizes: dict[str, int] = {}
    for names, n, _ in sums:
        for s in names:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes)
    wanted = targets(sizes, sum(n for _, n, _ in sums), weights)
    place = {s: j for j, s in enumerate(order)}
    flows = routed([n for _, n, _ in sums], [[place[s] for s in names] for names, _, _ in sums], [round(wanted[s]) for s in order])
    made = []
    for i, ((names, n, held), row) in enumerate(zip(sums, flows, strict=True)):
        whole, rest = divmod(sum(row), n) if n else (1, 0)
        made.append((i, list(names), sizes[names[0]], float(wanted[names[0]]), whole, rest, held))
    table = local_rows(
        spark, made, mix_id=pa.int32(), mix_names=pa.list_(pa.string()), mix_source_size=pa.int64(), mix_target=pa.float64(), mix_whole=pa.int64(), mix_rest=pa.int64(), mix_held=pa.int64()
    )
    few = len(made) <= BROADCAST_ROWS
    parted = rows.join(F.broadcast(table) if few else table, F.col("mix_pattern") == F.col("mix_names")).where("mix_rest > 0")
    bits = max([RANGE_BITS, *((held // RANGE_DOCS).bit_length() for _, _, held in sums)])
    cutoffs = _cutoffs(parted, bits, few)
    ends = local_rows(spark, cutoffs, mix_end_id=pa.int32(), mix_key=pa.int64(), mix_tie=pa.string())
    return table.join(ends, table["mix_id"] == ends["mix_end_id"], "left")


def applied(df: DataFrame, planned: DataFrame, sources: Column, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """``df`` with mix_source_size, mix_target and mix_copies, where the rows lie unless the plan is long."""
    key, tie = _order(id_col, seed)
    named = planned.withColumnRenamed("mix_names", "mix_pattern")
    out = joined_labels(df.withColumn("mix_pattern", pattern(sources)), named, "mix_pattern", "mix_held")
    first = F.coalesce((key < F.col("mix_key")) | ((key == F.col("mix_key")) & (tie <= F.col("mix_tie"))), F.lit(False))
    return out.select(*df.columns, "mix_source_size", "mix_target", (F.col("mix_whole") + first.cast("long")).alias("mix_copies"))


def mix(df: DataFrame, size: Column, sources: Column, id_col: str = "doc_id", weights: tuple = WEIGHTS, seed: int = 42) -> DataFrame:
    """``df`` with mix_size, mix_source_size and mix_target (of its first source), mix_copies and mix_taken.

    ``mix_taken`` is size times copies, at most three copies. The same rows give
    the same mix whatever their order or partitions; rows that repeat an id are
    taken or left together. Null ids are one id. Documents of size 0 are taken
    as often as their neighbours in the order. Columns whose names begin with
    ``mix_`` are dropped. Empty tables give no rows.
    """
    df = _without_own(df)
    out = applied(df.withColumn("mix_size", size.cast("long")), plan(df, size, sources, id_col, weights, seed), sources, id_col, seed)
    return out.withColumn("mix_taken", F.col("mix_size") * F.col("mix_copies"))


def _without_own(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower().startswith("mix_")))


def _cutoffs(rows: DataFrame, bits: int, few: bool) -> list[tuple]:
    """(pattern, key, tie) of the last document that each pattern's part pass takes: the one whose middle is within the rest."""
    keyed = rows.select("mix_id", "mix_rest", "mix_size", "k", "t", F.shiftright("k", 64 - bits).alias("r"))
    sums = keyed.groupBy("mix_id", "mix_rest", "r").agg(F.sum("mix_size").alias("n"))
    running = F.sum("n").over(Window.partitionBy("mix_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    # The range in which the running sum passes the rest: one row a pattern.
    at = sums.withColumn("upto", running).where("upto >= mix_rest and upto - n < mix_rest").select("mix_id", "r", (F.col("upto") - F.col("n")).alias("before")).collect()
    spots = local_rows(keyed.sparkSession, [(x.mix_id, x.r, x.before) for x in at], i=pa.int32(), s=pa.int64(), before=pa.int64())
    near = keyed.join(F.broadcast(spots) if few else spots, (F.col("mix_id") == F.col("i")) & (F.col("r") == F.col("s")))
    docs = near.groupBy("mix_id", "mix_rest", "before", "k", "t").agg(F.sum("mix_size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("mix_id").orderBy("k", "t").rowsBetween(Window.unboundedPreceding, 0))
    taken = docs.withColumn("upto", upto).where("2 * (before + upto) - n <= 2 * mix_rest")
    last = taken.groupBy("mix_id").agg(F.max(F.struct("k", "t")).alias("x")).collect()
    found = {r.mix_id: (r.mix_id, r.x.k, r.x.t) for r in last}
    # None of the range is taken: the cutoff is just before it.
    for x in at:
        found.setdefault(x.mix_id, (x.mix_id, (x.r << (64 - bits)) - 1 if x.r > -(1 << (bits - 1)) else -(1 << 63), ""))
    return list(found.values())


def resampled(df: DataFrame, size: Column, sources: Column, id_col: str = "doc_id", weights: tuple = WEIGHTS, seed: int = 42) -> DataFrame:
    """``df`` with each row as often as the mix takes it, without the mix's own columns.

    Sizes are made once, beside the ids and sources, and checkpointed for the plan.
    """
    df = _without_own(df)
    narrow = checkpointed(df.select(F.col(id_col), size.cast("long").alias("mix_size"), sources.alias("mix_sources")))
    planned = plan(narrow, F.col("mix_size"), F.col("mix_sources"), id_col, weights, seed)
    mixed = applied(df, planned, sources, id_col, seed)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return mixed.where("mix_copies > 0").withColumn("mix_copy", times).select(*df.columns)
