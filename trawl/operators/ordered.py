"""Running values within groups of any size.

A window by group puts a whole group into one task. Here rows are dealt into
sorted ranges of (group, order) once, each range is read in its order with what
its first group carries over from earlier ranges. The driver holds one row a
range: its first and last group and what the last one carries on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trawl.operators.session import checkpointed

RANGE = "_range"


def dealt(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` in sorted ranges of (group, order), checkpointed, with the range's number. Later steps keep rows in their range and order."""
    by = [*group, *order]
    return checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(RANGE, F.spark_partition_id()))


def _begins(b: pa.RecordBatch, group: list[str], before: tuple | None) -> np.ndarray:
    """Whether each row's group differs from that of the row before; nulls are one group."""
    new = np.zeros(b.num_rows, bool)
    new[0] = before is None or before != tuple(b.column(g)[0].as_py() for g in group)
    for g in group:
        x = b.column(g)
        here, last = x.slice(1), x.slice(0, len(x) - 1)
        apart = pc.fill_null(pc.not_equal(here, last), False).to_numpy(zero_copy_only=False)
        new[1:] |= apart | (here.is_null().to_numpy(zero_copy_only=False) != last.is_null().to_numpy(zero_copy_only=False))
    return new


def _sums(values: pa.Array, new: np.ndarray, carried) -> pa.Array:
    """Running sums within groups; the first group goes on from ``carried``."""
    v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    v = v.astype(np.int64 if v.dtype.kind in "iu" else float)
    total = np.cumsum(v)
    starts = np.flatnonzero(new)
    base = np.concatenate([[-(carried or 0)], (total - v)[starts]])
    return pa.array(total - base[np.cumsum(new)])


def _lagged(values: pa.Array, new: np.ndarray, carried) -> pa.Array:
    """The value before within the group; ``carried`` before the first."""
    moved = pa.concat_arrays([pa.array([carried], values.type), values.slice(0, len(values) - 1)])
    return pc.if_else(pa.array(new), pa.scalar(None, values.type), moved)


def _running(rows: DataFrame, group: list[str], value: str, out: str, kind: T.DataType, made: Callable, kept: Callable, joined: Callable) -> DataFrame:
    """``dealt`` rows with ``out`` of type ``kind``: ``made(values, new, carried)``.

    ``kept(values, results)`` is what the last row passes on, ``joined(earlier, own)`` the same over earlier ranges.
    """
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != out), T.StructField(out, kind)])
    names = [n for n in schema.names if n != out]

    def through(batches: Iterator[pa.RecordBatch], carries: dict) -> Iterator[tuple[pa.RecordBatch, pa.Array, tuple, bool]]:
        """(batch, results, its last row's group and what it passes on, whether all rows so far are of one group)."""
        before, carried, one = None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            first = before is None
            if first:
                carried = carries.get(b.column(RANGE)[0].as_py())
            new = _begins(b, group, before)
            if first and carried is not None:
                new[0] = False
            one = one and not new[1 if first else 0 :].any()
            results = made(b.column(value), new, carried)
            before, carried = tuple(b.column(g)[-1].as_py() for g in group), kept(b.column(value), results)
            yield b, results, (before, carried), one

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, head = None, None, None
        for b, _, end, one in through(batches, {}):
            if at is None:
                at, head = b.column(RANGE)[0].as_py(), b.slice(0, 1)
            last = (b.slice(b.num_rows - 1), end[1], one)
        if at is not None:
            for b, carried, one in ((head, None, last[2]), (last[0], last[1], last[2])):
                yield pa.RecordBatch.from_arrays([b.column(RANGE), *(b.column(g) for g in group), pa.array([carried], made_type), pa.array([one])], ends.names)

    ends = T.StructType([T.StructField(RANGE, T.IntegerType()), *(T.StructField(f"g{i}", rows.schema[g].dataType) for i, g in enumerate(group)),
                         T.StructField("_carried", kind), T.StructField("_one", T.BooleanType())])
    made_type = to_arrow_type(kind)
    # Two rows a range.
    needed = list(dict.fromkeys([RANGE, *group, value]))
    summary: dict[int, list] = {}
    for row in rows.select(*needed).mapInArrow(told, ends).toArrow().to_pylist():
        summary.setdefault(row[RANGE], []).append((tuple(row[f"g{i}"] for i in range(len(group))), row["_carried"], row["_one"]))
    carries, at, held = {}, None, None
    for number in sorted(summary):
        (first, _, one), (last, own, _) = summary[number]
        goes_on = at is not None and at == first
        if goes_on:
            carries[number] = held
        held = joined(held, own) if goes_on and one else own
        at = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, results, _, _ in through(batches, carries):
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), results], schema.names)

    return rows.mapInArrow(run, schema)


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``dealt`` rows with the sum of ``value`` over the group's rows up to each, itself included."""
    whole = isinstance(rows.schema[value].dataType, T.IntegralType)
    return _running(rows, group, value, out, T.LongType() if whole else T.DoubleType(), _sums, lambda _, results: results[-1].as_py(), lambda earlier, own: earlier + own)


def row_numbers(rows: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``dealt`` rows with their number in the group, from 1."""
    one = "_one_each"
    return running_sum(rows.withColumn(one, F.lit(1).cast("bigint")), group, order, one, out).drop(one)


def previous(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``dealt`` rows with ``value`` of the row before in the group, null at its first row."""
    return _running(rows, group, value, out, rows.schema[value].dataType, _lagged, lambda values, _: values[-1].as_py(), lambda _, own: own)
