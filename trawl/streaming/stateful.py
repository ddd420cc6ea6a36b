"""Structured Streaming forms of the crawler's keyed state.

``first_seen`` marks the first page of each content hash; ``fetch_slots`` gives
each host's pages slots one delay apart. Both keep one small state a key; what
they return for a key doesn't depend on how its rows fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trawl.operators.dedup import content_hash


def first_seen(pages: DataFrame, url_col: str = "url", text_col: str = "text") -> DataFrame:
    """(url, content_hash, dup_of): dup_of is null for the first page of a hash; in one batch the smallest url is first."""
    keyed = pages.select(F.col(url_col).alias("url"), content_hash(F.col(text_col)).alias("content_hash"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        urls = sorted(u for b in batches for u in b["url"])
        first = state.get[0] if state.exists else urls[0]
        state.update((first,))
        yield pd.DataFrame({"url": urls, "content_hash": key[0], "dup_of": [None if u == first else first for u in urls]})

    return keyed.groupBy("content_hash").applyInPandasWithState(
        run, "url string, content_hash string, dup_of string", "first string", "append", GroupStateTimeout.NoTimeout
    )


def fetch_slots(urls: DataFrame, delay: float, host_col: str = "host", url_col: str = "url") -> DataFrame:
    """(host, url, slot, earliest): earliest seconds from the host's first page."""
    keyed = urls.select(F.col(host_col).alias("host"), F.col(url_col).alias("url"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for b in batches:
            n = range(used, used + len(b))
            used += len(b)
            yield pd.DataFrame({"host": key[0], "url": b["url"].to_numpy(), "slot": [i + 1 for i in n], "earliest": [i * delay for i in n]})
        state.update((used,))

    return keyed.groupBy("host").applyInPandasWithState(
        run, "host string, url string, slot long, earliest double", "used long", "append", GroupStateTimeout.NoTimeout
    )


def sink_once(stream: DataFrame, path: str, checkpoint: str):
    """Write what is there as Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
