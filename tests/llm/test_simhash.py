import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from tests.conftest import SMALL
from trawl.llm import common, jaccard, queries, simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def roots(items, linked):
    least = dict.fromkeys(items)
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in least}


def test_query_against_brute(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {d: fingerprint(t) for d, t in docs.items()}
    want = roots(list(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = queries.op3_simhash(spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in docs}


def test_chains_of_fingerprints(spark):
    rng = random.Random(6)
    words = [rng.getrandbits(64) for _ in range(6)]
    for w in list(words):
        for _ in range(40):
            w ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 2)))
            words.append(w)
    words = sorted({w - (1 << 64) if w >> 63 else w for w in words})
    nodes = spark.createDataFrame([(w,) for w in words], "fp bigint")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    want = roots(words, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {w: found.get(w, w) for w in words} == want


def test_edges(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (None, "a b c d"), (7, "a b c d"), (7, "A  B c D"), (9, "x"), (8, "word " * 30000), (5, "Ä"), (4, "ä")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[3] == by[1] == by[2] == {1} and by[None] == by[7] == {7} and by[9] == {9} and by[5] == {5} and by[4] == {4}
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7, 8, 9]
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_hot_keys_meet_their_labels(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(9000)], "id long, k long")
    labels = rows.groupBy("k").agg(F.count("*").alias("held")).withColumn("name", F.col("k") * 2)
    got = common.joined_labels(rows, labels, "k")
    assert got.columns == ["id", "k", "name"] and sorted(map(tuple, got.collect())) == [(i, k, 2 * k) for i, k in sorted(map(tuple, rows.collect()))]
    assert common.joined_labels(rows.where("false"), labels.where("false"), "k").collect() == []


def test_majority():
    h = np.array([1, 3, 2**63], np.uint64)
    assert simhash.majority(h, 64) == 1 and simhash.majority(h[:0], 64) == 0
    assert simhash.majority(np.array([5, 5, 2], np.uint64), 2) == 1


def test_rows_without_or_with_shared_ids_are_kept_by_component(spark):
    texts = [f"text {w} about {w} and nothing like the others {w}{w}" for w in ("amber", "birch", "cedar", "delta", "ember", "fjord")]
    ids = [None, None, 7, 7, 7, 8]
    rows = [*zip(ids, texts, strict=True), (9, texts[0]), (7, texts[5]), (7, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # One row a text: its smallest id, and no id only where it has none.
    want = sorted([("9", texts[0]), ("None", texts[1]), *(("7", t) for t in texts[2:])])
    for how in (simhash.keep_representatives, jaccard.keep_representatives):
        assert sorted((str(r.doc_id), r.text) for r in how(df).collect()) == want
