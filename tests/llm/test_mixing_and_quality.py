import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trawl.llm import mixing, quality, queries

MIDDLE = "/root/testdata/sf0.01"


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, "c": 1000, "d": 0}, 1110)
    assert t["a"] == 30 and t["d"] == 0 and abs(sum(t.values()) - 1110) < 1e-9 and t["b"] <= 300
    assert mixing.targets({}, 0) == {}


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(30):
        supply = [rng.randint(0, 4) for _ in range(3)]
        members = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in supply]
        demand = [rng.randint(0, 9) for _ in range(2)]
        flow = mixing.min_cost_flow(supply, members, demand)
        cost = lambda used: sum(sum(n // s if s else 0 for n in range(u)) for u, s in zip(used, supply, strict=True))
        used = [sum(r) for r in flow]
        got = [sum(f for row, m in zip(flow, members, strict=True) for f, s in zip(row, m, strict=True) if s == j) for j in range(2)]
        assert all(u <= 3 * s for u, s in zip(used, supply, strict=True)) and all(g <= d for g, d in zip(got, demand, strict=True))
        best = None
        ways = [[(x,) if len(m) == 1 else (x, y) for x in range(3 * s + 1) for y in (range(3 * s + 1 - x) if len(m) == 2 else (0,))] for s, m in zip(supply, members, strict=True)]
        for a in ways[0]:
            for b in ways[1]:
                for c in ways[2]:
                    take = Counter()
                    for row, m in zip((a, b, c), members, strict=True):
                        for x, s in zip(row, m, strict=True):
                            take[s] += x
                    if all(take[j] <= demand[j] for j in range(2)):
                        key = (-sum(take.values()), cost([sum(a), sum(b), sum(c)]))
                        best = key if best is None else min(best, key)
        assert best == (-sum(used), cost(used))


def test_query_near_targets_and_stable(spark):
    rows = queries.op6_mixing(spark, MIDDLE).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = queries.op6_mixing(spark, MIDDLE).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, rows)) == sorted(map(str, again))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    sizes = {d: len(r.text.encode().split()) for d, r in docs.items()}
    sums, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == sizes[r.doc_id] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        sums[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    # Targets by raising one level until all is shared out: a source takes its weight times the level, or three times its size.
    order = sorted(sums)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, float(sum(sums.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sums[s], weight[s] * level) for s in order) < sum(sums.values()) else (low, level)
    want = {s: min(3 * sums[s], weight[s] * low) for s in order}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sums[s] and abs(r.target - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_mixing_edges(spark):
    rows = [(1, "a b c", ["x"]), (2, None, ["x"]), (3, "", None), (4, "a b\x0bc", ["y", "x", None]), (None, "one two", []), (5, "w " * 30000, ["y"]), (5, "w " * 30000, ["y"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, src array<string>, mix_size int")
    got = mixing.mix(df, mixing.word_count(F.col("text")), F.col("src"))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 7 and (by[1].mix_size, by[2].mix_size, by[3].mix_size, by[4].mix_size, by[5].mix_size) == (3, 0, 0, 2, 30000)
    assert all(0 <= r.mix_copies <= 3 for r in by.values())
    assert mixing.mix(df.where("false"), F.lit(1), F.col("src")).collect() == []
    out = mixing.resampled(df.drop("mix_size"), mixing.word_count(F.col("text")), F.col("src"))
    assert out.columns == ["doc_id", "text", "src"]


def test_flow_by_groups_is_the_flow_of_all():
    rng = random.Random(8)
    for _ in range(40):
        members = [sorted(rng.sample(range(6), rng.choice([1, 1, 1, 2]))) for _ in range(6)]
        members = [list(m) for m in sorted(set(map(tuple, members)))]
        supply, demand = [rng.randint(0, 9) for _ in members], [rng.randint(0, 20) for _ in range(6)]
        cost = lambda flow: (sum(map(sum, flow)), sum(sum(n // s if s else 0 for n in range(sum(r))) for r, s in zip(flow, supply, strict=True)))
        assert cost(mixing.routed(supply, members, demand)) == cost(mixing.min_cost_flow(supply, members, demand))


def test_thousands_of_sources(spark, monkeypatch):
    rows = [(i, f"s{i % 3000}", i % 7 + 1) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    first = sorted(map(str, mixing.mix(df, F.col("words"), F.array("source")).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10)
    assert sorted(map(str, mixing.mix(df, F.col("words"), F.array("source")).collect())) == first and len(first) == 9000


def brute_base(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(8)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_base_rules_against_brute(spark):
    texts = ["", "a b", "x y z\n\nx y z\n \t\nq#|<>", "w " * 100, "é b c\x0bd", " ".join(map(str, range(30))) + "\n" + " ".join(map(str, range(9)))]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert [quality.base_rules(t) for t in texts] == [brute_base(t) for t in texts]


def small_model(spark, texts):
    grams = Counter()
    for t in texts:
        t = "\x02" * 4 + t
        grams.update(t[i - 4 : i + 1] for i in range(4, len(t)))
    df = spark.createDataFrame([("en", g, n) for g, n in grams.items()], "lang string, gram string, n long")
    return df, quality.Model(quality.levels_of(quality.train(df).toArrow())["en"])


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by the textbook, over dictionaries."""
    counts = {5: Counter()}
    for t in texts:
        t = "\x02" * 4 + t
        counts[5].update(t[i - 4 : i + 1] for i in range(4, len(t)))
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = [0, *(max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        cut[k] = [min(i, max(0.05 * i, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]

    def p(gram, k):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = {g: v for g, v in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:], k - 1)
        total, d = sum(own.values()), lambda v: cut[k][min(v, 3) - 1]
        here = max(0, own[gram] - d(own[gram])) if gram in own else 0
        return here / total + sum(map(d, own.values())) / total * p(gram[1:], k - 1)

    return p


def test_model_is_the_textbook_one_and_a_distribution(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aab b", k=rng.randint(1, 60))) for _ in range(30)]
    counted, model = small_model(spark, texts)
    for cell in ([*texts], ["ab", ""]):
        df = spark.createDataFrame([("en", t) for t in cell], "lang string, text string")
        assert quality.count_ngrams(df).collect() == []  # too short to teach
    p = kneser_ney(texts)
    for context in ("\x02\x02\x02\x02", "\x02\x02ab", "aab ", "bbbb", "zzzz", "zaab"):
        every = ["a", "b", " ", "?"]
        points = np.array([[ord(x) for x in context + c] for c in every], np.uint32)
        got = np.exp([model.log_probabilities(row, np.array([4]))[0] for row in points])
        assert np.allclose(got, [p(context + c, 5) for c in every], rtol=1e-4) and abs(got.sum() - 1) < 1e-4


def test_tables_find_what_they_hold():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        h = np.unique(rng.integers(0, 2**64, n, np.uint64))
        t = quality.Table(h, np.arange(len(h), dtype=np.float32))
        asked = np.concatenate([h, rng.integers(0, 2**64, 500, np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]])
        value, found = t.find(asked)
        assert found[: len(h)].all() and (value[: len(h)] == np.arange(len(h))).all() and found[len(h) :].sum() == np.isin(asked[len(h) :], h).sum()


def test_ngrams_are_those_of_whole_texts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang")
    want = Counter()
    for r in docs.collect():
        if quality.reference_like(r.text):
            t = "\x02" * 4 + "".join(map(chr, quality.folded(r.text).tolist()))
            want.update((r.lang, t[i - 4 : i + 1]) for i in range(4, len(t)))
    monkeypatch.setattr(quality, "COUNT_CHARS", 1000)
    assert {(r.lang, r.gram): r.n for r in quality.count_ngrams(docs).collect()} == want


def test_blocks_score_as_the_broadcast_does(spark, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang if r.doc_id % 9 else (None, "")[r.doc_id % 2]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(-1, None, "en"), (-2, "", "xx"), (-3, "Ω never seen Ω " * 40, "xx"), (-4, "q" * 3000, "en"), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda r: (r.doc_id, r.n_scored, str(r.lang))
    first = sorted(quality.quality(df).collect(), key=key)
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 20_000)
    second = sorted(quality.quality(df).collect(), key=key)
    assert len(first) == len(rows) and [key(r) for r in first] == [key(r) for r in second]
    for a, b in zip(first, second, strict=True):
        assert a.kept == b.kept and (a.nll is None) == (b.nll is None) and (a.nll is None or abs(a.nll - b.nll) < 1e-9)


def test_query_keeps_clean_and_rejects_junk(spark):
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, MIDDLE).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for d, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[d]) and not (r.base_failed and r.kept)
    clean = [got[d] for d, q in labels.items() if q == 1 and not got[d].base_failed]
    junk = [got[d] for d, q in labels.items() if q == 0]
    assert all(r.kept for r in clean) and sum(not r.kept for r in junk) / len(junk) > 0.9


def test_quality_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "word " * 50000, "en"), (4, " ".join(f"plain words {chr(97 + i % 26)}{i}x" for i in range(30)), None), (4, "𝒳 İ ﬁ", "zz"), (None, "a", "en")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, nll int")
    rows_ = quality.quality(df).collect()
    assert len(rows_) == 6 and {r.doc_id: r.kept for r in rows_ if r.doc_id in (1, 2, 3)} == {1: False, 2: False, 3: False}
    assert [r.kept for r in rows_ if r.doc_id == 4 and r.n_words > 20] == [True]
    left = quality.kept(df.union(df))
    assert left.columns == df.columns and [(r.doc_id, r.nll) for r in left.collect()] == [(4, 5)] * 2
    assert quality.kept(df.where("false")).collect() == []
    assert quality.quality(df.where("false")).collect() == []
