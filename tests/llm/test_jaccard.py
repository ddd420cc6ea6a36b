import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tests.llm.test_simhash import roots
from trawl.llm import jaccard, simhash


def sets(texts, shingle=5):
    out = []
    for t in texts:
        w = t.encode().lower().split()
        out.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return out


def test_sets_of_shingles():
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abAB", k=rng.randint(0, 40))) for _ in range(300)] + ["", " \n", "Ä ä", "a\x0bb\x0cc\rd\te", "x " * 5000]
    made = list(jaccard.shingle_sets(pa.array([*texts, None]), 5))
    want = [*sets(texts), set()]
    assert [len(h) for _, h in made] == [len(w) for w in want]
    for (a, x), v in zip(made[:80], want, strict=False):
        for (b, y), w in zip(made[:80], want, strict=False):
            assert len(np.intersect1d(x, y)) == len(v & w) and (a != b or v == w)
    assert made[0][0] != made[1][0] and made[-1][0] == made[300][0]


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in jaccard.keep_representatives(df.repartition(4)).collect())


def test_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(90)]
    texts = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(3, 120))] + passage * (i % 2) + [word() for _ in range(8)]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            for at in rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 60))):
                base[at] = word()
            texts.append(" ".join(base))
    texts += ["", " ", "one two", "One  TWO", "one two three"]
    s = sets(texts)
    # Ends of the chain of a text are often below 0.8 of each other, and links go through the middle.
    linked = lambda a, b: s[a] == s[b] or len(s[a] & s[b]) / max(1, len(s[a] | s[b])) >= 0.8
    want = roots(list(range(len(texts))), linked)
    assert kept(spark, texts) == sorted(set(want.values())) and len(set(want.values())) < len(texts) - 60


def test_thousands_share_a_passage(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    passage = [word() for _ in range(60)]
    texts, want = [], []
    for i in range(20000):
        # Passages of half of a text and of over 0.8 of it, where one is never a link by itself.
        own = [word() for _ in range(60 if i % 2 else 12)]
        want.append(len(texts))
        texts.append(" ".join(passage + own))
        if i % 10 < 2:
            own[-1] = word()
            texts.append(" ".join(passage + own))
    assert kept(spark, texts) == want


def test_copies_of_one_text_that_are_unlike_each_other(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    base = [word() for _ in range(80)]
    texts = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy if i != 700 else base))
    assert kept(spark, texts) == [0]


def test_links_at_the_similarity_and_none_below(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts, want = [], []
    for i in range(80):
        # 80 of 100 shingles in common, or 79 of 99.
        base = [word() for _ in range(94 - i % 2)]
        want += [2 * i, 2 * i + 1] if i % 2 else [2 * i]
        texts += [" ".join(base), " ".join(base[:-10] + [word() for _ in range(10)])]
    assert kept(spark, texts) == want


def test_whole_table_against_all_pairs(spark):
    """Every pair of 0.8 or more of the table, found by counting what two texts share, and no other link."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    s = dict(zip([d for d, _ in rows], sets([t for _, t in rows]), strict=True))
    holders = {}
    for d, shingles in s.items():
        for x in shingles:
            holders.setdefault(x, []).append(d)
    shared = Counter((a, b) for who in holders.values() for i, a in enumerate(who) for b in who[i + 1 :])
    pairs = {p for p, n in shared.items() if n / (len(s[p[0]]) + len(s[p[1]]) - n) >= 0.8}
    want = roots(sorted(s), lambda a, b: (a, b) in pairs or (b, a) in pairs or not s[a] and not s[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(pairs) > 20 and sorted(r.doc_id for r in jaccard.keep_representatives(df).collect()) == sorted(set(want.values()))


def test_near_copies_meet_in_balls(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(400)]
        for _ in range(4):
            texts.append(" ".join(base))
            base[rng.choice([0, 399])] = word()
    prints = [simhash.majority(h) for _, h in jaccard.shingle_sets(pa.array(texts), 5)]
    want = sorted(set(roots(list(range(len(texts))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2).values()))
    assert 25 <= len(want) < 60
    # The balls find them where prefixes find nothing,
    with monkeypatch.context() as m:
        m.setattr(jaccard, "viable", lambda *_: F.lit(False))
        assert kept(spark, texts) == want
    # and what meets by chance is told apart by its sets.
    links = lambda words: words.alias("x").crossJoin(words.alias("y")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).where("a < b")
    monkeypatch.setattr(jaccard, "links", links)
    assert kept(spark, texts) == list(range(0, 100, 4))
