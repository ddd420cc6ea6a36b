import random
import zlib

import numpy as np

from tests.conftest import SMALL
from trawl.llm import packing, queries


def best_cost(ends, penalties, window):
    """Quadratic dynamic programme over all cuts."""
    at, cost = [0, *ends], [0.0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                options.append(cost[i] + (0 if j == len(at) - 1 else window - n))
        cost.append(min(options) + penalties[j - 1])
    return cost[-1]


def total(ends, penalties, chosen, window):
    before, out = 0, 0.0
    for k in chosen:
        n = ends[k] - before
        out += (0 if k == chosen[-1] else window - n) + penalties[k]
        before = ends[k]
    return out


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        window = rng.choice([256, 512, 700])
        ends = list(np.cumsum([rng.randint(1, window // 3) for _ in range(rng.randint(1, 40))]))
        penalties = [rng.choice([0, 8, 64]) for _ in ends]
        chosen = packing.choose_cuts([int(e) for e in ends], penalties, window)
        assert chosen[-1] == len(ends) - 1
        assert abs(total(ends, penalties, chosen, window) - best_cost(ends, penalties, window)) < 1e-6


def test_tokens_equal_the_library():
    w = packing.WordTokenizer(queries.tokenizer_path())
    texts = ["Hello, World's 42nd “test”!", "", None, "é à ÇA\u0301 ß İstanbul ΑΣ Σ", "a\x1cb", "x\u00a0y z\u3000w", "<|endoftext|> a<|startoftext|>b", "it's we're I'll", "  \n\t ", "日本 語 ½²", "naïve don't ©"]
    import pyarrow as pa

    ids, at = w.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == w.whole.encode(t or "", add_special_tokens=False).ids, t


def test_few_known_words_give_the_same_ids(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdé'", k=rng.randint(1, 6))) for _ in range(300)) for _ in range(12)]
    whole = packing.WordTokenizer(queries.tokenizer_path())
    want = [whole.whole.encode(t, add_special_tokens=False).ids for t in texts]
    for words, parts in ((400_000, 100_000), (350, 50), (1, 1)):
        monkeypatch.setattr(packing, "CACHE_WORDS", words)
        monkeypatch.setattr(packing, "CACHE_PARTS", parts)
        w = packing.WordTokenizer(queries.tokenizer_path())
        got = []
        for t in texts + texts:
            ids, at = w.encode(pa.array([t, t[:50]], pa.string()))
            got.append(ids[at[0] : at[1]].tolist())
        assert got == want + want


def check(rows, docs, window=2048, gapless=True):
    """Every id in one piece, gapless sequences, right checksums."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(docs)
    for d, text in docs.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padded = total_ = 0
    for s in seqs.values() if gapless else []:
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padded += window - at if at & (at - 1) else 0
        total_ += at
    # Only the tails of partitions are short.
    assert not gapless or sum(sum(r.length for r in s) < 0.75 * window for s in seqs.values()) <= 12 * len({q >> 33 for q in seqs})
    return padded / max(1, total_)


def test_query_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check(queries.op2_packing(spark, SMALL).collect(), docs) < 0.02


def test_edges(spark):
    docs = {0: None, 1: "", 2: "one. " * 9000, 3: "x" * 40000, 4: "word " * 5000, 5: "  "}
    df = spark.createDataFrame([(k, v, "p", 7) for k, v in docs.items()], "doc_id long, text string, source string, start int")
    out = packing.pack(df.coalesce(1), queries.tokenizer_path())
    assert out.columns == ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(out.collect(), docs)
    assert packing.pack(df.where("false"), queries.tokenizer_path()).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string").coalesce(1), queries.tokenizer_path()).collect()
    assert [r.start for r in twice].count(0) == 3
