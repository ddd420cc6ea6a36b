import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import crawl, dedup, evaluation, links, stats
from trawl.sources import readers, sinks


@pytest.fixture(scope="module")
def dump(spark):
    schema = readers.ARTICLE.replace("title string", "doc_id long, title string")
    rows = [
        (0, "united_states", 0, "a", 9, 0.5, [(0, "USA"), (1, "Talk:USA")], ["Canada", "canada", "Mexico red", "USA"]),
        (1, "Canada", 0, "b", 3, 0.2, [(0, "USA")], ["USA"]),
        (2, "Mexico", 0, "c", 0, 0.0, None, ["united states", "Canada"]),
    ]
    return spark.createDataFrame(rows, schema)


def test_link_graph(dump):
    assert {(r.src, r.dst) for r in links.edges(dump).collect()} == {(0, 1), (1, 0), (2, 0), (2, 1)}
    s = links.graph_stats(dump).first()
    assert (s.articles, s.redirect_aliases, s.links_in_dump, s.edges, s.unresolved_links, s.self_links) == (3, 2, 7, 4, 1, 1)


def rank_of(spark, n, edges, **k):
    nodes = spark.range(n)
    result = links.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), **k)
    return np.array([r["rank"] for r in result.rank.orderBy("id").collect()]), result


def test_pagerank_small(spark):
    r, result = rank_of(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert np.allclose(r, 1 / 3) and result.converged and result.iterations == len(result.l1_history)
    r, _ = rank_of(spark, 5, [(1, 0), (2, 0), (3, 0), (0, 1)], fixed=25)
    assert r.argmax() == 0 and abs(r.sum() - 1) < 1e-9


def test_pagerank_against_dense(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(40), rng.randrange(50)) for _ in range(150)})
    r, _ = rank_of(spark, 50, edges, fixed=12)
    m = np.zeros((50, 50))
    for a, b in edges:
        m[b, a] += 1
    out = m.sum(0)
    x = np.full(50, 1 / 50)
    for _ in range(12):
        x = 0.85 * (m @ np.where(out > 0, x / np.maximum(out, 1), 0) + x[out == 0].sum() / 50) + 0.15 / 50
    assert np.allclose(r, x, atol=1e-12)


def test_degrees_and_ranks(spark, monkeypatch):
    e = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "src long, dst long")
    assert [r.in_degree for r in links.in_degree(spark.range(4), e).orderBy("id").collect()] == [1, 1, 1, 0]
    df = spark.createDataFrame([(0, 10), (1, 20), (2, 20), (3, 5)], "id long, v long")
    assert [r.avg_rank for r in stats.average_ranks(df, "v").orderBy("id").collect()] == [2.0, 3.5, 3.5, 1.0]
    t = spark.createDataFrame([(0, 5, 4), (1, 4, 5), (2, 3, 1), (3, 2, 9)], "id long, a long, b long")
    assert stats.top_k_overlap(t, "a", "b", 2).first().overlap == 0.5
    assert abs(stats.spearman(t, "a", "a").first().rho - 1) < 1e-12
    assert stats.mcnemar_exact(0, 0) == 1.0 and abs(stats.mcnemar_exact(1, 5) - 0.21875) < 1e-12
    low, high = stats.bootstrap_interval(spark.range(100), (F.col("id") % 2).cast("double"))
    assert 0.35 < low < 0.5 < high < 0.65
    monkeypatch.setattr(stats, "MOST_VALUES", 1)
    low, high = stats.bootstrap_interval(spark.range(100), (F.col("id") % 2).cast("double"), 1000)
    assert 0.35 < low < 0.5 < high < 0.65
    assert stats.weighted_sample(t, "a", 2).count() == 2


def test_evaluation(spark):
    run = spark.createDataFrame([("q", "a", 1.0), ("q", "c", 1.0), ("q", "b", 2.0)], "qid string, docid string, score double")
    assert [r.docid for r in evaluation.trec_order(run).orderBy("rank").collect()] == ["b", "c", "a"]
    qrels = spark.createDataFrame([("q", "x", 2), ("q", "y", 1), ("q", "z", 0), ("p", "y", 1), ("n", "y", 0)], "qid string, docid string, grade int")
    run = spark.createDataFrame([("q", "n", 2.0), ("q", "x", 1.0)], "qid string, docid string, score double")
    want = (2 / np.log2(3)) / (2 + 1 / np.log2(3))
    got = {r.qid: r.ndcg for r in evaluation.ndcg(run, qrels).collect()}
    assert abs(got["q"] - want) < 1e-12 and got["p"] == 0 and "n" not in got
    row = evaluation.evaluate(run, qrels).first()
    assert row.n_queries == 2 and abs(row.ndcg - want / 2) < 1e-12 and row.recall == 0.25


def greedy(prints, near):
    kept, out = [], {}
    for i, h in prints:
        exact = next((k for k, x in kept if x == h), None)
        found = [k for k, _ in kept if (k, i) in near]
        if exact is not None:
            out[i] = (exact, "exact")
        elif found:
            out[i] = (True, "near")
        else:
            kept.append((i, h))
            out[i] = (None, None)
    return out


def test_greedy_duplicates(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("energy market price system report global annual trading".split()) + str(rng.randrange(500))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(300)]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(300)] = word()
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    prints = dedup.fingerprints(df)
    pairs = {(r.earlier, r.later) for r in dedup.verified_pairs(prints).collect()}
    want = greedy([(r.doc_id, r.content_hash) for r in prints.orderBy("doc_id").collect()], pairs)
    got = {r.doc_id: (r.dup_of, r.dup_kind) for r in dedup.assign(prints).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[i][0] == w[0] for i, w in want.items() if w[1] == "exact")
    originals = {i for i, v in got.items() if v[1] is None}
    assert all(v[0] in originals for v in got.values() if v[0] is not None) and any(v[1] == "near" for v in got.values())


def test_fingerprint_values():
    a = dedup.features("Hello   World! again")
    assert len(a) == 1 and dedup.simhash(a[:0]) == 0 and dedup.minhash(a[:0]) == [0] * 64
    words = " ".join(f"word{i}" for i in range(400))
    x, y = dedup.features(words), dedup.features(words.replace("word10 ", "other ") + " updated 3 october 2026")
    assert (dedup.simhash(x) ^ dedup.simhash(y)).bit_count() <= 8
    assert np.mean(np.array(dedup.minhash(x)) == np.array(dedup.minhash(y))) >= 0.8


def test_blocks(spark):
    base = 0x5EADBEEFCAFEF00D
    flips = {1: [0], 2: [0, 20, 40, 60], 3: [0, 7, 14, 21, 28, 35, 42, 49], 4: [0, 7, 14, 21, 28, 35, 42, 49, 62]}
    rows = [(0, base)] + [(i, base ^ sum(1 << b for b in f)) for i, f in flips.items()]
    df = spark.createDataFrame(rows, "doc_id long, simhash long")
    found = lambda k: {r.later for r in dedup.candidates(df, k).where("earlier = 0").collect()}
    assert found(3) == {1} and found(8) == {1, 2, 3}


def test_longer_keys_find_the_same_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 10))) for b in base for _ in range(4)]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, simhash long")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(a, b, (x ^ y).bit_count()) for x, b in first.items() for y, a in first.items() if b < a and (x ^ y).bit_count() <= 8}
    for k in (1, 2, 3):
        monkeypatch.setattr(dedup, "agreeing", lambda n, m, k=k: k)
        got = dedup.candidates(df).collect()
        assert {(r.later, r.earlier, r.bits) for r in got} == want
        assert all(r.block == next(i for i in range(9) if (values[r.later] ^ values[r.earlier]) >> 7 * i & (127 if i < 8 else 255) == 0) for r in got)
    assert {r.doc_id: r.representative for r in dedup.classes(df).collect()} == {i: first[v] for i, v in enumerate(values)}
    assert len(want) > 60


def test_crawl(spark, tmp_path):
    page = lambda body, *out: f"<html><title>t</title><body><p>{body}</p>" + "".join(f'<a href="{o}">l</a>' for o in out) + "</body></html>"
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [
        ("http://a.com/", 200, page(text("home"), "/b", "/copy", "/private/x", "http://other.com/")), ("http://a.com/b", 200, page(text("b"), "/c")),
        ("http://a.com/c", 200, page(text("c"))), ("http://a.com/copy", 200, page(text("b"), "/hidden")), ("http://a.com/hidden", 200, page(text("h"))),
        ("http://a.com/private/x", 200, page(text("p"))), ("http://other.com/", 200, page(text("o"))),
    ]
    responses = spark.createDataFrame([(u, s, h, None, "text/html", float(i)) for i, (u, s, h) in enumerate(rows)], "url string, status int, html string, final_url string, content_type string, fetched_at double")
    robots = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /private/")], "host string, status int, text string")
    seeds = spark.createDataFrame([("http://a.com/",)], "url string")
    pages, edges, _ = crawl.crawl(seeds, responses, robots)
    got = {r.url: (r.depth, r.dup_kind) for r in pages.collect()}
    assert got == {"http://a.com/": (0, None), "http://a.com/b": (1, None), "http://a.com/copy": (1, "exact"), "http://a.com/c": (2, None)}
    one = crawl.crawl_stats(pages, edges).first()
    assert (one.pages, one.exact_dups, one.hosts, one.dup_rate) == (4, 1, 1, 0.25)
    docs = readers.indexable_pages(pages).orderBy("doc_id").collect()
    assert [d.url for d in docs] == ["http://a.com/", "http://a.com/b", "http://a.com/c"]
    stored = sinks.upsert_pages(pages, pages.where("depth = 0").withColumn("title", F.lit("new")))
    assert stored.where("title = 'new'").count() == 1 and stored.count() == 4
    sinks.log_run(spark, str(tmp_path / "runs"), {"pages": 4}, 0.0, 1.0)
    assert sinks.last_run(spark, str(tmp_path / "runs")) == {"pages": 4}
    assert crawl.effective_delay(1.0, 50.0) == 30.0 and crawl.retry_wait(1) == 4.0 and crawl.retry_wait(0, "0") == 0.0 and crawl.retry_wait(1, network=True) == 1.0


def test_readers(spark, tmp_path):
    import gzip
    import json

    lines = ['{"index":{}}', json.dumps({"title": "B c", "text": "x", "namespace": 0}), '{"index":{}}', json.dumps({"title": "T", "text": "", "namespace": 0}),
             '{"index":{}}', json.dumps({"title": "N", "text": "y", "namespace": 1}), '{"index":{}}', json.dumps({"title": "A", "text": "z"})]
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write("\n".join(lines))
    docs = readers.article_documents(spark, str(tmp_path / "d.json.gz")).orderBy("doc_id").collect()
    assert [(d.doc_id, d.title, d.url[-3:]) for d in docs] == [(0, "B c", "B_c"), (1, "A", "i/A")]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\n")
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "one"}\n')
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d", "title": "t", "text": "one"}\n{"_id": "c"}\n')
    assert readers.beir_qrels(spark, str(tmp_path)).first() == ("q", "d", 1)
    assert readers.beir_queries(spark, str(tmp_path)).first() == ("q", "one")
    assert [(r.doc_id, r.url, r.text) for r in readers.beir_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "c", ""), (1, "d", "one")]


def test_streams(spark, tmp_path):
    from trawl.streaming import stateful

    schema = "url string, text string, host string"
    for i, rows in enumerate(([("u1", "One two!", "h"), ("u2", "three", "h")], [("u3", "one TWO", "h"), ("u4", "four", "g")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.sink_once(stateful.first_seen(read()), str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    got = {r.url: r.dup_of for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert got["u2"] is None and got["u4"] is None and {got["u1"], got["u3"]} in ({None, "u1"}, {None, "u3"})
    stateful.sink_once(stateful.fetch_slots(read(), 0.5), str(tmp_path / "b"), str(tmp_path / "cb")).awaitTermination()
    slots = sorted(r.earliest for r in spark.read.parquet(str(tmp_path / "b")).where("host = 'h'").collect())
    assert slots == [0.0, 0.5, 1.0]
