import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import index as ix
from trawl.operators import query, rank

VOCAB = "enron raptor hedge stock swap gas power trade risk new york city energy deal board".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    docs = [(i, f"u{i}", f"Doc {i}", " ".join(rng.choices(VOCAB, k=rng.randint(5, 60)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, url string, title string, text string")
    built = ix.build(df)
    built.postings.cache()
    return docs, built


def words_of(doc):
    return f"doc {doc[0]} {doc[3]}".split()


def has(words, terms):
    return any(words[i : i + len(terms)] == terms for i in range(len(words)))


def test_random_queries_against_scan(corpus):
    docs, index = corpus
    rng = random.Random(2)
    cases = [("enron nonexistentterm", lambda w: False), ("-enron", lambda w: "enron" not in w)]
    for _ in range(4):
        a, b, c = rng.sample(VOCAB, 3)
        cases += [
            (f"{a} {b}", lambda w, a=a, b=b: a in w and b in w), (f'"{a} {b}"', lambda w, a=a, b=b: has(w, [a, b])), (f"{a} OR {b}", lambda w, a=a, b=b: a in w or b in w),
            (f"{a} -{b}", lambda w, a=a, b=b: a in w and b not in w), (f'"{a} {b}" OR {c} -{a}-{c}', lambda w, a=a, b=b, c=c: (has(w, [a, b]) or c in w) and not has(w, [a, c])),
        ]
    for text, fits in cases:
        assert sorted(r.doc_id for r in query.search(index, text).collect()) == [d[0] for d in docs if fits(words_of(d))], text


def test_parse():
    groups = query.parse('raptor "new york" OR boston -stock')
    assert [[(c.terms, c.negated) for c in g] for g in groups] == [[(("raptor",), False)], [(("new", "york"), False), (("boston",), False)], [(("stock",), True)]]
    assert query.parse("raptor-ii")[0][0].terms == ("raptor", "ii")
    assert query.parse("OR enron") == query.parse("enron") and query.parse('- ""') == []
    assert query.parse('"states of america"', "english")[0][0].offsets == (0, 2)


def test_phrase_gap_of_stop_words(spark):
    df = spark.createDataFrame([(0, "the united states of america"), (1, "united states america")], "doc_id long, text string")
    index = ix.build(df, "english")
    assert [r.doc_id for r in query.search(index, '"states of america"').collect()] == [0]
    assert sorted(r.doc_id for r in query.search(index, '"united states"').collect()) == [0, 1]


def test_save_load_and_shuffle_partitions(corpus, spark, tmp_path):
    docs, index = corpus
    want = [(r.doc_id, round(r.score, 9)) for r in rank.ranked_search(index, "enron raptor", k=20).collect()]
    ix.save(index, str(tmp_path))
    again = ix.load(spark, str(tmp_path))
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert [(r.doc_id, round(r.score, 9)) for r in rank.ranked_search(again, "enron raptor", k=20).collect()] == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again.term("nonexistent") is None and again.doc(3)["url"] == "u3" and again.analyzer == "plain"


def seen(n):
    if n < 32:
        return n
    shift = (n - 24).bit_length() - 4
    return 24 + (((n - 24) >> shift) << shift)


@pytest.mark.parametrize("lucene", [True, False])
def test_bm25_against_formula(corpus, lucene):
    docs, index = corpus
    lengths = [len(words_of(d)) for d in docs]
    average = sum(lengths) / len(docs)
    terms = ["enron", "gas"]
    want = {}
    for d, n in zip(docs, lengths, strict=True):
        w = words_of(d)
        for t in terms:
            df = sum(t in words_of(x) for x in docs)
            tf = w.count(t)
            k = 0.9 * (0.6 + 0.4 * (seen(n) if lucene else n) / average)
            want[d[0]] = want.get(d[0], 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf / (tf + k)
    got = rank.search(index, "enron gas", k=500, lucene_norms=lucene).collect()
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got) and len(got) == sum(v > 0 for v in want.values())


def test_lucene_length(spark):
    rows = spark.range(0, 3000).select("id", rank.lucene_length(F.col("id")).alias("s")).collect()
    assert all(r.s == seen(r.id) for r in rows) and next(r.s for r in rows if r.id == 100) == 96


def test_priors_and_empty(spark):
    same = spark.createDataFrame([(i, "one two") for i in range(5)], "doc_id long, text string")
    index = ix.build(same)
    assert [r.doc_id for r in rank.ranked_search(index, "one").collect()] == [0, 1, 2, 3, 4]
    priors = spark.createDataFrame([(3, 2.0)], "doc_id long, prior double")
    assert rank.ranked_search(index, "one", priors=priors, prior_weight=0.5).first().doc_id == 3
    assert rank.ranked_search(index, "-one").collect() == [] and rank.search(index, "...").collect() == []
    with pytest.raises(ValueError):
        rank.prior(same, "fame")
    nothing = ix.build(same.where("false"))
    assert query.search(nothing, "one").collect() == [] and nothing.sizes() == (0, 0)


def test_codec_columns(spark):
    df = spark.createDataFrame([(0,), (127,), (128,), (16383,), (16384,), (2**32,), (2**63 - 1,)], "n long")
    assert [r.s for r in df.orderBy("n").select(ix.vbyte_size(F.col("n")).alias("s")).collect()] == [1, 1, 2, 2, 3, 5, 9]


def exchanges(df):
    """Exchanges of the plan before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange"), df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_index_is_made_without_a_shuffle_of_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The the cat"), (2, None), (3, "cat's ß, the"), (3, "the dog")], "doc_id long, text string")
    once = docs.where("doc_id < 3 or text like 'cat%'")
    rows = ix.forward(once, exact=False)
    assert exchanges(rows) == (0, 0)
    assert [(r.doc_id, sorted(zip(r.terms, r.tfs, r.positions, strict=True))) for r in rows.orderBy("doc_id").collect()] == [
        (1, [("cat", 1, [2]), ("the", 2, [0, 1])]), (2, []), (3, [("cat", 1, [0]), ("s", 1, [1]), ("ss", 1, [2]), ("the", 1, [3])])]
    # Rows of one id are one document.
    assert {r.term: (r.tf, r.positions) for r in ix.postings(docs).where("doc_id = 3").collect()}["the"] == (2, [0, 3])
    ix.save(ix.build(docs, "english"), str(tmp_path))
    again = ix.load(spark, str(tmp_path))
    assert {(r.term, r.doc_id): r.positions for r in again.postings.collect()}[("cat", 3)] == [0] and again.sizes() == (4, 7)


def test_batch_keeps_the_best_of_each_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["a"] * (i % 3 + 1) + ["b"] * (i % 2) + ["c"] * (i % 7))) for i in range(90)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "a"), (3, "none")], "qid long, term string")
    index = ix.build(docs)
    found = rank.batch(index, asked, 7, remove_self=True, digits=6)
    # One exchange deals the documents above and one the ranks; none is by document.
    assert exchanges(found)[1] == 2 and "doc_id" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "score", "rank").collect()))
    few = rows(found)
    monkeypatch.setattr(rank, "SENT_TERMS", 0)
    assert len(few) == 14 and few == rows(rank.batch(index, asked, 7, remove_self=True, digits=6))
    wanted = asked.where("qid < 3")
    joined = sorted(map(tuple, rank.holding(index, wanted).collect()))
    monkeypatch.setattr(rank, "SENT_TERMS", 100)
    assert joined == sorted(map(tuple, rank.holding(index, wanted).collect())) and len(joined) > 50


def test_rounding_is_that_of_spark(spark):
    values = [0.1234565, 2.5000005, 1.0000015, 3.9999995, 1e-7, 12.3456784999999, 7.0, 0.0, 1234.5678905]
    want = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("s")).collect()]
    assert rank.rounded(np.array(values), 6).tolist() == want


def test_phrases_are_not_unfolded(spark):
    index = ix.build(spark.createDataFrame([(1, "of the of the"), (2, "the of"), (3, "the x the of the")], "doc_id long, text string"))
    docs = lambda terms, offsets: query.phrase_docs(index, query.Clause(terms, offsets))
    assert [r.doc_id for r in docs(("the", "the"), (0, 2)).collect()] == [1, 3] and exchanges(docs(("the", "the"), (0, 2))) == (0, 0)
    assert sorted(r.doc_id for r in docs(("of", "the"), (0, 1)).collect()) == [1, 3]
    assert [r.doc_id for r in docs(("the", "of", "the"), (0, 1, 2)).orderBy("doc_id").collect()] == [1, 3]


def test_dense_ids(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    rows = ix.with_doc_ids(df, "x").orderBy("x").collect()
    assert [r.doc_id for r in rows] == list(range(1000))
