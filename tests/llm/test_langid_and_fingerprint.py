import hashlib
import zlib

from pyspark.sql import functions as F

from tests.conftest import SMALL
from trawl.llm import fingerprint, langid, queries

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op4_language_id(spark, MIDDLE).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and len(truth[r.doc_id][1]) > 60]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.98


def test_language_edges(spark):
    rows = [(1, "the house is on the hill and the river", "en"), (2, "das haus ist auf dem berg und der fluss", "de"), (3, None, "en"), (4, "123 ...", "en"), (5, "", None), (1, "the house", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.dictionaries(langid.sample(df))
    got = langid.predict(df.withColumn("score", F.lit("x")), content)
    assert got.columns == ["doc_id", "lang", "lang_pred", "score", "lang_margin", "lang_rejected"]
    by = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert by == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (1, "en")]
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    assert langid.predict(df.where("false"), content).collect() == [] and langid.sample(df.where("false")) == {}


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_query_against_brute(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, SMALL).collect()}
    assert len(got) == len(docs)
    off = []
    for i, (d, text) in enumerate(docs):
        after, n = docs[(i + 1) % len(docs)][1], len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            off.append(abs(value - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03


def test_sketch_parts_and_estimates(spark):
    words = [f"w{i}" for i in range(5000)]
    rows = [(" ".join(words), " ".join(words[2000:])), ("a b c", "a b c"), ("", None), ("x " * 60000, "x")]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"s": fingerprint.sketch(F.col("a")), "t": fingerprint.sketch(F.col("b"))})
    got = df.select(
        "s", "t", fingerprint.merge(F.col("s"), F.col("t")).alias("m"), fingerprint.resemblance(F.col("s"), F.col("t")).alias("j"),
        fingerprint.containment(F.col("t"), F.col("s")).alias("c"), fingerprint.distinct_shingles(F.col("s")).alias("n"),
    ).collect()
    assert got[0].m == got[0].s and abs(got[0].j - 0.6) < 0.15 and got[0].c > 0.85 and abs(got[0].n / 4996 - 1) < 0.3
    assert (got[1].j, got[1].n, got[1].c) == (1.0, 1.0, 1.0) and got[2].s == [] and got[2].j == 1.0 and len(got[3].s) == 1


def test_followers_and_edges(spark):
    ids = [5, 9, -3, 700, 12, 12, None]
    df = spark.createDataFrame([(i, f"text {i}" if i != 9 else None, 1) for i in ids], "doc_id long, text string, head int")
    assert {r.id: r.next_id for r in fingerprint.followers(df).collect()} == {-3: 5, 5: 9, 9: 12, 12: 700, 700: -3}
    got = sorted((str(r.id), r.edited) for r in fingerprint.edited_pairs(df).collect())
    assert got == sorted([("-3", "text -t"), ("5", "text "), ("9", ""), ("12", "text 1t"), ("12", "text 1t"), ("700", "text 7te"), ("None", "text No")])
    assert fingerprint.edited_pairs(df.where("false")).collect() == []
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert fingerprint.edited_pairs(one).first().edited == "abcdefab"
