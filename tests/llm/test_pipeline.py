import os
from collections import Counter

import corpus_pipeline
from tests.llm.test_packing import check
from trawl.llm import mixing

MIDDLE = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns, kept, texts = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MIDDLE).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.doc_id for r in docs.collect()]
        if name != "sequence_packing":
            assert docs.columns == columns
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    first = set(kept["quality_rules"])
    assert len([d for d, q in labels.items() if q == 0 and d in first]) <= 0.1 * sum(q == 0 for q in labels.values())
    second = texts["near_duplicates"]
    assert len(set(second.values())) == len(second) and set(second) < first
    assert set(kept["secret_scans"]) == set(second) and any("[secret]" in t for t in texts["secret_scans"].values())
    assert max(Counter(kept["source_mixing"]).values()) <= 3
    sizes, taken = Counter(), Counter()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    for d, t in texts["secret_scans"].items():
        sizes[source[d]] += len(t.encode().split())
    for d in kept["source_mixing"]:
        taken[source[d]] += len(texts["source_mixing"][d].encode().split())
    for s, t in mixing.targets(dict(sizes), sum(sizes.values())).items():
        assert abs(taken[s] - t) < 8000
    pieces = docs.collect()
    copies = Counter(kept["source_mixing"])
    # A document that the mix takes once is one whole; one that it takes n times is n wholes of the same pieces' ids.
    once = {d: texts["source_mixing"][d] for d, n in copies.items() if n == 1}
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    whole = {q for q, rs in sequences.items() if all(r.doc_id in once for r in rs)}
    assert check([r for r in pieces if r.doc_id in once], once, gapless=False) >= 0 and whole
    for d, n in copies.items():
        mine = [r for r in pieces if r.doc_id == d]
        assert sum(r.length for r in mine) == n * mine[0].doc_tokens and sum(r.start == 0 for r in mine) == n
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))] and sum(r.length for r in rs) <= 2048


def test_run_of_nothing_and_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"plain words of number {i} here" for i in range(20))
    long = " ".join(f"word{i % 700}x{i}" for i in range(40000))
    rows = [(1, None, None, None, None), (4, long, "en", "t", 1), (5, " ".join(f"other phrases with the number {i} there" for i in range(30)), None, "t", 1), (5, long[:3000], "en", "t", 1), (2, text, "en", None, 3), (2, text, "en", None, 3), (3, text, "en", "s", 3), (None, "", "en", "s", 0)]
    for name, data in (("empty", []), ("some", rows)):
        extra = spark.createDataFrame(data, schema).selectExpr("*", "1 AS mix_size", "2 AS sequence_id", "'x' AS key", "0.5 AS nll")
        extra.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    got = out.collect()
    # One of the two copies of a text, both texts of the shared id, the long text whole.
    assert {r.doc_id for r in got} <= {2, 4, 5} and out.columns[0] == "doc_id"
    for d, n in ((4, 1), (5, 2)):
        mine = [r for r in got if r.doc_id == d]
        assert len({r.doc_tokens for r in mine}) in (0, n) and sum(r.length for r in mine) % max(1, sum({r.doc_tokens for r in mine})) == 0
    # Only the last table is left of those between the stages.
    left = [p for p in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if p.startswith("pipeline-")]
    assert all(p.startswith("pipeline-sequence_packing") for p in left)
