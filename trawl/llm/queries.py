"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import fingerprint, html_wrapper, langid, licenses, mixing, packing, quality, secrets, simhash, url_filter
from trawl.llm.common import checkpointed, read_table

#: (verdict, host and path) of the registered URL query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_path_rule(*r) for r in URL_RULES] + [url_filter.pattern_rule(*r) for r in url_filter.DEFAULT_PATTERNS]
    judged = url_filter.judge_urls(read_table(spark, sf_dir, "pages", "page_id", "url"), rules)
    ours = F.col("rule").isin([r for _, r in URL_RULES])
    return judged.select("page_id", "host", "path", F.when(ours, F.col("rule")).alias("rule"), "verdict")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return near.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    content = langid.dictionaries(langid.sample(docs.where(~held_out)))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), content)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.edited_pairs(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    made = pairs.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "sketch", fingerprint.sketch(F.col("edited")).alias("edited_sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"),
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    # Words are counted once, and the plan's passes read the counts.
    sized = checkpointed(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    mixed = mixing.mix(sized, F.col("words"), F.array("source"))
    names = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_taken": "taken"}
    return mixed.select("doc_id", *(F.col(a).alias(b) for a, b in names.items()))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *base, F.exp("nll").alias("perplexity"), "ppl_low", "ppl_high")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_wrapper.main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return licenses.scan(docs, licenses.train(licenses.negatives(docs)))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def _url_sql() -> str:
    """The URL query for DuckDB, rules and patterns spelled out."""
    fits = lambda r: f"regexp_matches(s, '{r.regex}')".replace("(?is)", "(?is)")
    own = sorted((url_filter.host_path_rule(*r) for r in URL_RULES), key=lambda r: (-r.priority, r.name))
    more = sorted((url_filter.pattern_rule(*r) for r in url_filter.DEFAULT_PATTERNS), key=lambda r: -r.priority)
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in own)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in [*own, *more])
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
b AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), '{up}', '{up.lower()}') AS host,
             substr(u, length(regexp_extract(u, '^[^/?#]*')) + 1) AS rest FROM a),
c AS (SELECT page_id, host, regexp_extract(rest, '^[^?#]*') AS path, host || rest AS s FROM b)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _url_sql()}
