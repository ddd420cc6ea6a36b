"""The registered queries over the engine's own operators, each beside its DuckDB SQL.

Texts of the benchmark tables are NFKC and fold like lower case but for ß, so
token queries use the JVM form of the tokenizer; ``tokens`` uses the exact one.
Doubles are rounded to six digits before they order anything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import pages as pg
from trawl.functions import robots as rb
from trawl.functions import text as tx
from trawl.functions import urls
from trawl.operators import crawl, dedup, evaluation, links, query, rank, stats
from trawl.operators import index as ix
from trawl.operators.session import checkpoint_folder, checkpointed
from trawl.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql is not None:
            SQL[f.__name__.removeprefix("q_")] = " ".join(sql.split())
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


_OPENED: dict[tuple[str, str], ix.Index] = {}


def opened(spark: SparkSession, d: str) -> ix.Index:
    """Index of ``documents``: built once an application into the checkpoint folder and read from there, files pruned by term."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _OPENED:
        path = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
        ix.save(ix.build(documents(spark, d), exact=False, keep_text=False), path)
        _OPENED[key] = ix.load(spark, path)
    return _OPENED[key]


# --- text and index -------------------------------------------------------------------------------------------------

LIST = r"list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}]+'), lambda x: length(x) <= 40)"
TOK = f"l AS (SELECT doc_id, {LIST} AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM l)"
POST = f"{TOK}, p AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM t GROUP BY ALL)"
LEX = f"{POST}, x AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term)"
DL = f"{LEX}, dl AS (SELECT doc_id, len(l) AS length FROM l), n AS (SELECT count(*) AS n, avg(length) AS a FROM dl)"
STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@registered(f"WITH {TOK} SELECT doc_id, pos::INT AS pos, term FROM t")
def q_tokens(spark, d):
    return tx.positions(documents(spark, d))


@registered(f"WITH {TOK} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t GROUP BY doc_id")
def q_token_counts(spark, d):
    return tx.positions(documents(spark, d), exact=False).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


@registered(f"WITH {TOK} SELECT doc_id, pos::INT AS pos, term FROM t WHERE term NOT IN ({STOPS})")
def q_tokens_stopped(spark, d):
    return tx.positions(documents(spark, d), exact=False).where(~F.col("term").isin(*tx.STOP_WORDS))


@registered()
def q_tokens_english(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "lang").where("lang = 'en'")
    return tx.positions(docs, "english", exact=False)


@registered(f"WITH {POST} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM p")
def q_postings(spark, d):
    return opened(spark, d).postings.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@registered(f"WITH {TOK} SELECT doc_id, len(l)::BIGINT AS length FROM l")
def q_doc_lengths(spark, d):
    return ix.doc_lengths(documents(spark, d).select("doc_id"), opened(spark, d).postings)


@registered(f"WITH {LEX} SELECT term, df, cf FROM x")
def q_lexicon(spark, d):
    return ix.lexicon(opened(spark, d).postings)


@registered(f"WITH {LEX} SELECT term, df, cf FROM x ORDER BY df DESC, term LIMIT 50")
def q_top_terms(spark, d):
    return ix.lexicon(opened(spark, d).postings).orderBy(F.desc("df"), "term").limit(50)


@registered(f"""WITH {LEX}, s AS (SELECT count(*) AS terms, sum(df)::BIGINT AS postings, sum(cf)::BIGINT AS tokens FROM x)
SELECT (SELECT count(*) FROM documents) AS docs, tokens, terms, postings, 4 * (2 * postings + tokens) AS uncompressed_bytes,
round(tokens / (SELECT count(*) FROM documents), 6) AS avg_doc_length FROM s""")
def q_index_stats(spark, d):
    return ix.index_stats(documents(spark, d).select("doc_id"), opened(spark, d).postings).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@registered(f"WITH {TOK} SELECT term, doc_id, pos::INT AS pos, (pos - lag(pos, 1, 0) OVER (PARTITION BY term, doc_id ORDER BY pos))::INT AS gap FROM t")
def q_position_gaps(spark, d):
    rows = opened(spark, d).postings.withColumn("gaps", ix.position_gaps(F.col("positions")))
    both = rows.select("term", "doc_id", F.explode(F.arrays_zip("positions", "gaps")).alias("z"))
    return both.select("term", "doc_id", F.col("z.positions").alias("pos"), F.col("z.gaps").alias("gap"))


@registered(f"WITH {POST} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM p")
def q_docid_gaps(spark, d):
    return ix.docid_gaps(opened(spark, d).postings)


@registered(f"WITH {POST} SELECT term, doc_id FROM p")
def q_docid_gaps_roundtrip(spark, d):
    # The gap rows keep no document id but as their order.
    return ix.from_gaps(ix.gap_rows(opened(spark, d).postings))


@registered(f"""WITH {POST}, g AS (SELECT doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS g, tf FROM p)
SELECT sum(greatest(1, ceil(length(bin(g)) / 7.0)))::BIGINT AS docid_bytes, sum(greatest(1, ceil(length(bin(tf)) / 7.0)))::BIGINT AS tf_bytes FROM g""")
def q_vbyte_size(spark, d):
    rows = opened(spark, d).postings
    both = ix.docid_gaps(rows).agg(F.sum(ix.vbyte_size(F.col("gap"))).alias("docid_bytes"))
    return both.crossJoin(rows.agg(F.sum(ix.vbyte_size(F.col("tf"))).alias("tf_bytes")))  # one row each


@registered(f"WITH {POST} SELECT term, doc_id, array_to_string(positions, ' ') AS positions, sum(greatest(1, ceil(length(bin(g)) / 7.0)))::BIGINT AS bytes FROM (SELECT *, unnest(list_transform(positions, lambda x, i: x - coalesce(positions[i - 1], 0))) AS g FROM p) GROUP BY term, doc_id, positions")
def q_vbyte_roundtrip(spark, d):
    rows = opened(spark, d).postings
    coded = rows.select("term", "doc_id", ix.vbyte_encode(ix.position_gaps(F.col("positions").cast("array<bigint>"))).alias("data"))
    # Nothing but the bytes is read back; positions are running sums of the gaps.
    gaps = ix.vbyte_decode(F.col("data"))
    sums = F.transform(F.sequence(F.lit(1), F.size("g")), lambda n: F.aggregate(F.slice("g", 1, n), F.lit(0).cast("bigint"), lambda t, x: t + x))
    out = coded.select("term", "doc_id", F.octet_length("data").cast("bigint").alias("bytes"), gaps.alias("g"))
    return out.select("term", "doc_id", F.array_join(sums.cast("array<string>"), " ").alias("positions"), "bytes")


@registered(f"""WITH {LEX}, r AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS n FROM p JOIN x USING (term) WHERE df >= 100)
SELECT term, n, doc_id FROM r WHERE n % 32 = 0""")
def q_skip_points(spark, d):
    rows = opened(spark, d).postings
    return ix.skip_points(rows, ix.lexicon(rows), 100, 32).withColumn("n", F.col("n").cast("long"))


# --- boolean and phrase -----------------------------------------------------------------------------------------------


def holds(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM t WHERE term = '{term}')"


def stands(*slots: tuple[str, int]) -> str:
    parts = " OR ".join(f"(term = '{t}' AND o = {o})" for t, o in slots)
    values = ", ".join(f"({o})" for _, o in slots)
    return f"""doc_id IN (SELECT doc_id FROM (SELECT doc_id, pos - o AS s, o FROM t, (VALUES {values}) v(o) WHERE {parts})
    GROUP BY doc_id, s HAVING count(DISTINCT o) = {len(slots)})"""


def searched(name: str, text: str, condition: str) -> None:
    def run(spark, d, text=text):
        return query.search(opened(spark, d), text)

    QUERIES[name] = run
    SQL[name] = " ".join(f"WITH {TOK} SELECT doc_id FROM documents WHERE {condition}".split())


searched("term_docs", "tion", holds("tion"))
searched("bool_and", "the of tion", f"{holds('the')} AND {holds('of')} AND {holds('tion')}")
searched("bool_or", "erst OR tion", f"({holds('erst')} OR {holds('tion')})")
searched("bool_not", "the -tion", f"{holds('the')} AND NOT {holds('tion')}")
searched("bool_pure_not", "-the", f"NOT {holds('the')}")
searched("phrase2", '"of the"', stands(("of", 0), ("the", 1)))
searched("phrase3", '"is of the"', stands(("is", 0), ("of", 1), ("the", 2)))
searched("bool_combined", '"of the" OR erst and -tion', f"({stands(('of', 0), ('the', 1))} OR {holds('erst')}) AND {holds('and')} AND NOT {holds('tion')}")


@registered(f"WITH {TOK} SELECT doc_id FROM documents WHERE {stands(('the', 0), ('the', 2))}")
def q_phrase_gap(spark, d):
    return query.phrase_docs(opened(spark, d), query.Clause(("the", "the"), (0, 2)))


# --- ranking ----------------------------------------------------------------------------------------------------------

LL = "CASE WHEN length < 24 OR length - 24 < 8 THEN length ELSE 24 + (((length - 24) >> (length(bin(length - 24)) - 4)) << (length(bin(length - 24)) - 4)) END"


def bm25_sql(terms: dict[str, int], k1: float, b: float, lucene: bool, where: str = "TRUE", prior: str = "0", k: int | None = 10) -> str:
    """SQL of one ranked query."""
    w = " ".join(f"WHEN '{t}' THEN {n}" for t, n in terms.items())
    length = "ll" if lucene else "length"
    names = ", ".join(f"'{t}'" for t in terms)
    tail = f"ORDER BY score DESC, doc_id LIMIT {k}" if k else ""
    return f"""WITH {DL}, dq AS (SELECT doc_id, length, {LL} AS ll FROM dl),
    s AS (SELECT p.doc_id, sum((CASE p.term {w} END) * ln(1 + (n.n - x.df + 0.5) / (x.df + 0.5)) * p.tf / (p.tf + {k1} * (1 - {b} + {b} * {length} / n.a))) AS s
    FROM p JOIN x USING (term) JOIN dq USING (doc_id) CROSS JOIN n WHERE p.term IN ({names}) GROUP BY p.doc_id)
    SELECT doc_id, round(s + {prior}, 6) AS score FROM s WHERE {where} {tail}"""


TEXT = "the of tion erst tion"
TERMS = {"the": 1, "of": 1, "tion": 2, "erst": 1}


@registered(f"WITH {TOK}, k AS (SELECT doc_id, len(l) AS length FROM l) SELECT doc_id, length, ({LL})::BIGINT AS seen FROM k")
def q_lucene_length(spark, d):
    docs = opened(spark, d).docs
    return docs.select("doc_id", "length", rank.lucene_length(F.col("length")).alias("seen"))


@registered(f"WITH {DL} SELECT term, round(ln(1 + (n.n - df + 0.5) / (df + 0.5)), 6) AS idf FROM x CROSS JOIN n")
def q_idf(spark, d):
    index = opened(spark, d)
    n, _ = index.sizes()
    return index.lexicon.select("term", F.round(rank.idf(F.col("df"), n), 6).alias("idf"))


@registered(bm25_sql(TERMS, 0.9, 0.4, False, k=None))
def q_bm25_scores(spark, d):
    return rank.scores(opened(spark, d), TERMS, lucene_norms=False).withColumn("score", F.round("score", 6))


@registered(bm25_sql(TERMS, 0.9, 0.4, True, k=None))
def q_bm25_lucene_norms(spark, d):
    return rank.scores(opened(spark, d), TERMS).withColumn("score", F.round("score", 6))


@registered(bm25_sql(TERMS, 0.9, 0.4, True))
def q_bm25_topk(spark, d):
    return rank.search(opened(spark, d), TEXT, digits=6)


@registered(bm25_sql(TERMS, 0.9, 0.4, True, "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def q_bm25_candidates(spark, d):
    english = table(spark, d, "documents", "doc_id", "lang").where("lang = 'en'")
    return rank.search(opened(spark, d), TEXT, candidates=english, digits=6)


@registered(bm25_sql(TERMS, 0.9, 0.4, True, "doc_id NOT IN (0, 1, 2, 3, 4)"))
def q_bm25_exclude(spark, d):
    return rank.search(opened(spark, d), TEXT, exclude=[0, 1, 2, 3, 4], digits=6)


@registered(bm25_sql(TERMS, 1.2, 0.75, True))
def q_ranked_search_free(spark, d):
    return rank.ranked_search(opened(spark, d), TEXT, digits=6)


@registered(bm25_sql({"of": 1, "the": 1, "erst": 1}, 1.2, 0.75, True, f"{stands(('of', 0), ('the', 1))} AND {holds('erst')}"))
def q_ranked_search_phrase(spark, d):
    return rank.ranked_search(opened(spark, d), '"of the" erst', digits=6)


@registered(bm25_sql({"the": 1, "erst": 1}, 1.2, 0.75, True, f"{holds('the')} AND {holds('erst')} AND NOT {holds('tion')}"))
def q_ranked_search_not(spark, d):
    return rank.ranked_search(opened(spark, d), "the erst -tion", digits=6)


COPURCHASE = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
WHERE dst IS NOT NULL AND src <> dst)"""
INDEG = f"{COPURCHASE}, ind AS (SELECT p_partkey AS id, (SELECT count(*) FROM e WHERE dst = p_partkey) AS in_degree FROM part)"


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as nodes, co-purchases as links."""
    nodes = table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("id"))
    return nodes, links.copurchase_links(table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"))


@registered(bm25_sql(TERMS, 1.2, 0.75, True, prior=f"0.3 * coalesce((SELECT ln(1 + in_degree) FROM (WITH {INDEG} SELECT * FROM ind) z WHERE z.id = s.doc_id), 0)"))
def q_bm25_prior(spark, d):
    nodes, edges = graph(spark, d)
    return rank.ranked_search(opened(spark, d), TEXT, priors=rank.prior(links.in_degree(nodes, edges), "indegree"), prior_weight=0.3, digits=6)


@registered(f"WITH {INDEG} SELECT id AS doc_id, round(ln(1 + in_degree), 6) AS prior FROM ind")
def q_prior_indegree(spark, d):
    nodes, edges = graph(spark, d)
    return rank.prior(links.in_degree(nodes, edges), "indegree").withColumn("prior", F.round("prior", 6))


def run_sql(k: int, remove_self: bool = False) -> str:
    """CTEs up to r(qid, docid, score, rank): benchmark items as queries."""
    blist = LIST.replace("text", "b.text")
    return f"""{DL}, dq AS (SELECT doc_id, length, {LL} AS ll FROM dl),
    q AS (SELECT item_id AS qid, unnest({blist}) AS term FROM benchmark b), qw AS (SELECT qid, term, count(*) AS w FROM q GROUP BY ALL),
    s AS (SELECT qid, p.doc_id, round(sum(w * ln(1 + (n.n - x.df + 0.5) / (x.df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * ll / n.a))), 6) AS score
    FROM qw JOIN p USING (term) JOIN x USING (term) JOIN dq USING (doc_id) CROSS JOIN n {'WHERE qid <> p.doc_id' if remove_self else ''} GROUP BY qid, p.doc_id),
    r AS (SELECT qid, doc_id AS docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {k})"""


def batch_run(spark: SparkSession, d: str, k: int, remove_self: bool = False) -> DataFrame:
    items = table(spark, d, "benchmark", "item_id", "text").withColumnRenamed("item_id", "doc_id")
    asked = tx.positions(items, exact=False).select(F.col("doc_id").alias("qid"), "term")
    return rank.batch(opened(spark, d), asked, k, remove_self=remove_self, digits=6)


@registered(f"WITH {run_sql(20)} SELECT qid, docid AS doc_id, score, rank::INT AS rank FROM r")
def q_bm25_batch(spark, d):
    return batch_run(spark, d, 20)


@registered(f"WITH {run_sql(20, True)} SELECT qid, docid AS doc_id, score, rank::INT AS rank FROM r")
def q_bm25_remove_query(spark, d):
    return batch_run(spark, d, 20, True)


# --- graph ------------------------------------------------------------------------------------------------------------


@registered("SELECT p_partkey, upper(substr(trim(replace(p_name, '_', ' ')), 1, 1)) || substr(trim(replace(p_name, '_', ' ')), 2) AS title FROM part")
def q_normalize_title(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", links.normalize_title(F.col("p_name")).alias("title"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as articles: brands are aliases; each links to the next part twice, itself, its brand and nothing known."""
    n = F.col("p_partkey").cast("string")
    after = (F.col("p_partkey") + 1).cast("string")
    alias = lambda ns, name: F.struct(F.lit(ns).alias("namespace"), name.alias("title"))
    return table(spark, d, "part", "p_partkey", "p_brand", "p_type").select(
        (F.col("p_partkey") - 1).alias("doc_id"), F.concat(F.lit("part_"), n).alias("title"), F.array(alias(0, F.col("p_brand")), alias(1, F.col("p_type"))).alias("redirect"),
        F.array(F.concat(F.lit("part "), after), F.concat(F.lit("Part_"), after), F.concat(F.lit("part_"), n), F.col("p_brand"), F.lit("nowhere at all")).alias("outgoing_link"),
    )


NAMED = """a AS (SELECT name, arg_min(id, (kind, turn)) AS id FROM (SELECT 'Part ' || p_partkey AS name, p_partkey - 1 AS id, 0 AS kind, 1 - p_partkey AS turn FROM part
UNION ALL SELECT upper(substr(p_brand, 1, 1)) || substr(p_brand, 2), p_partkey - 1, 1, p_partkey - 1 FROM part) GROUP BY name),
o AS (SELECT p_partkey - 1 AS src, unnest(['Part ' || (p_partkey + 1), 'Part ' || (p_partkey + 1), 'Part ' || p_partkey, upper(substr(p_brand, 1, 1)) || substr(p_brand, 2), 'Nowhere at all']) AS name FROM part),
g AS (SELECT src, a.id AS dst FROM o LEFT JOIN a USING (name))"""


@registered(f"WITH {NAMED} SELECT name, id FROM a")
def q_alias_resolve(spark, d):
    return links.names(articles(spark, d))


@registered(f"WITH {NAMED} SELECT DISTINCT src, dst FROM g WHERE dst IS NOT NULL AND src <> dst")
def q_article_edges(spark, d):
    return links.edges(articles(spark, d))


@registered(f"""WITH {NAMED} SELECT (SELECT count(*) FROM part) AS articles, (SELECT count(*) FROM part) AS redirect_aliases, count(*) AS links_in_dump,
count(DISTINCT CASE WHEN src <> dst THEN (src, dst) END) AS edges, count(*) FILTER (dst IS NULL) AS unresolved_links, count(*) FILTER (src = dst) AS self_links FROM g""")
def q_graph_stats(spark, d):
    return links.graph_stats(articles(spark, d))


@registered(f"WITH {COPURCHASE} SELECT src, dst FROM e")
def q_graph_edges(spark, d):
    return graph(spark, d)[1]


@registered(f"WITH {COPURCHASE} SELECT p_partkey AS id, count(dst) AS in_degree FROM part LEFT JOIN e ON dst = p_partkey GROUP BY p_partkey")
def q_in_degree(spark, d):
    return links.in_degree(*graph(spark, d))


@registered(f"WITH {COPURCHASE} SELECT p_partkey AS id, count(src) AS out_degree, count(src) = 0 AS dangling FROM part LEFT JOIN e ON src = p_partkey GROUP BY p_partkey")
def q_out_degree_dangling(spark, d):
    return links.out_degree(*graph(spark, d))


ITERATIONS = 8


def pagerank_sql(n: int = ITERATIONS, damping: float = 0.85) -> str:
    """Unrolled power iterations, r0 to rn."""
    parts = [f"WITH {COPURCHASE}", "c AS (SELECT count(*)::DOUBLE AS n FROM part)", "w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e)",
             "v AS (SELECT p_partkey AS id, p_partkey NOT IN (SELECT src FROM e) AS dangling FROM part)", "r0 AS MATERIALIZED (SELECT id, dangling, 1 / n AS r FROM v, c)"]
    for i in range(1, n + 1):
        parts.append(f"""r{i} AS MATERIALIZED (SELECT v.id, v.dangling, {damping}::DOUBLE * (coalesce(m.s, 0) + coalesce((SELECT sum(r) FROM r{i - 1} WHERE dangling), 0) / n)
        + (1 - {damping}::DOUBLE) / n AS r FROM v LEFT JOIN (SELECT dst, sum(r * w) AS s FROM w JOIN r{i - 1} ON id = src GROUP BY dst) m ON m.dst = v.id, c)""")
    return ", ".join(parts)


@registered(f"{pagerank_sql()} SELECT id, round(r, 10) AS rank FROM r{ITERATIONS}")
def q_pagerank_fixed(spark, d):
    return links.pagerank(*graph(spark, d), fixed=ITERATIONS).rank.withColumn("rank", F.round("rank", 10))


@registered(f"{pagerank_sql()} SELECT id, round(r, 10) AS rank FROM r{ITERATIONS} ORDER BY rank DESC, id LIMIT 10")
def q_pagerank_topk(spark, d):
    return q_pagerank_fixed(spark, d).orderBy(F.desc("rank"), "id").limit(10)


# --- rank statistics ----------------------------------------------------------------------------------------------------

RANKED = "a AS (SELECT *, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS ra, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS rb FROM orders)"


@registered(f"WITH {RANKED} SELECT o_orderkey, rb::DOUBLE AS avg_rank FROM a")
def q_average_ranks(spark, d):
    return stats.average_ranks(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "avg_rank")


@registered(f"WITH {RANKED} SELECT round(corr(ra, rb), 6) AS rho FROM a")
def q_spearman(spark, d):
    return stats.spearman(table(spark, d, "orders", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey").withColumn("rho", F.round("rho", 6))


@registered("""WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 100)
SELECT count(*) / 100.0::DOUBLE AS overlap FROM a JOIN b USING (p_partkey)""")
def q_top_k_overlap(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_retailprice", "p_size")
    return stats.top_k_overlap(parts, "p_retailprice", "p_size", 100, "p_partkey")


@registered("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type), p AS (SELECT unnest([50.0, 95.0, 99.0])::DOUBLE AS p)
SELECT event_type, p, v[1 + least(len(v) - 1, floor(p / 100 * len(v))::BIGINT)] AS value FROM s, p""")
def q_nearest_rank_percentile(spark, d):
    rows = table(spark, d, "events", "event_type", "value").where("value is not null")
    return stats.nearest_rank(rows, "event_type", "value", [50.0, 95.0, 99.0])


# --- evaluation -----------------------------------------------------------------------------------------------------------

QRELS = "j AS (SELECT item_id AS qid, d.doc_id AS docid, 1 + coalesce(quality, 0) AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id))"
ORDERED = f"WITH {run_sql(100)}, {QRELS}, o AS (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid::VARCHAR DESC) AS rank FROM r)"
NDCG = """dcg AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg FROM o JOIN j USING (qid, docid) WHERE rank <= 10 GROUP BY qid),
i AS (SELECT qid, sum(grade / log2(k + 1)) AS idcg FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS k FROM j WHERE grade > 0) WHERE k <= 10 GROUP BY qid),
nd AS (SELECT qid, coalesce(dcg, 0) / idcg AS ndcg FROM i LEFT JOIN dcg USING (qid))"""
RECALL = "rc AS (SELECT j.qid, count(o.docid) / count(*) AS recall FROM j LEFT JOIN o ON o.qid = j.qid AND o.docid = j.docid AND rank <= 100 WHERE grade > 0 GROUP BY j.qid)"


#: Pairs of an item and a document that are sent to every task.
SENT_PAIRS = 500_000


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark text, graded by quality.

    Only documents that hold all inner words of an item are searched for its
    text; every document is for items without an inner word.
    """
    docs, items = documents(spark, d), table(spark, d, "benchmark", "item_id", "text")
    words = tx.positions(items.withColumnRenamed("item_id", "doc_id"), exact=False)
    last = words.groupBy("doc_id").agg(F.max("pos").alias("last"))
    inner = checkpointed(words.join(last, "doc_id").where("pos > 0 and pos < last").select(F.col("doc_id").alias("qid"), "term"))
    asked = items.select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    pairs = checkpointed(rank.holding(opened(spark, d), inner))
    # Texts stay where they lie while the pairs fit every task.
    may = docs.join(F.broadcast(pairs) if pairs.count() <= SENT_PAIRS else pairs.hint("merge"), "doc_id").join(asked, "qid").select("qid", "doc_id", "text", "item")
    bare = checkpointed(asked.join(inner, "qid", "left_anti"))
    if not bare.isEmpty():
        may = may.unionByName(docs.crossJoin(bare).select("qid", "doc_id", "text", "item"))
    labels = table(spark, d, "labels", "doc_id", "quality")
    # The measures read judgements and runs several times.
    held = may.where(F.contains("text", "item")).select("qid", "doc_id")
    return checkpointed(held.join(labels, "doc_id", "left").select("qid", F.col("doc_id").alias("docid"), (1 + F.coalesce("quality", F.lit(0))).alias("grade")))


def eval_run(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(batch_run(spark, d, 100).select("qid", F.col("doc_id").alias("docid"), "score"))


@registered(f"{ORDERED} SELECT qid, docid, score, rank::INT AS rank FROM o")
def q_trec_order(spark, d):
    return evaluation.trec_order(eval_run(spark, d))


@registered(f"{ORDERED}, {NDCG} SELECT qid, round(ndcg, 6) AS ndcg FROM nd")
def q_ndcg_at_10(spark, d):
    return evaluation.ndcg(eval_run(spark, d), qrels(spark, d)).withColumn("ndcg", F.round("ndcg", 6))


@registered(f"{ORDERED}, {RECALL} SELECT qid, round(recall, 6) AS recall FROM rc")
def q_recall_at_100(spark, d):
    return evaluation.recall(eval_run(spark, d), qrels(spark, d)).withColumn("recall", F.round("recall", 6))


@registered(f"{ORDERED}, {NDCG}, {RECALL} SELECT count(*) AS n_queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM nd JOIN rc USING (qid)")
def q_eval_macro(spark, d):
    out = evaluation.evaluate(eval_run(spark, d), qrels(spark, d))
    return out.select("n_queries", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


@registered(f"""{ORDERED}, w AS (SELECT qid, min(docid) AS docid FROM j GROUP BY qid), h AS (SELECT w.qid, rank FROM w LEFT JOIN o ON o.qid = w.qid AND o.docid = w.docid)
SELECT count(*) AS n, avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS success_1, avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS success_k,
round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM h""")
def q_known_item_mrr(spark, d):
    targets = qrels(spark, d).groupBy("qid").agg(F.min("docid").alias("docid"))
    return evaluation.known_item(eval_run(spark, d), targets).withColumn("mrr", F.round("mrr", 6))


WEIGHTS = [0.0, 0.1, 0.2, 0.3, 0.5, 1.0]


@registered(f"""{ORDERED}, w AS (SELECT qid, min(docid) AS docid FROM j GROUP BY qid), {INDEG.replace("e AS", "e AS", 1)},
f AS (SELECT qid, docid, w.w, round(score + w.w * coalesce(ln(1 + in_degree), 0), 6) AS final FROM o LEFT JOIN ind ON ind.id = docid, (SELECT unnest({WEIGHTS})::DOUBLE AS w) w),
k AS (SELECT qid, docid, w, row_number() OVER (PARTITION BY qid, w ORDER BY final DESC, docid) AS k FROM f)
SELECT k.w, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) / (SELECT count(*) FROM w) AS success_1,
round(sum(CASE WHEN k <= 10 THEN 1.0::DOUBLE / k ELSE 0 END) / (SELECT count(*) FROM w), 6) AS mrr FROM k JOIN w USING (qid, docid) GROUP BY k.w""")
def q_prior_weight_sweep(spark, d):
    priors = rank.prior(links.in_degree(*graph(spark, d)), "indegree").withColumnRenamed("doc_id", "docid")
    scored = eval_run(spark, d).join(priors, "docid", "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    targets = qrels(spark, d).groupBy("qid").agg(F.min("docid").alias("docid"))
    return evaluation.weight_sweep(scored, targets, WEIGHTS, 6).withColumn("mrr", F.round("mrr", 6))


# --- URLs, robots and HTML --------------------------------------------------------------------------------------------------

TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
NORMAL = f"""regexp_extract(b, '^[^?]*') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(list_sort(k), '&') ELSE '' END FROM (SELECT *,
list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({TRACK})) AS k FROM (SELECT *, regexp_replace(url, '#.*$', '') AS b FROM pages))"""


@registered(f"SELECT page_id, {NORMAL.replace(' FROM (SELECT *,', ' AS normal FROM (SELECT *,', 1)}")
def q_url_normalize(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", urls.normalize_udf("url").alias("normal"))


@registered(f"SELECT page_id, {NORMAL.replace(' FROM (SELECT *,', ' AS normal FROM (SELECT *,', 1)}")
def q_url_tracking_strip(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", urls.normalized_simple(F.col("url")).alias("normal"))


@registered("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n FROM pages GROUP BY ALL")
def q_pages_per_host(spark, d):
    return table(spark, d, "pages", "url").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


BARE = r"regexp_replace(html, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<title>.*?</title>', '', 'g')"
DECODED = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def lined(html: str) -> str:
    """SQL of the text of markup: breaking elements end lines, white space is one space, blank lines go."""
    out = f"regexp_replace(regexp_replace({html}, '</?(p|div|br|li|h1|h2|article)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, value in DECODED:
        out = f"replace({out}, '{name}', '{value}')"
    return f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(regexp_replace(x, '[ ]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@registered(f"""SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '[ ]+', ' ', 'g')) AS title, {lined(BARE)} AS text,
NULL::VARCHAR AS canonical, FALSE AS noindex, FALSE AS nofollow FROM pages""")
def q_html_extract(spark, d):
    return pg.parsed_pages(table(spark, d, "pages", "page_id", "url", "html")).select("page_id", "page.title", "page.text", "page.canonical", "page.noindex", "page.nofollow")


@registered(f"""SELECT page_id, {lined(f"regexp_replace({BARE}, '(?s)<nav>.*?</nav>|<footer>.*?(</footer>|$)', '', 'g')")} AS main_text FROM pages""")
def q_html_main_text(spark, d):
    return pg.analyzed(table(spark, d, "pages", "page_id", "url", "html")).select("page_id", F.col("body").alias("main_text"))


@registered("""SELECT page_id, (n - 1)::INT AS n, link FROM (SELECT page_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS link FROM (SELECT page_id,
list_transform(list_filter(x, lambda v, i: list_position(x, v) = i), lambda v: lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+')) || replace(replace(url_encode(v), '%2F', '/'), '%2C', ',')) AS l
FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages)))""")
def q_page_outlinks(spark, d):
    return pg.parsed_pages(table(spark, d, "pages", "page_id", "url", "html")).select("page_id", F.posexplode("page.links").alias("n", "link"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\nDisallow: /de/2\nAllow: /de/\nCrawl-delay: 2\n\nUser-agent: otherbot\nDisallow: /fr/\nSitemap: http://example.com/map.xml\n"


def _rule(allow: bool, pattern: str) -> dict:
    return {"allow": allow, "pattern": pattern}


# What the file above says, read by hand.
POLICY = {"mode": "rules", "sitemaps": ["http://example.com/map.xml"], "groups": [
    {"agents": ["*"], "rules": [_rule(False, "/en/"), _rule(True, "/en/1"), _rule(False, "/*.html$"), _rule(False, "/de/2"), _rule(True, "/de/")], "crawl_delay": 2.0},
    {"agents": ["otherbot"], "rules": [_rule(False, "/fr/")]},
]}


@registered(f"SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host, '{json.dumps(POLICY, separators=(',', ':'))}' AS policy FROM pages")
def q_robots_parse(spark, d):
    hosts = table(spark, d, "pages", "url").select(urls.host_of(F.col("url")).alias("host")).distinct()
    return hosts.select("host", F.to_json(rb.parse_udf(F.lit(200), F.lit(ROBOTS))).alias("policy"))


_RULES = rb.rules_table(rb.parse(ROBOTS), "trawlbot/0.1")
_SQL_RULES = ", ".join(f"({'TRUE' if a else 'FALSE'}, '{x}', {n})" for a, _, x, n in _RULES)


@registered(f"""WITH r AS (SELECT * FROM (VALUES {_SQL_RULES}) v(ok, x, n)), u AS (SELECT page_id, CASE WHEN strpos(split_part(url, '://', 2), '/') = 0 THEN '/'
ELSE regexp_replace(regexp_extract(split_part(url, '://', 2), '/.*$'), '#.*$', '') END AS path FROM pages)
SELECT page_id, path, coalesce((SELECT arg_max(ok, n * 2 + ok::INT) FROM r WHERE regexp_matches(path, x)), TRUE) AS allowed FROM u""")
def q_robots_can_fetch(spark, d):
    paths = table(spark, d, "pages", "page_id", "url").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_and_query(F.col("url")).alias("path"))
    made = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(x).alias("regex"), F.lit(n).alias("length")) for a, _, x, n in _RULES])
    rules = paths.select("host").distinct().select("host", F.explode(made).alias("r")).select("host", "r.*")
    return rb.decide(paths, rules).select("page_id", "path", "allowed")


# --- duplicates ---------------------------------------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SHINGLES = f"""w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3
THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END)) AS g FROM w)"""
JACCARD = f"""{SHINGLES}, c AS (SELECT doc_id, list_sort(list(g)) AS s, count(*) AS n FROM g GROUP BY doc_id), k AS (SELECT min(doc_id) AS doc_id, s, n FROM c GROUP BY s, n),
kg AS (SELECT g.* FROM g JOIN k USING (doc_id)), pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM kg a JOIN kg b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
js AS (SELECT a, b, i / (x.n + y.n - i) AS jaccard FROM pr JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE i / (x.n + y.n - i) >= 0.8)"""


@registered(f"SELECT doc_id, sha1(array_to_string({WORDS}, ' ')) AS content_hash FROM documents")
def q_content_hash(spark, d):
    return documents(spark, d).select("doc_id", dedup.content_hash(F.col("text")).alias("content_hash"))


@registered(f"""WITH h AS (SELECT doc_id, sha1(array_to_string({WORDS}, ' ')) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h)
SELECT doc_id, first AS dup_of FROM h JOIN f USING (h) WHERE doc_id <> first""")
def q_exact_dups(spark, d):
    rows = q_content_hash(spark, d)
    first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("dup_of"))
    return rows.join(first, "content_hash").where("doc_id <> dup_of").select("doc_id", "dup_of")


@registered(f"WITH {SHINGLES} SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id")
def q_shingle_counts(spark, d):
    return dedup.shingle_rows(documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


@registered(f"WITH {JACCARD} SELECT a, b, round(jaccard, 6) AS jaccard FROM js")
def q_near_dup_pairs_exact_jaccard(spark, d):
    return dedup.exact_jaccard_pairs(documents(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@registered(f"WITH {JACCARD} SELECT c.doc_id, k.doc_id AS representative FROM c JOIN k USING (s, n)")
def q_shingle_classes(spark, d):
    return dedup.shingle_classes(documents(spark, d))


def _half(name: str) -> str:
    return " + ".join(f"CASE WHEN sum(({name} >> {i}) & 1) * 2 > count(*) THEN {1 << i} ELSE 0 END" for i in range(32))


SIMHASH = f"""{SHINGLES}, m AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS x, ('0x' || substr(md5(g), 9, 8))::BIGINT AS y FROM g),
sh AS (SELECT doc_id, ({_half('x')})::BIGINT AS hi, ({_half('y')})::BIGINT AS lo FROM m GROUP BY doc_id)"""
CANDIDATES = f"""{SIMHASH}, u AS (SELECT min(doc_id) AS doc_id, hi, lo, hi::UHUGEINT * 4294967296 + lo AS v FROM sh GROUP BY hi, lo), kb AS (SELECT doc_id, hi, lo, i, (v // (2::UHUGEINT ** (7 * i))::UHUGEINT) % (CASE WHEN i = 8 THEN 256 ELSE 128 END) AS b FROM u, range(9) r(i)),
cd AS (SELECT DISTINCT a.doc_id AS later, b.doc_id AS earlier, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS bits FROM kb a JOIN kb b ON a.i = b.i AND a.b = b.b AND b.doc_id < a.doc_id
WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8)"""


def portable_simhash(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, hi, lo): SimHash over MD5 features in two halves of 32 bits."""
    half = lambda at: F.conv(F.substr(F.md5("g"), F.lit(at), F.lit(8)), 16, 10).cast("bigint")
    rows = dedup.shingle_rows(documents(spark, d)).select("doc_id", half(1).alias("x"), half(9).alias("y"))
    bits = [F.sum(F.shiftright(c, i).bitwiseAND(1)).alias(f"{c}{i}") for c in "xy" for i in range(32)]
    summed = rows.groupBy("doc_id").agg(F.count("*").alias("n"), *bits)
    word = lambda c: sum((F.when(F.col(f"{c}{i}") * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(32)), F.lit(0).cast("bigint"))
    return summed.select("doc_id", word("x").alias("hi"), word("y").alias("lo"))


def portable_prints(spark: SparkSession, d: str) -> DataFrame:
    return portable_simhash(spark, d).select("doc_id", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("simhash"))


def portable_candidates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.candidates(portable_prints(spark, d))


@registered(f"WITH {SIMHASH} SELECT doc_id, hi, lo FROM sh")
def q_simhash_portable(spark, d):
    return portable_simhash(spark, d)


@registered(f"WITH {SHINGLES}, s AS (SELECT unnest(range(8)) AS seed) SELECT doc_id, seed::INT AS seed, min(md5(seed || ':' || g)) AS slot FROM g, s GROUP BY doc_id, seed")
def q_minhash_portable(spark, d):
    def slot(i: int) -> Column:
        return F.array_min(F.transform("g", lambda g: F.md5(F.concat(F.lit(f"{i}:"), g)))).alias(f"s{i}")

    # The least of each row is found where it lies; rows of one id share theirs.
    rows = dedup.shingle_lists(documents(spark, d)).select("doc_id", *map(slot, range(8)))
    wide = rows.groupBy("doc_id").agg(*(F.min(f"s{i}").alias(f"s{i}") for i in range(8))).where("s0 is not null")
    return wide.select("doc_id", F.posexplode(F.array(*[f"s{i}" for i in range(8)])).alias("seed", "slot"))


@registered(f"WITH {CANDIDATES} SELECT bits, count(*) AS pairs FROM cd GROUP BY bits")
def q_simhash_hamming(spark, d):
    return portable_candidates(spark, d).groupBy(F.col("bits").cast("int").alias("bits")).agg(F.count("*").alias("pairs"))


@registered(f"WITH {CANDIDATES} SELECT later, earlier, bits FROM cd")
def q_simhash_candidates(spark, d):
    return portable_candidates(spark, d).select("later", "earlier", "bits")


@registered(f"WITH {SIMHASH}, u AS (SELECT min(doc_id) AS doc_id, hi, lo FROM sh GROUP BY hi, lo) SELECT sh.doc_id, u.doc_id AS representative FROM sh JOIN u USING (hi, lo)")
def q_simhash_classes(spark, d):
    return dedup.classes(portable_prints(spark, d))


@registered(f"""WITH {CANDIDATES}, {JACCARD.removeprefix(SHINGLES + ',')}, f AS (SELECT DISTINCT later AS id FROM cd), t AS (SELECT DISTINCT b AS id FROM js)
SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM t) AS "true", count(*) AS "right", round(count(*) / (SELECT count(*) FROM f), 6) AS precision,
round(count(*) / (SELECT count(*) FROM t), 6) AS recall FROM f JOIN t USING (id)""")
def q_dup_precision_recall(spark, d):
    found = portable_candidates(spark, d).select(F.col("later").alias("id"))
    truth = dedup.exact_jaccard_pairs(documents(spark, d)).select(F.col("b").alias("id"))
    out = evaluation.duplicate_quality(found, truth)
    return out.select("found", "true", "right", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@registered()
def q_dedup_assign(spark, d):
    return dedup.assign(dedup.fingerprints(documents(spark, d)))


# --- crawl ----------------------------------------------------------------------------------------------------------------------

STORED = """s AS (SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 11 = 0 THEN 'x' END AS dup_of,
CASE WHEN page_id % 22 = 0 THEN 'near' WHEN page_id % 11 = 0 THEN 'exact' END AS dup_kind, page_id % 13 = 0 AS noindex, page_id // 2 AS fetched_at FROM pages)"""


def stored_pages(spark: SparkSession, d: str) -> DataFrame:
    """``pages`` with made-up fetch results."""
    n = F.col("page_id")
    return table(spark, d, "pages", "page_id", "url", "html").withColumns({
        "status": F.when(n % 7 == 0, 404).otherwise(200), "dup_of": F.when(n % 11 == 0, F.lit("x")),
        "dup_kind": F.when(n % 22 == 0, "near").when(n % 11 == 0, "exact"), "noindex": n % 13 == 0, "fetched_at": F.floor(n / 2),
        "title": F.lit(""), "text": F.lit("")})


@registered(f"WITH {STORED} SELECT row_number() OVER (ORDER BY fetched_at, url) - 1 AS doc_id, url FROM s WHERE status = 200 AND dup_of IS NULL AND NOT noindex")
def q_src_indexable_pages(spark, d):
    return readers.indexable_pages(stored_pages(spark, d)).select("doc_id", "url")


@registered("SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages")
def q_link_edges(spark, d):
    rows = table(spark, d, "pages", "url", "html")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return sinks.insert_links(None, rows.select(F.col("url").alias("src"), F.explode(found).alias("dst")))


@registered(f"""WITH {STORED}, k AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages)
SELECT count(*) AS pages, count(*) FILTER (status = 200) AS ok, count(*) FILTER (dup_kind = 'exact') AS exact_dups, count(*) FILTER (dup_kind = 'near') AS near_dups,
count(*) FILTER (noindex) AS noindex, count(DISTINCT split_part(split_part(url, '://', 2), '/', 1)) AS hosts, (SELECT count(*) FROM k) AS links,
round(count(*) FILTER (dup_kind IS NOT NULL) / count(*), 4) AS dup_rate FROM s""")
def q_crawl_stats(spark, d):
    return crawl.crawl_stats(stored_pages(spark, d), q_link_edges(spark, d))


@registered("""SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY url, page_id)::INT AS slot, (row_number() OVER (PARTITION BY host ORDER BY url, page_id) - 1) * 0.5::DOUBLE AS earliest
FROM (SELECT *, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)""")
def q_politeness_schedule(spark, d):
    rows = table(spark, d, "pages", "page_id", "url").withColumn("host", urls.host_of(F.col("url")))
    return crawl.schedule(rows, 0.5, "host", "url", "page_id").select("page_id", "host", "slot", "earliest")


@registered("""SELECT user_id, count(*) AS n, min(g) AS min_gap FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS g FROM events) GROUP BY user_id""")
def q_host_min_gap(spark, d):
    return crawl.host_gaps(table(spark, d, "events", "user_id", "ts"), "user_id", "ts")


@registered(f"""WITH {COPURCHASE}, b0 AS (SELECT unnest([1, 2, 3])::BIGINT AS node), b1 AS (SELECT DISTINCT dst AS node FROM e JOIN b0 ON src = node WHERE dst NOT IN (SELECT node FROM b0)),
b2 AS (SELECT DISTINCT dst AS node FROM e JOIN b1 ON src = node WHERE dst NOT IN (SELECT node FROM b0 UNION ALL SELECT node FROM b1)),
b3 AS (SELECT DISTINCT dst AS node FROM e JOIN b2 ON src = node WHERE dst NOT IN (SELECT node FROM b0 UNION ALL SELECT node FROM b1 UNION ALL SELECT node FROM b2))
SELECT node, 0 AS depth FROM b0 UNION ALL SELECT node, 1 FROM b1 UNION ALL SELECT node, 2 FROM b2 UNION ALL SELECT node, 3 FROM b3""")
def q_bfs_frontier(spark, d):
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "node bigint")
    return crawl.frontier(seeds, graph(spark, d)[1], 3)


# A web over the part keys: page i links to 2i, 2i + 1 and 3i, each tenth page is a copy, some are private, host h4 is not asked for.
WEB_SEEDS, WEB_DEPTH = (1, 2, 3, 5), 3


def part_web(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, responses, robots)."""
    i = F.col("i")
    at = lambda n: F.concat(F.lit("http://h"), (n % 5).cast("string"), F.lit(".test/"), F.when(n % 7 == 3, "private/").otherwise("p/"), n.cast("string"))
    body = F.when(i % 10 == 0, F.floor(i / 10)).otherwise(i)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda j: F.concat(F.lit("w"), ((body * 7919 + j * j * 104729) % 100003).cast("string"))), " ")
    out = [F.concat(at(2 * i), F.lit("?utm_medium=x#top")), at(2 * i + 1), F.lit("http://elsewhere.test/"), at(2 * i), at(3 * i)]
    html = F.concat(F.lit("<p>"), words, F.lit("</p>"), *(F.concat(F.lit('<a href="'), x, F.lit('"></a>')) for x in out))
    rows = table(spark, d, "part", "p_partkey").select(F.col("p_partkey").cast("bigint").alias("i"))
    responses = rows.select(at(i).alias("url"), F.lit(200).alias("status"), html.alias("html"), F.lit(None).cast("string").alias("final_url"), F.lit("text/html").alias("content_type"), i.cast("double").alias("fetched_at"))
    robots = spark.createDataFrame([(f"h{h}.test", 200, "User-agent: *\nDisallow: /private/") for h in range(5)], "host string, status int, text string")
    seeds = spark.createDataFrame([(n,) for n in WEB_SEEDS], "n bigint").coalesce(1).select(F.regexp_replace(at(F.col("n")), "^http://h", "HTTP://H").alias("url"))
    return seeds, responses, robots


_CRAWLED: dict[tuple[str, str], crawl.Crawl] = {}


def part_crawl(spark: SparkSession, d: str) -> crawl.Crawl:
    """The crawl of ``part_web``, once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CRAWLED:
        _CRAWLED[key] = crawl.crawl(*part_web(spark, d), crawl.CrawlConfig(max_pages=1_000_000, max_depth=WEB_DEPTH))
    return _CRAWLED[key]


def _web_sql() -> str:
    """CTEs of the same crawl, round by round: f(i, b, depth, nth) are the pages fetched and o the originals of them."""
    hosts = ", ".join(str(n % 5) for n in WEB_SEEDS)
    seeds = ", ".join(f"({n}::BIGINT, {k}::BIGINT)" for k, n in enumerate(WEB_SEEDS))
    out = [f"a0 AS (SELECT * FROM (VALUES {seeds}) v(i, nth))"]
    for d in range(WEB_DEPTH + 1):
        if d:
            known = " UNION ALL ".join(f"SELECT i FROM a{k}" for k in range(d))
            out.append(f"""a{d} AS (SELECT i, row_number() OVER (ORDER BY page, pos) - 1 AS nth FROM (SELECT t AS i, min((page, pos)).page AS page, min((page, pos)).pos AS pos FROM
            (SELECT nth AS page, unnest([2 * i, 2 * i + 1, 3 * i]) AS t, unnest([0, 1, 2]) AS pos FROM o{d - 1}) GROUP BY t) WHERE i % 5 IN ({hosts}) AND i NOT IN ({known}))""".replace(
                "min((page, pos)).page AS page, min((page, pos)).pos AS pos", "arg_min(page, page * 3 + pos) AS page, arg_min(pos, page * 3 + pos) AS pos"))
        out.append(f"f{d} AS (SELECT i, CASE WHEN i % 10 = 0 THEN i // 10 ELSE i END AS b, {d} AS depth, nth FROM a{d} WHERE i % 7 <> 3 AND i IN (SELECT p_partkey FROM part))")
        every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(d + 1))
        out.append(f"o{d} AS (SELECT i, nth FROM f{d} x WHERE NOT EXISTS (SELECT 1 FROM ({every}) y WHERE y.b = x.b AND y.i <> x.i AND (y.depth < {d} OR y.nth < x.nth)))")
    out.append("f AS (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(WEB_DEPTH + 1)) + ")")
    out.append("o AS (" + " UNION ALL ".join(f"SELECT i FROM o{k}" for k in range(WEB_DEPTH + 1)) + ")")
    out.append("a AS (" + " UNION ALL ".join(f"SELECT i FROM a{k}" for k in range(WEB_DEPTH + 1)) + ")")
    return ",\n".join(out)


_AT = "'http://h' || (i % 5) || '.test/' || CASE WHEN i % 7 = 3 THEN 'private/' ELSE 'p/' END || i"


@registered(f"""WITH {_web_sql()}, n AS (SELECT f.*, (SELECT min(y.i) FROM f y WHERE y.b = f.b AND y.i <> f.i AND f.i NOT IN (SELECT i FROM o)) AS j FROM f)
SELECT {_AT} AS url, depth, (SELECT {_AT} FROM (SELECT j AS i) z WHERE j IS NOT NULL) AS dup_of, CASE WHEN j IS NOT NULL THEN 'exact' END AS dup_kind FROM n""")
def q_crawl_pages(spark, d):
    return part_crawl(spark, d).pages.select("url", "depth", "dup_of", "dup_kind")


@registered(f"""WITH {_web_sql()} SELECT CASE WHEN i % 7 = 3 THEN 'robots_blocked' WHEN i NOT IN (SELECT p_partkey FROM part) THEN 'error' ELSE 'fetched' END AS outcome, count(*) AS n FROM a GROUP BY ALL""")
def q_crawl_outcomes(spark, d):
    return part_crawl(spark, d).fetches.groupBy("outcome").agg(F.count("*").alias("n"))
