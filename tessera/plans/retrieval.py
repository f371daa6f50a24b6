"""Retrieval queries: tokens, corpus statistics, BM25F, evidence, selection, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import corpus, evidence, selection, similarity
from tessera.plans.common import PROMPTS, query, read, sql_tokens


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "text")


def prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.explode_tokens(prompts(spark, sf_dir), F.col("text"), "prompt_id").distinct().withColumn("weight", F.lit(1.0))


@query("token_tf", f"SELECT doc_id, tok AS token, count(*) AS tf FROM {sql_tokens('documents', 'doc_id', 'text')} GROUP BY ALL")
def token_tf(spark, sf_dir):
    docs = T.explode_tokens(read(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return docs.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query("token_df", f"SELECT tok AS token, count(DISTINCT doc_id) AS df FROM {sql_tokens('documents', 'doc_id', 'text')} GROUP BY ALL")
def token_df(spark, sf_dir):
    return corpus.token_frequency(read(spark, sf_dir, "documents"), [F.col("text")], [])


@query(
    "field_stats",
    f"""WITH f AS (SELECT doc_id, 'summary' AS field, text AS t FROM documents UNION ALL SELECT doc_id, 'category', source FROM documents),
    n AS (SELECT field, doc_id, count(tok) AS n FROM (SELECT f.field, f.doc_id, k.tok FROM f LEFT JOIN {sql_tokens('f', 'field, doc_id', 't')} k ON k.field = f.field AND k.doc_id = f.doc_id) GROUP BY ALL)
    SELECT field, floor(greatest(avg(n), 1.0) * 1000000 + 0.5) / 1000000 AS average FROM n GROUP BY field""",
)
def field_stats(spark, sf_dir):
    rows = corpus.field_rows(read(spark, sf_dir, "documents"), {"summary": F.col("text"), "category": F.col("source")}, ["doc_id"])
    return corpus.field_lengths(rows, corpus.postings(rows, ["doc_id"]), []).select("field", S.rounded(F.col("average"), 6).alias("average"))


def _bm25_sql(fields: str, weights: dict[str, float], k: int) -> str:
    weight = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in weights.items()) + " END"
    return f"""WITH f AS ({fields}), k AS (SELECT * FROM {sql_tokens('f', 'item_id, field', 't')}),
    p AS (SELECT item_id, field, tok, count(*) AS tf FROM k GROUP BY ALL),
    l AS (SELECT f.item_id, f.field, count(k.tok) AS len FROM f LEFT JOIN k ON k.item_id = f.item_id AND k.field = f.field GROUP BY ALL),
    a AS (SELECT field, greatest(avg(len), 1.0) AS average FROM l GROUP BY field),
    w AS (SELECT p.item_id, p.tok, sum({weight.replace('field', 'p.field')} * tf / (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / average)) AS wtf
      FROM p JOIN l ON l.item_id = p.item_id AND l.field = p.field JOIN a ON a.field = p.field GROUP BY ALL),
    d AS (SELECT tok, count(DISTINCT item_id) AS df FROM k GROUP BY tok),
    q AS (SELECT DISTINCT prompt_id, tok FROM {sql_tokens(PROMPTS, 'prompt_id', 'text')}),
    s AS (SELECT prompt_id, item_id, floor(sum(ln(1 + ((SELECT count(DISTINCT item_id) FROM f) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (2.2::DOUBLE * wtf / (1.2::DOUBLE + wtf))) * 1000000 + 0.5) / 1000000 AS raw_score
      FROM q JOIN w USING (tok) JOIN d USING (tok) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY raw_score DESC, item_id) AS rank FROM s)
    SELECT * FROM r WHERE rank <= {k}"""


def _bm25_topk(spark, sf_dir, fields, weights, k):
    rows = corpus.field_rows(read(spark, sf_dir, "benchmark"), fields, ["item_id"])
    scored = corpus.bm25f(prompt_tokens(spark, sf_dir), rows, "item_id", weights).withColumn("raw_score", S.rounded(F.col("raw_score"), 6))
    return corpus.top_k(scored, ["prompt_id"], [F.desc("raw_score"), F.asc("item_id")], k)


@query("bm25f_topk", _bm25_sql("SELECT item_id, 'summary' AS field, text AS t FROM benchmark", {"summary": 1.5}, 4))
def bm25f_topk(spark, sf_dir):
    return _bm25_topk(spark, sf_dir, {"summary": F.col("text")}, {"summary": 1.5}, 4)


@query("bm25f_two_field", _bm25_sql("SELECT item_id, 'title' AS field, substr(text, 1, 40) AS t FROM benchmark UNION ALL SELECT item_id, 'summary', text FROM benchmark", {"title": 4.2, "summary": 1.5}, 4))
def bm25f_two_field(spark, sf_dir):
    return _bm25_topk(spark, sf_dir, {"title": F.substring("text", 1, 40), "summary": F.col("text")}, {"title": 4.2, "summary": 1.5}, 4)


_EIGHT = {"title": (1, 40), "triggers": (41, 60), "aliases": (101, 30), "topics": (1, 15), "intentModes": (131, 10), "requiredSignals": (141, 20), "category": (16, 12), "summary": (1, 10000)}


@query("bm25f_eight_field", _bm25_sql(" UNION ALL ".join(f"SELECT item_id, '{f}' AS field, substr(text, {a}, {n}) AS t FROM benchmark" for f, (a, n) in _EIGHT.items()), corpus.FIELD_WEIGHTS, 4))
def bm25f_eight_field(spark, sf_dir):
    return _bm25_topk(spark, sf_dir, {f: F.substring("text", a, n) for f, (a, n) in _EIGHT.items()}, corpus.FIELD_WEIGHTS, 4)


@query("code_token_split", f"SELECT page_id, tok AS token, count(*) AS n FROM {sql_tokens('pages', 'page_id', 'url')} GROUP BY ALL")
def code_token_split(spark, sf_dir):
    return T.explode_tokens(read(spark, sf_dir, "pages"), F.col("url"), "page_id").groupBy("page_id", "token").agg(F.count("*").alias("n"))


@query(
    "lang_detect",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM documents""",
)
def lang_detect(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.language_class(F.col("text")).alias("language"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Prompts and benchmark cards that share a token, with the prompt's text and tokens and the card's tokens and phrases."""
    cards = read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("card_tokens"), T.phrase_tokens(F.col("text")).alias("card_phrases"))
    held = cards.select("item_id", F.explode("card_tokens").alias("token"))
    said = prompts(spark, sf_dir).select("prompt_id", T.normalize(F.col("text")).alias("query_text"), T.tokens(F.col("text")).alias("query_tokens"))
    ids = prompt_tokens(spark, sf_dir).join(held, "token").select("prompt_id", "item_id").distinct()
    return ids.join(said, "prompt_id").join(cards, "item_id")


@query(
    "phrase_coverage",
    f"""WITH q AS (SELECT DISTINCT prompt_id, tok FROM {sql_tokens(PROMPTS, 'prompt_id', 'text')}), c AS (SELECT DISTINCT item_id, tok FROM {sql_tokens('benchmark', 'item_id', 'text')}),
    n AS (SELECT item_id, count(*) AS n FROM c GROUP BY 1)
    SELECT prompt_id, item_id, count(*) AS hits, floor(count(*)::DOUBLE / max(n) * 10000 + 0.5) / 10000 AS coverage FROM q JOIN c USING (tok) JOIN n USING (item_id) GROUP BY ALL""",
)
def phrase_coverage(spark, sf_dir):
    own = F.col("card_tokens")
    hits = F.size(F.array_intersect(own, "query_tokens"))
    return _pairs(spark, sf_dir).select("prompt_id", "item_id", hits.cast("long").alias("hits"), S.rounded(hits / F.size(own), 4).alias("coverage"))


@query(
    "lexical_support",
    f"""WITH q AS (SELECT DISTINCT prompt_id, tok FROM {sql_tokens(PROMPTS, 'prompt_id', 'text')}), c AS (SELECT DISTINCT item_id, tok FROM {sql_tokens('benchmark', 'item_id', 'text')})
    SELECT prompt_id, item_id, CASE WHEN count(*) >= 2 THEN least(18.0::DOUBLE, 6 + 2.5::DOUBLE * count(*)) ELSE 0.0::DOUBLE END AS value FROM q JOIN c USING (tok) GROUP BY ALL""",
)
def lexical_support(spark, sf_dir):
    return _pairs(spark, sf_dir).select("prompt_id", "item_id", evidence.lexical_support(F.col("card_tokens"), F.col("query_tokens")).alias("value"))


@query(
    "field_evidence",
    f"""WITH q AS (SELECT DISTINCT prompt_id, tok FROM {sql_tokens(PROMPTS, 'prompt_id', 'text')}), qn AS (SELECT prompt_id, count(*) AS qn FROM q GROUP BY 1),
    nq AS (SELECT prompt_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS query_text FROM {PROMPTS}),
    p0 AS (SELECT item_id, lower(trim(u.phrase)) AS phrase, u.i FROM (SELECT item_id, unnest(list_zip(regexp_split_to_array(text, '[\\n,，;；|]'), range(1000))) AS z FROM benchmark) b, LATERAL (SELECT z[1] AS phrase, z[2] AS i) u WHERE z[1] IS NOT NULL),
    p AS (SELECT item_id, phrase, min(i) AS i FROM p0 WHERE phrase <> '' GROUP BY ALL),
    pt AS (SELECT DISTINCT item_id, i, tok FROM {sql_tokens('p', 'item_id, i', 'phrase')}), pn AS (SELECT item_id, i, count(*) AS n FROM pt GROUP BY ALL),
    both_ids AS (SELECT DISTINCT prompt_id, item_id FROM q JOIN pt USING (tok)),
    h AS (SELECT prompt_id, item_id, i, count(*) AS hits FROM q JOIN pt USING (tok) GROUP BY ALL),
    v AS (SELECT b.prompt_id, b.item_id, p.i, pn.n, qn.qn, coalesce(h.hits, 0) AS hits, coalesce(h.hits, 0)::DOUBLE / pn.n AS cov,
      CASE WHEN regexp_matches(p.phrase, '^[a-z0-9][a-z0-9._/-]*$') THEN EXISTS (SELECT 1 FROM q WHERE q.prompt_id = b.prompt_id AND q.tok = p.phrase)
        ELSE contains(' ' || regexp_replace(nq.query_text, '[^a-z0-9]', ' ', 'g') || ' ', ' ' || p.phrase || ' ') AND NOT regexp_matches(p.phrase, '[^a-z0-9 ]') OR
          (regexp_matches(p.phrase, '[^a-z0-9 ]') AND regexp_matches(nq.query_text, '(^|[^a-z0-9])' || regexp_replace(p.phrase, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g') || '($|[^a-z0-9])')) END AS exact
      FROM both_ids b JOIN p USING (item_id) JOIN pn ON pn.item_id = p.item_id AND pn.i = p.i JOIN qn ON qn.prompt_id = b.prompt_id JOIN nq ON nq.prompt_id = b.prompt_id LEFT JOIN h ON h.prompt_id = b.prompt_id AND h.item_id = p.item_id AND h.i = p.i),
    e AS (SELECT *, CASE WHEN exact AND n >= 2 THEN 48.0::DOUBLE + least(10.0::DOUBLE, 2.0::DOUBLE * n) WHEN exact AND qn <= 2 THEN 44.0::DOUBLE WHEN exact THEN 24.0::DOUBLE
      WHEN hits >= 2 AND cov >= 0.5 THEN 52.0::DOUBLE * cov WHEN hits = 1 AND n = 2 THEN 52.0::DOUBLE * 0.28::DOUBLE ELSE 0.0::DOUBLE END AS value,
      (exact AND n >= 2) OR (exact AND n < 2 AND qn <= 2) OR (hits >= 2 AND cov >= 0.58) AS strong FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, item_id ORDER BY value DESC, i) AS k FROM e WHERE value > 0)
    SELECT prompt_id, item_id, floor(least(62.0::DOUBLE, sum(CASE WHEN k = 1 THEN value WHEN k <= 3 THEN value * 0.22::DOUBLE ELSE 0 END)) * 100 + 0.5) / 100 AS value, bool_or(k = 1 AND strong) AS strong FROM r GROUP BY ALL""",
)
def field_evidence(spark, sf_dir):
    found = evidence.field_evidence("triggers", F.col("card_phrases"), F.col("query_text"), F.col("query_tokens"))
    rows = _pairs(spark, sf_dir).select("prompt_id", "item_id", found.alias("e")).where("e.value > 0")
    return rows.select("prompt_id", "item_id", "e.value", "e.strong")


@query("noisy_or", "SELECT event_id, floor(100 * (1 - (1 - least(greatest(value, 0.0::DOUBLE), 100.0::DOUBLE) / 100) * (1 - least(greatest(value / 2 - 10, 0.0::DOUBLE), 100.0::DOUBLE) / 100)) * 100 + 0.5) / 100 AS score FROM events WHERE value IS NOT NULL")
def noisy_or(spark, sf_dir):
    return read(spark, sf_dir, "events").where("value is not null").select("event_id", S.rounded(S.noisy_or(F.array("value", F.col("value") / 2 - 10))).alias("score"))


@query(
    "rrf_fusion",
    """SELECT p_partkey, floor((1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2)) * 1000 * 100 + 0.5) / 100 AS rank_score FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r1,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r2 FROM part)""",
)
def rrf_fusion(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumnRenamed("p_retailprice", "raw_score").withColumnRenamed("p_size", "score")
    return selection.fuse(rows, ["p_brand"], "p_partkey").select("p_partkey", "rank_score")


@query(
    "diversity_penalty",
    """SELECT p_partkey, CASE WHEN n = 0 THEN p_retailprice ELSE floor(p_retailprice * greatest(0.72::DOUBLE, 1 - 0.12::DOUBLE * n) * 100 + 0.5) / 100 END AS rank_score, n AS repeat
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) - 1 AS n FROM part)""",
)
def diversity_penalty(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("rank_score", F.col("p_retailprice"))
    out = selection.diversify(rows, ["p_brand"], "p_type", [F.desc("rank_score"), F.asc("p_partkey")])
    return out.select("p_partkey", "rank_score", F.col("repeat").cast("long").alias("repeat"))


_CANDIDATES = "SELECT s_suppkey, s_nationkey, 40 + (s_acctbal + 1000) / 200 AS score, s_suppkey % 7 = 0 AS strong FROM supplier"


@query(
    "dynamic_topk",
    f"""WITH c AS ({_CANDIDATES}), q AS (SELECT *, row_number() OVER w = 1 OR strong OR score >= greatest(40.0::DOUBLE, first_value(score) OVER w - 18) AS fits FROM c WHERE score >= 40 WINDOW w AS (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey)),
    b AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM q)
    SELECT s_suppkey, n < 4 AND fits AS selected, CASE WHEN n >= 4 THEN 'post-selection:limit' WHEN NOT fits THEN 'post-selection:confidence-gap' END AS reason FROM b""",
)
def dynamic_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (40 + (F.col("s_acctbal") + 1000) / 200).alias("score"), (F.col("s_suppkey") % 7 == 0).alias("strong_anchor"), F.lit(0).alias("repeat"))
    out = selection.select_dynamic(rows.where("score >= 40"), ["s_nationkey"], [F.desc("score"), F.asc("s_suppkey")])
    return out.select("s_suppkey", "selected", "reason")


@query(
    "admission_reason",
    """SELECT c_custkey, CASE WHEN s < 40 THEN 'below-threshold:' || s || '<40.0' WHEN NOT strong AND fam < 2 THEN 'insufficient-independent-evidence' END AS reason
    FROM (SELECT c_custkey, floor((c_acctbal + 1000) / 110 * 10 + 0.5) / 10 AS s, c_mktsegment = 'BUILDING' AS strong, c_nationkey % 3 AS fam FROM customer)""",
)
def admission_reason(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    reason = selection.admission_reason(S.rounded((F.col("c_acctbal") + 1000) / 110, 1), F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 3, F.lit(40.0))
    return c.select("c_custkey", reason.alias("reason"))


_SETS = f"(SELECT item_id, list(DISTINCT tok) AS s FROM {sql_tokens('benchmark', 'item_id', 'text')} GROUP BY 1)"


def _token_sets(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("tokens"))


@query(
    "jaccard_pairs",
    f"""SELECT a.item_id AS a, b.item_id AS b, floor(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 10000 + 0.5) / 10000 AS jaccard,
    floor(len(list_intersect(a.s, b.s))::DOUBLE / least(len(a.s), len(b.s)) * 10000 + 0.5) / 10000 AS overlap FROM {_SETS} a JOIN {_SETS} b ON a.item_id < b.item_id WHERE len(list_intersect(a.s, b.s)) > 0""",
)
def jaccard_pairs(spark, sf_dir):
    out = similarity.set_pairs(_token_sets(spark, sf_dir), "item_id", "tokens")
    return out.select("a", "b", S.rounded(F.col("jaccard"), 4).alias("jaccard"), S.rounded(F.col("overlap"), 4).alias("overlap"))


@query(
    "near_duplicate_topk",
    f"""WITH p AS (SELECT a.item_id AS a, b.item_id AS b, floor(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 10000 + 0.5) / 100 AS score FROM {_SETS} a JOIN {_SETS} b ON a.item_id <> b.item_id)
    SELECT a, b, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM p WHERE score >= 5) WHERE rank <= 3""",
)
def near_duplicate_topk(spark, sf_dir):
    pairs = similarity.set_pairs(_token_sets(spark, sf_dir), "item_id", "tokens").select("a", "b", (S.rounded(F.col("jaccard"), 4) * 100).alias("score"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).withColumn("score", S.rounded(F.col("score")))
    return corpus.top_k(both.where("score >= 5"), ["a"], [F.desc("score"), F.asc("b")], 3)


@query(
    "max_weight_token",
    f"""SELECT conv_id, tok AS token, max(CASE role WHEN 'user' THEN 1.15::DOUBLE WHEN 'assistant' THEN 0.8::DOUBLE ELSE 0.35::DOUBLE END) AS weight FROM {sql_tokens('conversations', 'conv_id, role', 'text')} GROUP BY ALL""",
)
def max_weight_token(spark, sf_dir):
    weight = F.when(F.col("role") == "user", 1.15).when(F.col("role") == "assistant", 0.8).otherwise(0.35)
    rows = read(spark, sf_dir, "conversations").select("conv_id", weight.alias("weight"), "text")
    return T.explode_tokens(rows, F.col("text"), "conv_id", "weight").groupBy("conv_id", "token").agg(F.max("weight").alias("weight"))


@query(
    "head_tail",
    """WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(CASE WHEN len(w) <= 9 THEN w ELSE list_concat(w[1:5], w[len(w) - 3:len(w)]) END, ' ') AS kept FROM w""",
)
def head_tail(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.head_tail(words, 9), " ").alias("kept"))


@query(
    "prompt_segments",
    """SELECT conv_id, turn, len(s) AS n, array_to_string(list_sort(s), '|') AS segments FROM (SELECT conv_id, turn, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[\n。.!?？；;]'), lambda x: trim(x)), lambda x: length(x) > 8)) AS s FROM conversations)""",
)
def prompt_segments(spark, sf_dir):
    s = T.segments(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.array_join(F.sort_array(s), "|").alias("segments"))


@query(
    "prompt_summary",
    r"""SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '```[\s\S]*?```', ' ', 'g'), '\bat\s+[\w.$/:-]+\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')), 1, 700) AS summary FROM conversations""",
)
def prompt_summary(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.summarize(F.col("text")).alias("summary"))


@query(
    "budget_prefix",
    """SELECT source, doc_id, used AS used_chars FROM (SELECT source, doc_id, sum(length(text)) OVER w + 2 * (count(*) OVER w - 1) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE used <= 6000""",
)
def budget_prefix(spark, sf_dir):
    return selection.budget_prefix(read(spark, sf_dir, "documents"), ["source"], [F.asc("doc_id")], "text", 6000).select("source", "doc_id", "used_chars")


@query("slugs", "SELECT item_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9一-龥]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM benchmark")
def slugs(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.slugify(F.col("text")).alias("slug"))


@query("greedy_collapse")
def greedy_collapse(spark, sf_dir):
    """Near-duplicate benchmark cards among the best ten of each prompt fold into their first."""
    best = _bm25_topk(spark, sf_dir, {"summary": F.col("text")}, {"summary": 1.5}, 10).select("prompt_id", F.col("item_id").cast("string").alias("card_key"), F.col("item_id").alias("card_id"), F.col("raw_score").alias("score"), F.lit(1).alias("library_priority"), "rank")
    similar = similarity.set_pairs(_token_sets(spark, sf_dir), "item_id", "tokens", 0.2)
    return selection.collapse(best, similar, ["rank"])


@query(
    "jaccard_pairs_pruned",
    f"""SELECT a, b, shared, floor(j * 10000 + 0.5) / 10000 AS jaccard FROM (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s)) AS shared, len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j
    FROM {_SETS} a JOIN {_SETS} b ON a.item_id < b.item_id) WHERE j >= 0.12""",
)
def jaccard_pairs_pruned(spark, sf_dir):
    return similarity.set_pairs(_token_sets(spark, sf_dir), "item_id", "tokens", 0.12).select("a", "b", "shared", S.rounded(F.col("jaccard"), 4).alias("jaccard"))


@query("recall_selection")
def recall_selection(spark, sf_dir):
    """Admission, rank fusion, diversity and dynamic selection over the benchmark cards of each prompt."""
    raw = corpus.bm25f(prompt_tokens(spark, sf_dir), corpus.field_rows(read(spark, sf_dir, "benchmark"), {"summary": F.col("text")}, ["item_id"]), "item_id", {"summary": 1.5})
    found = evidence.field_evidence("triggers", F.col("card_phrases"), F.col("query_text"), F.col("query_tokens"))
    rows = _pairs(spark, sf_dir).select("prompt_id", "item_id", found.alias("e"), evidence.lexical_support(F.col("card_tokens"), F.col("query_tokens")).alias("lexical"))
    score = evidence.evidence_score(F.array("e.value", "lexical"), F.lit(0.0))
    families = (F.col("e.value") >= 8).cast("int") + (F.col("lexical") >= 8).cast("int")
    scored = rows.join(raw, ["prompt_id", "item_id"]).select("prompt_id", "item_id", score.alias("score"), S.rounded(F.col("raw_score")).alias("raw_score"), families.alias("families"), (F.col("e.strong") & (F.col("e.value") >= 36)).alias("strong_anchor"), F.lit(0).alias("priority_score"))
    admitted = scored.where(selection.admission_reason(F.col("score"), F.col("strong_anchor"), F.col("families"), F.lit(20.0)).isNull())
    order = selection.comparator("item_id")
    fused = selection.diversify(selection.fuse(admitted, ["prompt_id"], "item_id").withColumn("topic", F.col("item_id") % 5), ["prompt_id"], "topic", order)
    return selection.select_dynamic(fused, ["prompt_id"], order, threshold=20.0).select("prompt_id", "item_id", "score", "raw_score", "rank_score", "selected", "reason")
