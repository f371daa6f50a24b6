"""Evaluation, telemetry, message and curation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import curation, evaluation, evidence, gates, messages, selection, telemetry
from tessera.operators.corpus import top_k
from tessera.plans.common import query, read
from tessera.tables import dealt

# ---------------------------------------------------------------- evaluation

_RANKED = "SELECT source AS case_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents"
_WANTED = "SELECT source AS case_id, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars > 4000"
_CASES = f"""
  r AS (SELECT * FROM ({_RANKED}) WHERE rank <= 10), w AS ({_WANTED}), c AS (SELECT DISTINCT source AS case_id FROM documents),
  n AS (SELECT case_id, count(*) AS wanted FROM w GROUP BY 1),
  t AS (SELECT r.case_id, count(*) AS returned, count(w.id) AS hits, min(CASE WHEN w.id IS NOT NULL THEN rank END) AS first, sum(CASE WHEN w.id IS NOT NULL THEN 1 ELSE 0 END / log2(rank + 1)) AS dcg FROM r LEFT JOIN w USING (case_id, id) GROUP BY 1),
  x AS (SELECT c.case_id, coalesce(wanted, 0) AS wanted, coalesce(returned, 0) AS returned, coalesce(hits, 0) AS hits, first, coalesce(dcg, 0) AS dcg FROM c LEFT JOIN n USING (case_id) LEFT JOIN t USING (case_id)),
  m AS (SELECT case_id, returned, hits, wanted,
    floor((CASE WHEN returned > 0 THEN hits::DOUBLE / returned WHEN wanted = 0 THEN 1 ELSE 0 END) * 1000 + 0.5) / 1000 AS precision,
    floor((CASE WHEN wanted = 0 THEN CASE WHEN returned > 0 THEN 0 ELSE 1 END ELSE hits::DOUBLE / wanted END) * 1000 + 0.5) / 1000 AS recall,
    floor(coalesce(1.0::DOUBLE / first, 0) * 1000 + 0.5) / 1000 AS reciprocal_rank,
    floor((CASE WHEN wanted = 0 THEN CASE WHEN returned > 0 THEN 0 ELSE 1 END ELSE dcg / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda k: 1 / log2(k + 1))) END) * 1000 + 0.5) / 1000 AS ndcg,
    CASE WHEN wanted = 0 THEN returned = 0 ELSE hits = wanted AND returned = hits END AS passed FROM x)"""


def _cases(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = top_k(docs, ["case_id"], [F.desc("n_chars"), F.asc("id")], 10).select("case_id", "id", "rank")
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    wanted = docs.where("n_chars > 4000").join(good, "id").groupBy("case_id").agg(F.collect_list("id").alias("ids"))
    expected = docs.select("case_id").distinct().join(wanted, "case_id", "left").select("case_id", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
    return evaluation.case_metrics(expected, ranked, 10).withColumn("wanted", F.col("wanted").cast("long"))


@query("case_metrics", f"WITH {_CASES} SELECT * FROM m")
def case_metrics(spark, sf_dir):
    return _cases(spark, sf_dir)


@query(
    "metrics_by_group",
    f"""WITH {_CASES}, g AS (SELECT *, CASE WHEN wanted >= 3 THEN 'hard' WHEN wanted > 0 THEN 'medium' ELSE 'easy' END AS difficulty FROM m)
    SELECT difficulty, count(*) AS cases, floor(avg(passed::INT) * 1000 + 0.5) / 1000 AS pass_rate, floor(avg(precision) * 1000 + 0.5) / 1000 AS precision, floor(avg(recall) * 1000 + 0.5) / 1000 AS recall,
    floor(coalesce(avg(CASE WHEN wanted > 0 THEN reciprocal_rank END), 0) * 1000 + 0.5) / 1000 AS mrr, floor(coalesce(avg(CASE WHEN wanted > 0 THEN ndcg END), 0) * 1000 + 0.5) / 1000 AS ndcg,
    floor(avg((returned = 0)::INT) * 1000 + 0.5) / 1000 AS no_hit_rate FROM g GROUP BY 1""",
)
def metrics_by_group(spark, sf_dir):
    difficulty = F.when(F.col("wanted") >= 3, "hard").when(F.col("wanted") > 0, "medium").otherwise("easy")
    return evaluation.roll_up(_cases(spark, sf_dir).withColumn("difficulty", difficulty), "difficulty")


_BOUNDS = {"min-pass-rate": 0.2, "min-precision": 0.3, "min-mrr": 0.5, "max-no-hit": 0.0, "max-over-recall": 0.1}
_REPORT = f"""{_CASES}, g AS (SELECT *, CASE WHEN wanted >= 3 THEN 'hard' WHEN wanted > 0 THEN 'medium' ELSE 'easy' END AS difficulty FROM m),
    rep AS (SELECT difficulty, floor(avg(passed::INT) * 1000 + 0.5) / 1000 AS pass_rate, floor(avg(precision) * 1000 + 0.5) / 1000 AS precision, floor(coalesce(avg(CASE WHEN wanted > 0 THEN reciprocal_rank END), 0) * 1000 + 0.5) / 1000 AS mrr,
    floor(avg((returned = 0)::INT) * 1000 + 0.5) / 1000 AS no_hit_rate, 0.0::DOUBLE AS over_recall_rate FROM g GROUP BY 1)"""


@query(
    "threshold_gates",
    f"WITH {_REPORT} "
    + " UNION ALL ".join(f"SELECT difficulty, '{flag}' AS flag, {v}::DOUBLE AS expected, {evaluation.BOUNDS[flag][0]} AS actual, {evaluation.BOUNDS[flag][0]} {'>=' if evaluation.BOUNDS[flag][1] == 'min' else '<='} {v} AS passed FROM rep" for flag, v in _BOUNDS.items()),
)
def threshold_gates(spark, sf_dir):
    return evaluation.threshold_gates(metrics_by_group(spark, sf_dir), _BOUNDS, "difficulty")


@query(
    "report_compare",
    """WITH b AS (SELECT doc_id, quality::DOUBLE AS m FROM labels), n AS (SELECT CASE WHEN quality = 0 AND toxic = 1 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, toxic::DOUBLE AS m FROM labels)
    SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'added' WHEN n.m < b.m THEN 'regressed' ELSE 'kept' END AS state,
    floor((n.m - b.m) * 1000 + 0.5) / 1000 AS m_delta FROM b FULL JOIN n ON b.doc_id = n.doc_id""",
)
def report_compare(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    base = labels.select("doc_id", F.col("quality").cast("double").alias("m"))
    moved = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.col("doc_id") + 1000000).otherwise(F.col("doc_id"))
    return evaluation.compare(base, labels.select(moved.alias("doc_id"), F.col("toxic").cast("double").alias("m")), "doc_id", ["m"])


@query(
    "report_identity",
    """WITH f AS (SELECT unnest(['suite', 'engine_version', 'scorer_version', 'suite_fingerprint', 'card_set_fingerprint', 'config_fingerprint', 'limit', 'threshold']) AS field),
    v AS (SELECT field, CASE field WHEN 'suite' THEN (SELECT min(r_name) FROM region) WHEN 'engine_version' THEN '2' WHEN 'limit' THEN '4' WHEN 'threshold' THEN '40' WHEN 'suite_fingerprint' THEN (SELECT max(n_name) FROM nation) END AS before,
      CASE field WHEN 'suite' THEN (SELECT min(r_name) FROM region) WHEN 'engine_version' THEN '2' WHEN 'limit' THEN '5' WHEN 'threshold' THEN '40' WHEN 'suite_fingerprint' THEN (SELECT max(n_name) FROM nation) WHEN 'scorer_version' THEN '1' END AS after FROM f)
    SELECT field, CASE WHEN before IS NULL OR after IS NULL THEN 'missing' ELSE 'drift' END AS issue, before, after FROM v WHERE before IS NULL OR after IS NULL OR before <> after""",
)
def report_identity(spark, sf_dir):
    suite, last = read(spark, sf_dir, "region").agg(F.min("r_name").alias("suite")), read(spark, sf_dir, "nation").agg(F.max("n_name").alias("suite_fingerprint"))
    one = suite.withColumn("k", F.lit(1)).join(last.withColumn("k", F.lit(1)), "k").withColumn("engine_version", F.lit("2"))
    base = one.select("suite", "suite_fingerprint", "engine_version", F.lit(4).alias("limit"), F.lit(40).alias("threshold"), F.lit(" ").alias("scorer_version"))
    return evaluation.comparable_reports(base, base.withColumn("limit", F.lit(5)).withColumn("scorer_version", F.lit("1")))


# ---------------------------------------------------------------- telemetry

_SELECTED = "CASE WHEN event_type IN ('click', 'purchase') THEN [event_id % 40] WHEN event_type = 'view' THEN [event_id % 40, user_id % 40] ELSE [] END"
_SHOWN = "CASE WHEN event_type = 'error' THEN [event_id % 40] WHEN value > 50 THEN [event_id % 40] ELSE [] END"


def _hook_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    card, other, none = F.col("event_id") % 40, F.col("user_id") % 40, F.array().cast("array<bigint>")
    selected = F.when(F.col("event_type").isin("click", "purchase"), F.array(card)).when(F.col("event_type") == "view", F.array(card, other)).otherwise(none)
    rendered = F.when(F.col("event_type") == "error", F.array(card)).when(F.col("value") > 50, F.array(card)).otherwise(none)
    return e.select("user_id", "event_id", "event_type", selected.alias("selected"), rendered.alias("rendered"))


@query(
    "event_rates",
    f"""WITH e AS (SELECT user_id, {_SELECTED} AS s, {_SHOWN} AS r FROM events)
    SELECT user_id, count(*) AS events, count_if(len(s) > 0) AS matched, count_if(len(list_intersect(s, r)) > 0) AS rendered_events, count_if(len(s) > 0)::DOUBLE / count(*) AS match_rate,
    count_if(len(list_intersect(s, r)) > 0)::DOUBLE / count(*) AS render_rate, (count(*) - count_if(len(s) > 0))::DOUBLE / count(*) AS no_hit_rate FROM e GROUP BY 1""",
)
def event_rates(spark, sf_dir):
    return telemetry.rates(_hook_events(spark, sf_dir), "selected", "rendered", "user_id")


@query(
    "card_counts",
    f"""WITH e AS (SELECT {_SELECTED} AS s, {_SHOWN} AS r FROM events), a AS (SELECT card_id, count(*) AS recalled FROM (SELECT unnest(s) AS card_id FROM e) GROUP BY 1),
    b AS (SELECT card_id, count(*) AS rendered FROM (SELECT unnest(list_intersect(s, r)) AS card_id FROM e) GROUP BY 1)
    SELECT item_id AS card_id, coalesce(recalled, 0) AS recalled, coalesce(rendered, 0) AS rendered FROM benchmark LEFT JOIN a ON a.card_id = item_id LEFT JOIN b ON b.card_id = item_id""",
)
def card_counts(spark, sf_dir):
    return telemetry.card_counts(_hook_events(spark, sf_dir), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("card_id")))


@query("stale_ids", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def stale_ids(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return telemetry.stale(read(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")


@query("latest_decision", "SELECT user_id, arg_max(event_type, event_id) AS action, max(event_id) AS line FROM events GROUP BY 1")
def latest_decision(spark, sf_dir):
    return telemetry.latest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")]).select("user_id", F.col("event_type").alias("action"), F.col("event_id").alias("line"))


_ACTION = "CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'merge' WHEN 'error' THEN 'reject' ELSE 'defer' END"


@query(
    "curation_preview",
    f"""WITH d AS (SELECT user_id, arg_max({_ACTION}, event_id) AS action FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT c_custkey, action, coalesce(CASE action WHEN 'accept' THEN 'applied' WHEN 'merge' THEN 'merged' WHEN 'reject' THEN 'rejected' WHEN 'defer' THEN 'deferred' END, 'undecided') AS state FROM customer LEFT JOIN d ON c_custkey = user_id""",
)
def curation_preview(spark, sf_dir):
    found = curation.preview(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id")), _decisions(spark, sf_dir), [F.desc("line")])
    return found.select(F.col("candidate_id").alias("c_custkey"), "action", "state")


def _decisions(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type <> 'view'")
    return e.select(F.col("user_id").alias("candidate_id"), F.expr(_ACTION).alias("action"), F.lit(None).cast("string").alias("rewrite"), F.when(F.col("value") > 50, F.col("user_id") % 40).alias("target_card_id"), F.col("event_id").alias("line"))


@query(
    "apply_plan",
    f"""WITH d AS (SELECT user_id, {_ACTION} AS action, CASE WHEN value > 50 THEN user_id % 40 END AS target, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'view'),
    r AS (SELECT c_custkey, action, target, c_acctbal < 0 AS done, target IN (SELECT item_id FROM benchmark WHERE item_id > 10) AS known FROM customer LEFT JOIN d ON c_custkey = user_id AND n = 1)
    SELECT c_custkey, coalesce(target, -1) AS target, CASE WHEN done THEN 'skipped' WHEN action IS NULL OR action = 'reject' THEN 'skipped' WHEN action = 'merge' AND (target IS NULL OR NOT known) THEN 'error' WHEN action = 'merge' THEN 'merge' ELSE 'draft' END AS outcome,
    CASE WHEN done THEN 'already applied' WHEN action IS NULL THEN 'no decision' WHEN action = 'reject' THEN 'rejected' WHEN action = 'merge' AND target IS NULL THEN 'merge without target' WHEN action = 'merge' AND NOT known THEN 'merge target not found' END AS why FROM r""",
)
def apply_plan(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), "c_acctbal")
    cards = read(spark, sf_dir, "benchmark").where("item_id > 10").select(F.col("item_id").alias("card_id"), F.lit("active").alias("status"))
    found = curation.apply_plan(c, _decisions(spark, sf_dir), c.where("c_acctbal < 0"), cards, [F.desc("line")])
    return found.select(F.col("candidate_id").alias("c_custkey"), F.coalesce("target_card_id", F.lit(-1)).alias("target"), "outcome", "why")


_LINE = "p_name || chr(31) || p_size || chr(31) || p_type"


@query(
    "set_fingerprint",
    f"""WITH h AS (SELECT h, h || CASE WHEN count(*) > 1 THEN ':' || count(*) ELSE '' END AS t FROM (SELECT sha256({_LINE}) AS h FROM part) GROUP BY 1),
    f AS (SELECT substr(h, 1, 6) AS part, sha256(string_agg(t, '' ORDER BY h)) AS h FROM h GROUP BY 1), g AS (SELECT substr(part, 1, 3) AS part, sha256(string_agg(part || h, '' ORDER BY part)) AS h FROM f GROUP BY 1)
    SELECT sha256(string_agg(part || h, '' ORDER BY part)) AS fingerprint FROM g""",
)
def set_fingerprint(spark, sf_dir):
    return telemetry.fingerprint(read(spark, sf_dir, "part"), "p_type", "p_name", "p_size")


@query(
    "stats_report",
    f"""WITH e AS (SELECT event_id, event_type, {_SELECTED} AS s, {_SHOWN} AS r FROM events), k AS (SELECT list(item_id) AS ids FROM benchmark), c AS (SELECT event_id, list_filter(s, lambda x: list_contains(ids, x)) AS s, r FROM e, k WHERE event_type = 'click'),
    idle AS (SELECT coalesce(list_sort(list(item_id::VARCHAR)), []) AS ids FROM benchmark WHERE item_id NOT IN (SELECT unnest(s) FROM c)),
    v AS (SELECT 'current' AS view, * FROM c UNION ALL SELECT 'cumulative', event_id, s, r FROM e)
    SELECT view, count(*) AS events, count_if(len(s) > 0) AS matched, count_if(len(list_intersect(s, r)) > 0) AS rendered_events, count_if(len(s) > 0)::DOUBLE / count(*) AS match_rate, count_if(len(list_intersect(s, r)) > 0)::DOUBLE / count(*) AS render_rate,
    (count(*) - count_if(len(s) > 0))::DOUBLE / count(*) AS no_hit_rate, CASE WHEN view = 'current' THEN (SELECT count_if(event_type <> 'click') FROM e) END AS excluded, CASE WHEN view = 'current' THEN (SELECT array_to_string(ids, ',') FROM idle) ELSE '' END AS stale,
    CASE WHEN view = 'current' AND (SELECT len(ids) FROM idle) > 0 THEN 'review stale cards: ' || (SELECT array_to_string(ids, ', ') FROM idle) ELSE '' END AS actions FROM v GROUP BY view""",
)
def stats_report(spark, sf_dir):
    cards = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("card_id"))
    out = telemetry.stats_report(_hook_events(spark, sf_dir), cards, {"event_type": F.lit("click")})
    return out.withColumns({"stale": F.array_join("stale", ","), "actions": F.array_join("actions", "|")})


@query("source_state", "SELECT source, count(*) AS rows, count_if(lang = 'en') AS english, sum(strlen(text)) AS bytes, max(strlen(text)) AS largest FROM documents GROUP BY 1")
def source_state(spark, sf_dir):
    return telemetry.source_state(read(spark, sf_dir, "documents"), ["source"], "text", {"english": F.col("lang") == "en"})


# ---------------------------------------------------------------- messages


@query(
    "message_search",
    """WITH m AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'),
    s AS (SELECT conv_id, turn, CASE WHEN contains(t, 'the ing') THEN 107 WHEN contains(t, 'the') AND contains(t, 'ing') THEN 16 ELSE 0 END AS score FROM m)
    SELECT * FROM s WHERE score > 0 ORDER BY score DESC, conv_id, turn LIMIT 25""",
)
def message_search(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'user'")
    return messages.search(said, "the ing", [F.asc("conv_id"), F.asc("turn")], 25).select("conv_id", "turn", "score")


@query(
    "context_window",
    """SELECT m.conv_id, m.turn, h.turn AS hit, m.role FROM conversations m JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'tion')) h ON m.conv_id = h.conv_id AND m.turn BETWEEN h.turn - 2 AND h.turn + 2""",
)
def context_window(spark, sf_dir):
    m = read(spark, sf_dir, "conversations")
    hits = m.where((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("tion")))
    return messages.context(m, hits, "conv_id", "turn", 2).select("conv_id", "turn", "hit", "role")


@query(
    "session_hash",
    """WITH h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, sha256(role || chr(0) || text || chr(10)) AS h FROM conversations), b AS (SELECT conv_id, (place - 1) // 1024 AS block, sha256(string_agg(h, '' ORDER BY place)) AS h FROM h GROUP BY ALL)
    SELECT conv_id, sha256(string_agg(h, '' ORDER BY block)) AS hash FROM b GROUP BY 1""",
)
def session_hash(spark, sf_dir):
    return messages.session_hash(read(spark, sf_dir, "conversations"), "conv_id", ["turn"])


@query("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("carried", F.when(F.col("event_type") == "purchase", F.col("value")))
    return messages.carry_forward(e, "carried", ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "carried")


@query("dead_letter_json", "SELECT event_id, json_valid(props) AS ok, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT) AS k FROM events")
def dead_letter_json(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    parsed = F.try_parse_json("props")
    return e.select("event_id", F.coalesce(parsed.isNotNull(), F.lit(False)).alias("ok"), F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query(
    "user_message_index",
    """SELECT conv_id, turn, substr(sha1(conv_id || ':' || turn), 1, 16) AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE role = 'user' AND trim(text) <> ''""",
)
def user_message_index(spark, sf_dir):
    m = read(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''")
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return m.select("conv_id", "turn", F.substring(F.sha1(key), 1, 16).alias("id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query("snippets", "SELECT conv_id, turn, substr(text, greatest(strpos(lower(text), 'tion') - 80, 1), least(strpos(lower(text), 'tion'), 81) - 1 + 120) AS snippet FROM conversations WHERE contains(lower(text), 'tion')")
def snippets(spark, sf_dir):
    m = read(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("tion")))
    return m.select("conv_id", "turn", messages.snippet(F.col("text"), "tion").alias("snippet"))


# ---------------------------------------------------------------- gates, joins, catalogues

_PREFIXES = [("/en/1", "one"), ("/de", "german"), ("/fr/2/", "none"), ("", "root")]


@query(
    "scope_prefix_join",
    f"""WITH p(target, name) AS (VALUES {', '.join(str(x) for x in _PREFIXES)}), u AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    n AS (SELECT page_id, regexp_replace(path, '/+$', '') AS path FROM u)
    SELECT page_id, name FROM n JOIN p ON regexp_replace(target, '/+$', '') = '' OR path = regexp_replace(target, '/+$', '') OR starts_with(path, regexp_replace(target, '/+$', '') || '/')""",
)
def scope_prefix_join(spark, sf_dir):
    """Whole-directory prefixes: each path is expanded to its ancestors, which meet targets by equality."""
    paths = read(spark, sf_dir, "pages").select("page_id", gates.module_path(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1)).alias("path"))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    targets = spark.createDataFrame(_PREFIXES, "target string, name string").select(gates.module_path(F.col("target")).alias("at"), "name")
    return paths.select("page_id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ancestors))).alias("at")).join(targets, "at").select("page_id", "name")


_RULES = [(r"\b(stupid|idiot)\b", "rude"), (r"licen[sc]e", "licence"), (r"\bque\b", "spanish-or-french"), (r"\bder\b", "german"), ("tion", "prose")]


@query("category_rules", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{c}'" for p, c in _RULES) + " ELSE 'other' END AS category FROM documents")
def category_rules(spark, sf_dir):
    # an ASCII word boundary, as DuckDB's, since letters beyond ASCII end a word there
    rules = [(p.replace(r"\b(", r"(?<![0-9a-z_])(").replace(r")\b", r")(?![0-9a-z_])").replace(r"\bque\b", r"(?<![0-9a-z_])que(?![0-9a-z_])").replace(r"\bder\b", r"(?<![0-9a-z_])der(?![0-9a-z_])"), c) for p, c in _RULES]
    return read(spark, sf_dir, "documents").select("doc_id", gates.classify(F.col("text"), rules, "other").alias("category"))


_GATE = """WITH c AS (SELECT c_custkey, [(c_custkey % 6)::VARCHAR] AS blocked, CASE WHEN c_custkey % 2 = 0 THEN [(c_custkey % 7)::VARCHAR] ELSE [] END AS req, CASE WHEN c_custkey % 3 = 0 THEN [(c_custkey % 5)::VARCHAR, (c_nationkey % 4)::VARCHAR] ELSE [] END AS req_all,
    [(c_nationkey % 4)::VARCHAR, '3'] AS seen, [(c_nationkey % 4)::VARCHAR] AS pos, CASE WHEN c_custkey % 4 = 1 THEN ['plan'] ELSE ['explain', 'execute'] END AS modes, CASE WHEN c_custkey % 11 = 0 THEN ['plan'] ELSE [] END AS inc, CASE WHEN c_custkey % 13 = 0 THEN ['explain'] ELSE [] END AS exc,
    CASE WHEN c_custkey % 17 = 0 THEN ['near', 'far'] ELSE [] END AS neg, CASE WHEN c_custkey % 19 = 0 THEN ['n1', 'n2'] ELSE [] END AS aim FROM customer),
    t AS (SELECT *, list_filter(blocked, lambda x: NOT list_contains(['0', '1', '2', '3'], x)) AS ub, list_filter(blocked, lambda x: list_contains(seen, x)) AS hb, list_filter(req, lambda x: NOT list_contains(['0', '1', '2', '3'], x)) AS ua,
      list_filter(CASE WHEN len(req_all) = 2 AND req_all[1] = req_all[2] THEN [req_all[1]] ELSE req_all END, lambda x: NOT list_contains(['0', '1', '2', '3'], x)) AS ul, list_has_any(req, pos) AS hit,
      list_filter(CASE WHEN len(req_all) = 2 AND req_all[1] = req_all[2] THEN [req_all[1]] ELSE req_all END, lambda x: NOT list_contains(pos, x)) AS ml, list_filter(exc, lambda x: list_contains(modes, x)) AS he, list_has_any(inc, modes) AS hi FROM c)
    SELECT c_custkey, CASE WHEN len(ub) > 0 THEN 'blockedSignals.unknown:' || array_to_string(ub, '+') WHEN len(hb) > 0 THEN 'blockedSignals:' || array_to_string(hb, '+') WHEN len(ua) > 0 THEN 'requiredSignals.unknown:' || array_to_string(ua, '+')
      WHEN len(ul) > 0 THEN 'requiredAllSignals.unknown:' || array_to_string(ul, '+') WHEN len(req) > 0 AND NOT hit THEN 'requiredSignals:' || array_to_string(req, '+') WHEN len(ml) > 0 THEN 'requiredAllSignals:' || array_to_string(ml, '+')
      WHEN len(he) > 0 AND NOT (hi AND (hit OR list_has_any(req_all, pos))) THEN 'intentModes.exclude:' || array_to_string(he, '+') WHEN len(inc) > 0 AND NOT hi THEN 'intentModes.include:' || array_to_string(inc, '+')
      WHEN len(neg) > 0 THEN 'negativeTriggers:' || neg[1] WHEN len(aim) > 0 THEN 'ruleSignals.negative:' || array_to_string(aim, '+') END AS reason FROM t"""


@query("gate_order", _GATE)
def gate_order(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = lambda *c: F.array(*[x.cast("string") for x in c])
    words = lambda *w: F.array(*map(F.lit, w))
    none = F.array().cast("array<string>")
    some = lambda cond, v: F.when(cond, v).otherwise(none)
    card = {"blocked": text(k % 6), "required_any": some(k % 2 == 0, text(k % 7)), "required_all": some(k % 3 == 0, text(k % 5, n % 4)), "include": some(k % 11 == 0, words("plan")), "exclude": some(k % 13 == 0, words("explain"))}
    modes = F.when(k % 4 == 1, words("plan")).otherwise(words("explain", "execute"))
    gate = gates.recall_gate(card, F.array((n % 4).cast("string"), F.lit("3")), text(n % 4), modes, some(k % 17 == 0, words("near", "far")), some(k % 19 == 0, words("n1", "n2")), ["0", "1", "2", "3"])
    return read(spark, sf_dir, "customer").select("c_custkey", gates.gate_reason(gate).alias("reason"))


@query("catalog_merge", "SELECT o_custkey, arg_max(o_orderkey, (epoch_us(o_orderdate)::HUGEINT * 1000000000000 + o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def catalog_merge(spark, sf_dir):
    return telemetry.latest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("duplicate_ids", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return curation.duplicates(read(spark, sf_dir, "documents"), "text")


@query(
    "index_drift",
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'not-indexed' ELSE 'not-active' END AS issue FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
)
def index_drift(spark, sf_dir):
    return curation.index_drift(read(spark, sf_dir, "documents").where("lang = 'en'"), read(spark, sf_dir, "labels"), "doc_id")


@query("suggestions", "SELECT a.n_name AS name, b.n_name AS suggestion, levenshtein(a.n_name, b.n_name) AS edits FROM nation a JOIN nation b ON a.n_name <> b.n_name AND levenshtein(a.n_name, b.n_name) <= 7")
def suggestions(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return curation.suggestions(names, names, 7).withColumn("edits", F.col("edits").cast("long"))


@query("family_keys", "SELECT page_id, CASE WHEN contains(split_part(u, '/', 1), '.') THEN array_to_string(string_split(u, '/')[1:2], '/') ELSE array_to_string(string_split(u, '/')[1:len(string_split(u, '/')) - 1], '/') END AS family FROM (SELECT page_id, regexp_replace(url, '^[^:]*://', '') AS u FROM pages)")
def family_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", gates.family_key(F.regexp_replace("url", "^[^:]*://", "")).alias("family"))


_WEIGHT = "(event_id * i) % 41 - 20"


@query(
    "reason_compaction",
    f"""WITH r AS (SELECT event_id, i, {_WEIGHT} AS w FROM events, range(1, 31) t(i)), k AS (SELECT *, row_number() OVER (PARTITION BY event_id, w < 0 ORDER BY CASE WHEN w < 0 THEN w ELSE -w END, i) AS n FROM r)
    SELECT event_id, string_agg(i || ':' || w, ',' ORDER BY w >= 0, n) AS reasons FROM k WHERE n <= CASE WHEN w < 0 THEN 8 ELSE 12 END GROUP BY 1""",
)
def reason_compaction(spark, sf_dir):
    """Forty reasons of each event, the last ten of which repeat earlier ones under other weights."""
    made = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct((i % 30).cast("string").alias("field"), F.lit("t").alias("term"), ((F.col("event_id") * i) % 41 - 20).alias("weight"), i.cast("string").alias("i"), F.lit("k").alias("kind")))
    found = selection.compact_reasons(made)
    return dealt(read(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", F.array_join(F.transform(found, lambda r: F.concat(r["i"], F.lit(":"), r["weight"].cast("string"))), ",").alias("reasons"))


@query("priority_scores", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 2 ELSE 1 END + CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 ELSE 0 END - CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END AS priority FROM orders")
def priority_scores(spark, sf_dir):
    policy = F.when(F.col("o_orderstatus") == "F", "must").when(F.col("o_orderstatus") == "O", "should").otherwise("summary")
    risk = F.when(F.substring("o_orderpriority", 1, 1) == "1", "high").when(F.substring("o_orderpriority", 1, 1) == "2", "medium").otherwise("low")
    confidence = F.when(F.col("o_totalprice") < 50000, "low").otherwise("medium")
    return read(spark, sf_dir, "orders").select("o_orderkey", evidence.priority(policy, risk, confidence).alias("priority"))


@query("rounded_scores", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS score FROM lineitem")
def rounded_scores(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.rounded(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"))
