"""Queries of sources, curation, libraries, contexts and whole recall."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import prompt as P
from tessera.functions import signals as G
from tessera.operators import corpus, curation, gates, kept, recall, similarity, telemetry
from tessera.plans.common import query, read, sql_tokens
from tessera.plans.retrieval import prompts
from tessera.sources import cards as library
from tessera.sources import hooks, sessions
from tessera.streaming import recall as streams
from tessera.tables import materialize, remove, shared_folder

# ---------------------------------------------------------------- sources


BROKEN = 100_000


def _session_lines(spark, sf_dir):
    """Conversations as JSON lines in three hosts' shapes, with a broken line behind each conversation."""
    c = read(spark, sf_dir, "conversations")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    cwd = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("/w/"), F.col("conv_id").cast("string")))
    flat = F.to_json(F.struct("role", F.col("text").alias("content"), cwd.alias("cwd")))
    nested = F.to_json(F.struct(cwd.alias("cwd"), F.struct("role", parts.alias("content")).alias("message")))
    deep = F.to_json(F.struct(F.lit("response_item").alias("type"), cwd.alias("cwd"), F.struct("role", parts.alias("content")).alias("payload")))
    value = F.when(F.col("turn") % 3 == 0, flat).when(F.col("turn") % 3 == 1, nested).otherwise(deep)
    file = F.concat(F.lit("/s/conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file")
    whole = c.select(file, (F.col("turn") + 1).alias("line"), value.alias("value"))
    return whole.unionByName(c.select(file).distinct().select("file", F.lit(BROKEN).cast("long").alias("line"), F.lit("{broken").alias("value")))


_MESSAGES = r"""SELECT 'conv-' || conv_id AS session_id, turn + 1 AS line, role, trim(text) AS text,
    last_value(CASE WHEN turn % 3 = 0 THEN '/w/' || conv_id END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cwd FROM conversations"""


@query("visible_messages", f"SELECT * FROM ({_MESSAGES}) WHERE role IN ('user', 'assistant', 'tool') AND text <> ''")
def visible_messages(spark, sf_dir):
    return sessions.visible_messages(_session_lines(spark, sf_dir), "host").select("session_id", "line", "role", "text", "cwd")


def _sql_ordered_hash(rows: str, by: str, place: str, line: str) -> str:
    """Hashes of lines folded by blocks of neighbouring places."""
    return f"""(WITH h AS (SELECT {by}, {place} AS place, sha256({line}) AS h FROM {rows}), b AS (SELECT {by}, (place - 1) // {sessions.HASH_BLOCK} AS block, sha256(string_agg(h, '' ORDER BY place)) AS h FROM h GROUP BY ALL)
    SELECT {by}, sha256(string_agg(h, '' ORDER BY block)) AS hash FROM b GROUP BY ALL)"""


@query(
    "session_records",
    f"""WITH m AS (SELECT * FROM ({_MESSAGES}) WHERE role IN ('user', 'assistant', 'tool') AND text <> ''), h AS {_sql_ordered_hash('m', 'session_id', 'line', "role || chr(0) || text || chr(10)")}
    SELECT session_id, count(*) AS messages, any_value(hash) AS hash, arg_min(cwd, line) FILTER (WHERE cwd IS NOT NULL) AS cwd FROM m JOIN h USING (session_id) GROUP BY 1""",
)
def session_records(spark, sf_dir):
    found = sessions.session_records(sessions.visible_messages(_session_lines(spark, sf_dir), "host"))
    return found.select("session_id", "messages", "hash", "cwd")


@query("bad_lines", f"SELECT DISTINCT 'conv-' || conv_id AS session_id, {BROKEN} AS line FROM conversations")
def bad_lines(spark, sf_dir):
    _, dead = sessions.split_json(_session_lines(spark, sf_dir))
    return dead.select(sessions.session_of(F.col("file"), F.lit("host")).alias("session_id"), "line")


@query(
    "hook_payloads",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'cursor' WHEN 1 THEN 'claude' WHEN 2 THEN 'codex' ELSE 'unknown' END AS provider, CASE WHEN turn % 4 = 3 THEN 'agent.stop' ELSE 'prompt.submit' END AS event,
    coalesce(text, '') AS text, CASE turn % 4 WHEN 0 THEN '/w/a' WHEN 2 THEN '/w/b' END AS cwd FROM conversations""",
)
def hook_payloads(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    kind = F.col("turn") % 4
    value = (
        F.when(kind == 0, F.to_json(F.struct(F.array(F.lit("/w/a")).alias("workspace_roots"), F.col("text").alias("userPrompt"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("/t").alias("transcript_path"), F.col("text").alias("prompt"))))
        .when(kind == 2, F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("input"), F.lit("/w/b").alias("working_directory"))))
        .otherwise(F.to_json(F.struct(F.lit("Stop").alias("hook_event_name"), F.col("text").alias("user_prompt"))))
    )
    return hooks.normalize_payloads(c.select("conv_id", "turn", value.alias("value"))).select("conv_id", "turn", "provider", "event", "text", "cwd")


@query("storage_audit", "SELECT role, count(*) AS rows, count_if(turn = 0) AS first, sum(strlen(coalesce(text, ''))) AS bytes, max(strlen(coalesce(text, ''))) AS largest FROM conversations GROUP BY 1")
def storage_audit(spark, sf_dir):
    return telemetry.source_state(read(spark, sf_dir, "conversations"), ["role"], "text", {"first": F.col("turn") == 0})


# ---------------------------------------------------------------- prompts


def _sql_holds(terms: tuple[str, ...]) -> str:
    words, han = [t for t in terms if t.isascii()], [t for t in terms if not t.isascii()]
    parts = han + ([f"(?:^|[^a-z0-9])(?:{'|'.join(w.replace(' ', chr(92) + 's+') for w in words)})(?:[^a-z0-9]|$)"] if words else [])
    return "regexp_matches(lower(text), '" + "|".join(parts) + "')"


def _sql_labels(table: dict[str, tuple[str, ...]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_sql_holds(v)} THEN '{k}' END" for k, v in table.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("prompt_labels", f"SELECT conv_id, turn, {_sql_labels(P.TASK_TYPES)} AS task_types, {_sql_labels(P.OPERATIONS)} AS operations, {_sql_labels({t: (t,) for t in P.SURFACES})} AS surfaces FROM conversations")
def prompt_labels(spark, sf_dir):
    low = F.lower("text")
    said = {"task_types": P.labels(low, P.TASK_TYPES), "operations": P.labels(low, P.OPERATIONS), "surfaces": P.present(low, P.SURFACES)}
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.array_join(v, ",").alias(k) for k, v in said.items()])


@query("negated_spans")
def negated_spans(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(P.negated_spans(F.col("text")), "|").alias("spans"))


@query("envelope")
def envelope(spark, sf_dir):
    return P.with_envelope(prompts(spark, sf_dir)).drop("text")


@query("query_plan")
def query_plan(spark, sf_dir):
    return P.query_plan(P.with_envelope(prompts(spark, sf_dir)), "prompt_id")


@query("rule_signals")
def rule_signals(spark, sf_dir):
    rows = G.prompt_signals(prompts(spark, sf_dir), "prompt_id")
    return rows.select("prompt_id", F.array_join(G.ids(F.col("signals")), ",").alias("signals"), F.array_join("intent_modes", ",").alias("intents"))


# ---------------------------------------------------------------- whole recall


def _cards(spark, sf_dir):
    """Benchmark items as cards: the first words are the title, sentences are triggers."""
    text = F.col("text")
    triggers = F.filter(F.split(text, r"[.!?]\s+"), lambda s: F.length(s) > 12)
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("card_id"), F.substring(text, 1, 40).alias("title"), F.concat(F.lit("c"), (F.col("item_id") % 5).cast("string")).alias("category"), text.alias("summary"), triggers.alias("triggers"), F.array(F.concat(F.lit("t"), (F.col("item_id") % 4).cast("string"))).alias("topics"))


@query("recall_match")
def recall_match(spark, sf_dir):
    return recall.match(prompts(spark, sf_dir), _cards(spark, sf_dir), threshold=20.0).drop("families")


_NAMED = "(SELECT p_name AS name, min(p_partkey) AS card_id FROM part GROUP BY 1)"


@query(
    "recall_gated",
    f"""WITH k AS (SELECT *, card_id % 4 AS kind FROM {_NAMED}), p AS (SELECT p_partkey AS prompt_id, k.*, CASE WHEN p_size % 4 = 1 AND kind <> 1 THEN 0 ELSE p_size % 4 END AS asks FROM part JOIN k ON p_name = name)
    SELECT prompt_id, card_id, floor(100 * (100 * (1 - 0.58::DOUBLE * 0.89::DOUBLE * CASE WHEN kind = 1 THEN 0.46::DOUBLE ELSE 1.0::DOUBLE END)) + 0.5) / 100 AS score, true AS strong_anchor,
      CASE WHEN kind = 1 THEN 'lexical,signals,title' ELSE 'lexical,title' END AS families
    FROM p WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN asks = 1 WHEN 2 THEN asks <> 2 ELSE asks <> 3 END""",
)
def recall_gated(spark, sf_dir):
    """Recall at its own threshold, where gates decide: cards that need a signal, that a signal blocks, and with negative triggers."""
    part = read(spark, sf_dir, "part")
    cards = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("card_id"))
    kind, noun = F.col("card_id") % 4, F.element_at(F.split("title", " "), -1)
    some = lambda k, value: F.when(kind == k, F.array(value)).otherwise(F.array().cast("array<string>"))
    cards = cards.withColumns({"category": F.lit("parts"), "required_any": some(1, F.lit("git_operation")), "blocked": some(2, F.lit("explain_only")), "negative_triggers": some(3, F.concat(F.lit("legacy "), noun))})
    named = part.join(cards.select(F.col("title").alias("p_name"), "card_id"), "p_name")
    asks = F.when((F.col("p_size") % 4 == 1) & (kind != 1), 0).otherwise(F.col("p_size") % 4)
    said = F.concat(F.element_at(F.array(F.lit("please look at the "), F.lit("git push the "), F.lit("only explain the "), F.lit("please look at the ")), asks + 1), "p_name")
    text = F.when(asks == 3, F.concat(said, F.lit(" and the legacy "), F.element_at(F.split("p_name", " "), -1))).otherwise(said)
    found = recall.match(named.select(F.col("p_partkey").alias("prompt_id"), text.alias("text")), cards).where("rank = 1")
    return found.select("prompt_id", "card_id", "score", "strong_anchor", F.array_join(F.array_sort("families"), ",").alias("families"))


@query("recall_diagnostics")
def recall_diagnostics(spark, sf_dir):
    said = prompts(spark, sf_dir)
    return recall.diagnostics(recall.match_detailed(said, _cards(spark, sf_dir), threshold=20.0), said).drop("candidates")


@query(
    "context_blocks",
    """WITH m AS (SELECT p_size AS prompt_id, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
    b AS (SELECT prompt_id, rank, rank || '. [medium risk][should] ' || p_name || ' (' || p_partkey || ')' || chr(10) || '   Summary: ' || p_type || chr(10) || '   Scope: global' || chr(10) || '   Use if: ' || p_brand || chr(10)
      || '   Ignore if: unrelated to the task' || chr(10) || '   Matched by: score 50.0' || chr(10) || '   Link: [' || p_name || '](<cards/active/' || p_partkey || '.md>)' AS block FROM m JOIN part USING (p_partkey) WHERE rank <= 8),
    u AS (SELECT *, 20 + sum(length(block) + 1) OVER (PARTITION BY prompt_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM b)
    SELECT prompt_id, '# Related experience' || chr(10) || string_agg(block, chr(10) ORDER BY rank) AS context FROM u WHERE used <= 900 GROUP BY 1""",
)
def context_blocks(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    ranked = recall.corpus.top_k(p, ["p_size"], [F.desc("p_retailprice"), F.asc("p_partkey")], 8)
    matches = ranked.select(F.col("p_size").alias("prompt_id"), F.col("p_partkey").alias("card_id"), "rank", F.lit(50.0).alias("score"))
    return recall.render_context(matches, p.select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.array("p_brand").alias("triggers")), 900)


_TITLE, _LESSON = "(SELECT item_id, substr(text, 1, 40) AS t FROM benchmark)", "benchmark"


@query(
    "card_similarity",
    f"""WITH a AS (SELECT item_id, list(DISTINCT tok) AS s FROM {sql_tokens(_TITLE, 'item_id', 't')} GROUP BY 1), l AS (SELECT item_id, list(DISTINCT tok) AS s FROM {sql_tokens(_LESSON, 'item_id', 'text')} GROUP BY 1),
    b AS (SELECT l.item_id, coalesce(a.s, []) AS ts, l.s AS ls FROM l LEFT JOIN a USING (item_id))
    SELECT x.item_id AS a, y.item_id AS b, floor(least(1.0::DOUBLE, 0.30::DOUBLE * CASE WHEN len(x.ts) = 0 OR len(y.ts) = 0 THEN 0 ELSE len(list_intersect(x.ts, y.ts))::DOUBLE / (len(x.ts) + len(y.ts) - len(list_intersect(x.ts, y.ts))) END
      + CASE WHEN x.item_id % 5 = y.item_id % 5 THEN 0.34::DOUBLE + 0.08::DOUBLE ELSE 0.0::DOUBLE END + 0.14::DOUBLE * len(list_intersect(x.ls, y.ls))::DOUBLE / (len(x.ls) + len(y.ls) - len(list_intersect(x.ls, y.ls)))) * 10000 + 0.5) / 100 AS score
    FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(list_intersect(x.ls, y.ls)) > 0""",
)
def card_similarity(spark, sf_dir):
    cards = _cards(spark, sf_dir).withColumns({"triggers": F.array().cast("array<string>"), "topics": F.array().cast("array<string>"), "rule": F.lit(""), "body": F.lit("")})
    names = ("title", "category", "triggers", "topics", "summary", "rule", "body")
    sides = [cards.select(F.col("card_id").alias(k), F.struct(*names).alias(f"card_{k}")) for k in "ab"]
    pairs = similarity.set_pairs(cards.select("card_id", similarity.T.tokens(F.col("summary")).alias("tokens")), "card_id", "tokens").select("a", "b")
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", similarity.card_similarity(*[{c: F.col(f"card_{k}.{c}") for c in names} for k in "ab"]).alias("score"))


# ---------------------------------------------------------------- a kept corpus


def _changed_library(spark, sf_dir):
    """A library that is built, changed twice and compacted once in between: its folder."""
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    part = read(spark, sf_dir, "part")
    fields = {"title": F.col("p_name"), "category": F.col("p_brand"), "summary": F.col("p_type")}
    rows = lambda cards, title=fields["title"]: corpus.field_rows(cards, {**fields, "title": title}, ["p_partkey"])
    gone = lambda where: part.where(where).select("p_partkey")
    kept.apply(spark, path, rows(part), key="p_partkey")
    kept.apply(spark, path, rows(part.where("p_size > 45"), F.concat(F.lit("renewed "), "p_name", F.lit(" item"))), gone("p_size < 5"), key="p_partkey")
    kept.compact(spark, path, key="p_partkey")
    kept.apply(spark, path, rows(part.where("p_size = 3")), gone("p_size = 46"), key="p_partkey")
    return path


def _from_kept(spark, sf_dir, label, find):
    path = _changed_library(spark, sf_dir)
    found = materialize(find(path), label)
    remove(spark, path)
    return found


_KEPT = "(SELECT p_partkey, CASE WHEN p_size > 45 THEN 'renewed ' || p_name || ' item' ELSE p_name END AS title, p_brand AS category, p_type AS summary FROM part WHERE (p_size >= 5 OR p_size = 3) AND p_size <> 46)"
_KEPT_FIELDS = f"(SELECT p_partkey, unnest(['title', 'category', 'summary']) AS field, unnest([title, category, summary]) AS t FROM {_KEPT})"


@query("kept_frequency", f"SELECT tok AS token, count(DISTINCT p_partkey) AS df FROM {sql_tokens(_KEPT_FIELDS, 'p_partkey', 't')} GROUP BY 1")
def kept_frequency(spark, sf_dir):
    """Document frequencies of a library after upserts, removals and a compaction: those of a rebuild."""
    return _from_kept(spark, sf_dir, "kept-frequency", lambda path: kept.document_frequency(spark, path))


@query("kept_fields", f"SELECT f.field, (SELECT count(*) FROM {_KEPT}) AS n, sum(x.n)::BIGINT AS total FROM (SELECT field, count(*) AS n FROM {sql_tokens(_KEPT_FIELDS, 'field, p_partkey', 't')} GROUP BY 1) x JOIN (SELECT DISTINCT field FROM {_KEPT_FIELDS}) f USING (field) GROUP BY 1, 2")
def kept_fields(spark, sf_dir):
    """Cards and tokens of each field after the same changes."""
    return _from_kept(spark, sf_dir, "kept-fields", lambda path: kept.field_lengths(spark, path).drop("average"))


# ---------------------------------------------------------------- libraries and curation


@query("library_upsert", "SELECT p_partkey AS card_id, CASE WHEN p_size > 45 THEN 'new' ELSE p_brand END AS title FROM part")
def library_upsert(spark, sf_dir):
    cards = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("title"), "p_size")
    return library.upsert(cards, cards.where("p_size > 45").withColumn("title", F.lit("new"))).select("card_id", "title")


@query("card_patch", "SELECT p_partkey AS card_id, CASE WHEN p_size > 30 AND p_partkey % 2 = 0 THEN 'patched' ELSE p_name END AS title, p_type AS summary FROM part")
def card_patch(spark, sf_dir):
    cards = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), "p_size")
    changes = cards.where("p_size > 30").select("card_id", F.when(F.col("card_id") % 2 == 0, F.lit("patched")).alias("title"), F.lit(0).alias("p_size"))
    return library.patch(cards, changes).select("card_id", "title", "summary")


@query("archive_cards", "SELECT p_partkey AS card_id, CASE WHEN p_size < 5 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_size < 5 THEN 'unused' END AS archived_reason FROM part")
def archive_cards(spark, sf_dir):
    cards = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), F.lit("active").alias("status"), "p_size")
    return library.set_status(cards, cards.where("p_size < 5"), "archived", F.lit("unused")).select("card_id", "status", "archived_reason")


@query("library_stack", "SELECT scope, count(*) AS cards, count(b) AS with_brand FROM (SELECT 'global' AS scope, p_brand AS b FROM part UNION ALL SELECT 'project', NULL FROM supplier) GROUP BY 1")
def library_stack(spark, sf_dir):
    whole = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("brand"))
    own = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("card_id"))
    rows = library.union_libraries(**{"global": whole, "project": own})
    return rows.groupBy(F.col("library_scope").alias("scope")).agg(F.count("*").alias("cards"), F.count("brand").alias("with_brand"))


@query(
    "merged_lessons",
    """WITH c AS (SELECT n_regionkey AS card_id, list_sort(list(DISTINCT substr(n_name, 1, 1))) AS t, string_agg(DISTINCT n_name, chr(10) || chr(10) ORDER BY n_name) AS r FROM nation GROUP BY 1)
    SELECT r_regionkey AS card_id, array_to_string(list_sort(list_distinct(list_concat(['A', substr(r_name, 1, 1)], t))), ',') AS topics, r_name || chr(10) || chr(10) || r AS rule FROM region JOIN c ON r_regionkey = card_id""",
)
def merged_lessons(spark, sf_dir):
    cards = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("card_id"), F.array(F.lit("A"), F.substring("r_name", 1, 1)).alias("topics"), F.col("r_name").alias("rule"))
    candidates = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("target_card_id"), F.array(F.substring("n_name", 1, 1)).alias("topics"), F.col("n_name").alias("rule"))
    return curation.merge_cards(cards, candidates, ["topics"]).select("card_id", F.array_join(F.sort_array(F.array_distinct("topics")), ",").alias("topics"), "rule")


_REF = "substr('Customer#' || lpad(s_suppkey::VARCHAR, 9, '0'), 10, CASE WHEN s_nationkey < 5 THEN 7 ELSE 8 END)"


@query("protected_sessions", f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE contains(c_name, {_REF}))")
def protected_sessions(spark, sf_dir):
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    refs = read(spark, sf_dir, "supplier").select(F.substring(name, F.lit(10), F.when(F.col("s_nationkey") < 5, 7).otherwise(8)).alias("ref"))
    return curation.protected(read(spark, sf_dir, "customer"), refs, "c_name").select("c_custkey")


@query("prune_reasons", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'protected' WHEN o_totalprice > 300000 THEN 'referenced' WHEN o_orderkey % 100 < 30 THEN 'recent' ELSE 'prunable' END AS reason FROM orders")
def prune_reasons(spark, sf_dir):
    reason = curation.prune_reason(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000, F.col("o_orderkey") % 100, 30)
    return read(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query(
    "audit_completeness",
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'name' END, CASE WHEN c_nationkey > 20 AND c_acctbal < 0 THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM customer WHERE c_custkey % 4 = 0 OR (c_nationkey > 20 AND c_acctbal < 0)""",
)
def audit_completeness(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rows = c.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return curation.incomplete(rows, ["name"], ["balance"], F.col("c_nationkey") > 20).select("c_custkey", F.array_join("missing", ",").alias("missing"))


@query("registered_categories", "SELECT coalesce(k.source, d.source) AS category, k.source IS NOT NULL AS registered, coalesce(d.n, 0) AS cards FROM (SELECT DISTINCT source FROM documents WHERE length(source) % 2 = 0 UNION SELECT 'unused') k FULL JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) d ON k.source = d.source")
def registered_categories(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("category"), "doc_id")
    known = docs.where(F.length("category") % 2 == 0).select("category").unionByName(spark.createDataFrame([("unused",)], "category string")).distinct()
    return curation.category_counts(known, docs)


@query(
    "config_diff",
    """WITH b AS (SELECT c_custkey AS key, c_mktsegment AS v FROM customer), a AS (SELECT CASE WHEN c_nationkey > 20 THEN c_custkey + 1000000 ELSE c_custkey END AS key, CASE WHEN c_nationkey > 12 THEN 'other' ELSE c_mktsegment END AS v FROM customer)
    SELECT * FROM (SELECT coalesce(b.key, a.key) AS key, b.v AS old, a.v AS new, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN b.v <> a.v THEN 'changed' END AS change FROM b FULL JOIN a ON a.key = b.key) WHERE change IS NOT NULL""",
)
def config_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    before = c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    moved = F.when(F.col("c_nationkey") > 20, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey"))
    after = c.select(moved.alias("key"), F.when(F.col("c_nationkey") > 12, "other").otherwise(F.col("c_mktsegment")).alias("value"))
    return curation.config_diff(before, after)


_SCOPED = "'a.org/t' || ({k} % 3) || '/r' || ({k} % 4)"


@query(
    "applicable_cards",
    f"""WITH p AS (SELECT s_suppkey AS prompt_id, {_SCOPED.format(k='s_suppkey')} AS own, 'm' || (s_suppkey % 2) || '/x' AS place FROM supplier),
    c AS (SELECT n_nationkey AS card_id, n_nationkey % 3 AS level, {_SCOPED.format(k='n_nationkey')} AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'm0/' ELSE '' END AS m FROM nation)
    SELECT prompt_id, card_id FROM p JOIN c ON level = 1 AND own = key AND (m = '' OR starts_with(place, m)) UNION ALL
    SELECT prompt_id, card_id FROM p JOIN c ON level = 2 AND regexp_replace(own, '/[^/]*$', '') = regexp_replace(key, '/[^/]*$', '') AND (m = '' OR starts_with(place, m)) UNION ALL SELECT -1, card_id FROM c WHERE level = 0""",
)
def applicable_cards(spark, sf_dir):
    key = lambda k: F.concat(F.lit("a.org/t"), (F.col(k) % 3).cast("string"), F.lit("/r"), (F.col(k) % 4).cast("string"))
    p = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("prompt_id"), key("s_suppkey").alias("project_key"), F.concat(F.lit("m"), (F.col("s_suppkey") % 2).cast("string"), F.lit("/x")).alias("module_path"))
    level = F.element_at(F.array(*map(F.lit, ("global", "project", "project-family"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    c = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("card_id"), level.alias("level"), key("n_nationkey").alias("project_key"), F.when(F.col("n_nationkey") % 2 == 0, "./m0/").otherwise("").alias("module_path"))
    return gates.applicable(p, c).na.fill(-1, ["prompt_id"])


@query(
    "rates_by_hour",
    """WITH e AS (SELECT date_trunc('hour', ts) AS h, CASE WHEN event_type = 'view' THEN ['a'] WHEN event_type = 'click' THEN ['b'] ELSE [] END AS s, CASE WHEN value > 50 THEN ['a'] ELSE [] END AS r FROM events)
    SELECT h AS "from", h + INTERVAL 1 HOUR AS "to", count(*) AS events, count_if(len(s) > 0) AS matched, count_if(len(list_intersect(s, r)) > 0) AS rendered_events FROM e GROUP BY 1""",
)
def rates_by_hour(spark, sf_dir):
    none = F.array().cast("array<string>")
    e = read(spark, sf_dir, "events")
    selected = F.when(F.col("event_type") == "view", F.array(F.lit("a"))).when(F.col("event_type") == "click", F.array(F.lit("b"))).otherwise(none)
    return streams.rates_stream(e.select("ts", selected.alias("selected"), F.when(F.col("value") > 50, F.array(F.lit("a"))).otherwise(none).alias("rendered")))
