"""Queries of card files, suites, runs, projects and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql as functions
from tessera.functions import text as T
from tessera.operators import curation, gates
from tessera.plans.common import query, read
from tessera.sources import cards, evals, hooks, projects, sessions
from tessera.tables import dealt

_NONE = "[]::VARCHAR[]"


def _cards(spark, sf_dir):
    """Parts as cards: every column of a card that a file holds."""
    p = read(spark, sf_dir, "part")
    status = F.when(F.col("p_size") > 45, "draft").when(F.col("p_size") < 5, "archived").otherwise("active")
    return p.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("card_id"), status.alias("status"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("p_type").alias("summary"),
        F.array("p_name", "p_brand").alias("triggers"), F.array(F.lit("not this")).alias("negative_triggers"), F.array("p_brand").alias("topics"), F.array(F.lit("ui_surface")).alias("required_any"), F.array(F.lit("plan")).alias("include"),
        F.lit("project").alias("level"), F.lit("h.org/o/p").alias("project_key"), F.concat(F.lit("do "), "p_name").alias("rule"), "p_size",
    )


@query(
    "card_round_trip",
    """SELECT 'part-' || p_partkey AS card_id, CASE WHEN p_size > 45 THEN 'draft' WHEN p_size < 5 THEN 'archived' ELSE 'active' END AS status, p_name AS title, p_brand AS category, p_type AS summary, p_name || '|' || p_brand AS triggers, 'not this' AS negative,
    p_brand AS topics, 'ui_surface' AS required, 'plan' AS include, 'project/h.org/o/p' AS place, 'do ' || p_name AS rule, NULL::VARCHAR AS issue FROM part""",
)
def card_round_trip(spark, sf_dir):
    """Cards written as files and parsed again."""
    written = cards.card_markdown(cards.render_body(dealt(_cards(spark, sf_dir), "card_id")))
    c = cards.parse_cards(written.select(F.col("card_id").alias("file"), F.col("markdown").alias("value")))
    joined = lambda n: F.array_join(n, "|")
    return c.select("card_id", "status", "title", "category", "summary", joined("triggers").alias("triggers"), joined("negative_triggers").alias("negative"), joined("topics").alias("topics"), joined("required_any").alias("required"), joined("include").alias("include"), F.concat_ws("/", "level", "project_key").alias("place"), cards.rule_section(F.col("body")).alias("rule"), "issue")


@query(
    "card_migration",
    """SELECT 'f' || n_nationkey AS file, CASE WHEN n_nationkey % 3 = 1 THEN 'c' || n_nationkey END AS card_id, CASE WHEN n_nationkey % 3 = 1 THEN n_name ELSE '' END AS triggers, CASE WHEN n_nationkey % 3 = 2 THEN 'no-front-matter' END AS issue, CASE WHEN n_nationkey % 3 = 1 THEN 'must' END AS policy FROM nation WHERE n_nationkey % 3 <> 0""",
)
def card_migration(spark, sf_dir):
    """Files of today's form, of the old form and of none: the plan covers the last two."""
    n = read(spark, sf_dir, "nation")
    kind, key = F.col("n_nationkey") % 3, F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))
    now = F.to_json(F.struct(key.alias("id"), F.struct(F.array("n_name").alias("triggers")).alias("recall")))
    old = F.to_json(F.struct(key.alias("id"), F.array("n_name").alias("triggers"), F.lit("must").alias("recall_policy")))
    value = F.when(kind == 0, F.concat(F.lit("---\n"), now, F.lit("\n---\n"))).when(kind == 1, F.concat(F.lit("---\n"), old, F.lit("\n---\n"))).otherwise(F.col("n_name"))
    files = n.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"), value.alias("value"))
    rows = cards.parse_cards(files, cards.parse_legacy_card)
    plan = rows.where(F.substring("file", 2, 9).cast("int") % 3 != 0)
    return plan.select("file", "card_id", F.coalesce(F.array_join("triggers", "|"), F.lit("")).alias("triggers"), "issue", F.col("recall_policy").alias("policy"))


@query("index_build", "SELECT 'part-' || p_partkey AS card_id, p_name AS title, p_brand AS category, 'ui_surface' AS required, 'should' AS policy FROM part WHERE p_size BETWEEN 5 AND 45")
def index_build(spark, sf_dir):
    return cards.index(_cards(spark, sf_dir)).select("card_id", "title", "category", F.array_join("required_any", "|").alias("required"), F.col("recall_policy").alias("policy"))


@query("active_listing", "SELECT 'part-' || p_partkey AS card_id FROM part WHERE p_size > 45")
def active_listing(spark, sf_dir):
    return cards.listed(_cards(spark, sf_dir).withColumns({"issue": F.lit(None).cast("string"), "file": F.col("card_id")}), "draft")[0].select("card_id")


# ---------------------------------------------------------------- suites


def _suites(spark, sf_dir):
    """A suite for each region, with its nations as cases and fixtures."""
    n = read(spark, sf_dir, "nation")
    case = F.struct(
        F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "hard").alias("difficulty"), F.concat(F.lit("find "), "n_name").alias("prompt"), F.array(F.lit("b"), "n_name", F.lit("b")).alias("expectedCards"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit(30.5)).alias("threshold"), (F.col("n_nationkey") % 7 == 0).alias("expectNoMatches"),
    )
    fixture = F.struct(F.col("n_name").alias("id"), F.struct(F.array("n_name").alias("triggers"), F.lit("must").alias("policy")).alias("recall"), F.struct(F.array(F.lit("no")).alias("ignore_when")).alias("criteria"), F.struct(F.lit("project").alias("level"), F.lit("k").alias("projectKey")).alias("scope"))
    lists = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", case.alias("case"), fixture.alias("fixture")))).alias("x"))
    told = F.to_json(F.struct(F.col("r_name").alias("name"), F.transform("x", lambda v: v["case"]).alias("cases"), F.transform("x", lambda v: v["fixture"]).alias("experiences")))
    return read(spark, sf_dir, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("/"), "r_name").alias("file"), told.alias("value"))


_PLACED = "SELECT r_name AS suite, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(
    "suite_cases",
    f"""SELECT suite, place, n_nationkey::VARCHAR AS case_id, CASE WHEN n_nationkey % 2 = 0 THEN 'hard' ELSE 'unknown' END AS difficulty, 'find ' || n_name AS text, 'b|' || n_name || '|b' AS ids, n_nationkey % 7 = 0 AS expect_none, CASE WHEN n_nationkey % 5 = 0 THEN 30.5::DOUBLE END AS threshold FROM ({_PLACED})""",
)
def suite_cases(spark, sf_dir):
    return evals.cases(_suites(spark, sf_dir)).select("suite", "place", "case_id", "difficulty", "text", F.array_join("ids", "|").alias("ids"), "expect_none", "threshold")


@query(
    "suite_fingerprints",
    f"""WITH c AS (SELECT suite, place, sha256(array_to_string([n_nationkey::VARCHAR, 'find ' || n_name, array_to_string(list_sort(list_distinct(['b', n_name])), chr(30)), '', '', CASE WHEN n_nationkey % 7 = 0 THEN 'true' ELSE 'false' END, CASE WHEN n_nationkey % 5 = 0 THEN '30.5' ELSE chr(0) END, chr(0)], chr(31))) AS h FROM ({_PLACED}))
    SELECT suite, sha256(suite || chr(10) || string_agg(h, chr(10) ORDER BY place)) AS fingerprint FROM c GROUP BY 1""",
)
def suite_fingerprints(spark, sf_dir):
    return evals.suite_fingerprint(evals.cases(_suites(spark, sf_dir)))


@query("fixture_cards", "SELECT n_name AS card_id, 'active' AS status, n_name AS triggers, 'no' AS negative, 'project' AS level, 'k' AS project_key, 'must' AS policy, 'medium' AS risk FROM nation")
def fixture_cards(spark, sf_dir):
    f = evals.fixtures(_suites(spark, sf_dir))
    return f.select("card_id", "status", F.array_join("triggers", "|").alias("triggers"), F.array_join("negative_triggers", "|").alias("negative"), "level", "project_key", F.col("recall_policy").alias("policy"), "risk")


# ---------------------------------------------------------------- runs and settings


@query(
    "run_states",
    """WITH d AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'reject' WHEN o_orderstatus = 'O' THEN 'accept' END AS action, o_totalprice > 150000 AS done FROM orders),
    t AS (SELECT o_custkey, count(*) AS n, count(action) AS decided, count_if(done) AS applied, count_if(done OR coalesce(action = 'reject', FALSE)) AS closed FROM d GROUP BY 1)
    SELECT c_custkey AS run_id, CASE WHEN coalesce(n, 0) = 0 THEN 'created' WHEN closed = n AND applied > 0 THEN 'applied_to_drafts' WHEN decided > 0 THEN 'decisions_recorded' ELSE 'candidates_generated' END AS state FROM customer LEFT JOIN t ON c_custkey = o_custkey""",
)
def run_states(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("candidate_id"), "o_orderstatus", "o_totalprice")
    action = F.when(F.col("o_orderstatus") == "F", "reject").when(F.col("o_orderstatus") == "O", "accept")
    decisions = o.withColumn("action", action).where("action is not null")
    return curation.run_state(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id")), o, decisions, o.where("o_totalprice > 150000"))


@query(
    "review_pages",
    """WITH c AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, CASE WHEN n_nationkey % 2 = 0 THEN 'accept' END AS action FROM nation),
    b AS (SELECT n_regionkey, place, '## ' || (place + 1) || '. ' || n_name || chr(10) || chr(10) || '### Lesson' || chr(10) || chr(10) || 'about ' || n_name || chr(10) || chr(10) || '### When' || chr(10) || chr(10) || '- ' || n_name || chr(10) || chr(10) || '### Rule' || chr(10) || chr(10)
      || '```agent-rule' || chr(10) || 'do ' || n_name || chr(10) || '```' || chr(10) || chr(10) || '### Decision' || chr(10) || chr(10) || CASE WHEN action IS NULL THEN '> Decision: open' || chr(10) || '>' || chr(10) || '> accept / reject / rewrite / merge' ELSE '> Decision: accept' || chr(10) || '> Reason: good' END AS block FROM c)
    SELECT r_regionkey AS run_id, '# Review of drafts' || chr(10) || chr(10) || 'State: open' || chr(10) || chr(10) || 'Run: ' || r_regionkey || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY place) || chr(10) AS markdown FROM region JOIN b ON r_regionkey = n_regionkey GROUP BY r_regionkey""",
)
def review_pages(spark, sf_dir):
    from pyspark.sql import Window

    n = read(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    candidates = n.select(F.col("n_regionkey").alias("run_id"), place.alias("place"), F.col("n_nationkey").alias("candidate_id"), F.col("n_name").alias("title"), F.concat(F.lit("about "), "n_name").alias("summary"), F.array("n_name").alias("triggers"), F.array().cast("array<string>").alias("negative_triggers"), F.concat(F.lit("do "), "n_name").alias("rule"))
    decisions = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("candidate_id"), F.lit("accept").alias("action"), F.lit("good").alias("reason"), F.lit(None).cast("string").alias("target_card_id"), F.lit(None).cast("string").alias("rewrite"))
    return curation.review(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("run_id"), F.lit("open").alias("state")), candidates, decisions, [F.desc("candidate_id")])


_KEY = "p_brand || '.' || p_size || '.' || p_partkey"


@query(
    "config_set",
    f"""WITH s AS (SELECT {_KEY} AS key, p_name AS value FROM part), c AS (SELECT p_brand || '.' || p_size AS key, 'whole' AS value FROM part WHERE p_size = 7 GROUP BY 1 UNION ALL SELECT {_KEY}, NULL FROM part WHERE p_size = 8)
    SELECT key, value FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE s.key = c.key OR starts_with(s.key, c.key || '.') OR starts_with(c.key, s.key || '.')) UNION ALL SELECT key, value FROM c WHERE value IS NOT NULL""",
)
def config_set(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    dotted = lambda *c: F.concat_ws(".", *[F.col(x).cast("string") for x in c])
    settings = p.select(dotted("p_brand", "p_size", "p_partkey").alias("key"), F.col("p_name").alias("value"))
    whole = p.where("p_size = 7").select(dotted("p_brand", "p_size").alias("key"), F.lit("whole").alias("value")).distinct()
    gone = p.where("p_size = 8").select(dotted("p_brand", "p_size", "p_partkey").alias("key"), F.lit(None).cast("string").alias("value"))
    return curation.set_config(settings, whole.unionByName(gone))


@query(
    "category_upsert",
    """SELECT r_name AS category, CASE WHEN r_regionkey < 2 THEN 'old' WHEN r_regionkey = 2 THEN 'new' ELSE 'kept' END AS description, CASE WHEN r_regionkey < 2 THEN 'card' ELSE 'manual' END AS source, 1 AS created_at, CASE WHEN r_regionkey < 2 THEN 1 ELSE 9 END AS updated_at FROM region WHERE r_regionkey < 4
    UNION ALL SELECT '未分类', 'x', 'manual', 9, 9""",
)
def category_upsert(spark, sf_dir):
    r = read(spark, sf_dir, "region").where("r_regionkey < 4")
    known = r.select(F.col("r_name").alias("category"), F.when(F.col("r_regionkey") < 2, "old").otherwise("kept").alias("description"), F.lit("card").alias("source"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    named = r.where("r_regionkey >= 2").select(F.col("r_name").alias("category"), F.when(F.col("r_regionkey") == 2, "new").otherwise("").alias("description"))
    return curation.upsert_category(known, named.unionByName(spark.createDataFrame([(" ", "x")], "category string, description string")), F.lit(9))


@query("inferred_categories", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(source, '') || ' ' || substr(text, 1, 10000000)), '{p}') THEN '{c}'" for p, c in gates.CATEGORY_RULES) + f" ELSE '{gates.DEFAULT_CATEGORY}' END AS category FROM documents WHERE source IS NOT NULL")
def inferred_categories(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("source is not null").select("doc_id", gates.infer_category(F.col("source"), F.col("text")).alias("category"))


@query(
    "library_findings",
    """WITH a AS (SELECT p_partkey FROM part WHERE p_size >= 5), i AS (SELECT p_partkey FROM part WHERE p_size <= 45)
    SELECT 'index' AS layer, 'warning' AS severity, 'not-indexed: ' || p_partkey AS message FROM a WHERE p_partkey NOT IN (SELECT * FROM i) UNION ALL SELECT 'index', 'warning', 'not-active: ' || p_partkey FROM i WHERE p_partkey NOT IN (SELECT * FROM a)
    UNION ALL SELECT 'config', 'error', n_name || ': not a number of 0 or more' FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'sources', 'warning', s_suppkey || ': source is gone' FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'log', 'error', r_name || ':7: invalid JSON' FROM region UNION ALL SELECT 'cards', 'error', n_name || ': bad-id' FROM nation UNION ALL SELECT 'events', 'info', 'no events yet'""",
)
def library_findings(spark, sf_dir):
    p, n = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    rows = p.select(F.col("p_partkey").alias("card_id"), F.when(F.col("p_size") >= 5, "active").otherwise("draft").alias("status"))
    return curation.doctor(
        rows,
        p.where("p_size <= 45").select(F.col("p_partkey").alias("card_id")),
        n.select(F.col("n_name").alias("card_id"), F.lit("bad-id").alias("issue")),
        read(spark, sf_dir, "region").select(F.col("r_name").alias("file"), F.lit(7).alias("line")),
        n.select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") == 0, "x").when(F.col("n_nationkey") < 3, "-1").otherwise("2.5").alias("value")),
        read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), (F.col("s_acctbal") >= 0).alias("source_exists")),
        read(spark, sf_dir, "events").limit(0),
    )


# ---------------------------------------------------------------- texts and sources


@query(
    "maintenance_prompts",
    """WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || chr(10) || 'please run tessera doctor now' WHEN 1 THEN 'about tessera doctor' WHEN 2 THEN '$ tessera configure' ELSE '  > npx tessera config set' END AS text FROM conversations)
    SELECT conv_id, turn, coalesce(list_bool_or(list_transform(string_split(text, chr(10)), lambda x: list_bool_or(list_transform([list_slice(regexp_extract_all(lower(x), '[A-Za-z0-9_@./-]+'), 1, 8)],
      lambda w: list_bool_or(list_transform([list_position(list_transform(w, lambda y: y IN ('please', 'run', 'execute', 'npx')), false)], lambda i: w[i] = 'tessera'
        AND w[i + 1] IN ('init', 'uninstall', 'source', 'doctor', 'config', 'experience', 'hook', 'project', 'reflect'))))) AND regexp_matches(x, '^[\\s`$>]*[A-Za-z]'))), false) AS maintenance FROM t""",
)
def maintenance_prompts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    kind = F.col("turn") % 4
    text = F.when(kind == 0, F.concat("text", F.lit("\nplease run tessera doctor now"))).when(kind == 1, "about tessera doctor").when(kind == 2, "$ tessera configure").otherwise("  > npx tessera config set")
    return c.select("conv_id", "turn", hooks.is_maintenance(text).alias("maintenance"))


@query(
    "rendered_cards",
    """WITH m AS (SELECT p_size AS prompt_id, p_partkey FROM part), c AS (SELECT p_size AS prompt_id, string_agg('show ' || p_partkey || ' ', chr(10)) AS context FROM part WHERE p_retailprice > 960 GROUP BY 1)
    SELECT prompt_id, array_to_string(list_sort(list(p_partkey)), ',') AS rendered FROM m JOIN c USING (prompt_id) WHERE contains(context, 'show ' || p_partkey || ' ') GROUP BY 1""",
)
def rendered_cards(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_size").alias("prompt_id"), F.col("p_partkey").alias("card_id"), "p_retailprice")
    marker = F.concat(F.lit("show "), F.col("card_id").cast("string"), F.lit(" "))
    contexts = p.where("p_retailprice > 960").groupBy("prompt_id").agg(F.array_join(F.collect_list(marker), "\n").alias("context"))
    return hooks.rendered_ids(p, contexts, marker).select("prompt_id", F.array_join("rendered", ",").alias("rendered"))


@query("source_paths", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?:~|\.{1,2}|\/)?[\w./@-]+\.(?:js|jsx|ts|tsx|json|md|toml|yaml|yml|py|go|rs|css|html|lock)'))), ' ') AS paths FROM pages".replace("\\\\", "\\"))
def source_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.sort_array(T.paths(F.col("html"))), " ").alias("paths"))


@query(
    "clean_texts",
    r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations",
)
def clean_texts(spark, sf_dir):
    """User texts under injected blocks, which are taken off again."""
    said = F.concat(F.lit("<environment_context>cwd: /x\n</environment_context>\n"), "text", F.lit("\n<system-reminder>soon</system-reminder>"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", sessions.clean_user_text(said).alias("text"))


@query(
    "catalog_scan",
    """SELECT o_orderkey::VARCHAR AS session_id, CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE 'host' END AS provider, '/s/' || o_orderkey AS source_path, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE o_custkey::INT END AS messages FROM orders""",
)
def catalog_scan(spark, sf_dir):
    """Session records of an older and of today's form."""
    o = read(spark, sf_dir, "orders")
    key, path = F.col("o_orderkey").cast("string"), F.concat(F.lit("/s/"), F.col("o_orderkey").cast("string"))
    old = F.to_json(F.struct(key.alias("id"), path.alias("sourcePath"), F.array(F.lit("a"), F.lit("b")).alias("messages")))
    new = F.to_json(F.struct(key.alias("id"), F.lit("host").alias("provider"), path.alias("source_path"), F.col("o_custkey").alias("messageCount")))
    return sessions.catalog(o.select(F.when(F.col("o_orderstatus") == "F", old).otherwise(new).alias("value"))).select("session_id", "provider", "source_path", "messages")


@query(
    "user_index_read",
    "SELECT conv_id, turn, trim(text) AS text, 'unknown' AS provider, CASE WHEN turn % 2 = 0 THEN 'id' || conv_id ELSE substr(sha1('unknown' || chr(0) || 'f' || conv_id || chr(0) || turn || chr(0) || trim(text)), 1, 16) END AS id FROM conversations WHERE trim(text) <> ''",
)
def user_index_read(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    stored = c.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("line"), F.concat(F.lit(" "), "text").alias("text"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("id"), F.col("conv_id").cast("string"))).alias("id"))
    return sessions.read_user_index(stored).select(F.substring("file", 2, 20).cast("long").alias("conv_id"), F.col("line").cast("long").alias("turn"), "text", "provider", "id")


@query("project_keys", r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'h.org/o/r' || page_id ELSE regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?', ''), '/+$', '') END AS project_key FROM pages")
def project_keys(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    remote = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("git@h.org:o/r"), F.col("page_id").cast("string"), F.lit(".git"))).otherwise(F.concat("url", F.lit(".git")))
    return p.select("page_id", projects.project_key(remote).alias("project_key"))


@query(
    "sql_functions",
    """SELECT p_partkey, floor(j * 10000 + 0.5) / 10000 AS jaccard, floor(100 * (1 - (1 - least(p_size, 100) / 100.0::DOUBLE) * 0.75::DOUBLE) * 100 + 0.5) / 100 AS noisy, floor(1000 * (1.0::DOUBLE / (60 + p_size) + 1.0::DOUBLE / 61) * 100 + 0.5) / 100 AS fused
    FROM (SELECT *, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(lower(p_type), ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))) AS j FROM part)""",
)
def sql_functions(spark, sf_dir):
    functions.register(spark)
    read(spark, sf_dir, "part").createOrReplaceTempView("tessera_part")
    return spark.sql("SELECT p_partkey, floor(jaccard(split(p_name, ' '), split(lower(p_type), ' ')) * 10000 + 0.5D) / 10000 AS jaccard, floor(noisy_or(array(CAST(p_size AS DOUBLE), 25.0D)) * 100 + 0.5D) / 100 AS noisy, rrf(p_size, 1) AS fused FROM tessera_part")


@query(
    "sql_search",
    """WITH m AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM conversations),
    s AS (SELECT conv_id, turn, length(text) AS chars, CASE WHEN contains(t, 'the ing') THEN 107 WHEN contains(t, 'the') AND contains(t, 'ing') THEN 16 ELSE 0 END AS score FROM m)
    SELECT * FROM s WHERE score > 0""",
)
def sql_search(spark, sf_dir):
    """Search by a table function, in SQL alone."""
    read(spark, sf_dir, "conversations").createOrReplaceTempView("tessera_messages")
    functions.register_search(spark, "tessera_messages", "conv_id", "turn")
    return spark.sql("SELECT conv_id, turn, length(text) AS chars, score FROM search_messages(' The   ING ')")
