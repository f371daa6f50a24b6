"""Card libraries: Markdown files with a front matter, card tables, and their life cycle.

Files are read whole by Spark (a card is a page of text) and parsed in Arrow batches; the front matter
needs PyYAML, or is JSON (which YAML includes).  Life-cycle steps are joins that return the next table,
which ``write_table`` writes to a path of its own (never the one that the step reads).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import signals as G
from tessera.operators import recall

try:
    import yaml
except ImportError:  # only front matter in JSON is read then
    yaml = None

TEXTS = ("card_id", "status", "title", "category", "summary", "recall_policy", "risk", "confidence", "level", "project_key", "module_path", "body")
LISTS = ("triggers", "negative_triggers", "aliases", "topics", "required_any", "required_all", "blocked", "include", "exclude")
SCHEMA = "file string, issue string, " + ", ".join(f"{c} string" for c in TEXTS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS)
# Headings of a card's body.
HEADINGS = {"summary": "## 这张卡解决什么问题", "criteria": "## 使用标准", "use": "使用：", "ignore": "不要使用：", "policy": "召回策略：", "risk": "风险级别：", "rule": "## 完整规则"}
#: Columns that recall reads, which an index holds.
INDEXED = ("card_id", "title", "category", "status", "file", "triggers", "negative_triggers", "topics", "level", "project_key", "module_path", "include", "exclude", "required_any", "required_all", "blocked", "aliases", "recall_policy", "risk", "confidence", "summary")
#: Columns that a patch may change.
PATCHABLE = ("title", "category", "summary", "triggers", "negative_triggers", "topics", "aliases", "recall_policy", "risk", "confidence", "body")


def _list(value: object) -> list[str]:
    if isinstance(value, str):
        value = [value]
    return [str(x) for x in value if str(x).strip()] if isinstance(value, list) else []


def _block(data: dict, name: str) -> dict:
    return data[name] if isinstance(data.get(name), dict) else {}


def _yaml(text: str) -> object:
    if yaml is None:
        raise ValueError("front matter in YAML needs PyYAML")
    return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))


#: Front matter in JSON, which PyYAML reads many times slower.  Numbers are what YAML takes them for; it has no NaN or Infinity of JSON's spelling.
_JSON = json.JSONDecoder(parse_float=_yaml if yaml else None, parse_constant=str)


def front_matter(head: str) -> object:
    """The front matter of a file: JSON if it is that, else YAML; None if it is neither."""
    try:
        return _JSON.decode(head)
    except (ValueError, RecursionError):
        pass
    try:
        return _yaml(head)
    except Exception:
        return None


def parse_card(text: str) -> dict:
    """A card file's columns; ``issue`` tells why it is none."""
    head, _, body = text.removeprefix("---").partition("\n---")
    data = front_matter(head) if text.startswith("---") else None
    if not isinstance(data, dict):
        return {"issue": "no-front-matter"}
    rules, hints, how, scope = (_block(data, n) for n in ("criteria", "engine_hints", "recall", "scope"))
    modes, aliases = _block(rules, "intent_modes"), data.get("aliases") or how.get("aliases")
    said = {"card_id": data.get("id"), "status": data.get("status"), "title": data.get("title") or data.get("id"), "category": data.get("category"), "summary": data.get("summary")}
    said |= {"recall_policy": how.get("policy"), "risk": how.get("risk"), "confidence": how.get("confidence"), "level": scope.get("level") or "global", "project_key": scope.get("project_key"), "module_path": scope.get("module_path"), "body": body.strip()}
    out: dict = {k: None if v is None else str(v) for k, v in said.items()}
    out |= {"triggers": _list(how.get("triggers")) or _list(rules.get("use_when")), "negative_triggers": _list(rules.get("ignore_when")), "topics": _list(how.get("topics"))}
    out["aliases"] = [x for v in aliases.values() for x in _list(v)] if isinstance(aliases, dict) else _list(aliases)
    out |= {"required_any": _list(hints.get("positive")), "required_all": _list(hints.get("required_all")), "blocked": _list(hints.get("negative"))}
    out |= {"include": _list(modes.get("include")), "exclude": _list(modes.get("exclude"))}
    return out if out["card_id"] else {"issue": "no-id"}


def _some(*values: object) -> list[str]:
    """The first that holds anything."""
    return next((found for v in values if (found := _list(v))), [])


def parse_legacy_card(text: str) -> dict:
    """Columns of a card of the old form: fields at the top, under old or new names; ``issue`` tells why it is none."""
    head = text.removeprefix("---").partition("\n---")[0]
    data = front_matter(head) if text.startswith("---") else None
    if not isinstance(data, dict):
        return {"issue": "no-front-matter"}
    if data.get("schema"):
        return {"issue": f"declares-schema:{data['schema']}"}
    card = parse_card(text)
    if "issue" in card:
        return card
    rules, hints, how = (_block(data, n) for n in ("criteria", "engine_hints", "recall"))
    modes = data["intentModes"] if isinstance(data.get("intentModes"), dict) else _block(rules, "intent_modes")
    card |= {
        "triggers": _some(how.get("triggers"), data.get("triggers"), rules.get("use_when")),
        "negative_triggers": _some(rules.get("ignore_when"), data.get("negative_triggers"), data.get("negativeTriggers")),
        "topics": _some(how.get("topics"), data.get("topics")),
        "required_any": _some(hints.get("positive"), data.get("requiredSignals"), data.get("required_signals")),
        "required_all": _some(hints.get("required_all"), data.get("requiredAllSignals"), data.get("required_all_signals")),
        "blocked": _some(hints.get("negative"), data.get("blockedSignals"), data.get("blocked_signals")),
        "include": _list(modes.get("include")),
        "exclude": _list(modes.get("exclude")),
    }
    for column, names in {"recall_policy": ("recall_policy", "recallPolicy"), "risk": ("risk",), "confidence": ("confidence",)}.items():
        given = next((data[n] for n in names if data.get(n)), None)
        card[column] = str(given) if given else card[column]
    return card


def parse_cards(files: DataFrame, parse=parse_card) -> DataFrame:
    """Card columns of ``files`` (``file``, ``value``); broken ones keep their ``issue``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(c, pa.string()) for c in ("file", "issue", *TEXTS)] + [(c, pa.list_(pa.string())) for c in LISTS]
        for batch in batches:
            rows = [{"file": f} | parse(t or "") for f, t in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return files.select("file", "value").mapInArrow(run, SCHEMA)


def migration(files: DataFrame) -> DataFrame:
    """Plan for files that are no cards of today's form (``file``, ``value``): those of the old form with their columns, the others with
    the ``issue`` that keeps them as they are."""
    broken = parse_cards(files).where("issue is not null").select("file")
    return parse_cards(files.join(broken, "file", "left_semi"), parse_legacy_card)


def strict(cards: DataFrame) -> DataFrame:
    """Cards of a scan, none of which may have an issue: the job fails at the first that has."""
    said = F.concat(F.lit("invalid card "), "file", F.lit(": "), "issue")
    return cards.withColumn("issue", F.when(F.col("issue").isNull(), F.col("issue")).otherwise(F.raise_error(said).cast("string")))


def listed(cards: DataFrame, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cards by id, of one status if given, and issues by file."""
    fine = cards.where("issue is null")
    return (fine.where(F.col("status") == status) if status else fine).orderBy("card_id"), cards.where("issue is not null").select("file", "issue").orderBy("file")


def rule_section(body: Column) -> Column:
    """The fenced rule of a card's body; empty without one."""
    found = F.regexp_extract(body, rf"(?is)(?:^|\n){HEADINGS['rule'].replace(' ', chr(92) + 's+')}\s*\n+(`{{3,}})(?:text|markdown|md|agent-rule)?\s*\n(.*?)\n\1", 2)
    return F.trim(F.coalesce(found, F.lit("")))


def render_body(cards: DataFrame) -> DataFrame:
    """Cards with the ``body`` that people read: what for, when, when not, and the rule in a fence."""
    c = recall.with_defaults(cards)

    def items(values: Column, default: str) -> Column:
        said = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
        lines = F.transform(said, lambda v: F.concat(F.lit("- "), v))
        return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(f"- {default}"))

    rule = F.trim("rule")
    fence = F.when(F.contains(rule, F.lit("```")), "````").otherwise("```")
    parts = (
        F.lit(HEADINGS["summary"]), F.trim("summary"), F.lit(HEADINGS["criteria"]),
        F.concat_ws("\n", F.lit(HEADINGS["use"]), items(F.col("triggers"), "the task matches this card's workflow")),
        F.concat_ws("\n", F.lit(HEADINGS["ignore"]), items(F.col("negative_triggers"), "the task only talks about this card's workflow")),
        F.concat(F.lit(HEADINGS["policy"]), "recall_policy", F.lit("。\n"), F.lit(HEADINGS["risk"]), "risk", F.lit("。")),
        F.lit(HEADINGS["rule"]), F.concat(fence, F.lit("text\n"), rule, F.lit("\n"), fence),
    )
    return c.withColumn("body", F.concat_ws("\n\n", *parts))


def index(cards: DataFrame) -> DataFrame:
    """What recall reads of active cards."""
    c = recall.with_defaults(cards).where("status = 'active'")
    return c.select(*[F.col(n) if n in c.columns else F.lit(None).cast("string").alias(n) for n in INDEXED])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index written as one JSON document with the list ``experiences``."""
    shape = "struct<" + ",".join(f"{c}:{'array<string>' if c in LISTS else 'string'}" for c in INDEXED) + ">"
    return spark.read.schema(f"experiences array<{shape}>").json(path, multiLine=True).select(F.inline("experiences"))


def starters(spark: SparkSession) -> DataFrame:
    """The cards that a new library begins with."""
    rows = [
        ("starter-goal-execution", "Carry a started goal through", "Execution", "When a goal is started in earnest, do and verify all of it instead of a first slice.", "State scope and acceptance, work through every item, verify each by its real entry, and report what is open.", ["/goal", "create a goal and start now", "execute the goal and verify it"], ["explain goals", "business goal"], ["goal", "execution"], ["goal_execute"], ["goal_example_discussion", "business_goal_discussion", "explain_only"], ["execute"], ["discuss", "explain"], "must", "high"),
        ("starter-real-entry", "Validate through the real entry", "Validation", "Delivery is proven by the entry that people use, not by internal calls.", "Exercise the entry that the user will use, look at its output and side effects, and keep fixtures away from real data.", ["verify this end to end", "is this really usable", "validate the user flow"], ["unit-only helper change"], ["validation", "delivery"], [], [], [], [], "should", "high"),
        ("starter-root-cause", "Fix the cause, keep it simple", "Code", "Remove the reason of a fault and stale branches rather than adding another fallback.", "Keep modules cohesive, delete what is superseded, and leave one source of truth.", ["fix the root cause", "clean up the implementation", "remove compatibility clutter"], ["throwaway script"], ["architecture", "maintenance"], ["architecture_quality"], [], [], [], "should", "medium"),
    ]
    names = "card_id string, title string, category string, summary string, rule string, triggers array<string>, negative_triggers array<string>, topics array<string>, required_any array<string>, blocked array<string>, include array<string>, exclude array<string>, recall_policy string, risk string"
    return recall.with_defaults(spark.createDataFrame(rows, names)).withColumn("level", F.lit("global"))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """All card files below a folder with their columns; broken ones keep their ``issue``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return parse_cards(files.select(F.col("_metadata.file_path").alias("file"), "value"))


def card_markdown(cards: DataFrame) -> DataFrame:
    """``card_id`` and ``markdown`` that ``parse_card`` reads back (front matter in JSON)."""
    c = recall.with_defaults(cards)
    have = lambda name: F.col(name) if name in cards.columns else F.lit(None).cast("string")
    modes = F.struct("include", "exclude")
    front = F.struct(
        F.col("card_id").alias("id"), "status", "title", "category", "summary",
        F.struct(F.col("triggers").alias("use_when"), F.col("negative_triggers").alias("ignore_when"), modes.alias("intent_modes")).alias("criteria"),
        F.struct(F.col("required_any").alias("positive"), "required_all", F.col("blocked").alias("negative")).alias("engine_hints"),
        F.struct(F.col("recall_policy").alias("policy"), "risk", "confidence", "triggers", "topics").alias("recall"), "aliases",
        F.struct(have("level").alias("level"), have("project_key").alias("project_key"), have("module_path").alias("module_path")).alias("scope"),
    )
    return c.select("card_id", F.concat(F.lit("---\n"), F.to_json(front), F.lit("\n---\n"), F.coalesce(have("body"), F.lit(""))).alias("markdown"))


# ---------------------------------------------------------------- library


def union_libraries(**scopes: DataFrame) -> DataFrame:
    """Cards of several libraries with ``library_scope``; columns that one lacks are null there."""
    out = None
    for scope, cards in scopes.items():
        part = cards.withColumn("library_scope", F.lit(scope))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def find(cards: DataFrame, card_id: str) -> DataFrame:
    """A card by id: the active one, else the draft, else the archived one."""
    rank = F.array_position(F.array(*map(F.lit, ("active", "draft", "archived"))), F.col("status"))
    return cards.where(F.col("card_id") == card_id).orderBy(F.when(rank == 0, 9).otherwise(rank)).limit(1)


def upsert(cards: DataFrame, newer: DataFrame) -> DataFrame:
    """Cards with the rows of ``newer`` in place of those of the same id."""
    return cards.join(newer.select("card_id").distinct(), "card_id", "left_anti").unionByName(newer, allowMissingColumns=True)


def add_missing(cards: DataFrame, starters: DataFrame) -> DataFrame:
    """Cards and those starters whose id is not there yet."""
    return cards.unionByName(starters.join(cards.select("card_id"), "card_id", "left_anti"), allowMissingColumns=True)


def patch(cards: DataFrame, changes: DataFrame) -> DataFrame:
    """Cards with the non-null values of the patchable columns of ``changes``, and nulls where its ``cleared`` (an array of
    column names) says so.  Several changes of one card are applied one after another in order of ``place``, if there is
    such a column, else of their values: later ones win, column by column."""
    names = [c for c in changes.columns if c in PATCHABLE and c in cards.columns]
    cleared = F.coalesce("cleared", F.array().cast("array<string>")) if "cleared" in changes.columns else F.array().cast("array<string>")
    order = F.struct("place") if "place" in changes.columns else F.struct(*names)
    told = lambda c: F.col(c).isNotNull() | F.array_contains(cleared, c)
    last = changes.groupBy("card_id").agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(told(c), order)).alias(f"__{c}") for c in names])
    return cards.join(last, "card_id", "left").select(*[F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in cards.columns])


def trigger_contract(cards: DataFrame) -> DataFrame:
    """Violations (``card_id``, ``trigger_index``, ``trigger``, ``code``, ``signals``) of the rule that each trigger of a card gives
    the signals that the card asks for, none that it blocks and none that aims at them."""
    c = recall.with_defaults(cards)
    triggers = c.select("card_id", F.posexplode("triggers").alias("trigger_index", "trigger"))
    said = G.prompt_signals(triggers, "card_id", "trigger_index", "trigger", text="trigger")
    rows = said.join(c.select("card_id", F.array_distinct("required_any").alias("any"), F.array_distinct("required_all").alias("all"), F.array_distinct("blocked").alias("blocked")), "card_id")
    seen, positive = G.ids(F.col("signals")), G.ids(F.col("signals"), "positive")
    routed = F.array_union("any", "all")
    none = F.array().cast("array<string>")
    checks = {
        "required-signals-missing": F.when(F.arrays_overlap("any", positive), none).otherwise(F.col("any")),
        "required-all-signals-missing": F.array_except("all", positive),
        "blocked-signal-detected": F.array_intersect("blocked", seen),
        "targeted-negative-suppression": F.filter(G.ids(F.col("signals"), "negative"), lambda i: F.arrays_overlap(G.targets_of(i), routed)),
    }
    found = F.array(*[F.struct(F.lit(code).alias("code"), terms.alias("signals")) for code, terms in checks.items()])
    return rows.select("card_id", "trigger_index", "trigger", F.inline(F.filter(found, lambda x: F.size(x["signals"]) > 0)))


def promotable(cards: DataFrame) -> DataFrame:
    """``card_id`` and ``issues`` of drafts: unknown signals, and triggers that break the contract with the card's signals."""
    drafts = recall.with_defaults(cards).where("status = 'draft'")
    unknown = G.unknown_ids(F.concat(F.array_union("required_any", "required_all"), F.col("blocked")))
    broken = trigger_contract(drafts).groupBy("card_id").agg(F.sort_array(F.collect_list(F.concat_ws(":", "code", F.col("trigger_index").cast("string"), F.array_join("signals", "+")))).alias("broken"))
    issues = F.concat(F.transform("unknown", lambda s: F.concat(F.lit("unknown-signal:"), s)), F.coalesce("broken", F.array().cast("array<string>")))
    return drafts.select("card_id", unknown.alias("unknown")).join(broken, "card_id", "left").select("card_id", issues.alias("issues"))


def set_status(cards: DataFrame, ids: DataFrame, status: str, reason: Column | None = None) -> DataFrame:
    """Cards with ``status`` (and ``archived_reason``) changed for the ids of ``ids``."""
    hit = cards.join(ids.select("card_id", F.lit(True).alias("__hit")).distinct(), "card_id", "left")
    kept = F.col("archived_reason") if "archived_reason" in cards.columns else F.lit(None).cast("string")
    changed = {"status": F.when(F.col("__hit"), status).otherwise(F.col("status"))}
    if reason is not None:
        changed["archived_reason"] = F.when(F.col("__hit"), reason).otherwise(kept)
    return hit.withColumns(changed).drop("__hit")


def promote(cards: DataFrame, ids: DataFrame) -> DataFrame:
    """Drafts among the ids that have no issue become active."""
    ready = promotable(cards).where(F.size("issues") == 0).join(ids.select("card_id"), "card_id", "left_semi")
    return set_status(cards, ready, "active")


def write_table(cards: DataFrame, path: str) -> None:
    """Write a card table, one folder per status, so that recall reads active cards alone."""
    cards.write.mode("overwrite").partitionBy("status").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append events to a log of JSON lines, one a row."""
    events.write.mode("append").json(path)


def operation(spark: SparkSession, name: str, **details: object) -> DataFrame:
    """An operation as an event for the log."""
    told = [(name, json.dumps(details, sort_keys=True, default=str))]
    return spark.createDataFrame(told, "operation string, details string").select(F.lit("operation").alias("kind"), "operation", "details", F.current_timestamp().alias("created_at"))
