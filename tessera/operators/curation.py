"""Curation: candidates and decisions, source catalogues, protected sessions, audits, configuration drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.telemetry import latest

#: Decisions that change a card, and what a candidate then becomes.
STATES = {"accept": "applied", "merge": "merged", "reject": "rejected", "defer": "deferred"}


def preview(candidates: DataFrame, decisions: DataFrame, order: list[Column]) -> DataFrame:
    """Candidates with their latest decision (later wins) and ``state``; ``undecided`` without one."""
    last = latest(decisions, ["candidate_id"], order).select("candidate_id", "action", "rewrite")
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("action")]
    return candidates.join(last, "candidate_id", "left").withColumn("state", F.coalesce(state, F.lit("undecided")))


def overlay(rows: DataFrame, rewrite: str, columns: list[str]) -> DataFrame:
    """Columns, texts or arrays of texts, with the values that a JSON rewrite gives in their place."""
    kinds = dict(rows.dtypes)

    def value(c: str):
        found = F.get_json_object(rewrite, f"$.{c}")
        return F.coalesce(F.from_json(found, "array<string>") if kinds[c].startswith("array") else found, F.col(c))

    return rows.withColumns({c: value(c) for c in columns}).drop(rewrite)


def apply_plan(candidates: DataFrame, decisions: DataFrame, applied: DataFrame, cards: DataFrame, order: list[Column]) -> DataFrame:
    """``candidate_id``, ``outcome`` (draft, merge, skipped or error), ``why`` and ``target_card_id`` of each candidate under its latest decision
    (candidate_id, action, rewrite, target_card_id)."""
    last = latest(decisions, ["candidate_id"], order).select("candidate_id", "action", "rewrite", "target_card_id")
    done = applied.select("candidate_id", F.lit(True).alias("done")).distinct()
    known = cards.where("status in ('active', 'draft')").select(F.col("card_id").alias("target_card_id"), F.lit(True).alias("known")).distinct()
    rows = candidates.select("candidate_id").join(last, "candidate_id", "left").join(done, "candidate_id", "left").join(known, "target_card_id", "left")
    said = lambda outcome, why: F.struct(F.lit(outcome).alias("outcome"), F.lit(why).alias("why"))
    merge = F.col("action") == "merge"
    found = (
        F.when(F.col("done"), said("skipped", "already applied"))
        .when(F.col("action").isNull(), said("skipped", "no decision"))
        .when(F.col("action") == "reject", said("skipped", "rejected"))
        .when((F.col("action") == "rewrite") & F.col("rewrite").isNull(), said("error", "rewrite without payload"))
        .when(merge & F.col("target_card_id").isNull(), said("error", "merge without target"))
        .when(merge & F.col("known").isNull(), said("error", "merge target not found"))
        .when(merge, said("merge", None))
        .otherwise(said("draft", None))
    )
    return rows.select("candidate_id", found.alias("f"), "target_card_id").select("candidate_id", "f.outcome", "f.why", "target_card_id")


def run_state(runs: DataFrame, candidates: DataFrame, decisions: DataFrame, applied: DataFrame) -> DataFrame:
    """``run_id`` and ``state`` of each run: created, candidates_generated, decisions_recorded or applied_to_drafts (every candidate is
    applied or rejected)."""
    order = [F.desc("line")] if "line" in decisions.columns else [F.desc("action")]
    last = latest(decisions, ["run_id", "candidate_id"], order).select("run_id", "candidate_id", "action")
    done = applied.select("run_id", "candidate_id", F.lit(True).alias("done")).distinct()
    rows = candidates.select("run_id", "candidate_id").join(last, ["run_id", "candidate_id"], "left").join(done, ["run_id", "candidate_id"], "left")
    closed = F.coalesce(F.col("done"), F.lit(False)) | F.coalesce(F.col("action") == "reject", F.lit(False))
    totals = rows.groupBy("run_id").agg(F.count("*").alias("n"), F.count("action").alias("decided"), F.count_if("done").alias("applied"), F.count_if(closed).alias("closed"))
    state = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "created")
        .when((F.col("closed") == F.col("n")) & (F.col("applied") > 0), "applied_to_drafts")
        .when(F.col("decided") > 0, "decisions_recorded")
        .otherwise("candidates_generated")
    )
    return runs.select("run_id").join(totals, "run_id", "left").select("run_id", state.alias("state"))


def fenced(text: Column, info: str) -> Column:
    """A Markdown fence that is longer than any run of back quotes inside."""
    plain = F.rtrim(text)
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(plain, F.lit("(`{3,})"), 1), lambda x: F.length(x))), F.lit(2))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, F.lit(f"{info}\n"), plain, F.lit("\n"), fence)


def review(runs: DataFrame, candidates: DataFrame, decisions: DataFrame, order: list[Column]) -> DataFrame:
    """``run_id`` and ``markdown``: the page on which people judge a run's candidates (run_id, place, candidate_id, title, summary,
    triggers, negative_triggers, rule).  A run's page is one row."""
    last = latest(decisions, ["candidate_id"], order).select("candidate_id", "action", F.col("reason").alias("said"), "target_card_id", "rewrite")
    rows = candidates.join(last, "candidate_id", "left")
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    never = F.when(F.size("negative_triggers") > 0, F.concat(F.lit("\n\nNot for:\n"), bullets("negative_triggers"))).otherwise("")
    verdict = F.concat_ws(
        "\n",
        F.concat(F.lit("> Decision: "), F.coalesce("action", F.lit("open"))),
        F.when(F.col("action").isNull(), F.lit(">\n> accept / reject / rewrite / merge")),
        F.concat(F.lit("> Reason: "), F.nullif("said", F.lit(""))),
        F.concat(F.lit("> Merge into: "), "target_card_id"),
        F.concat(F.lit("> Rewrite: "), "rewrite"),
    )
    block = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## "), (F.col("place") + 1).cast("string"), F.lit(". "), "title"),
        F.lit("### Lesson"), F.col("summary"),
        F.lit("### When"), F.concat(F.when(F.size("triggers") > 0, bullets("triggers")).otherwise("- to be named"), never),
        F.lit("### Rule"), fenced(F.col("rule"), "agent-rule"),
        F.lit("### Decision"), verdict,
    )
    blocks = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("place", block.alias("block")))).alias("b"))
    page = F.concat_ws("\n\n", F.lit("# Review of drafts"), F.concat(F.lit("State: "), "state"), F.concat(F.lit("Run: "), F.col("run_id").cast("string")), F.transform("b", lambda x: x["block"]))
    return runs.join(blocks, "run_id", "left").select("run_id", F.concat(page, F.lit("\n")).alias("markdown"))


def not_applied(candidates: DataFrame, applied: DataFrame) -> DataFrame:
    return candidates.join(applied.select("candidate_id").distinct(), "candidate_id", "left_anti")


def merge_lesson(rule: Column, lesson: Column) -> Column:
    """The rule with a lesson appended, unless it holds it already."""
    has = F.contains(F.coalesce(rule, F.lit("")), F.trim(lesson))
    return F.when(F.coalesce(F.trim(lesson), F.lit("")) == "", rule).when(has, rule).otherwise(F.concat_ws("\n\n", F.nullif(F.trim(rule), F.lit("")), F.trim(lesson)))


def merge_cards(cards: DataFrame, candidates: DataFrame, lists: list[str]) -> DataFrame:
    """Cards with the lists and lessons of all candidates that target them (``target_card_id``, ``rule``)."""
    one = candidates.groupBy(F.col("target_card_id").alias("card_id")).agg(*[F.array_distinct(F.flatten(F.sort_array(F.collect_list(c)))).alias(f"__{c}") for c in lists], F.array_join(F.sort_array(F.collect_set("rule")), "\n\n").alias("__rule"))
    none = F.array().cast("array<string>")
    merged = {c: F.array_union(F.coalesce(c, none), F.coalesce(f"__{c}", none)) for c in lists}
    return cards.join(one, "card_id", "left").withColumns(merged | {"rule": merge_lesson(F.col("rule"), F.col("__rule"))}).select(*cards.columns)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def incomplete(audits: DataFrame, required: list[str], strict: list[str], is_strict: Column) -> DataFrame:
    """Audits and the ``missing`` fields they must have; ``strict`` ones only where ``is_strict`` holds."""
    absent = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    checks = [F.when(absent(c), F.lit(c)) for c in required] + [F.when(is_strict & absent(c), F.lit(c)) for c in strict]
    return audits.withColumn("missing", F.array_compact(F.array(*checks))).where(F.size("missing") > 0)


def protected(sessions: DataFrame, refs: DataFrame, key: str = "session_id", n: int = 8) -> DataFrame:
    """Sessions whose id holds a protected reference (``ref``; null and empty ones protect nothing).

    Ids and references meet by grams, so the join is an equi-join however many there are: references of ``n`` characters or more
    by their first ``n``, shorter ones whole, against the id's grams of each length that occurs."""
    wanted = refs.where("ref <> ''").select("ref", F.substring("ref", 1, n).alias("gram")).distinct()
    lengths = [r[0] for r in wanted.select(F.length("gram")).distinct().collect()]  # n at most
    grams = [_grams(key, size) for size in lengths]
    if not grams:
        return sessions.limit(0)
    cut = sessions.select(F.col(key), F.explode(F.array_distinct(F.concat(*grams))).alias("gram"))
    hit = cut.join(wanted, "gram").where(F.contains(key, F.col("ref"))).select(key).distinct()
    return sessions.join(hit, key, "left_semi")


def _grams(key: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - size + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(size)))


def prune_reason(is_protected: Column, is_referenced: Column, age_days: Column, keep_days: int) -> Column:
    """Why a session may not be pruned; ``prunable`` if it may."""
    return F.when(is_protected, "protected").when(is_referenced, "referenced").when(age_days < keep_days, "recent").otherwise("prunable")


def compact(records: DataFrame, drop: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records without the texts of ``drop``, and how many bytes that saves."""
    slim = records.drop(*drop)
    size = lambda columns: F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns)))), F.lit(0))
    saved = records.agg(size(records.columns).alias("before"), size(slim.columns).alias("after")).withColumn("saved", F.col("before") - F.col("after"))
    return slim, saved


def category_counts(known: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards of every known category, zero included, and of categories that nobody registered."""
    n = cards.groupBy("category").agg(F.count("*").alias("cards"))
    both = known.select("category", F.lit(True).alias("registered")).join(n, "category", "full_outer")
    return both.select("category", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("cards", F.lit(0)).alias("cards"))


def sorted_categories(counts: DataFrame, collation: str = "zh") -> DataFrame:
    """Most cards first, then by name as a reader of Chinese sorts (Han by pinyin, then Latin); names that collate alike by code point."""
    return counts.orderBy(F.desc("cards"), F.collate("category", collation), "category")


def upsert_category(categories: DataFrame, named: DataFrame, now: Column) -> DataFrame:
    """Categories (category, description, source, created_at, updated_at) with those of ``named`` (category, description) registered by
    hand: a known one keeps when it was made, and its description unless a new one is given."""
    old = categories.select("category", F.col("description").alias("had"), F.col("created_at").alias("made"))
    clean = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("未分类"))
    new = named.select(clean.alias("category"), "description").groupBy("category").agg(F.max("description").alias("description")).join(old, "category", "left")
    text = F.coalesce(F.nullif("description", F.lit("")), "had", F.lit(""))
    rows = new.select("category", text.alias("description"), F.lit("manual").alias("source"), F.coalesce("made", now).alias("created_at"), now.alias("updated_at"))
    return categories.join(new, "category", "left_anti").select(*rows.columns).unionByName(rows)


def set_config(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Flattened settings (dotted ``key``, ``value``) with changes applied: a key that is set takes its value and replaces
    all keys below and above it; a null value removes it."""
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("key", r"\."))), lambda i: F.array_join(F.slice(F.split("key", r"\."), 1, i), "."))
    own = changes.select(F.col("key").alias("changed"))
    covered = settings.withColumn("changed", F.explode(above)).join(own, "changed", "left_semi").select("key")
    upper = changes.select(F.explode(above).alias("key"))
    kept = settings.join(covered.unionByName(upper).distinct(), "key", "left_anti")
    return kept.unionByName(changes.where("value is not null").select("key", "value"))


def config_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``key`` and ``change`` of flattened settings (key, value) that were added, removed or changed."""
    both = before.select("key", F.col("value").alias("old"), F.lit(1).alias("b")).join(after.select("key", F.col("value").alias("new"), F.lit(1).alias("a")), "key", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select("key", "old", "new", "change")


def index_drift(active: DataFrame, indexed: DataFrame, key: str = "card_id") -> DataFrame:
    """Ids that an index lacks (``not-indexed``) or holds in vain (``not-active``)."""
    both = active.select(key, F.lit(1).alias("a")).distinct().join(indexed.select(key, F.lit(1).alias("i")).distinct(), key, "full_outer").where("a is null or i is null")
    return both.select(key, F.when(F.col("i").isNull(), "not-indexed").otherwise("not-active").alias("issue"))


def suggestions(names: DataFrame, known: DataFrame, edits: int = 3) -> DataFrame:
    """``name``, ``suggestion`` and ``edits`` of known names within a few edits of each name; rows meet by the neighbouring lengths
    that so few edits allow."""
    near = known.select(F.col("name").alias("suggestion"), F.explode(F.sequence(F.length("name") - edits, F.length("name") + edits)).alias("size")).distinct()
    pairs = names.select("name", F.length("name").alias("size")).distinct().join(near, "size").where("name <> suggestion")
    return pairs.withColumn("edits", F.levenshtein("name", "suggestion")).where(F.col("edits") <= edits).select("name", "suggestion", "edits")


def doctor(cards: DataFrame, indexed: DataFrame, issues: DataFrame, dead_lines: DataFrame | None = None, settings: DataFrame | None = None, sources: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Findings (layer, severity, message) of a library: broken and repeated cards, drift of its index, broken log lines (file, line),
    settings (key, value) out of range, sources (session_id, source_exists) that are gone, and a silent event log."""

    def said(rows: DataFrame, layer: str, severity: str, message: Column) -> DataFrame:
        return rows.select(F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), message.alias("message"))

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    found = said(issues, "cards", "error", text(F.col("card_id"), ": ", F.col("issue")))
    found = found.unionByName(said(duplicates(cards.where("status = 'active'"), "card_id"), "cards", "error", text(F.col("card_id"), ": ", F.col("n"), " active cards")))
    drift = index_drift(cards.where("status = 'active'"), indexed)
    found = found.unionByName(said(drift, "index", "warning", text(F.col("issue"), ": ", F.col("card_id"))))
    if dead_lines is not None:
        found = found.unionByName(said(dead_lines, "log", "error", text(F.col("file"), ":", F.col("line"), ": invalid JSON")))
    if settings is not None:
        bad = settings.where(F.col("value").try_cast("double").isNull() | (F.col("value").try_cast("double") < 0))
        found = found.unionByName(said(bad, "config", "error", text(F.col("key"), ": not a number of 0 or more")))
    if sources is not None:
        found = found.unionByName(said(sources.where("not source_exists"), "sources", "warning", text(F.col("session_id"), ": source is gone")))
    if events is not None:
        found = found.unionByName(said(events.agg(F.count("*").alias("n")).where("n = 0"), "events", "info", F.lit("no events yet")))
    return found
