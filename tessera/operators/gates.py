"""Ordered gates, scopes and classification rules: the first that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Reason of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in checks])


def recall_gate(card: dict[str, Column], seen: Column, positive: Column, modes: Column, negatives: Column, aiming: Column, known: list[str]) -> Column:
    """Why a card is out, in the fixed order of checks: a struct of ``field``, the offending ``term`` (ids joined by +) and
    ``kind``; null if it stays.

    ``card`` has the arrays blocked, required_any, required_all, include and exclude; ``seen`` and
    ``positive`` are the prompt's signal ids, ``modes`` its intents, ``negatives`` the card's negative triggers
    that occur, ``aiming`` the prompt's negative signals that aim at what the card requires.
    """
    ids = F.array(*map(F.lit, known))
    some = lambda a: F.size(a) > 0
    own = {k: F.array_distinct(v) for k, v in card.items()}
    any_, all_, include, exclude = own["required_any"], own["required_all"], own["include"], own["exclude"]
    hit_any, missing_all = F.array_intersect(any_, positive), F.array_except(all_, positive)
    routed = some(hit_any) | some(F.array_intersect(all_, positive))
    included, excluded = F.array_intersect(include, modes), F.array_intersect(exclude, modes)
    none = F.array().cast("array<string>")
    checks = (  # what offends, where any of it does
        ("blockedSignals.unknown", F.array_except(own["blocked"], ids), "unknown-blocked-signal"),
        ("blockedSignals", F.array_intersect(own["blocked"], seen), "blocked-signal"),
        ("requiredSignals.unknown", F.array_except(any_, ids), "unknown-required-signal"),
        ("requiredAllSignals.unknown", F.array_except(all_, ids), "unknown-required-signal"),
        ("requiredSignals", F.when(some(hit_any), none).otherwise(any_), "missing-required-any"),
        ("requiredAllSignals", missing_all, "missing-required-all"),
        ("intentModes.exclude", F.when(some(included) & routed, none).otherwise(excluded), "excluded-intent"),
        ("intentModes.include", F.when(some(included), none).otherwise(include), "missing-included-intent"),
        ("negativeTriggers", F.slice(negatives, 1, 1), "negative-exact"),
        ("ruleSignals.negative", aiming, "negative-route"),
    )
    return F.coalesce(*[F.when(some(terms), F.struct(F.lit(field).alias("field"), F.array_join(terms, "+").alias("term"), F.lit(kind).alias("kind"))) for field, terms, kind in checks])


def gate_reason(gate: Column) -> Column:
    """The gate's result as ``field:term``."""
    return F.concat(gate["field"], F.lit(":"), gate["term"])


def filtered_by_applicability(cards: DataFrame, project: Column, module: Column) -> DataFrame:
    """Cards of ``cards`` (``level``, ``project_key``, ``module_path``) that do not apply in one project's module."""
    return cards.where(~applies(F.col("level"), F.col("project_key"), F.col("module_path"), project, module))


def module_path(path: Column) -> Column:
    """A module path without ``./`` and trailing slashes; ``.`` is the root."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\", "/"), r"^(\./)+", ""), "/+$", "")
    return F.when(plain == ".", "").otherwise(plain)


def within_module(path: Column, target: Column) -> Column:
    """An empty target holds everything; else equality or a whole-directory prefix."""
    p, t = module_path(path), module_path(target)
    return (t == "") | (p == t) | F.startswith(p, F.concat(t, F.lit("/")))


def family_key(project: Column) -> Column:
    """host/owner where the first part is a host, else all but the last part."""
    parts = F.split(project, "/")
    host = F.contains(F.get(parts, 0), F.lit("."))
    keep = F.when(host, F.least(F.size(parts), F.lit(2))).otherwise(F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.slice(parts, 1, keep), "/")


def applicable(prompts: DataFrame, cards: DataFrame) -> DataFrame:
    """Prompts (prompt_id, project_key, module_path) and the cards (card_id, level, project_key,
    module_path) that apply to them.  Project and family cards meet prompts by an equi-join; global
    cards need no pairs and come back with a null prompt_id.
    """
    p = prompts.select("prompt_id", F.col("project_key").alias("own"), family_key(F.col("project_key")).alias("family"), F.col("module_path").alias("at"))
    by_project = p.join(cards.where("level = 'project'"), F.col("own") == F.col("project_key"))
    by_family = p.join(cards.where("level = 'project-family'"), F.col("family") == family_key(F.col("project_key")))
    scoped = by_project.unionByName(by_family).where(within_module(F.col("at"), F.col("module_path"))).select("prompt_id", "card_id")
    everyone = cards.where("level = 'global'").select(F.lit(None).cast(dict(prompts.dtypes)["prompt_id"]).alias("prompt_id"), "card_id")
    return scoped.unionByName(everyone)


def applies(level: Column, project: Column, module: Column, own: Column, at: Column) -> Column:
    """Whether a card of this level, project and module applies to a prompt of project ``own`` at module
    ``at``.  A card without a level is global; a scoped one needs both projects."""
    same = F.when(level == "project", project == own).when(level == "project-family", family_key(project) == family_key(own))
    known = (own != "") & (project != "")
    return F.coalesce(level == "global", F.lit(True)) | F.coalesce(same & known & within_module(at, module), F.lit(False))


def classify(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern occurs in the lower-cased text."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(pattern), F.lit(label)) for pattern, label in rules], F.lit(default))


# Categories and the words that give them, in order; the last is the default.
CATEGORY_RULES = (
    ("(skill|docx|contract|email|邮件|合同|开源)", "开源 Skill 经验蒸馏"),
    ("(recall|retrieval|hook|经验|召回)", "经验召回"),
    ("(ui|ux|产品|界面|页面|交互|console|design)", "产品与 UI"),
    ("(frontend|react|form|css|browser|responsive|前端|表单|浏览器|响应式)", "前端工程"),
    ("(api|backend|server|database|后端|接口|数据库)", "后端与 API"),
    ("(security|auth|secret|permission|安全|权限|隐私|密钥)", "安全"),
    ("(test|e2e|playwright|验收|测试|冒烟)", "测试验收"),
    ("(deploy|runtime|publish|package|git|运行时|发布|部署|打包)", "运行时与发布"),
    ("(performance|latency|stats|observability|性能|观测|统计)", "性能与观测"),
    ("(docs|readme|roadmap|文档|开源)", "文档与开源"),
)
DEFAULT_CATEGORY = "未分类"


def infer_category(*texts: Column) -> Column:
    """Category of a card from its title, topics, triggers, summary and rule."""
    return classify(F.concat_ws(" ", *texts), list(CATEGORY_RULES), DEFAULT_CATEGORY)
