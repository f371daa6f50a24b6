"""Steps whose work must not outgrow their input: one test for each finding of the third review."""

from pyspark.sql import functions as F

from tessera.functions import signals
from tessera.operators import recall, selection
from tessera.plans import registry
from tessera.sources import cards, hooks

SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- F1


def test_front_matter_in_json_is_read_as_json(spark):
    head = '{"id":"a","title":"x\x7f\u2028y","summary":"\\ud83d\\ude00","recall":{"policy":1e5,"risk":1.50,"confidence":NaN}}'
    card = cards.parse_card(f"---\n{head}\n---\nbody")
    assert [card[c] for c in ("card_id", "title", "summary", "recall_policy", "risk", "confidence", "body")] == ["a", "x\x7f\u2028y", "\U0001f600", "1e5", "1.5", "NaN", "body"]
    assert cards.parse_card("---\nid: a\ntitle: 'x'\n---\n")["title"] == "x" and cards.parse_card("---\n" + "[" * 5000 + "\n---\n") == {"issue": "no-front-matter"}
    assert registry.queries()["card_round_trip"](spark, SF).rdd.getNumPartitions() == 4  # dealt, however few files



# ---------------------------------------------------------------- F2


def test_prompts_of_equal_text_are_recalled_once(spark):
    texts = ["git push the old bolt", "please look at the old bolt", None, "", "nothing"]
    prompts = spark.createDataFrame([(10 * k + i, t, "x/y" if i == 2 else None) for i in range(4) for k, t in enumerate(texts)], "prompt_id long, text string, project_key string")
    cards = spark.createDataFrame([(1, "old bolt", "global", None), (2, "bolt old", "project", "x/y")], "card_id long, title string, level string, project_key string")
    keep = []
    found = {(r["prompt_id"], r["card_id"]): (r["score"], r["rank"]) for r in recall.match(prompts, cards, threshold=20.0, keep=keep).collect()}
    assert [t.count() for t in keep if "own_project_key" in t.columns] == [2 * len(texts)]  # one a text and place
    apart = {}
    for i in range(4):  # each of the equal prompts alone
        apart |= {(r["prompt_id"], r["card_id"]): (r["score"], r["rank"]) for r in recall.match(prompts.where(F.col("prompt_id") % 10 == i), cards, threshold=20.0).collect()} if i in (0, 2) else {}
    assert {k: v for k, v in found.items() if k[0] % 10 in (0, 2)} == apart and {(k[0] + 1, k[1]): v for k, v in found.items() if k[0] % 10 == 0} == {k: v for k, v in found.items() if k[0] % 10 == 1}
    assert {k[1] for k in found if k[0] % 10 == 2} == {1, 2} and {k[1] for k in found if k[0] % 10 == 0} == {1}
    told = recall.diagnostics(recall.match_detailed(prompts, cards, threshold=20.0), prompts)
    assert {r["prompt_id"] for r in told.collect()} == {r["prompt_id"] for r in prompts.collect()}


# ---------------------------------------------------------------- F3


def _plain_compaction(reasons):
    seen, once = set(), []
    for r in reasons:
        if r[:2] + r[3:] not in seen:
            seen.add(r[:2] + r[3:])
            once.append(r)
    low, high = sorted((r for r in once if r[2] < 0), key=lambda r: r[2]), sorted((r for r in once if r[2] >= 0), key=lambda r: -r[2])
    return low[: selection.NEGATIVE_REASONS] + high[: selection.POSITIVE_REASONS]


def test_reasons_are_found_once_and_compacted_as_in_plain_python(spark):
    lists = [[(None if (k * i) % 7 == 0 else f"f{k * i % 5}", f"t{i % 4}", float((i * k) % 11 - 5), f"k{i % 3}") for i in range(n)] for k, n in ((1, 0), (2, 1), (3, 90), (5, 200))]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, reasons array<struct<field:string,term:string,weight:double,kind:string>>")
    got = {r["id"]: [tuple(x) for x in r["c"]] for r in df.select("id", selection.compact_reasons(F.col("reasons")).alias("c")).collect()}
    assert got == {k: _plain_compaction(x) for k, x in enumerate(lists)}
    made = df.select(selection.compact_reasons(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(i.alias("field"), i.alias("term"), i.alias("weight"), i.alias("kind")))).alias("c"))
    assert made._jdf.queryExecution().analyzed().toString().count("sequence(") == 1


# ---------------------------------------------------------------- F4


def test_atoms_are_sought_before_their_nearness(spark):
    told = ["the legacy path is retired and removed, only one source is left", "the legacy path" + " x" * 900 + " removed, only one source", "only one source", "start the codex goal now and execute it with proof", ""]
    low = spark.createDataFrame([(t,) for t in told], "low string").unionByName(spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("lower(coalesce(text, '')) AS low"))
    every = [c for s in signals.REGISTRY for c in s.compositions]
    pairs = [(signals._composed(F.col("low"), c), F.col("low").rlike(signals._together(c))) for c in every]
    r = low.select(*[F.count_if(~a.eqNullSafe(b)).alias(f"d{k}") for k, (a, b) in enumerate(pairs)], *[F.count_if(b).alias(f"n{k}") for k, (_, b) in enumerate(pairs)]).first()
    assert all(r[f"d{k}"] == 0 for k in range(len(pairs))) and sum(r[f"n{k}"] for k in range(len(pairs))) > 0


# ---------------------------------------------------------------- F5


def test_markers_meet_contexts_by_equality(spark):
    context = "😀 show 1 \nshow 12 x" + "y" * 57 + "show 7 " + "z" * 200 + "show 345 sho\tshow show 9"
    said = [(1, context), (2, "aaaa"), (2, "b"), (3, ""), (4, None), (5, "show 1 ")]
    asked = {1: ["show 1 ", "show 2 ", "show 7 ", "show 12 ", "show 345 sho\t", "show 9", "show show 9", "show 9 ", "z" * 150, "z" * 201, "😀", None], 2: ["aa", "aaaa", "aaaaa", "b", "ab"], 3: ["", "a"], 4: ["", "a"], 5: ["show 1 ", "show 1"], 6: ["a"]}
    rows = [(p, 100 * p + k, m) for p, texts in asked.items() for k, m in enumerate(texts)]
    contexts, matches = spark.createDataFrame(said, "prompt_id int, context string"), spark.createDataFrame(rows, "prompt_id int, card_id int, m string")
    for kept in (lambda m: True, lambda m: m is not None and m.startswith("show ")):
        found = {r["prompt_id"]: r["rendered"] for r in hooks.rendered_ids(matches.where(F.col("card_id").isin([k for _, k, m in rows if kept(m)])), contexts, F.col("m")).collect()}
        want = {}
        for p, k, m in rows:
            if kept(m) and m is not None and any(q == p and t is not None and m in t for q, t in said):
                want.setdefault(p, []).append(k)
        assert found == want
    plan = hooks.rendered_ids(matches, contexts, F.col("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(context" not in plan and "contains(context" not in plan.lower()


# ---------------------------------------------------------------- F6


def test_pairs_are_dealt_before_they_carry_phrases(spark):
    prompts, library = spark.createDataFrame([(1, "look at the old bolt")], "prompt_id long, text string"), spark.createDataFrame([(1, "old bolt")], "card_id long, title string")

    def nodes(plan):
        yield plan
        children = plan.children()
        for k in range(children.size()):
            yield from nodes(children.apply(k))

    scored = recall.score(prompts, library)
    dealt = [n.output().mkString(",") for n in nodes(scored._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert dealt and not any("p_title" in x for x in dealt)
    assert [r["card_id"] for r in scored.collect()] == [1]
