"""Recall by its definitions in plain Python: one prompt and one card at a time, no shared code but the fixed tables and patterns."""

import math
import re

from tessera.functions import prompt as P
from tessera.functions import signals as G
from tessera.functions import text as T
from tessera.operators import corpus, evidence

A = re.ASCII
STOP = set(T.STOPWORDS)


def distinct(values):
    return list(dict.fromkeys(values))


def half_up(x, digits=2):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def bounded(p):
    return re.compile(T.ascii_bounds(p), A)


NEGATED = re.compile("(?i)" + T.ascii_bounds(P.NEGATED), A)


def strip_negated(text):
    return NEGATED.sub(" ", text).strip(" ")


def strip_noise(text):
    text = bounded(T.STACK_FRAME).sub(" ", re.sub(T.FENCED, " ", text))
    return re.sub(r"\s+", " ", text, flags=A).strip(" ")


def searchable(text):
    assert "```" not in text, "code blocks have tests of their own"
    return strip_noise(text)


def plain(text):
    return re.sub(r"\s+", " ", text, flags=A).strip(" ").lower()


def tokens(text):
    out = []
    for w in re.findall(T.WORD, text.lower()):
        w = w.rstrip("./-")
        if w >= "一":
            out += [w] if len(w) <= 2 else [w, *(w[k : k + 2] for k in range(len(w) - 1))]
        else:
            out += [w] + ([p for p in re.split(r"[._/-]+", w) if len(p) > 1] if re.search(r"[._/-]", w) else [])
    return [t for t in out if t not in STOP]


def token_set(text):
    return distinct(tokens(text))


def holds(low, term):
    if re.search(f"[{T.HAN}]", term):
        return term in low
    return re.search(r"(?<![a-z0-9])" + r"\s+".join(map(re.escape, term.split())) + r"(?![a-z0-9])", low) is not None


def labels(low, table):
    return [k for k, terms in table.items() if any(holds(low, t) for t in terms)]


def head_tail(values, n):
    return values if len(values) <= n else values[: -(-n // 2)] + (values[-(n // 2) :] if n // 2 else [])


def commands(text):
    tools = {*T.COMMAND_NAMES, *T.OWN_COMMANDS}

    def begins(words, i):
        return words[i].lower() in tools and i + 1 < len(words) and re.match("[A-Za-z0-9_./:@=-]", words[i + 1]) is not None

    marks = text.split("`")
    out = [c for k, c in enumerate(marks) if k % 2 and k < len(marks) - 1 and begins(re.split(r"\s+", c.strip(" "), flags=A), 0)]
    for line in re.split("[\n;]", text):
        for k, clause in enumerate(re.split("[。`，,]", line)):
            words = re.split(r"\s+", clause.strip(" "), flags=A)
            starts = [i for i in range(len(words)) if begins(words, i) and (k == 0 if i == 0 else words[i - 1].lower() in T.COMMAND_VERBS)]
            out += [" ".join(words[starts[0] :])] if starts else []
    return distinct(c.strip(" ")[: T.COMMAND_CHARS] for c in out)


# ------------------------------------------------------------------ signals


def shows(text, s):
    direct = any(re.search("(?s)" + T.ascii_bounds(p), text, A) for p in s.patterns) and not s.instead
    return direct or any(together(text, c) for c in s.compositions)


def together(text, c):
    """Some atom begins, and all others begin behind it, near enough and few sentences away."""
    begins = {a: [m.start() for m in re.finditer(f"(?s)(?={T.ascii_bounds(G.ATOMS[a])})", text, A)] for a in c.atoms}

    def fits(at, x):
        return at <= x <= at + c.span and len(re.findall(f"[{re.escape(G.SENTENCE_END)}]+", text[at:x])) <= c.gap

    return any(all(any(fits(at, x) for x in begins[b]) for b in c.atoms if b != a) for a in c.atoms for at in begins[a])


def parts_of(text, pattern):
    return [p for p in (x.strip(" ") for x in re.split(pattern, text, flags=A | re.I)) if p]


def judged(text):
    seen = [s for s in G.REGISTRY if shows(text, s)]
    segments = parts_of(text, G.SEGMENT_BREAK)
    contexts = distinct(parts_of(text, G.CONTEXT_BREAK) + [m.group(0).strip(" ") for m in re.finditer(G.CURRENT_BLOCK, text, A | re.I)])
    by_id = {s.id: s for s in seen}  # parts are asked only for what the whole shows
    denied = set()
    for s in seen:
        own = [p for p in segments if shows(p, s)]
        if s.positive and own and all(any(re.search(q, p, A | re.I) for q in G.DENIED) and not (s.id in G.NO_DENIAL and re.search(G.NO_DENIAL[s.id], p, A | re.I)) for p in own):
            denied.add(s.id)
    hit, contextual = set(), set()
    for s in seen:
        if s.targets:
            pool = contexts + ([] if s.id == G.REFERENCE else segments)
            if any(any(t in by_id and shows(p, by_id[t]) for t in s.targets) and not shows(p, s) for p in pool):
                contextual.add(s.id)
            else:
                hit |= set(s.targets)
    return [s.id for s in seen if s.id not in denied | hit | contextual]


def signals(text):
    narrative, positive = strip_noise(text).lower(), strip_noise(strip_negated(text)).lower()
    raw = text.lower()
    lined = re.search(G.LINED, raw, A | re.I) or re.search(G.CURRENT_BLOCK, raw, A | re.I)
    found = judged(narrative)
    by_id = {s.id: s for s in G.REGISTRY}
    affirmed = found if positive == narrative else judged(positive)
    kept = [s.id for s in G.REGISTRY if any(re.search("(?s)" + T.ascii_bounds(p), narrative, A) for p in s.kept_if) or (s.keeps_compositions and any(together(narrative, c) for c in s.compositions))]
    back = [i for i in (judged(raw) if lined else []) if i in G.LINED_SIGNALS and i not in found]
    ids = [i for i in found if (not by_id[i].positive or i in affirmed or i in kept) and not (i == G.REFERENCE and G.LINED_SIGNALS[0] in back)] + back
    modes = set()
    for p in parts_of(positive, G.SEGMENT_BREAK):
        ours = {s.id for s in G.REGISTRY if shows(positive, s) and shows(p, s)}
        aimed = {s.id for s in G.REGISTRY if set(s.targets) & set(G.EXECUTION)}
        earnest = ours & set(G.EXECUTION) and not ours & aimed and not re.search(G.NO_EXECUTION, p, A | re.I)
        modes |= {m for m, patterns in G.INTENTS.items() if any(re.search(q, p, A | re.I) for q in patterns) and (m != "execute" or earnest)}
    return ids, [m for m in G.INTENT_MODES if m in modes and not ("execute" in modes and m in ("explain", "discuss"))]


# ------------------------------------------------------------------ prompts


def envelope(text):
    positive = strip_negated(text)
    low, said = searchable(positive).lower(), strip_noise(positive)
    ids, modes = signals(text)
    by_id = {s.id: s for s in G.REGISTRY}
    terms = distinct(t for i in ids if by_id[i].positive for t in (by_id[i].terms or i.split("_")))
    present = lambda terms: [t for t in terms if holds(low, t)]
    return {
        "summary": said[: T.SUMMARY_CHARS],
        "task_types": labels(low, P.TASK_TYPES),
        "operations": labels(low, P.OPERATIONS),
        "files": distinct(re.findall(T.PATH, positive, A)),
        "commands": commands(positive),
        "constraints": present(P.CONSTRAINTS),
        "risks": present(P.RISKS),
        "surfaces": present(P.SURFACES),
        "keywords": head_tail([t for t in token_set(low) if len(t) > 1], T.KEYWORDS),
        "negatives": distinct(m.strip(" ") for m in (x.group(0) for x in NEGATED.finditer(strip_noise(text))) if m.strip(" ")),
        "segments": distinct(s for s in (x.strip(" ") for x in re.split(T.SEGMENT_BREAK, said)) if len(s) > T.MIN_SEGMENT),
        "rule_signals": ids,
        "intent_modes": modes,
        "signal_terms": terms,
    }


def variants(e):
    out = [(e[k] if isinstance(e[k], str) else " ".join(e[k]), w) for k, w in P.VARIANT_WEIGHTS.items()]
    return [(t, w) for t, w in out + [(s, P.SEGMENT_WEIGHT) for s in head_tail(e["segments"], P.SEGMENTS)] if t]


# ------------------------------------------------------------------ scores


def fields(card):
    lines = lambda *names: "\n".join(x for n in names for x in card.get(n, []))
    return {"title": card["title"], "triggers": lines("triggers"), "aliases": lines("aliases"), "topics": lines("topics"), "intentModes": lines("include", "exclude"), "requiredSignals": "\n".join(distinct(card.get("required_any", []) + card.get("required_all", []))), "category": card["category"], "summary": card["summary"]}


def bm25f(plan, cards):
    posted = {c["card_id"]: {f: tokens(t) for f, t in fields(c).items()} for c in cards}
    average = {f: max(1.0, sum(len(p[f]) for p in posted.values()) / len(cards)) for f in corpus.FIELD_WEIGHTS}
    out = {}
    for key, own in posted.items():
        total = 0.0
        for token, weight in plan.items():
            wtf = sum(w * own[f].count(token) / (1 - corpus.B + corpus.B * len(own[f]) / average[f]) for f, w in corpus.FIELD_WEIGHTS.items())
            if wtf:
                df = sum(any(token in s for s in p.values()) for p in posted.values())
                total += weight * math.log(1 + (len(cards) - df + 0.5) / (df + 0.5)) * (corpus.K1 + 1) * wtf / (corpus.K1 + wtf)
        if any(t in s for s in own.values() for t in plan):
            out[key] = total
    return out


def term_in(text, own_tokens, term):
    if not term:
        return False
    if re.search(f"[{T.HAN}]", term):
        return term in text
    if re.fullmatch(r"[a-z0-9][a-z0-9._/-]*", term):
        return term in own_tokens
    return bool(token_set(term)) and re.search(r"(^|[^a-z0-9])" + r"\s+".join(map(re.escape, re.split(r"\s+", term))) + r"($|[^a-z0-9])", text) is not None


def field_evidence(field, text, query, query_tokens):
    found = []
    for phrase in distinct(p.strip(" ").lower() for p in re.split(T.PHRASE_BREAK, text) if p.strip(" ")):
        own = token_set(phrase)
        if not own:
            continue
        hits, exact = len([t for t in own if t in query_tokens]), term_in(query, query_tokens, phrase)
        coverage, multi = hits / len(own), len(own) >= 2 or len(re.findall(f"[{T.HAN}]", phrase)) >= 3
        short = exact and not multi and len(query_tokens) <= 2
        if exact and multi:
            value = evidence.EXACT[field] + min(10, 2 * len(own))
        elif short:
            value = max(evidence.SINGLE[field], 30 if field == "topics" else 44)
        elif exact:
            value = evidence.SINGLE[field]
        elif hits >= 2 and coverage >= 0.5:
            value = evidence.PARTIAL[field] * coverage
        else:
            value = evidence.PARTIAL[field] * 0.28 if hits == 1 and len(own) == 2 else 0
        if value:
            found.append((value, (exact and multi) or short or (hits >= 2 and coverage >= 0.58 and field in ("triggers", "aliases"))))
    found.sort(key=lambda x: -x[0])
    return (half_up(min(62, found[0][0] + 0.22 * sum(v for v, _ in found[1:3]))), found[0][1]) if found else (0.0, False)


def match(prompt, cards, threshold, limit=4):
    """Selected card ids in order, and why each other candidate lost."""
    e = envelope(prompt)
    said = variants(e)
    plan = {}
    for text, weight in said:
        for t in token_set(text):
            plan[t] = max(plan.get(t, 0), weight)
    query = plain(" ".join(t for t, _ in said))
    query_tokens = token_set(query)
    rows, reasons = [], {}
    for key, raw in bm25f(plan, cards).items():
        card = next(c for c in cards if c["card_id"] == key)
        f = fields(card)
        parts = [(n, *field_evidence(n, f[n], query, query_tokens)) for n in evidence.EXACT]
        shared = [t for t in token_set("\n".join(f[n] for n in evidence.EXACT)) if t in query_tokens]
        parts.append(("lexical", min(18.0, 6 + 2.5 * len(shared)) if len(shared) >= 2 else 0.0, False))
        score = 100 * (1 - math.prod(1 - v / 100 for _, v, _ in parts))
        score = half_up(min(100, max(0, score)))
        families = [n for n, v, _ in parts if v >= 8]
        strong = any(s and v >= 36 for _, v, s in parts)
        if score < threshold:
            reasons[key] = "below-threshold"
        elif not strong and len(families) < 2:
            reasons[key] = "insufficient-independent-evidence"
        else:
            rows.append({"id": key, "key": f"global:{key}", "raw": half_up(raw), "score": score, "strong": strong, "topic": card["topics"][0]})
    for by in ("raw", "score"):
        for k, r in enumerate(sorted(rows, key=lambda r: (-r[by], r["key"])), 1):
            r[f"r_{by}"] = k
    for r in rows:
        r["rank"] = half_up(1000 * (1 / (60 + r["r_raw"]) + 1 / (60 + r["r_score"])))
    order = lambda r: (-r["rank"], -r["score"], -r["raw"], r["key"])
    rows.sort(key=order)
    seen = {}
    for r in rows:
        n = seen[r["topic"]] = seen.get(r["topic"], -1) + 1
        if n:
            r["rank"] = half_up(r["rank"] * max(0.72, 1 - 0.12 * n))
    rows.sort(key=order)
    chosen = []
    for r in rows:
        if len(chosen) >= limit:
            reasons[r["id"]] = "limit"
        elif not chosen or r["strong"] or r["score"] >= max(threshold, rows[0]["score"] - 18):
            chosen.append(r["id"])
        else:
            reasons[r["id"]] = "confidence-gap"
    return chosen, reasons, e
