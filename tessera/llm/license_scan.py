"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser
evaluates licence expressions.

One automaton holds all phrases and tags as words between spaces, so matches start and end at
words.  A tag's expression (``and``, ``or``, ``with``, parentheses) is read from the text behind it,
brought to postfix order and evaluated to labels and a usability: ``and`` takes the least,
``or`` the greatest, an exception after ``with`` raises it a little.  A document's score is the
least over its notices and expressions, 0 without any.

Defined cases: a null text counts as empty and gives 0 words, no places, null first and last
word, empty labels and score 0; a malformed expression keeps the labels of its known identifiers;
repeated rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import add_columns, table

QUERY = "op9_license_scan"

#: Phrases that count as base places, and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases and their labels.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: Words of the tags that a licence expression follows.
TAGS = ("spdx license identifier", "license expression")
#: What identifiers begin with, and their labels; a version may follow, and then any parts.
IDENTIFIERS = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("mpl", "mpl"), ("isc", "isc"), ("bsl", "boost"), ("cc-by", "cc-by"), ("cc0", "public-domain"), ("unlicense", "public-domain"))
#: Usability of a label's text: 1 free for any use, 0 not usable.
USABILITY = {"mit": 1.0, "bsd": 1.0, "isc": 1.0, "boost": 1.0, "public-domain": 1.0, "apache": 0.95, "cc-by": 0.9, "cc": 0.7, "mpl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "reserved": 0.0}
UNKNOWN = 0.4
EXCEPTION = 0.1
#: ASCII letters in lower case, digits and all bytes of other letters stay; the rest are spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
FAMILY_END = re.compile(r"v?[0-9.]*(?:[-+]|$)")
RANK = {"or": 1, "and": 2, "with": 3}


@functools.lru_cache(maxsize=4)
def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(f" {p} ", p)
    found.make_automaton()
    return found


def words_of(text: str | None) -> list[str]:
    """Words of a text with A-Z in lower case; all characters beyond ASCII belong to words."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass").split(" ") if w] if text else []


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: identifiers and operators in postfix order; unbalanced parentheses are dropped."""
    out: list[str] = []
    stack: list[str] = []
    for t in tokens:
        op = t.lower()
        if op in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[op]:
                out.append(stack.pop())
            stack.append(op)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        else:
            out.append(t)
    return out + [t for t in reversed(stack) if t != "("]


def label_of(identifier: str) -> str | None:
    """Label of an identifier whose family stands whole: ``apache2`` and ``Apache-2.0`` are ``apache``, ``apachefoo`` is not."""
    low = identifier.lower()
    return next((label for family, label in IDENTIFIERS if low.startswith(family) and FAMILY_END.match(low, len(family))), None)


def expression_tokens(line: str) -> list[str]:
    """The tokens that can belong to one expression: operands and operators take turns."""
    out: list[str] = []
    operand = True
    for t in TOKEN.findall(line):
        op = t.lower()
        if op in RANK:
            if operand:
                break
            operand = True
        elif t == "(":
            if not operand:
                break
        elif t == ")":
            if operand:
                break
        else:
            if not operand:
                break
            operand = False
        out.append(t)
    return out


def evaluate(line: str) -> tuple[set[str], float] | None:
    """Labels and usability of the expression that a line begins with."""
    stack: list[tuple[set[str], float]] = []
    labels: set[str] = set()
    for t in postfix(expression_tokens(line)):
        if t in RANK:
            if len(stack) < 2:
                continue
            (la, a), (lb, b) = stack[-2:]
            del stack[-2:]
            if t == "with":
                stack.append((la, min(1.0, a + EXCEPTION)))
            else:
                stack.append((la | lb, min(a, b) if t == "and" else max(a, b)))
        else:
            label = label_of(t)
            known = {label} if label else set()
            stack.append((known, USABILITY[label] if label else UNKNOWN))
    if not stack:
        return None
    for known, _ in stack:
        labels |= known
    return labels, min(value for _, value in stack)


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = words_of(text)
    joined = f" {' '.join(words)} "
    base: set[str] = set()
    more: set[str] = set()
    values: list[float] = []
    n = word = seen = 0
    first = last = None
    tagged = False
    for end, phrase in automaton((*BASE, *MORE, *TAGS)).iter(joined):
        if phrase in TAGS:
            tagged = True
            continue
        label = BASE.get(phrase) or MORE[phrase]
        values.append(USABILITY[label])
        if phrase not in BASE:
            more.add(label)
            continue
        start = end - len(phrase)  # of the phrase's first word
        if start >= seen:
            word += joined.count(" ", seen, start)
            at = word - 1
        else:
            at = joined.count(" ", 0, start) - 1
        seen = max(seen, start)
        n += 1
        base.add(label)
        first, last = at if first is None else min(first, at), at if last is None else max(last, at)
    if tagged:
        for m in TAG_LINE.finditer(text):
            found = evaluate(m.group(1))
            if found:
                more |= found[0]
                values.append(found[1])
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), min(values, default=0.0)


TAG_LINE = re.compile("(?:" + "|".join(r"[^0-9A-Za-z\x80-\U0010ffff]+".join(t.split()) for t in TAGS) + r")[ \t:=\"']*([^\r\n]*)", re.I)

_NEW = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}


def scan_licenses(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Add the columns of ``scan`` to all rows."""
    return add_columns(docs, _NEW, lambda texts: list(zip(*map(scan, texts), strict=True)), carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
