"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

A kind has a pattern, a validator and words that speak for it when they stand near a span.  Of each kind, matches
are leftmost and don't overlap; those that the validator refuses are dropped.  A span's score is its kind's,
raised by ``BOOST`` if one of the kind's words occurs within ``NEAR`` characters of it, at most 1.  Base
kinds (email, ip, card, phone) keep every confirmed span, whatever its score; of the others (iban, with its mod-97 check,
and id, a number in the form 3-2-4 that a word must speak for) a span counts from ``ACCEPT`` on.

Patterns take time linear in the text: an email is found from its ``@``, and no run of digits is entered twice.

Defined cases: null and empty texts have no spans; a part of an ip counts by its value, leading zeros aside; spans of different kinds may overlap; repeated rows
have equal spans; ``spans`` and ``redacted`` replace columns of those names, all others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches, table

QUERY = "op13_pii"

#: Characters before and after a span in which words adjust its score, by how much, and the least score of a span that is not of a base kind.
NEAR, BOOST, ACCEPT = 40, 0.35, 0.5
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPACES = str.maketrans("", "", " -")
_DIGITS = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address begins as far before its ``@`` as local characters go, but after the last address and ``@``."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        before = text[max(free, text.rfind("@", free, at) + 1) : at]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            yield at - local, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)


def _matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def small_parts(ip: str) -> bool:
    """All parts are 255 at most."""
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in ip.split(".")))


def luhn(number: str) -> bool:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = [ord(c) - 48 for c in number.translate(_SPACES)]
    twice = digits[-2::-2]
    return 16 <= len(digits) <= 19 and (sum(digits) + sum(d - 9 * (d > 4) for d in twice)) % 10 == 0


def dialable(number: str) -> bool:
    """8 to 15 digits."""
    return 8 <= len(_DIGITS.findall(number)) <= 15


def mod97(iban: str) -> bool:
    """The country and check digits moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@dataclass(frozen=True)
class Kind:
    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    score: float
    words: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", _emails, lambda m: True, 0.9, ("mail", "contact", "write")),
    Kind("ip", _matches(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}"), small_parts, 0.6, ("ip", "address", "host", "server")),
    Kind("card", _matches(r"[0-9](?:[ -]?[0-9])+"), luhn, 0.6, ("card", "visa", "mastercard", "payment")),
    Kind("phone", _matches(r"\+[0-9][ ().0-9-]+[0-9]"), dialable, 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", _matches(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), mod97, 0.8, ("iban", "account", "bank", "transfer"), base=False),
    Kind("id", _matches(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"), lambda m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000", 0.3, ("ssn", "social security", "identity", "taxpayer"), base=False),
)


def _spoken_for(text: str, start: int, end: int, words: re.Pattern) -> bool:
    return bool(words.search(text[max(0, start - NEAR) : start]) or words.search(text[end : end + NEAR]))


def finder(kinds: tuple[Kind, ...] = KINDS) -> Callable[[str | None], list[tuple[str, int, int, float]]]:
    """Function that lists the spans of a text (kind, start, end in code points, score), by kind as listed, then start."""
    said = [re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, k.words)) + ")") for k in kinds]

    def spans(text: str | None) -> list[tuple[str, int, int, float]]:
        out = []
        for kind, words in zip(kinds, said, strict=True):
            for start, end in kind.find(text or ""):
                if kind.valid(text[start:end]):
                    score = min(1.0, kind.score + BOOST * _spoken_for(text, start, end, words))
                    if kind.base or score >= ACCEPT:
                        out.append((kind.name, start, end, score))
        return out

    return spans


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with its spans replaced by their kinds; what overlaps an earlier span goes with it."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, text: str = "text", carry: list[str] | None = None, with_text: bool = True, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``carry`` columns (all by default), ``spans`` and, if ``with_text``, the ``redacted`` text of each row."""
    small_batches(docs.sparkSession)
    new = ("spans", "redacted") if with_text else ("spans",)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    read = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], F.col(text).alias("text"))
    own = [f"c{k}" for k in range(len(carry))]
    schema = T.StructType([*read.select(*own).schema, T.StructField("spans", SPANS), *([T.StructField("redacted", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder(kinds)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans(t) for t in texts]
            made = [pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found], _ARROW)]
            if with_text:
                made.append(pa.array([t and redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *made], names=[*own, *new])

    return read.mapInArrow(run, schema).toDF(*carry, *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], with_text=False)
    base = [k.name for k in KINDS if k.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, base), F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _sql_matches(kind: str, pattern: str) -> str:
    """Rows ``kind``, ``m`` and ``e`` (end) of all matches: each piece of a text runs to the end of a match, so lengths of pieces add up to ends."""
    cut = lambda group: f"regexp_extract_all(text, '(?s)(.*?)({pattern})', {group})"
    return f"SELECT k, text, '{kind}' AS kind, unnest({cut(2)}) AS m, unnest({cut(0)}) AS piece, generate_subscripts({cut(0)}, 1) AS i FROM docs"


_BASE_SQL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# RE2 has no look-around, so what must not stand beside a span is checked afterwards; these cover all candidates
_ADDED_SQL = {
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def _sql_words(kind: Kind) -> str:
    return "(?i)\\b(?:" + "|".join(kind.words) + ")"


_BY_NAME = {k.name: k for k in KINDS}
_SAID = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN regexp_matches(before, '{_sql_words(k)}') OR regexp_matches(after, '{_sql_words(k)}')" for k in KINDS if not k.base) + " END"
_DIGIT_LIST = "list_transform(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''), lambda c: TRY_CAST(c AS INTEGER))"

ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_sql_matches(k, p) for k, p in (_BASE_SQL | _ADDED_SQL).items())}),
spans AS (
  SELECT *, e - length(m) AS s FROM (SELECT k, kind, m, text, CAST(sum(length(piece)) OVER (PARTITION BY k, kind ORDER BY i) AS BIGINT) AS e FROM found)
), around AS (
  SELECT *, substr(text, greatest(s - {NEAR}, 0) + 1, s - greatest(s - {NEAR}, 0)) AS before, substr(text, e + 1, {NEAR}) AS after, {_DIGIT_LIST} AS digits,
    regexp_replace(m, ' ', '', 'g') AS plain
  FROM spans
), kept AS (
  SELECT k, kind, s, e FROM around WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) END)) <= 255
    WHEN 'card' THEN len(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(digits, lambda d, i: CASE WHEN (len(digits) - i) % 2 = 1 THEN 2 * d - CASE WHEN d > 4 THEN 9 ELSE 0 END ELSE d END)) % 10 = 0
    WHEN 'phone' THEN len(digits) BETWEEN 8 AND 15
    WHEN 'iban' THEN NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]') AND length(plain) BETWEEN 15 AND 34
      AND list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[1:4], ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
    ELSE NOT regexp_matches(before, '[A-Za-z0-9-]$') AND NOT regexp_matches(after, '^[A-Za-z0-9-]') AND m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000' AND {_SAID} END
), joined AS (
  SELECT k, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY list_position({[k.name for k in KINDS]}, kind), s) FILTER (kind NOT IN ('iban', 'id')) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY list_position({[k.name for k in KINDS]}, kind), s) AS spans
  FROM kept GROUP BY k
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (k)
"""
