"""URL filters with redirect equivalence.

Rules block or allow a host (with its subdomains) and a path prefix; the longest fitting rule wins.
Redirects and canonical links make URLs aliases of each other: distributed connected components over
those edges carry block decisions to all aliases that no rule fits itself.  An explicit allow takes
precedence: a URL's own rule always decides, and a component with an explicitly allowed URL
blocks none of its undecided aliases.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, is no
alias of anything and is allowed; null html has no links; repeated rows get equal verdicts; links that lead to
the page itself are ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, table
from tessera.llm.graph import components

QUERY = "op1_url_filters"

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links of a page: canonical links with either order of attributes, then the meta refresh.
LINKS = (
    r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)[^>]*\brel\s*=\s*["']?canonical\b""",
    r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*["']?([^"'\s>]+)""",
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What aliases are told apart by: host, path and query; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of distinct ``host`` and ``path`` that some rule fits, with the longest as ``rule`` and ``own``.

    ``rules`` has columns verdict, host and prefix.  A host meets rules by equality with one of its
    suffixes, so the join is an equi-join however many rules there are.  Suffixes of more labels than
    any rule has can't meet one, so a host of very many labels gives few.
    """
    keys = urls.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    longest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(longest))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    listed = rules.select(F.col("host").alias("suffix"), "prefix", "verdict", F.concat("host", "prefix").alias("rule"))
    pairs = keys.withColumn("suffix", F.explode(F.array_distinct(suffixes))).join(listed, "suffix").where(F.startswith("path", "prefix"))
    best = F.max(F.struct(F.length("rule"), "rule", "verdict"))
    return pairs.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.col("best.verdict").alias("own"))


def page_links(pages: DataFrame) -> DataFrame:
    """Edges ``from`` and ``to`` of absolute URLs, from canonical links and meta refreshes; relative
    targets are resolved against the page's host and directory."""
    found = F.explode(F.array_compact(F.array(*[F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in LINKS])))
    links = pages.where(F.col("url").contains("://") & F.col("html").isNotNull()).select(F.col("url").alias("from"), found.alias("target"))
    base = F.regexp_extract("from", r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract("from", r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(path_of(F.col("from")), r"(?s)^(.*/)", 1)
    absolute = (
        F.when(F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("target"))
        .when(F.startswith("target", F.lit("//")), F.concat(scheme, "target"))
        .when(F.startswith("target", F.lit("/")), F.concat(base, "target"))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), "target"))
    )
    return links.select("from", absolute.alias("to"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """All rows of ``pages`` (``url``, ``html``) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``redirects`` may add edges (``from``, ``to``) that a crawl has seen.
    """
    new = ("host", "path", "rule", "verdict")
    row = F.struct(*[c for c in pages.columns if c not in new]).alias("row")
    urls = pages.select(row, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from", "to"))
    edges = materialize(links.select(node_of(F.col("from")).alias("a"), node_of(F.col("to")).alias("b"), "from", "to").where("a <> b"), "url-edges")
    out = urls.join(matched(urls, rules), ["host", "path"], "left")
    if edges.isEmpty():
        discard(edges)
        return out.select("row.*", "host", "path", "rule", F.coalesce("own", F.lit(DEFAULT)).alias("verdict"))
    ends = edges.select(F.col("from").alias("url")).unionByName(edges.select(F.col("to").alias("url"))).distinct()
    ends = ends.select(node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    member = components(edges.select("a", "b"))
    decided = ends.join(matched(ends, rules), ["host", "path"]).join(member, "node")
    spread = decided.groupBy("component").agg(F.min("own").alias("spread"))  # allow sorts before block
    aliases = member.join(spread, "component").select("node", "spread")
    out = out.withColumn("node", node_of(F.col("url"))).join(aliases, "node", "left")
    return out.select("row.*", "host", "path", "rule", F.coalesce("own", "spread", F.lit(DEFAULT)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([*RULES], "verdict string, host string, prefix string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')"
_PATH = r"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = f"CASE WHEN contains({{u}}, '://') THEN {_HOST} || {_PATH} || regexp_extract({{u}}, '(?s)^.*?://[^?#]*(\\?[^#]*)?', 1) END"
_LINKS = " UNION ALL ".join(f"SELECT url AS f, regexp_extract(html, '{p.replace(chr(39), chr(39) * 2)}', 1) AS t FROM pages WHERE contains(url, '://')" for p in LINKS)

ORACLE_SQL = rf"""
WITH RECURSIVE rules(verdict, rhost, prefix) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), raw AS ({_LINKS}), links AS (
  SELECT f, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(f, '(?s)^(.*?:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(f, '(?s)^(.*?://[^/?#]*)', 1) || t
    ELSE regexp_extract(f, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({_PATH.format(u="f")}, '(?s)^(.*/)', 1), ''), '/') || t END AS t
  FROM raw WHERE t <> ''
), edges AS (
  SELECT * FROM (SELECT {_NODE.format(u="f")} AS a, {_NODE.format(u="t")} AS b, f, t FROM links) WHERE a <> b
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), urls AS (
  SELECT page_id, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path, {_NODE.format(u="url")} AS node FROM pages
), ends AS (
  SELECT DISTINCT {_NODE.format(u="u")} AS node, {_HOST.format(u="u")} AS host, {_PATH.format(u="u")} AS path FROM (SELECT f AS u FROM edges UNION SELECT t FROM edges)
), keys AS (
  SELECT host, path FROM urls UNION SELECT host, path FROM ends
), best AS (
  SELECT host, path, arg_max(rhost || prefix, length(rhost || prefix)) AS rule, arg_max(verdict, length(rhost || prefix)) AS own
  FROM keys JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, prefix) GROUP BY host, path
), spread AS (
  SELECT reach.node, min(best.own) AS spread FROM reach JOIN ends ON reach.other = ends.node JOIN best ON ends.host = best.host AND ends.path = best.path GROUP BY reach.node
)
SELECT page_id, urls.host, urls.path, best.rule, coalesce(best.own, spread.spread, 'allow') AS verdict
FROM urls LEFT JOIN best ON urls.host = best.host AND urls.path = best.path LEFT JOIN spread ON urls.node = spread.node
"""
