"""URL filters with redirect equivalence, in DataFrame functions only.

A url is judged by the longest rule that fits its host and path. Urls without a rule take
the decision of their aliases: urls linked by canonical links, meta refreshes or a given
redirect table form components (rounds of joins, see ``components``), and a component with a
blocked url and no explicitly allowed one is blocked. A rule of its own always wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscope.llm.common import prepare, stored
from quillscope.llm.components import connected_components, small

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MAX_RULES = 1000  # rules are literals of the plan
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_REST = r"(?s)^.*?://[^/?#]*([^#]*)"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_GOTO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def node(url: Column) -> Column:
    """Host, path and query: what aliases are compared by. Null without a host."""
    n = F.concat(host(url), F.regexp_extract(url, _REST, 1))
    return F.when(host(url) != "", n)


def rule_of(h: Column, p: Column, rules) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rh, rp, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_target(url: Column, tag: Column, pattern: str) -> Column:
    """The node that a link tag of a page names, made absolute; null without one."""
    href = F.replace(F.regexp_extract(tag, pattern, 1), F.lit("&amp;"), F.lit("&"))
    here = F.concat(F.lit("http://"), host(url))
    full = (
        F.when(href == "", F.lit(None))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(here, href))
        .when(href.rlike(r"^[?#]"), F.concat(here, path(url), href))
        .otherwise(F.concat(here, F.regexp_replace(path(url), r"[^/]*$", ""), href))
    )
    return node(full)


def url_filter(
    pages: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for each row of ``pages``.

    ``redirects``: more alias edges ``(from_url, to_url)``. A null url, or one without ``://``, has
    empty host and path, no rule and no aliases; without a rule and aliases a url is allowed. Null html
    has no links. Repeated rows are judged alike; an empty table gives none.
    """
    prepare(pages.sparkSession)
    u = F.col(f"`{url_col}`")
    links = []
    if html_col is not None:
        html = F.col(f"`{html_col}`")
        links = [
            link_target(u, F.regexp_extract(html, _LINK, 0), _HREF),
            link_target(u, F.regexp_extract(html, _META, 0), _GOTO),
        ]
    narrow = stored(
        pages.select(
            F.col(f"`{id_col}`").alias("id"),
            host(u).alias("host"),
            path(u).alias("path"),
            node(u).alias("node"),
            F.array_compact(F.array(*links) if links else F.array().cast("array<string>")).alias("links"),
        ),
        "urls",
    )
    edges = narrow.where("node is not null").select("node", F.explode("links").alias("alias"))
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("from_url")).alias("node"), node(F.col("to_url")).alias("alias")))
    edges = stored(edges.where("node is not null and alias is not null and node != alias").distinct(), "aliases")
    judged = narrow.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    own = F.col("_r.verdict")
    if edges.isEmpty():
        out = judged.withColumn("verdict", F.coalesce(own, F.lit("allow")))
    else:
        parts = connected_components(edges, "node", "alias")
        at = F.concat(F.lit("http://"), F.col("node"))
        known = parts.withColumn("v", rule_of(host(at), path(at), rules)["verdict"])
        verdicts = known.groupBy("root").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
        blocked = stored(
            parts.join(verdicts.where("block and not coalesce(allow, false)"), "root").select("node", F.lit("block").alias("_alias")),
            "blocked",
        )
        out = judged.join(small(blocked), "node", "left").withColumn("verdict", F.coalesce(own, "_alias", F.lit("allow")))
    return out.select("id", "host", "path", F.col("_r.rule").alias("rule"), "verdict")


def _rule_sql(h: str, p: str, which: int) -> str:
    s = "CASE "
    for rh, rp, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        s += f"WHEN ({h} = '{rh}' OR ends_with({h}, '.{rh}')) AND starts_with({p}, '{rp}') THEN '{(rh + rp, v)[which]}' "
    return s + "END"


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase


def _parts_sql(url: str) -> tuple[str, str, str]:
    h = f"translate(regexp_extract({url}, '{_HOST}', 1), '{_UP}', '{_LOW}')"
    return h, f"regexp_extract({url}, '{_PATH}', 1)", f"regexp_extract({url}, '{_REST}', 1)"


_H, _P, _R = _parts_sql("coalesce(url, '')")
_FH, _FP, _FR = _parts_sql("f")
_NH, _NP, _ = _parts_sql("('http://' || node)")
_Q = lambda s: s.replace("'", "''")
SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, {_H} AS host, {_P} AS path, {_R} AS rest FROM pages),
l AS (SELECT host, path, host || rest AS node, replace(unnest([
  regexp_extract(regexp_extract(html, '{_Q(_LINK)}', 0), '{_Q(_HREF)}', 1),
  regexp_extract(regexp_extract(html, '{_Q(_META)}', 0), '{_Q(_GOTO)}', 1)]), '&amp;', '&') AS href FROM u WHERE host <> ''),
f AS (SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
  WHEN starts_with(href, '//') THEN 'http:' || href WHEN starts_with(href, '/') THEN 'http://' || host || href
  WHEN regexp_matches(href, '^[?#]') THEN 'http://' || host || path || href
  ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || href END AS f FROM l WHERE href <> ''),
e AS (SELECT DISTINCT node AS a, {_FH} || {_FR} AS b FROM f WHERE {_FH} <> ''),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS x, a AS y FROM n UNION SELECT x, b FROM reach JOIN n ON y = a),
v AS (SELECT x, y AS node FROM reach),
d AS (SELECT x, bool_or(r = 'allow') AS al, bool_or(r = 'block') AS bl FROM (SELECT x, {_rule_sql(_NH, _NP, 1)} AS r FROM v) GROUP BY x)
SELECT page_id, host, path, {_rule_sql('host', 'path', 0)} AS rule,
  coalesce({_rule_sql('host', 'path', 1)}, CASE WHEN bl AND NOT coalesce(al, false) THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN d ON host <> '' AND x = host || rest
"""
