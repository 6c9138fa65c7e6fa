"""Operator 6, URL filters: redirect equivalence. DataFrame functions only.

A rule is a host and the start of a path; it fits its host and all subdomains where the URL's path starts with the
rule's, and the longest fitting rule decides. Redirects and canonical links join URLs into components. A URL without a
rule of its own takes its component's decision: block if a member is blocked by a rule and none is explicitly allowed,
allow otherwise. An explicit allow thus wins over any propagated block, and an own rule wins over both.

A null URL, or one without ``://``, has an empty host and path and no rule; a null URL has no aliases and is allowed.
Repeated rows and URLs are each judged alike; an empty edge or rule table changes nothing but that it decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrow import table
from .graph import connected_components
from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the production query as (host, path, action).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
#: Character references that occur in links, and what they stand for; the ampersand last.
REFERENCES = [("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&sol;", "/"), ("&#58;", ":"), ("&#x3A;", ":"), ("&#x3a;", ":"), ("&colon;", ":"), ("&#61;", "="), ("&equals;", "="), ("&#63;", "?"), ("&quest;", "?"), ("&#38;", "&"), ("&#x26;", "&"), ("&AMP;", "&"), ("&amp;", "&")]
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What two spellings of one URL share: no fragment, scheme and host in lower case, a slash for an empty path."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    head = F.regexp_extract(bare, r"^[^/?#]*://[^/?#]*", 0)
    tail = F.substr(bare, F.length(head) + 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.when((head != "") & ~tail.startswith("/"), "/").otherwise(""), tail)


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    done = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part))),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(done, folder), "/"))


def _absolute(base: Column, link: Column) -> Column:
    """A link of the page ``base`` by RFC 3986; null if its scheme has no host (``mailto:``): it leads to no page."""
    for reference, character in REFERENCES:
        link = F.replace(link, F.lit(reference), F.lit(character))
    site = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*(/(?:[^?#]*/)?)?", 0)
    target = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[^/?#]*:", 0), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(folder == site, F.concat(site, F.lit("/"), link))
        .otherwise(F.concat(folder, link))
    )
    head, path = (F.regexp_extract(target, r"^([^/?#]*//[^/?#]*)?(/[^?#]*)?", k) for k in (1, 2))
    tail = F.substr(target, F.length(head) + F.length(path) + 1)
    plain = F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(head, _without_dots(path), tail)).otherwise(target)
    own = F.when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link)).when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), link))
    return F.coalesce(own, plain)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` URLs of all canonical links and refresh redirects in pages."""
    url, html = F.col(url_col), F.col(html_col)

    def links(word: str, tag: str, value: str) -> Column:
        found = F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, value, 1))
        return F.when(html.ilike(f"%{word}%"), found).otherwise(F.array().cast("array<string>"))

    both = F.concat(links("canonical", CANONICAL, HREF), links("refresh", REFRESH, TARGET))
    found = pages.where(html.ilike("%canonical%") | html.ilike("%refresh%")).where(url.isNotNull())
    edges = found.select(url.alias("src"), F.explode(both).alias("link")).where("link != ''")
    return edges.select("src", _absolute(F.col("src"), F.col("link")).alias("dst")).where("dst IS NOT NULL")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, action)`` for the distinct hosts and paths that a rule fits; equally long: allow first."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = rules.select(F.col("rule_host").alias("suffix"), "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "action")
    fits = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix")).join(known, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule"), F.length("suffix"), (F.col("action") == "allow"), "rule", "action"))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


def filter_urls(urls: DataFrame, edges: DataFrame, rules: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdicts for ``urls``.

    ``edges``: ``src`` and ``dst`` URLs that lead to the same resource; ``rules``: ``rule_host``, ``rule_path``,
    ``action``. All three may be of any size. Returns id_col, host, path, rule, component (null: no aliases), verdict.
    """
    u = F.col(url_col)
    pages = urls.select(F.col(id_col), host_of(u).alias("host"), path_of(u).alias("path"), key_of(u).alias("key"))
    component = connected_components(edges.select(key_of(F.col("src")).alias("s"), key_of(F.col("dst")).alias("d")), "s", "d", scratch)
    nodes = component.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    ruled = nodes.join(fitting_rules(nodes, rules), ["host", "path"])
    decided = ruled.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"))
    alias = component.join(decided, "component", "left").select(F.col("node").alias("key"), "component", "allowed")
    own = pages.join(fitting_rules(pages, rules), ["host", "path"], "left")
    verdict = F.coalesce("action", F.when(~F.col("allowed"), "block").otherwise("allow"))
    return own.join(alias, "key", "left").select(id_col, "host", "path", "rule", "component", verdict.alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table made by the plan itself, without a Python scan."""
    rows = ", ".join("('" + "', '".join(x.replace("\\", "\\\\").replace("'", "\\'") for x in r) + "')" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_host, rule_path, action)" if rules else "SELECT '' rule_host, '' rule_path, '' action WHERE false")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = filter_urls(pages.select("page_id", "url"), link_edges(pages.select("url", "html")), rule_table(spark, RULES), Scratch(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
_HOST = "CASE WHEN contains({u}, '://') THEN translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*'), '" + UPPER + "', '" + LOWER + "') ELSE '' END"
_PATH = "CASE WHEN contains({u}, '://') THEN regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_TAIL = "substr(regexp_extract({u}, '^[^#]*'), length(regexp_extract({u}, '^[^/?#]*://[^/?#]*')) + 1)"
_KEY = "translate(regexp_extract({u}, '^[^/?#]*://[^/?#]*'), '" + UPPER + "', '" + LOWER + "') || CASE WHEN regexp_matches({u}, '^[^/?#]*://') AND NOT starts_with(" + _TAIL + ", '/') THEN '/' ELSE '' END || " + _TAIL
_LINK = "link"
for _reference, _character in REFERENCES:
    _LINK = f"replace({_LINK}, '{_reference}', '{_character}')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH RECURSIVE rules(rule_host, rule_path, action) AS (VALUES {_VALUES}),
links AS (
  SELECT url AS src, unnest(list_concat(list_transform(regexp_extract_all(html, {_q(CANONICAL)}), lambda t: regexp_extract(t, {_q(HREF)}, 1)),
                                        list_transform(regexp_extract_all(html, {_q(REFRESH)}), lambda t: regexp_extract(t, {_q(TARGET)}, 1)))) AS link
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
absolute AS (
  SELECT src, {_LINK} AS l, regexp_extract(src, '^[^/?#]*://[^/?#]*') AS site, regexp_extract(src, '^[^/?#]*://[^/?#]*(/([^?#]*/)?)?') AS folder
  FROM links WHERE link <> ''),
targets AS (
  SELECT src, l, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(l, '//') THEN regexp_extract(src, '^[^/?#]*:') || l
    WHEN starts_with(l, '/') THEN site || l WHEN folder = site THEN site || '/' || l ELSE folder || l END AS t FROM absolute),
split AS (SELECT src, l, t, regexp_extract(t, '^([^/?#]*//[^/?#]*)?(/[^?#]*)?', 1) AS head, regexp_extract(t, '^([^/?#]*//[^/?#]*)?(/[^?#]*)?', 2) AS path FROM targets),
pairs AS (
  SELECT src, CASE WHEN starts_with(l, '?') THEN regexp_extract(src, '^[^?#]*') || l WHEN starts_with(l, '#') THEN regexp_extract(src, '^[^#]*') || l
    WHEN regexp_matches(path, '/[.][.]?(/|$)') THEN head || list_reduce(list_prepend('', string_split(substr(path, 2), '/')),
        lambda kept, part: CASE part WHEN '.' THEN kept WHEN '..' THEN regexp_replace(kept, '/[^/]*$', '') ELSE kept || '/' || part END)
      || CASE WHEN regexp_matches(path, '/[.][.]?$') THEN '/' ELSE '' END || substr(t, length(head) + length(path) + 1)
    ELSE t END AS dst FROM split),
edges AS (SELECT {_KEY.format(u="src")} AS a, {_KEY.format(u="dst")} AS b FROM pairs WHERE dst IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
components AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
judged AS (
  SELECT u.url, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY u.url ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC, r.action) AS k
  FROM (SELECT DISTINCT url, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path
        FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT node FROM components)) u
  JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)),
own AS (SELECT url, rule, action FROM judged WHERE k = 1),
decided AS (SELECT c.component, bool_or(o.action = 'allow') AS allowed FROM components c JOIN own o ON o.url = c.node GROUP BY 1)
SELECT p.page_id, coalesce({_HOST.format(u="p.url")}, '') AS host, coalesce({_PATH.format(u="p.url")}, '') AS path, o.rule,
       coalesce(o.action, CASE WHEN NOT d.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN own o ON o.url = p.url
LEFT JOIN components c ON c.node = {_KEY.format(u="p.url")} LEFT JOIN decided d ON d.component = c.component
"""

QUERIES = {"op6_url_filters": op6_url_filters}
ORACLE = {"op6_url_filters": ORACLE_SQL}
