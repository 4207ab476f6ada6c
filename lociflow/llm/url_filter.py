"""URL filters whose block decisions reach aliases, in DataFrame functions only.

Rules name a host and a path prefix and fit the host with all its subdomains; of the rules that fit, the longest
decides. Pages that redirect to each other (a refresh in their markup, or given edges) or name each other as canonical
are aliases: connected components of those edges. A page without a rule is blocked if a page, or a mere target, of its
component is blocked by rule and none is explicitly allowed; otherwise it is allowed. A page's own rule always wins.

A node is a url without scheme and fragment: its host in ASCII lower case without its scheme's own port, its path (``/``
for none) without ``.`` and ``..`` steps, and its query. Links count where a browser reads them: not in comments, scripts or
styles, against the page's ``<base>`` if it has one, with the entities of ``ENTITIES`` decoded; of several tags of a kind the
first counts. A target that is a mere query goes to the page's own path, a mere fragment to the page itself.

Edge cases: a url that is null or has no ``://`` has empty host and path, no rule, no aliases, and is allowed; null markup
has no edges; pages that repeat a url, or an id, get one row each. No edges: every page without a rule is allowed; no
pages: no rows. Very long markup is read whole. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import written
from lociflow.llm.components import components

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL_TAG = r"(?is)<link\s[^>]*rel\s*=\s*[\x22']?canonical[\x22'\s/>][^>]*"
REFRESH_TAG = r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\x22']?refresh[\x22'\s/>][^>]*"
BASE_TAG = r"(?is)<base\s[^>]*"
HREF = r"(?is)\shref\s*=\s*[\x22']?([^\x22'\s>]+)"
TARGET = r"(?is)url\s*=\s*[\x22']?([^\x22'\s>]+)"
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
#: Entities that stand in links and what they mean; the ampersand's own come last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]
#: Ports that a scheme has anyway.
PORTS = {"http": ":80", "https": ":443"}


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))


def straight(p: Column) -> Column:
    """A path without ``.`` and ``..`` steps; ``/`` for the empty one."""
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.regexp_replace(done, r"/[^/]*\z", "")).otherwise(F.concat(done, F.lit("/"), s))
    walked = F.aggregate(F.split(F.regexp_replace(p, "^/", ""), "/", -1), F.lit(""), step)
    walked = F.when(p.rlike(r"(?:^|/)\.\.?\z"), F.concat(walked, F.lit("/"))).otherwise(walked)
    return F.when(p == "", "/").when(F.contains(p, F.lit("/.")), walked).otherwise(p)


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)``, with x computed once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _parts(url: Column) -> Column:
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*([^#]*)", 1)
    return F.struct(scheme(url).alias("scheme"), host(url).alias("host"), path(url).alias("path"), query.alias("query"))


def node(url: Column) -> Column:
    """The page that a url names, null for none."""

    def named(u: Column) -> Column:
        name = u["host"]
        for known, port in PORTS.items():
            name = F.when((u["scheme"] == known) & u["host"].endswith(port), F.regexp_replace(u["host"], f"{port}\\z", "")).otherwise(name)
        return F.when(u["host"] != "", F.concat(name, straight(u["path"]), u["query"]))

    return _let(url, lambda u: _let(_parts(u), named))


def rule_of(h: Column, p: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null for none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last that fits stands
        fits = ((h == name) | h.endswith("." + name)) & p.startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(f"{name}/{prefix}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _resolved(target: Column, base: Column) -> Column:
    """A target as an absolute url."""

    def at(b: Column) -> Column:
        site = F.concat(b["scheme"], F.lit("://"), b["host"])
        folder = F.regexp_replace(F.when(b["path"] == "", F.lit("/")).otherwise(b["path"]), r"[^/]*\z", "")
        return (
            F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(b["scheme"], F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?") | target.startswith("#"), F.concat(site, b["path"], target))
            .otherwise(F.concat(site, folder, target))
        )

    return _let(_parts(base), at)


def _decoded(text: Column) -> Column:
    for entity, meant in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(meant))
    return text


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that canonical links and refresh redirects in the pages' markup connect."""
    page = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("html").rlike(r"(?i)canonical|refresh"))
    page = page.withColumn("html", F.regexp_replace("html", UNREAD, " "))
    inside = lambda tag, place: _decoded(F.regexp_extract(F.regexp_extract("html", tag, 0), place, 1))
    page = page.select("url", inside(BASE_TAG, HREF).alias("base"), inside(CANONICAL_TAG, HREF).alias("canonical"), inside(REFRESH_TAG, TARGET).alias("refresh"))
    page = page.withColumn("base", F.when(F.col("base") == "", F.col("url")).otherwise(_resolved(F.col("base"), F.col("url"))))
    found = [page.select(node(F.col("url")).alias("a"), F.when(F.col(t) != "", node(_resolved(F.col(t), F.col("base")))).alias("b")) for t in ("canonical", "refresh")]
    return found[0].union(found[1]).where("a is not null and b is not null and a != b")


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, component (smallest node of its aliases, null without any)
    and by (``rule``, ``alias`` or ``default``). ``edges`` (a, b: urls) add to those in the markup."""
    links = page_edges(pages, url, html)
    if edges is not None:
        links = links.union(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    roots = written(components(links, "a", "b"))
    ruled = rule_of(F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1), rules)
    held = written(roots.groupBy("root").agg(F.count_if(ruled["verdict"] == "block").alias("blocked"), F.count_if(ruled["verdict"] == "allow").alias("allowed")))
    # Written, as what a component holds is, so that Spark can split the joins with a large component or a url of very many pages.
    verdicts = written(roots.join(held, "root").select(F.col("node").alias("alias"), F.col("root").alias("component"), ((F.col("blocked") > 0) & (F.col("allowed") == 0)).alias("stopped")))
    own = pages.select(F.col(key).alias("page"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), node(F.col(url)).alias("node"))
    # Pages without a node meet no alias; a number of their own keeps them out of one task.
    own = own.withColumn("node", F.coalesce("node", F.concat(F.lit("#"), F.col("page").cast("string"))))
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(verdicts, F.col("node") == F.col("alias"), "left")
    stopped = F.coalesce("stopped", F.lit(False))
    return own.select(
        F.col("page").alias(key),
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.when(F.col("r").isNotNull(), F.col("r.verdict")).when(stopped, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        "component",
        F.when(F.col("r").isNotNull(), F.lit("rule")).when(stopped, F.lit("alias")).otherwise(F.lit("default")).alias("by"),
    )


#: The rules of op4_url_filter.
RULES: list[Rule] = [
    ("block", "com", "en/"),
    ("allow", "example.com", "en/7"),
    ("allow", "net", "de/"),
    ("block", "example.net", "de/8"),
    ("block", "org", "es/"),
]



def oracle(rules: Sequence[Rule] = RULES) -> str:
    """The same verdicts in DuckDB SQL, components by recursion."""
    table = ", ".join(f"('{v}', '{n}', '{x}')" for v, n, x in rules)
    fits = "(host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, '/' || r.p)"
    after = lambda u: f"substr({u}, strpos({u}, '://') + 3)"
    host_of = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract({after(u)}, '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END"
    path_of = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract(regexp_extract({after(u)}, '^[^?#]*'), '(?s)^[^/]*(.*)$', 1) ELSE '' END"
    kind_of = lambda u: f"lower(split_part({u}, '://', 1))"

    def node_of(u: str) -> str:
        h, p = f"({host_of(u)})", f"({path_of(u)})"
        steps = f"list_reduce(string_split(regexp_replace({p}, '^/', ''), '/'), lambda done, s: CASE s WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END, '')"
        walked = f"CASE WHEN {p} = '' THEN '/' WHEN contains({p}, '/.') THEN {steps} || CASE WHEN suffix({p}, '/.') OR suffix({p}, '/..') THEN '/' ELSE '' END ELSE {p} END"
        plain = f"CASE WHEN {kind_of(u)} = 'http' AND suffix({h}, ':80') THEN {h}[:-4] WHEN {kind_of(u)} = 'https' AND suffix({h}, ':443') THEN {h}[:-5] ELSE {h} END"
        return f"CASE WHEN {h} <> '' THEN {plain} || {walked} || coalesce(regexp_extract({after(u)}, '(?s)^[^?#]*([^#]*)', 1), '') END"

    def meant(text: str) -> str:
        for entity, sign in ENTITIES:
            text = f"replace({text}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
        return text

    def resolved(t: str, u: str) -> str:
        site = f"{kind_of(u)} || '://' || {host_of(u)}"
        return (
            f"CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t} WHEN {t} LIKE '//%' THEN {kind_of(u)} || ':' || {t} WHEN {t} LIKE '/%' THEN {site} || {t} "
            f"WHEN {t}[1] IN ('?', '#') THEN {site} || {path_of(u)} || {t} ELSE {site} || regexp_extract('/' || ({path_of(u)})[2:], '(?s)^.*/') || {t} END"
        )

    q = lambda s: s.replace(r"\x22", '"').replace("'", "''")
    inside = lambda tag, place: meant(f"regexp_extract(regexp_extract(html, '{q(tag)}', 0), '{q(place)}', 1)")
    return f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {table}),
pg AS (SELECT page_id, coalesce(url, '') AS url, html, {host_of("coalesce(url, '')")} AS host, {path_of("coalesce(url, '')")} AS path, {node_of("coalesce(url, '')")} AS node FROM pages),
read AS (SELECT node, url, regexp_replace(html, '{q(UNREAD)}', ' ', 'g') AS html FROM pg),
found AS (SELECT node, url, {inside(BASE_TAG, HREF)} AS base, {inside(CANONICAL_TAG, HREF)} AS c, {inside(REFRESH_TAG, TARGET)} AS t FROM read),
based AS (SELECT node, CASE WHEN base = '' THEN url ELSE {resolved("base", "url")} END AS base, c, t FROM found),
targets AS (SELECT node, base, c AS t FROM based UNION ALL SELECT node, base, t FROM based),
urls AS (SELECT node, {resolved("t", "base")} AS u FROM targets WHERE t <> ''),
edges AS (SELECT node AS a, {node_of("u")} AS b FROM urls),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT reach.n, b FROM reach JOIN both_ways ON m = a),
roots AS (SELECT n AS node, min(m) AS root FROM reach GROUP BY n),
split AS (SELECT node, root, regexp_extract(node, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM roots),
ruled AS (SELECT root, (SELECT arg_max(r.verdict, length(r.h || r.p)) FROM rules r WHERE {fits}) AS verdict FROM split),
held AS (SELECT root, count(*) FILTER (verdict = 'block') > 0 AND count(*) FILTER (verdict = 'allow') = 0 AS stopped FROM ruled GROUP BY root),
own AS (SELECT pg.*, (SELECT arg_max(r.h || '/' || r.p, length(r.h || r.p)) FROM rules r WHERE {fits}) AS rule,
  (SELECT arg_max(r.verdict, length(r.h || r.p)) FROM rules r WHERE {fits}) AS own_verdict FROM pg)
SELECT page_id, host, path, rule, coalesce(own_verdict, CASE WHEN stopped THEN 'block' ELSE 'allow' END) AS verdict,
  root AS component, CASE WHEN own_verdict IS NOT NULL THEN 'rule' WHEN stopped THEN 'alias' ELSE 'default' END AS "by"
FROM own LEFT JOIN roots USING (node) LEFT JOIN held USING (root)
"""
