"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in every text. Each candidate's value is counted over the whole corpus by the distinct
repositories and owners that hold it. A value that ``EXAMPLE_OWNERS`` owners or more have is a widely copied example; so
is one that fewer owners share among ``EXAMPLE_REPOSITORIES`` repositories or more. A value of a single owner is
specific to it, in however many of its repositories, and any value that is no example looks live. Beside the three base kinds there is ``opaque``, a long run that
mixes cases and digits; no pattern vouches for it, so it is reported only where its ownership looks live.

Spans are in characters (code points), ends exclusive, and cover the whole match. Edge cases: null counts as the
empty text; rows without an owner or repository share a nameless one; equal texts get equal results whatever their
ids; an empty table gives no rows. Very long texts are read whole; in ``redacted`` the time of a text also grows with the
square of its number of live spans. Other columns, of whatever name, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import fingerprint, unused, written

#: The kinds in the order that sorts spans with equal starts, their patterns, the group that is the
#: secret and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "opaque": (r"[A-Za-z0-9+/_-]{24,}", 0, 24),
}
BASE = ("assign", "access", "hex")
MIXED = ("[a-z]", "[A-Z]", "[0-9]")
#: Owners from which on a value counts as a widely copied example, and repositories if several owners have it.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: Matches of a text whose places are counted together.
CHUNK = 256
MASK = "[SECRET]"


HITS = "array<struct<start:int,end:int,kind:int,value:string>>"


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind, in order, as HITS; kind is its place in KINDS.

    What splitting at the matches leaves between them gives each match its place. Lengths are added up by chunks, as an
    array that grows match by match would be copied for each of them.
    """
    pattern, group, least = KINDS[kind]
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.slice(F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value")), 1, F.size(whole))
    parts = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("whole"), p["value"].alias("value")))
    number = list(KINDS).index(kind)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))
    sizes = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, p: n + p["gap"] + p["whole"]))
    begins = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["begins"], F.array(s["at"])).alias("begins")),
        lambda s: s["begins"],
    )

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["whole"]
        hit = F.struct(start.alias("start"), end.alias("end"), F.lit(number).alias("kind"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(part["value"]) >= least, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"))

    placed = F.arrays_zip(chunks.alias("chunk"), begins.alias("begin"))
    hits = F.flatten(F.transform(placed, lambda p: F.aggregate(p["chunk"], F.struct(p["begin"].alias("at"), F.array().cast(HITS).alias("hits")), step, lambda s: s["hits"])))
    return F.when(text.rlike(pattern), hits).otherwise(F.array().cast(HITS))


def _hits(text: Column) -> tuple[Column, Column]:
    """Base and opaque matches of a text, the latter where no base match is."""
    base = F.concat(*[_found(text, k) for k in BASE])
    return base, F.filter(_found(text, "opaque"), lambda hit: hit["value"].rlike(MIXED[0]) & hit["value"].rlike(MIXED[1]) & hit["value"].rlike(MIXED[2]))


def candidates(docs: DataFrame, text: str, repository: str, owner: str, names: list[str]) -> DataFrame:
    """docs with more columns, by these names: repository, owner, a hash of the text, base and opaque matches."""
    a, b, body, base, opaque = names
    some = _hits(F.coalesce(F.col(text), F.lit("")))
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((repository, a), (owner, b))]
    out = docs.select("*", *known, fingerprint(F.col(text)).alias(body), some[0].alias(base), some[1].alias(opaque))
    return out.withColumn(opaque, F.filter(opaque, lambda hit: ~F.exists(base, lambda x: (x["start"] < hit["end"]) & (hit["start"] < x["end"]))))


def _spans(hits: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(hits), lambda h: F.concat_ws(":", names[h["kind"]], h["start"], h["end"])), ",")


JUDGED = "array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>"


def _judged(found: DataFrame) -> DataFrame:
    """By text: all its candidates, each with its numbers of owners and repositories and whether it looks live."""
    each = found.select("body", "repository", "owner", F.explode(F.concat("base", "opaque")).alias("hit"))
    each = each.select("body", "repository", "owner", F.struct("hit.start", "hit.kind", "hit.end").alias("hit"), F.unhex(F.sha2("hit.value", 256)).alias("secret"))
    holders = each.select("secret", "repository", "owner").distinct().groupBy("secret").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES))
    # Written, as the result is, so that Spark can split the joins with a secret, or a text, that a large part of the rows has.
    known = each.select("body", "hit", "secret").distinct().join(written(holders), "secret")
    known = known.select("body", F.struct("hit.start", "hit.kind", "hit.end", "owners", "repositories", (~copied).alias("live")).alias("hit"))
    return written(known.groupBy("body").agg(F.collect_list("hit").cast(JUDGED).alias("hits")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """One row per row of the input: key; n_assign, n_access, n_hex; base_sha256 (of the string of base spans); spans (all
    spans); n_live and n_example (candidates whose ownership looks live, or widely copied); n_owners and n_repositories
    (the most that one of its candidates has)."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(repository).alias("a"), F.col(owner).alias("b"))
    found = written(candidates(slim, "text", "a", "b", ["repository", "owner", "body", "base", "opaque"]).drop("text", "a", "b"))
    some = F.size("base") + F.size("opaque") > 0
    joined = found.where(some).join(_judged(found.where(some)), "body").select("id", "base", "hits")
    joined = joined.union(found.where(~some).select("id", "base", F.array().cast(JUDGED)))  # texts without candidates meet nothing
    hits, opaque = F.col("hits"), list(KINDS).index("opaque")
    base = _spans(F.transform("base", lambda h: F.struct(h["start"], h["kind"], h["end"])))
    kept = F.filter(hits, lambda h: h["live"] | (h["kind"] != opaque))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda h: h["kind"] == BASE.index(kind))).cast("long").alias(f"n_{kind}")

    def most(of: str) -> Column:
        return F.coalesce(F.array_max(F.transform(hits, lambda h: h[of])), F.lit(0)).cast("long").alias(f"n_{of}")

    return joined.select(
        F.col("id").alias(key),
        *map(number, BASE),
        F.sha2(base, 256).alias("base_sha256"),
        _spans(F.transform(kept, lambda h: F.struct(h["start"], h["kind"], h["end"]))).alias("spans"),
        F.size(F.filter(hits, lambda h: h["live"])).cast("long").alias("n_live"),
        F.size(F.filter(hits, lambda h: ~h["live"])).cast("long").alias("n_example"),
        most("owners"),
        most("repositories"),
    )


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source", length: str | None = "n_chars") -> DataFrame:
    """docs with every live-looking span of its texts replaced by MASK; widely copied examples stay. A column of text
    lengths follows where its text changed."""
    names = unused(docs, "repository_", "owner_", "body", "base", "opaque")
    live, new, asked = unused(docs, "live", "new", "asked")
    found = written(candidates(docs, text, repository, owner, names))  # with the texts, so that patterns are sought once
    some = F.size(names[3]) + F.size(names[4]) > 0
    own = [F.col(n).alias(x) for n, x in zip(names, ("repository", "owner", "body", "base", "opaque"), strict=True)]
    ours = F.array_sort(F.transform(F.filter("hits", lambda h: h["live"]), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    judged = written(_judged(found.where(some).select(*own)).select(F.col("body").alias(asked), ours.alias(live)).where(F.size(live) > 0))
    # Pieces of text and masks in turn; joined at the end, as a text that grows span by span would be copied for each.
    merged = F.transform(live, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
    before = lambda s: F.coalesce(F.array_max(F.transform(F.slice(live, 1, s["i"]), lambda x: x["end"])), F.lit(0))
    spans = F.filter(F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), before(s).alias("before"))), lambda s: s["start"] >= s["before"])
    pieces = F.transform(spans, lambda s: F.concat(F.substring(F.col(text), s["before"] + 1, s["start"] - s["before"]), F.lit(MASK)))
    last = F.array_max(F.transform(live, lambda s: s["end"]))
    done = F.concat(F.array_join(pieces, ""), F.substring(F.col(text), last + 1, F.length(text)))
    joined = found.where(some).join(judged, F.col(names[2]) == F.col(asked), "left")
    out = joined.withColumn(new, F.when(F.col(live).isNull(), F.col(text)).otherwise(done))
    columns = [F.col(new).alias(c) if c == text else F.when(F.col(live).isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c) if c == length else F.col(c) for c in docs.columns]
    return out.select(*columns).union(found.where(~some).select(*docs.columns))  # texts without candidates stay where they are


def oracle() -> str:
    """The same result in DuckDB SQL over documents, a source being repository and owner."""
    found = []
    for n, (pattern, group, least) in enumerate(KINDS.values()):
        p = pattern.replace("'", "''")
        found.append(f"""
  SELECT doc_id, owner, {n} AS kind, v[i] AS value, length(w[i]) AS size,
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS b
  FROM (SELECT doc_id, owner, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS w, regexp_extract_all(t, '{p}', {group}) AS v FROM d) m, unnest(range(1, len(w) + 1)) AS u(i)
  WHERE length(v[i]) >= {least}""")
    opaque = list(KINDS).index("opaque")
    mixed = " AND ".join(f"regexp_matches(value, '{x}')" for x in MIXED)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    counts = ", ".join(f"count(*) FILTER (kind = {n}) AS n_{k}" for n, k in enumerate(BASE))
    shown = f"string_agg({names}[kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
matches AS ({" UNION ALL ".join(found)}),
spans AS (SELECT *, (b + size)::BIGINT AS e FROM matches),
hits AS (SELECT * FROM spans s WHERE kind < {opaque} OR {mixed} AND NOT EXISTS (
  SELECT 1 FROM spans x WHERE x.doc_id = s.doc_id AND x.kind < {opaque} AND x.b < s.e AND s.b < x.e)),
holders AS (SELECT value, count(DISTINCT owner) AS owners, owners < {EXAMPLE_OWNERS} AND NOT (owners > 1 AND owners >= {EXAMPLE_REPOSITORIES}) AS live FROM hits GROUP BY value),
per AS (SELECT doc_id, {counts}, {shown} FILTER (kind < {opaque}) AS base, {shown} FILTER (kind < {opaque} OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS n_owners FROM hits JOIN holders USING (value) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(n_owners, 0) AS n_owners, coalesce(n_owners, 0) AS n_repositories FROM d LEFT JOIN per USING (doc_id)
"""
