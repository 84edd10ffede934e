"""URL filter: host rules first, else trust and distrust propagated over the graph of hosts.

Host edges come from absolute links in the pages' HTML and from the host
hierarchy (a host and its parent domain refer to each other). Trust is a
personalised PageRank from hosts with allowed pages; distrust is one from hosts
with blocked pages over reversed edges: whoever refers to the distrusted is
distrusted. Both run as one iteration over (kind, from, to) edges. A host with
more distrust than trust is blocked.

Per-page work is narrow; pages are summed by host before anything is joined,
and edges by (from, to), so that a host with a third of all pages costs a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Mass of either kind that may be left unplaced.
TOLERANCE = 1e-3
#: Lineage is cut, and the mass left is looked at, after so many rounds.
CUT = 4
#: Weight of an edge between a host and its parent domain; a link's weight is 1.
HIERARCHY = 1.0
#: Trust less distrust below which a host is blocked.
LEAST_NET = 0.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\x22\x27]?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\x22\x27\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parent_of(host: Column) -> Column:
    """The domain above a host of three labels or more, else null."""
    above = F.regexp_extract(host, r"^[^.]+\.([^.]+\.[^.]+.*)$", 1)
    return F.when(above != "", above)


def host_edges(pages: DataFrame, hierarchy: float = HIERARCHY) -> DataFrame:
    """source, target, weight over distinct pairs of hosts; ``pages`` has host and html."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    # summed by pair while the pages are read, so that they are read once; the outer form keeps the pattern out of a filter
    links = (
        pages.where(F.col("host") != "").select(F.col("host").alias("source"), F.explode_outer(found).alias("target"))
        .groupBy("source", F.translate("target", UPPER, LOWER).alias("target")).agg(F.count("*").cast("double").alias("weight"))
    )
    links = materialise(links)
    hosts = links.select(F.explode(F.array("source", "target")).alias("host")).where("host IS NOT NULL").distinct()
    tree = hosts.select("host", parent_of(F.col("host")).alias("up")).where("up IS NOT NULL")
    tree = tree.select(F.inline(F.array(
        F.struct(F.col("host").alias("source"), F.col("up").alias("target")),
        F.struct(F.col("up").alias("source"), F.col("host").alias("target")),
    ))).distinct()
    return (
        links.where("target IS NOT NULL AND source <> target")
        .unionByName(tree.withColumn("weight", F.lit(float(hierarchy))))
        .groupBy("source", "target").agg(F.sum("weight").alias("weight")).where("weight > 0")
    )


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, score: personalised PageRank for kind 'trust' along and 'distrust' against the edges.

    ``seeds`` has kind, host, seed (sums to 1 per kind). Each round moves on the
    mass that the one before placed; it ends once less than ``tolerance`` of
    either kind can still come. Mass at hosts without outgoing edges goes no
    further.
    """
    both = edges.select(F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "weight"),
        F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("a"), F.col("source").alias("b"), "weight"),
    )))
    out = both.groupBy("kind", "a").agg(F.sum("weight").alias("total"))
    shares = both.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("weight") / F.col("total")).alias("share"))
    # a row from each host to itself carries its score on, so that a round reads the state once
    hosts = both.select("kind", F.explode(F.array("a", "b")).alias("a")).unionByName(seeds.select("kind", F.col("host").alias("a"))).distinct()
    both = materialise(shares.unionByName(hosts.select("kind", "a", F.col("a").alias("b"), F.lit(None).cast("double").alias("share"))))
    first = (1 - DAMPING) * F.col("seed")
    state, written = seeds.select("kind", "host", first.alias("score"), first.alias("fresh")), None
    came = DAMPING * F.col("fresh") * F.col("share")
    while True:
        for _ in range(CUT):
            state = (
                both.join(state.withColumnRenamed("host", "a"), ["kind", "a"])
                .select("kind", F.col("b").alias("host"), F.coalesce(came, "score").alias("score"), F.coalesce(came, F.lit(0.0)).alias("fresh"))
                .groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("fresh").alias("fresh"))
            )
        state = materialise(state)
        if written is not None:
            discard(written)
        written = state
        left = state.groupBy("kind").agg(F.sum("fresh").alias("fresh")).agg(F.max("fresh")).first()[0] or 0.0
        if left * DAMPING / (1 - DAMPING) < tolerance:
            return state.select("kind", "host", "score")


def judge(pages: DataFrame, rules: tuple = RULES, least_net: float = LEAST_NET, hierarchy: float = HIERARCHY, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per page.

    A host without a rule is blocked if its trust less its distrust is below
    ``least_net``; hosts that no seed reaches have zero of both. The scores come
    by Spark jobs while the plan is built. Null urls and urls without '://' have
    an empty host and path, fit no rule and are judged as hosts without seeds.
    Repeated rows are judged alike; extra columns are ignored; an empty table
    gives no rows.
    """
    url = F.col("url").cast("string")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = read.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    counts = materialise(
        ruled.where("host <> ''").groupBy("host").agg(
            F.sum(F.when(F.col("fit.verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
            F.sum(F.when(F.col("fit.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"),
            F.count("*").alias("pages"),
        )
    )
    seeds = counts.select(F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), "host", (F.col("allowed") / F.col("pages")).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), "host", (F.col("blocked") / F.col("pages")).alias("seed")),
    ))).where("seed > 0")
    totals = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("n")).collect()}
    seeds = seeds.select("kind", "host", (F.col("seed") / F.when(F.col("kind") == "trust", F.lit(totals.get("trust", 1.0))).otherwise(F.lit(totals.get("distrust", 1.0)))).alias("seed"))
    score = propagate(host_edges(read, hierarchy), seeds, tolerance)
    net = score.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(-F.col("score"))).alias("net"))
    by_net = F.when(F.coalesce("net", F.lit(0.0)) < least_net, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", "fit").join(net, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_net).alias("verdict")
    )


def oracle(rules: tuple = RULES) -> str:
    """The same verdicts as DuckDB SQL."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked)
    return rf"""
WITH RECURSIVE split AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages
), ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS said FROM split
), seeds AS (
  SELECT kind, host, seed / sum(seed) OVER (PARTITION BY kind) AS seed FROM (
    SELECT 'trust' AS kind, host, count(*) FILTER (said = 'allow') / count(*) AS seed FROM ruled WHERE host <> '' GROUP BY host
    UNION ALL
    SELECT 'distrust', host, count(*) FILTER (said = 'block') / count(*) FROM ruled WHERE host <> '' GROUP BY host) WHERE seed > 0
), links AS (
  SELECT host AS source, translate(target, '{UPPER}', '{LOWER}') AS target, count(*)::DOUBLE AS weight
  FROM (SELECT host, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{LINK}', 1))) AS target FROM split WHERE host <> '') GROUP BY ALL
), hosts AS (SELECT host FROM split WHERE host <> '' UNION SELECT target FROM links
), parents AS (SELECT host, regexp_extract(host, '^[^.]+\.([^.]+\.[^.]+.*)$', 1) AS up FROM hosts
), edges AS (
  SELECT source, target, sum(weight) AS weight FROM (
    SELECT * FROM links WHERE source <> target
    UNION ALL SELECT DISTINCT host, up, {HIERARCHY}::DOUBLE FROM parents WHERE up <> ''
    UNION ALL SELECT DISTINCT up, host, {HIERARCHY}::DOUBLE FROM parents WHERE up <> '') GROUP BY ALL
), moves AS (
  SELECT kind, a, b, weight / sum(weight) OVER (PARTITION BY kind, a) AS share FROM (
    SELECT 'trust' AS kind, source AS a, target AS b, weight FROM edges UNION ALL SELECT 'distrust', target, source, weight FROM edges)
), steps AS (
  SELECT * FROM moves UNION ALL SELECT kind, a, a, NULL FROM (SELECT kind, a FROM moves UNION SELECT kind, b FROM moves UNION SELECT kind, host FROM seeds)
), state(round, kind, host, score, fresh) AS (
  SELECT 0, kind, host, {1 - DAMPING} * seed, {1 - DAMPING} * seed FROM seeds
  UNION ALL
  SELECT round + 1, kind, b, sum(coalesce({DAMPING} * fresh * share, score)), sum(coalesce({DAMPING} * fresh * share, 0.0))
  FROM (SELECT r.*, b, share FROM state r JOIN steps s ON s.kind = r.kind AND s.a = r.host)
  WHERE round = 0 OR round % {CUT} <> 0 OR (SELECT max(x) FROM (SELECT sum(fresh) AS x FROM state GROUP BY kind)) * {DAMPING} / {1 - DAMPING} >= {TOLERANCE}
  GROUP BY round, kind, b
), net AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE -score END) AS net FROM state WHERE round = (SELECT max(round) FROM state) GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(net, 0.0) < {LEAST_NET} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN net USING (host)"""
