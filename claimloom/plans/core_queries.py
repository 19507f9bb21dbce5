"""The credibility queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import attributes as A
from claimloom.operators import agreement, canonical, community, overlap, propagate, report, walk
from claimloom.plans import credibility
from claimloom.session import cut, ensure_checkpoint_dir, table
from claimloom.sources import readers

#: Rounds of the fixed-length propagation queries; walk length; the pair that is inspected.
K = 8
STEPS = 6
START = 7
#: Rounds of the reference's v0 to v2; tolerance and cap of its runs to convergence.
FULL_ROUNDS = 20
TOLERANCE = 1e-8
CAP = 1000


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return readers.distinct_edges(table(spark, sf, "assertions"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    return report.one_name_each(table(spark, sf, "sources"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = canonical.filter_vocabulary(table(spark, sf, "source_claims"))
    return canonical.canonicalise(rows)


def _properties(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a canonical value, by property."""
    rows = _claims(spark, sf).withColumnRenamed("canonical_attribute", "attribute")
    return rows.select("row_id", "source_id", "product_id", "attribute", "value", "unit", "claim_id")


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    return _properties(spark, sf).filter(F.col("value").isNotNull())


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    claims = readers.last_by(table(spark, sf, "claims"), ["claim_id"], ["product_id", "attribute"], "loaded_at")
    values = table(spark, sf, "source_claims").select("row_id", "source_id", "claim_id", canonical.raw_value().alias("value"))
    kept = values.filter(F.col("source_id").isNotNull() & F.col("claim_id").isNotNull())
    return agreement.agreement_weights(kept, claims, order="row_id")


def _scores(spark: SparkSession, sf: str, rule: str, weighted: bool = False, init: DataFrame | None = None) -> propagate.Propagation:
    weights = _weights(spark, sf) if weighted else None
    return propagate.propagate(edges(spark, sf), init, rule=rule, weights=weights, fixed_iterations=K)


def _rounded(p: propagate.Propagation) -> DataFrame:
    return p.scores.select("source_id", F.round("score", 10).alias("score"))


def source_names(spark, sf):
    return names(spark, sf)


def graph_stats(spark, sf):
    return overlap.graph_stats(edges(spark, sf))


def source_sizes(spark, sf):
    return report.with_names(overlap.source_sizes(edges(spark, sf)), names(spark, sf)).orderBy(F.desc("degree"), F.desc("source_id"))


def support_breakdown(spark, sf):
    return overlap.support_breakdown(edges(spark, sf)).orderBy("support")


def source_overlap(spark, sf):
    rows = overlap.source_overlap(edges(spark, sf)).withColumn("ratio", F.round("ratio", 10))
    return report.with_names(rows, names(spark, sf)).orderBy(F.desc("ratio"), F.desc("source_id"))


def propagate_v0(spark, sf):
    return _rounded(_scores(spark, sf, "v0"))


def propagate_v1(spark, sf):
    """The v0 rule from a seeded start."""
    return _rounded(_scores(spark, sf, "v1", init=propagate.seeded(edges(spark, sf))))


def propagate_v2(spark, sf):
    return _rounded(_scores(spark, sf, "v2"))


def propagate_v4(spark, sf):
    return _rounded(_scores(spark, sf, "v4"))


def propagate_weighted(spark, sf):
    return _rounded(_scores(spark, sf, "v7", weighted=True))


def propagate_paper(spark, sf):
    return _rounded(_scores(spark, sf, "paper"))


def claim_support(spark, sf):
    """Claim credibility of the last round, scaled by its sum."""
    support = _scores(spark, sf, "v4").support
    total = support.agg(F.sum("support").alias("_t"))
    return support.join(F.broadcast(total)).select("claim_id", F.round(F.col("support") / F.col("_t"), 10).alias("support"))


def convergence_history(spark, sf):
    """The largest change of each of the first rounds of the sum rule."""
    found = propagate.propagate(edges(spark, sf), rule="v4", tolerance=0.0, max_iterations=5)
    return found.history().withColumn("delta", F.round("delta", 9))


def converged_v3(spark, sf):
    """The mean rule in the loop that stops at convergence or, as here, at the cap."""
    return _rounded(propagate.propagate(edges(spark, sf), rule="v3", max_iterations=K))


def _full(spark: SparkSession, sf: str, rule: str, init: DataFrame | None = None) -> DataFrame:
    return _rounded(propagate.propagate(edges(spark, sf), init, rule=rule, fixed_iterations=FULL_ROUNDS))


def full_v0(spark, sf):
    """The v0 rule for all rounds of the reference."""
    return _full(spark, sf, "v0")


def full_v1(spark, sf):
    """The v0 rule from a seeded start for all rounds of the reference."""
    return _full(spark, sf, "v1", propagate.seeded(edges(spark, sf)))


def full_v2(spark, sf):
    return _full(spark, sf, "v2")


def fixed_point_v3(spark, sf):
    """The mean rule until convergence, by the reference's tolerance and cap."""
    return _rounded(propagate.propagate(edges(spark, sf), rule="v3", tolerance=TOLERANCE, max_iterations=CAP))


def credibility_run(spark, sf):
    """The whole run: weighted, unweighted and seeded scores until convergence."""
    e = edges(spark, sf)
    graph = readers.CredibilityGraph(names(spark, sf), e, _weights(spark, sf))
    result = credibility.run(graph, tolerance=TOLERANCE, max_iterations=CAP)
    runs = {"credibility": result.credibility, "baseline": result.baseline, "from_seed": result.from_seed}
    first, *rest = (p.scores.select("source_id", F.round("score", 10).alias(k)) for k, p in runs.items())
    for other in rest:
        first = first.join(other, "source_id")
    return first.withColumn("same_fixed_point", F.lit(result.same_fixed_point))


def init_difference(spark, sf):
    """The largest difference after some rounds between an equal and a seeded start."""
    e = edges(spark, sf)
    first, second = _scores(spark, sf, "v4"), _scores(spark, sf, "v4", init=propagate.seeded(e))
    both = first.scores.join(second.scores.withColumnRenamed("score", "other"), "source_id")
    return both.agg(F.round(F.max(F.abs(F.col("score") - F.col("other"))), 9).alias("difference"))


def agreement_weights(spark, sf):
    return _weights(spark, sf).withColumn("weight", F.round("weight", 10))


def top_sources(spark, sf):
    return report.with_names(report.top_sources(_scores(spark, sf, "v7", True).scores), names(spark, sf))


def top_sources_with_claims(spark, sf):
    rows = report.top_sources_with_claims(_scores(spark, sf, "v0").scores, edges(spark, sf))
    return report.with_names(rows, names(spark, sf))


def bottom_sources(spark, sf):
    return report.with_names(report.bottom_sources(_scores(spark, sf, "v4").scores), names(spark, sf))


def ranking_changes(spark, sf):
    changes = report.ranking_changes(_scores(spark, sf, "v4").scores, _scores(spark, sf, "v7", True).scores)
    return report.with_names(changes, names(spark, sf))


def saved_scores(spark, sf):
    """The score file, written and read again as it stands: 12 decimals."""
    path = f"{ensure_checkpoint_dir(spark)}/scores-{hashlib.md5(sf.encode()).hexdigest()}"
    report.save_scores(_scores(spark, sf, "v4").scores, names(spark, sf), path)
    return spark.read.schema("source_id bigint, domain string, score string").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def top_claims(spark, sf):
    """Claims of highest support with what they are about."""
    about = readers.last_by(table(spark, sf, "claims"), ["claim_id"], ["product_id", "attribute"], "loaded_at")
    support = claim_support(spark, sf).orderBy(F.desc("support"), "claim_id").limit(20)
    known = support.join(about, "claim_id", "left")
    return known.select("claim_id", "support", F.coalesce("product_id", F.lit("?")).alias("product_id"), F.coalesce("attribute", F.lit("?")).alias("attribute"))


def canonical_claims(spark, sf):
    return canonical.claim_nodes(_claims(spark, sf))


def canonical_support(spark, sf):
    nodes = canonical.claim_nodes(_claims(spark, sf)).withColumnRenamed("claim_hash", "claim_id")
    return overlap.support_breakdown(nodes)


def skipped_claims(spark, sf):
    return canonical.skipped_claims(_claims(spark, sf)).orderBy(F.desc("skipped"), "canonical_attribute")


def skipped_examples(spark, sf):
    return canonical.skipped_examples(_claims(spark, sf))


def raw_claims(spark, sf):
    return canonical.raw_claims(canonical.filter_vocabulary(table(spark, sf, "source_claims")))


def property_agreement(spark, sf):
    found = agreement.property_agreement(_valued(spark, sf))
    return found.select("product_id", "attribute", "support", "largest", F.round("agreement", 10).alias("agreement"), F.size("counts").alias("n_values"))


def agreement_summary(spark, sf):
    return agreement.agreement_summary(agreement.property_agreement(_valued(spark, sf)))


def agreement_distribution(spark, sf):
    return agreement.distribution(agreement.property_agreement(_valued(spark, sf)), "largest", "support", "bucket").orderBy("bucket")


def worst_agreement(spark, sf):
    worst = agreement.worst_agreement(agreement.property_agreement(_valued(spark, sf)))
    return worst.select("product_id", "attribute", "support", "largest", F.round("agreement", 10).alias("agreement"))


def worst_agreement_values(spark, sf):
    """The values behind the worst properties, most backed first."""
    worst = agreement.worst_agreement(agreement.property_agreement(_valued(spark, sf)))
    return _values(worst)


def _values(worst: DataFrame) -> DataFrame:
    """The values of some properties with their counts, in order of count."""
    listed = worst.select("product_id", "attribute", F.posexplode("counts").alias("_p", "value", "n"))
    return listed.select("product_id", "attribute", "value", "n", (F.col("_p") + 1).alias("rank"))


def _clean(spark, sf):
    return agreement.remove_ambiguous(_properties(spark, sf)).filter(F.col("value").isNotNull())


def remove_ambiguous(spark, sf):
    return agreement.remove_ambiguous(_properties(spark, sf)).select("row_id", "source_id", "product_id", "attribute", "value")


def ambiguous_count(spark, sf):
    return agreement.ambiguous_count(_properties(spark, sf))


def agreement_edges(spark, sf):
    found = agreement.agreement_edges(_clean(spark, sf))
    return found.select("row_id", "source_id", "product_id", "attribute", "value", "support", "total", F.round("weight", 10).alias("weight"))


def edge_weight_distribution(spark, sf):
    return agreement.distribution(agreement.agreement_edges(_clean(spark, sf)), "support", "total", "bucket").orderBy("bucket")


def weakest_edges(spark, sf):
    found = agreement.weakest_edges(agreement.agreement_edges(_clean(spark, sf)))
    return found.select("row_id", "source_id", "product_id", "attribute", "value", "support", "total", F.round("weight", 10).alias("weight"))


def largest_disagreements(spark, sf):
    worst = agreement.worst_agreement(agreement.property_agreement(_clean(spark, sf)))
    return worst.select("product_id", "attribute", "support", "largest", F.round("agreement", 10).alias("agreement"))


def largest_disagreement_values(spark, sf):
    """The groups of values behind the largest disagreements, most backed first."""
    return _values(agreement.worst_agreement(agreement.property_agreement(_clean(spark, sf))))


def _last(spark, sf):
    rows = _properties(spark, sf).filter(F.col("claim_id").isNotNull() & F.col("source_id").isNotNull() & F.col("product_id").isNotNull())
    return overlap.last_values(rows, "row_id", ("value", "unit"))


def last_values(spark, sf):
    return _last(spark, sf)


_INCLUSION = ("score_ab", "score_ba", "agreement", "asymmetry")


def directional_inclusion(spark, sf):
    pairs = overlap.directional_inclusion(_last(spark, sf))
    return pairs.select("source_a", "source_b", "matches", "disagreements", "size_a", "size_b", *[F.round(c, 10).alias(c) for c in _INCLUSION])


def top_inclusion(spark, sf):
    pairs = directional_inclusion(spark, sf)
    order = ("asymmetry", "matches", "disagreements", "agreement", "source_a", "source_b")
    return _pair_names(spark, sf, report.top_by(pairs, 30, *[F.desc(c) for c in order]))


def _pair_names(spark: SparkSession, sf: str, pairs: DataFrame) -> DataFrame:
    known = names(spark, sf)
    return report.with_names(report.with_names(pairs, known, "source_a", "name_a"), known, "source_b", "name_b")


def structural_independence(spark, sf):
    pairs = overlap.structural_independence(_last(spark, sf))
    measures = ("inclusion", "average_rarity", "redundancy", "independence")
    return pairs.select("source_a", "source_b", "matches", "disagreements", *[F.round(c, 9).alias(c) for c in measures])


def rarity_overlap(spark, sf):
    return overlap.rarity_overlap(edges(spark, sf)).withColumn("score", F.round("score", 9))


def top_rarity(spark, sf):
    return _pair_names(spark, sf, report.top_by(rarity_overlap(spark, sf), 30, *[F.desc(c) for c in ("score", "shared", "source_a", "source_b")]))


def _two(spark, sf):
    """The two sources of most rows."""
    rows = _last(spark, sf)
    sizes = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    largest = sorted(r.source_id for r in sizes.orderBy(F.desc("n"), "source_id").limit(2).collect())
    if len(largest) < 2:
        return rows.filter(F.lit(False)), rows.filter(F.lit(False))
    a, b = largest
    return readers.source_rows(rows, a), readers.source_rows(rows, b)


def inspect_pair(spark, sf):
    return overlap.inspect_pair(*_two(spark, sf)).orderBy("product_id", "attribute")


def inspect_totals(spark, sf):
    return overlap.inspect_totals(overlap.inspect_pair(*_two(spark, sf)))


def source_graph(spark, sf):
    return overlap.source_graph(edges(spark, sf))


def projection_edges(spark, sf):
    """The edges of the source graph by name, heaviest first."""
    return _pair_names(spark, sf, overlap.source_graph(edges(spark, sf))).orderBy(F.desc("weight"), "source_a", "source_b")


def communities(spark, sf):
    return community.find_communities(overlap.source_graph(edges(spark, sf)))


def bridge_edges(spark, sf):
    graph = cut(overlap.source_graph(edges(spark, sf)))
    return community.bridge_edges(graph, community.find_communities(graph))


def connected_components(spark, sf):
    return community.connected_components(edges(spark, sf))


def expected_visits(spark, sf):
    return walk.expected_visits(edges(spark, sf), START, STEPS).withColumn("visits", F.round("visits", 10))


def visit_share(spark, sf):
    found = report.share(walk.expected_visits(edges(spark, sf), START, STEPS), "visits")
    shown = found.select("source_id", F.round("percent", 8).alias("percent"))
    return report.with_names(report.top_by(shown, 20, F.desc("percent"), "source_id"), names(spark, sf))


def random_walks(spark, sf):
    return walk.random_walks(edges(spark, sf), START, walkers=5000, steps=4)


def visit_totals(spark, sf):
    return report.visit_totals(walk.random_walks(edges(spark, sf), START, walkers=5000, steps=4))


def unvisited_sources(spark, sf):
    """The sources that one step from the source of the smallest id cannot reach."""
    e = edges(spark, sf)
    start = e.agg(F.min("source_id").alias("s")).head().s
    return walk.unvisited(names(spark, sf), walk.expected_visits(e, 0 if start is None else start, 1))


def source_by_domain(spark, sf):
    """The id of each domain, as the point lookup gives it."""
    return table(spark, sf, "sources").filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.min("source_id").alias("source_id"))


QUERIES = {
    f.__name__: f
    for f in (
        source_names, source_by_domain, graph_stats, source_sizes, support_breakdown, source_overlap, propagate_v0, propagate_v1, propagate_v2,
        propagate_v4, propagate_weighted, propagate_paper, claim_support, convergence_history, converged_v3, init_difference, agreement_weights,
        full_v0, full_v1, full_v2, fixed_point_v3, credibility_run,
        top_sources, top_sources_with_claims, bottom_sources, ranking_changes, saved_scores, top_claims, canonical_claims, canonical_support, skipped_claims,
        skipped_examples, raw_claims, property_agreement, agreement_summary, agreement_distribution, worst_agreement, worst_agreement_values,
        remove_ambiguous, ambiguous_count, agreement_edges, edge_weight_distribution, weakest_edges, largest_disagreements, largest_disagreement_values, last_values,
        directional_inclusion, top_inclusion, structural_independence, rarity_overlap, top_rarity, inspect_pair, inspect_totals, source_graph, projection_edges,
        communities, bridge_edges, connected_components, expected_visits, visit_share, random_walks, visit_totals, unvisited_sources,
    )
}

# ---------------------------------------------------------------- the same in SQL

_STAND_INS = ", ".join("'" + w.replace("'", "''") + "'" for w in A.STAND_INS)
_VOCABULARY = ", ".join(f"'{v}'" for v in canonical.VOCABULARY)
_E = "e AS MATERIALIZED (SELECT DISTINCT source_id AS s, claim_id AS c FROM assertions WHERE source_id IS NOT NULL AND claim_id IS NOT NULL)"
_N = "nm AS (SELECT source_id AS s, arg_max(domain, (loaded_at, domain)) AS domain FROM sources GROUP BY source_id)"
_NAME = "coalesce(domain, s::VARCHAR) AS name"
_TRIM = "regexp_replace(raw, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
_ROWS = f"""raw AS (SELECT row_id, source_id AS s, product_id AS p, canonical_attribute AS a, unit, claim_id AS c, value_numeric, value_string,
  coalesce(value_numeric::VARCHAR, value_string) AS raw FROM source_claims WHERE canonical_attribute IN ({_VOCABULARY})),
r AS MATERIALIZED (SELECT *, CASE WHEN NOT (lower({_TRIM}) IN ({_STAND_INS}) OR NOT regexp_matches(raw, '[\\p{{L}}\\p{{N}}]')) THEN
  CASE a WHEN 'bluetooth_version' THEN nullif(regexp_extract(raw, '([0-9]+([.][0-9]+)?)', 1), '')
         WHEN 'wifi_standard' THEN lower({_TRIM}) WHEN 'touchscreen' THEN lower({_TRIM}) ELSE raw END END AS v FROM raw)"""
_LAST_CLAIM = "cl AS (SELECT claim_id AS c, max({'loaded_at': loaded_at, 'product_id': product_id, 'attribute': attribute}) AS m FROM claims GROUP BY 1)"
_WEIGHTS = f"""{_LAST_CLAIM}, wr AS (SELECT s.row_id, s.source_id AS s, s.claim_id AS c, m.product_id AS p, m.attribute AS a,
  coalesce(value_numeric::VARCHAR, value_string) AS v FROM source_claims s JOIN cl ON cl.c = s.claim_id WHERE s.source_id IS NOT NULL),
ww AS (SELECT row_id, s, c, count(*) OVER (PARTITION BY p, a, v) / count(*) OVER (PARTITION BY p, a) AS w FROM wr),
wt AS MATERIALIZED (SELECT s, c, arg_max(w, row_id) AS w FROM ww GROUP BY s, c)"""


def _chain(rounds: int, split: bool, combine: str, weighted: bool = False, seeded: bool = False, prefix: str = "", scaled: bool = False) -> str:
    """Common table expressions for a number of rounds; the last are ``{prefix}x{rounds}`` (s, x) and ``{prefix}y{rounds}`` (c, y)."""
    p = prefix
    down = ("coalesce(w, 1.0)" if weighted else "1.0") + (" / d" if split else "")
    up = {"sum": "1.0", "mean": "1.0 / d", "claim_split": "1.0 / n"}[combine]
    left = " LEFT JOIN wt USING (s, c)" if weighted else ""
    own = "((s % 2147483647 + 2147483647) % 2147483647)"
    start = f"((({own} * 48271 + 69621) % 2147483647 * 48271) % 2147483647 + 1)::DOUBLE" if seeded else "1.0"
    parts = [
        f"{p}g AS MATERIALIZED (SELECT s, c, {down} AS dn, {up} AS up FROM e JOIN (SELECT s, count(*) AS d FROM e GROUP BY s) USING (s)"
        f" JOIN (SELECT c, count(*) AS n FROM e GROUP BY c) USING (c){left})",
        f"{p}i AS (SELECT DISTINCT s FROM e)",
        f"{p}x0 AS MATERIALIZED (SELECT s, {start} / sum({start}) OVER () AS x FROM {p}i)",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"{p}y{k} AS MATERIALIZED (SELECT c, sum(x * dn) AS y FROM {p}g JOIN {p}x{k - 1} USING (s) GROUP BY c)")
        raw = f"SELECT s, sum(y * up) AS x FROM {p}g JOIN {p}y{k} USING (c) GROUP BY s"
        last = scaled or k == rounds
        parts.append(f"{p}x{k} AS MATERIALIZED ({f'SELECT s, x / sum(x) OVER () AS x FROM ({raw})' if last else raw})")
    return ", ".join(parts)


def _propagated(split: bool, combine: str, **options) -> str:
    weights = f", {_WEIGHTS}" if options.get("weighted") else ""
    return f"WITH {_E}{weights}, {_chain(K, split, combine, **options)} SELECT s AS source_id, round(x, 10) AS score FROM x{K}"


def _rounds_20(split: bool, combine: str, **options) -> str:
    return f"WITH {_E}, {_chain(FULL_ROUNDS, split, combine, **options)} SELECT s AS source_id, round(x, 10) AS score FROM x{FULL_ROUNDS}"


def _fixed_point(prefix: str, split: bool, combine: str, **options) -> str:
    """Tables of a run until convergence; the last is ``{prefix}fp`` (s, x). Needs RECURSIVE."""
    p = prefix
    return f"""{_chain(0, split, combine, prefix=p, **options)}, {p}lo(k, s, x, delta) AS (SELECT 0, s, x, 1e9::DOUBLE FROM {p}x0 UNION ALL
SELECT k, s, x, max(abs(x - was)) OVER () FROM (SELECT n.k, n.s, n.z / sum(n.z) OVER () AS x, o.x AS was FROM
  (SELECT max(k) + 1 AS k, s, sum(y * up) AS z FROM {p}g JOIN (SELECT max(k) AS k, c, sum(x * dn) AS y FROM {p}g JOIN {p}lo USING (s)
    WHERE k < {CAP} AND delta >= {TOLERANCE} GROUP BY c) USING (c) GROUP BY s) n JOIN {p}lo o USING (s))),
{p}fp AS MATERIALIZED (SELECT s, x FROM {p}lo WHERE k = (SELECT max(k) FROM {p}lo))"""


_SUM = f"WITH {_E}, {_chain(K, True, 'sum')}"
_WSUM = f"WITH {_E}, {_WEIGHTS}, {_chain(K, True, 'sum', weighted=True)}"
_TENTH = """CASE WHEN (20 * {0}) % {1} = 0 AND (20 * {0} // {1}) % 2 = 1
  THEN CASE 20 * {0} // {1} WHEN 1 THEN 0.1 WHEN 3 THEN 0.1 WHEN 5 THEN 0.2 WHEN 7 THEN 0.3 WHEN 9 THEN 0.5 WHEN 11 THEN 0.6 WHEN 13 THEN 0.7
       WHEN 15 THEN 0.8 WHEN 17 THEN 0.8 ELSE 0.9 END ELSE round_even({0}::DOUBLE / {1}, 1) END::DOUBLE"""
_GROUPS = "pv AS (SELECT p, a, v, count(*) AS n FROM {0} WHERE v IS NOT NULL GROUP BY ALL), pg AS (SELECT p, a, sum(n)::BIGINT AS support, max(n) AS largest, count(*)::INT AS nv FROM pv GROUP BY ALL HAVING sum(n) >= 2)"
_ONE = "one AS (SELECT s, p, a FROM r GROUP BY ALL HAVING count(DISTINCT v) = 1), am AS MATERIALIZED (SELECT r.* FROM r JOIN one ON r.s IS NOT DISTINCT FROM one.s AND r.p IS NOT DISTINCT FROM one.p AND r.a = one.a)"
_CLEAN = "cv AS (SELECT * FROM am WHERE v IS NOT NULL), ed AS (SELECT *, count(*) OVER (PARTITION BY p, a, v) AS support, count(*) OVER (PARTITION BY p, a) AS total FROM cv)"
_AGREE = "SELECT p AS product_id, a AS attribute, support, largest, round(largest / support::DOUBLE, 10) AS agreement"
_EDGE = "SELECT row_id, s AS source_id, p AS product_id, a AS attribute, v AS value, support, total, round(support / total::DOUBLE, 10) AS weight FROM ed"
_MAPS = """mp AS MATERIALIZED (SELECT s, p, a, arg_max(v, row_id) AS v, arg_max((unit, 1), row_id)[1] AS unit FROM r WHERE c IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND v IS NOT NULL GROUP BY s, p, a)"""
_INCL = """sz AS (SELECT s, count(*) AS n FROM mp GROUP BY s),
pr AS (SELECT x.s AS a, y.s AS b, count(*) FILTER (x.v = y.v) AS m, count(*) FILTER (x.v <> y.v) AS d FROM mp x JOIN mp y ON x.p = y.p AND x.a = y.a AND x.s < y.s GROUP BY ALL),
inc AS (SELECT a AS source_a, b AS source_b, m AS matches, d AS disagreements, i.n AS size_a, j.n AS size_b, m / j.n::DOUBLE AS ab, m / i.n::DOUBLE AS ba,
  m / (m + d)::DOUBLE AS ag FROM pr JOIN sz i ON i.s = a JOIN sz j ON j.s = b)"""
_INCLUDED = "SELECT source_a, source_b, matches, disagreements, size_a, size_b, round(ab, 10) AS score_ab, round(ba, 10) AS score_ba, round(ag, 10) AS agreement, round(abs(ab - ba), 10) AS asymmetry FROM inc"
_RARITY = f"""WITH {_E}, q AS (SELECT s, c, 1.0 / count(*) OVER (PARTITION BY c) AS w FROM e)
SELECT x.s AS source_a, y.s AS source_b, round(sum(x.w), 9) AS score, count(*) AS shared FROM q x JOIN q y ON x.c = y.c AND x.s < y.s GROUP BY ALL"""
_PAIR_NAMES = "coalesce(na.domain, source_a::VARCHAR) AS name_a, coalesce(nb.domain, source_b::VARCHAR) AS name_b"
_PAIR_JOINS = " ".join(
    f"LEFT JOIN (SELECT source_id AS s, arg_max(domain, (loaded_at, domain)) AS domain FROM sources GROUP BY source_id) n{x} ON n{x}.s = r.source_{x}" for x in "ab"
)
_RANK = "row_number() OVER (PARTITION BY pv.p, pv.a ORDER BY n DESC, v)::INT AS rank"
_TWO = """tw AS (SELECT s FROM mp GROUP BY s ORDER BY count(*) DESC, s LIMIT 2),
ins AS (SELECT x.p, x.a, CASE WHEN x.v = y.v AND x.unit IS NOT DISTINCT FROM y.unit THEN 'MATCH' ELSE 'DISAGREE' END AS verdict,
  concat_ws(' ', x.v, nullif(x.unit, '')) AS text_a, concat_ws(' ', y.v, nullif(y.unit, '')) AS text_b
  FROM mp x JOIN mp y ON x.p = y.p AND x.a = y.a WHERE x.s = (SELECT min(s) FROM tw) AND y.s = (SELECT max(s) FROM tw))"""


def _walk(steps: int, start: str = str(START)) -> str:
    p = f"""g AS MATERIALIZED (SELECT s, c, 1.0 / count(*) OVER (PARTITION BY s) AS dn, 1.0 / count(*) OVER (PARTITION BY c) AS up FROM e),
w0 AS MATERIALIZED (SELECT {start}::BIGINT AS s, 1.0::DOUBLE AS x)"""
    for k in range(1, steps + 1):
        p += f""", w{k} AS MATERIALIZED (SELECT s, sum(y * up) AS x FROM g JOIN (SELECT c, sum(x * dn) AS y FROM g JOIN w{k - 1} USING (s) GROUP BY c) USING (c) GROUP BY s)"""
    union = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(steps + 1))
    return f"WITH {_E}, {p}, vis AS (SELECT s, sum(x) AS visits FROM ({union}) GROUP BY s)"


def _monte_carlo(walkers: int, steps: int) -> str:
    draw = lambda k: f"(((((walker + 1) * 48271) % 2147483647 + {k}) * 48271) % 2147483647 + 7919) * 48271 % 2147483647"
    p = f"""n AS MATERIALIZED (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY s) AS d,
row_number() OVER (PARTITION BY c ORDER BY s) - 1 AS j, count(*) OVER (PARTITION BY c) AS a FROM e),
a0 AS MATERIALIZED (SELECT range AS walker, {START}::BIGINT AS s FROM range({walkers}))"""
    for k in range(steps):
        p += f""", b{k} AS MATERIALIZED (SELECT walker, n.c, n.a FROM a{k} JOIN n ON n.s = a{k}.s AND n.i = ({draw(2 * k)}) % n.d),
a{k + 1} AS MATERIALIZED (SELECT walker, n.s FROM b{k} JOIN n ON n.c = b{k}.c AND n.j = ({draw(2 * k + 1)}) % n.a)"""
    union = " UNION ALL ".join(f"SELECT s FROM a{k}" for k in range(steps + 1))
    return f"WITH {_E}, {p} SELECT s AS source_id, count(*) AS visits FROM ({union}) GROUP BY s"


_CHANGES = f"""WITH {_E}, {_WEIGHTS}, {_chain(K, True, 'sum', prefix='b')}, {_chain(K, True, 'sum', weighted=True)}, {_N},
ch AS (SELECT s, round(x{K}.x, 10) AS after, coalesce(round(bx{K}.x, 10), 0.0) AS before FROM x{K} LEFT JOIN bx{K} USING (s))
SELECT s AS source_id, before, after, round(after - before, 10) AS change, {_NAME} FROM ch LEFT JOIN nm USING (s)
ORDER BY abs(round(after - before, 10)) DESC, round(after - before, 10) DESC, s DESC LIMIT 20"""
_DELTAS = " UNION ALL ".join(f"SELECT {k}::INT AS iteration, (SELECT round(max(abs(a.x - b.x)), 9) FROM x{k - 1} a JOIN x{k} b USING (s)) AS delta" for k in range(1, 6))

SQL = {
    "source_names": f"WITH {_N} SELECT s AS source_id, domain FROM nm",
    "source_by_domain": "SELECT domain, min(source_id) AS source_id FROM sources WHERE domain IS NOT NULL GROUP BY domain",
    "graph_stats": f"WITH {_E} SELECT count(DISTINCT s) AS n_sources, count(DISTINCT c) AS n_claims, count(*) AS n_assertions FROM e",
    "source_sizes": f"WITH {_E}, {_N} SELECT s AS source_id, count(*) AS degree, {_NAME} FROM e LEFT JOIN nm USING (s) GROUP BY s, domain",
    "support_breakdown": f"WITH {_E} SELECT support, count(*) AS claims FROM (SELECT c, count(*) AS support FROM e GROUP BY c) GROUP BY support",
    "source_overlap": f"""WITH {_E}, {_N}, q AS (SELECT s, count(*) OVER (PARTITION BY c) AS n FROM e)
        SELECT s AS source_id, count(*) AS total, count(*) FILTER (n = 1) AS unique_claims, round(count(*) FILTER (n = 1) / count(*)::DOUBLE, 10) AS ratio,
        {_NAME} FROM q LEFT JOIN nm USING (s) GROUP BY s, domain""",
    "propagate_v0": _propagated(False, "mean"),
    "propagate_v1": _propagated(False, "mean", seeded=True),
    "propagate_v2": _propagated(True, "mean"),
    "converged_v3": _propagated(True, "mean"),
    "full_v0": _rounds_20(False, "mean"),
    "full_v1": _rounds_20(False, "mean", seeded=True),
    "full_v2": _rounds_20(True, "mean"),
    "fixed_point_v3": f"WITH RECURSIVE {_E}, {_fixed_point('', True, 'mean')} SELECT s AS source_id, round(x, 10) AS score FROM fp",
    "credibility_run": f"""WITH RECURSIVE {_E}, {_WEIGHTS}, {_fixed_point('w', True, 'sum', weighted=True)}, {_fixed_point('b', True, 'sum')},
        {_fixed_point('r', True, 'sum', weighted=True, seeded=True)}
        SELECT s AS source_id, round(wfp.x, 10) AS credibility, round(bfp.x, 10) AS baseline, round(rfp.x, 10) AS from_seed,
        max(abs(wfp.x - rfp.x)) OVER () < {credibility.SAME_FIXED_POINT} AS same_fixed_point FROM wfp JOIN bfp USING (s) JOIN rfp USING (s)""",
    "propagate_v4": _propagated(True, "sum"),
    "propagate_weighted": _propagated(True, "sum", weighted=True),
    "propagate_paper": _propagated(True, "claim_split"),
    "claim_support": f"{_SUM} SELECT c AS claim_id, round(y / sum(y) OVER (), 10) AS support FROM y{K}",
    "convergence_history": f"WITH {_E}, {_chain(5, True, 'sum', scaled=True)} {_DELTAS}",
    "init_difference": f"WITH {_E}, {_chain(K, True, 'sum')}, {_chain(K, True, 'sum', seeded=True, prefix='b')} SELECT round(max(abs(a.x - b.x)), 9) AS difference FROM x{K} a JOIN bx{K} b USING (s)",
    "agreement_weights": f"WITH {_WEIGHTS} SELECT s AS source_id, c AS claim_id, round(w, 10) AS weight FROM wt",
    "top_sources": f"{_WSUM}, {_N} SELECT s AS source_id, round(x, 10) AS score, {_NAME} FROM x{K} LEFT JOIN nm USING (s) ORDER BY round(x, 10) DESC, s LIMIT 20",
    "bottom_sources": f"{_SUM}, {_N} SELECT s AS source_id, round(x, 10) AS score, {_NAME} FROM x{K} LEFT JOIN nm USING (s) ORDER BY round(x, 10), s LIMIT 20",
    "top_sources_with_claims": f"""WITH {_E}, {_chain(K, False, 'mean')}, {_N}, t AS (SELECT s, round(x, 10) AS score FROM x{K} ORDER BY 2 DESC, s LIMIT 20)
        SELECT s AS source_id, score, (SELECT count(*) FROM e WHERE e.s = t.s) AS claims, {_NAME} FROM t LEFT JOIN nm USING (s)""",
    "visit_totals": f"SELECT count(*) AS sources, sum(visits)::BIGINT AS visits FROM ({_monte_carlo(5000, 4)})",
    "ranking_changes": _CHANGES,
    "saved_scores": f"{_SUM}, {_N} SELECT s AS source_id, coalesce(domain, s::VARCHAR) AS domain, printf('%.12f', x) AS score FROM x{K} LEFT JOIN nm USING (s)",
    "top_claims": f"""{_SUM}, {_LAST_CLAIM}, t AS (SELECT c, round(y / sum(y) OVER (), 10) AS support FROM y{K} ORDER BY 2 DESC, c LIMIT 20)
        SELECT c AS claim_id, support, coalesce(m.product_id, '?') AS product_id, coalesce(m.attribute, '?') AS attribute FROM t LEFT JOIN cl USING (c)""",
    "canonical_claims": f"""WITH {_ROWS} SELECT DISTINCT sha256(concat_ws('|', coalesce(p, 'None'), coalesce(a, 'None'), v, coalesce(unit, 'None'))) AS claim_hash,
        s AS source_id FROM r WHERE v IS NOT NULL AND s IS NOT NULL""",
    "canonical_support": f"""WITH {_ROWS} SELECT support, count(*) AS claims FROM (SELECT count(DISTINCT s) AS support FROM r
        WHERE v IS NOT NULL AND s IS NOT NULL GROUP BY p, a, v, unit) GROUP BY support""",
    "skipped_claims": f"WITH {_ROWS} SELECT a AS canonical_attribute, count(*) AS skipped FROM r WHERE v IS NULL GROUP BY a",
    "skipped_examples": f"""WITH {_ROWS}, x AS (SELECT DISTINCT a, raw FROM r WHERE v IS NULL AND raw IS NOT NULL)
        SELECT a AS canonical_attribute, raw AS raw_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY raw)::INT AS rank FROM x) WHERE rank <= 50""",
    "raw_claims": f"""WITH {_ROWS} SELECT DISTINCT s AS source_id, p AS product_id, a AS canonical_attribute, value_numeric,
        CASE WHEN value_numeric IS NULL THEN value_string END AS value_string, unit FROM r""",
    "property_agreement": f"WITH {_ROWS}, {_GROUPS.format('r')} {_AGREE}, nv AS n_values FROM pg",
    "agreement_summary": f"WITH {_ROWS}, {_GROUPS.format('r')} SELECT count(*) FILTER (largest = support) AS perfect, count(*) FILTER (largest <> support) AS partial, count(*) AS total FROM pg",
    "agreement_distribution": f"WITH {_ROWS}, {_GROUPS.format('r')} SELECT {_TENTH.format('largest', 'support')} AS bucket, count(*) AS n FROM pg GROUP BY 1",
    "worst_agreement": f"WITH {_ROWS}, {_GROUPS.format('r')} {_AGREE} FROM pg WHERE largest <> support ORDER BY largest / support::DOUBLE, support DESC, p NULLS FIRST, a LIMIT 20",
    "worst_agreement_values": f"""WITH {_ROWS}, {_GROUPS.format('r')}, t AS (SELECT * FROM pg WHERE largest <> support ORDER BY largest / support::DOUBLE, support DESC, p NULLS FIRST, a LIMIT 20)
        SELECT pv.p AS product_id, pv.a AS attribute, v AS value, n, {_RANK} FROM pv JOIN t ON pv.p IS NOT DISTINCT FROM t.p AND pv.a = t.a""",
    "largest_disagreement_values": f"""WITH {_ROWS}, {_ONE}, {_GROUPS.format('am')}, t AS (SELECT * FROM pg WHERE largest <> support ORDER BY largest / support::DOUBLE, support DESC, p NULLS FIRST, a LIMIT 20)
        SELECT pv.p AS product_id, pv.a AS attribute, v AS value, n, {_RANK} FROM pv JOIN t ON pv.p IS NOT DISTINCT FROM t.p AND pv.a = t.a""",
    "remove_ambiguous": f"WITH {_ROWS}, {_ONE} SELECT row_id, s AS source_id, p AS product_id, a AS attribute, v AS value FROM am",
    "ambiguous_count": f"WITH {_ROWS} SELECT count(*) FILTER (n = 1) AS kept, count(*) FILTER (n <> 1) AS removed FROM (SELECT count(DISTINCT v) AS n FROM r GROUP BY s, p, a)",
    "agreement_edges": f"WITH {_ROWS}, {_ONE}, {_CLEAN} {_EDGE}",
    "edge_weight_distribution": f"WITH {_ROWS}, {_ONE}, {_CLEAN} SELECT {_TENTH.format('support', 'total')} AS bucket, count(*) AS n FROM ed GROUP BY 1",
    "weakest_edges": f"WITH {_ROWS}, {_ONE}, {_CLEAN} {_EDGE} WHERE support <> total ORDER BY support / total::DOUBLE, total DESC, p NULLS FIRST, a, s NULLS FIRST, v, row_id LIMIT 20",
    "largest_disagreements": f"WITH {_ROWS}, {_ONE}, {_GROUPS.format('am')} {_AGREE} FROM pg WHERE largest <> support ORDER BY largest / support::DOUBLE, support DESC, p NULLS FIRST, a LIMIT 20",
    "last_values": f"WITH {_ROWS}, {_MAPS} SELECT s AS source_id, p AS product_id, a AS attribute, v AS value, unit FROM mp",
    "directional_inclusion": f"WITH {_ROWS}, {_MAPS}, {_INCL} {_INCLUDED}",
    "top_inclusion": f"""WITH {_ROWS}, {_MAPS}, {_INCL} SELECT r.*, {_PAIR_NAMES} FROM ({_INCLUDED}
        ORDER BY asymmetry DESC, matches DESC, disagreements DESC, agreement DESC, source_a DESC, source_b DESC LIMIT 30) r {_PAIR_JOINS}""",
    "projection_edges": f"""WITH {_E} SELECT r.*, {_PAIR_NAMES} FROM (SELECT x.s AS source_a, y.s AS source_b, count(*) AS weight
        FROM e x JOIN e y ON x.c = y.c AND x.s < y.s GROUP BY ALL) r {_PAIR_JOINS}""",
    "structural_independence": f"""WITH {_ROWS}, {_MAPS}, {_INCL}, ra AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY p, a, v) AS w FROM mp),
        mr AS (SELECT x.s AS i, y.s AS j, sum(x.w) / count(*) AS ar FROM ra x JOIN ra y ON x.p = y.p AND x.a = y.a AND x.v = y.v AND x.s < y.s GROUP BY ALL)
        SELECT source_a, source_b, matches, disagreements, round(greatest(ab, ba), 9) AS inclusion, round(coalesce(ar, 0.0), 9) AS average_rarity,
        round(greatest(ab, ba) * coalesce(ar, 0.0), 9) AS redundancy, round(1 - greatest(ab, ba) * coalesce(ar, 0.0), 9) AS independence
        FROM inc LEFT JOIN mr ON i = source_a AND j = source_b""",
    "rarity_overlap": _RARITY,
    "top_rarity": f"SELECT r.*, {_PAIR_NAMES} FROM (SELECT * FROM ({_RARITY}) ORDER BY score DESC, shared DESC, source_a DESC, source_b DESC LIMIT 30) r {_PAIR_JOINS}",
    "inspect_pair": f"WITH {_ROWS}, {_MAPS}, {_TWO} SELECT p AS product_id, a AS attribute, verdict, text_a, text_b FROM ins",
    "inspect_totals": f"WITH {_ROWS}, {_MAPS}, {_TWO} SELECT count(*) FILTER (verdict = 'MATCH') AS matches, count(*) FILTER (verdict <> 'MATCH') AS disagreements FROM ins",
    "source_graph": f"WITH {_E} SELECT x.s AS source_a, y.s AS source_b, count(*) AS weight FROM e x JOIN e y ON x.c = y.c AND x.s < y.s GROUP BY ALL",
    "connected_components": f"""WITH RECURSIVE {_E}, cc(s, r) AS (SELECT DISTINCT s, s FROM e UNION SELECT y.s, cc.r FROM cc JOIN e x ON x.s = cc.s JOIN e y ON y.c = x.c AND y.s <> x.s)
        SELECT s AS source_id, min(r) AS component FROM cc GROUP BY s""",
    "expected_visits": f"{_walk(STEPS)} SELECT s AS source_id, round(visits, 10) AS visits FROM vis",
    "visit_share": f"{_walk(STEPS)}, {_N}, t AS (SELECT s, round(visits / sum(visits) OVER () * 100, 8) AS percent FROM vis ORDER BY 2 DESC, s LIMIT 20) SELECT s AS source_id, percent, {_NAME} FROM t LEFT JOIN nm USING (s)",
    "random_walks": _monte_carlo(5000, 4),
    "unvisited_sources": f"{_walk(1, '(SELECT min(s) FROM e)')}, {_N} SELECT s AS source_id, domain FROM nm WHERE s NOT IN (SELECT s FROM vis)",
}

#: Reports whose order counts get it as a column, in the query and in its SQL: ``-`` before a column is descending.
_ORDERS = {
    "top_sources": "-score source_id", "bottom_sources": "score source_id", "top_sources_with_claims": "-score source_id", "top_claims": "-support claim_id",
    "visit_share": "-percent source_id", "worst_agreement": "agreement -support product_id attribute", "largest_disagreements": "agreement -support product_id attribute",
    "weakest_edges": "weight -total product_id attribute source_id value row_id", "top_rarity": "-score -shared -source_a -source_b",
    "top_inclusion": "-asymmetry -matches -disagreements -agreement -source_a -source_b", "ranking_changes": "-abs(change) -change -source_id",
    "skipped_claims": "-skipped canonical_attribute",
}


def _in_order(query: Callable[[SparkSession, str], DataFrame], order: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def ordered(spark: SparkSession, sf: str) -> DataFrame:
        return report.numbered(query(spark, sf), *[F.expr(c.lstrip("-")).desc() if c[0] == "-" else F.expr(c).asc() for c in order])

    ordered.__name__, ordered.__doc__ = query.__name__, query.__doc__
    return ordered


for _name, _order in _ORDERS.items():
    _columns = _order.split()
    QUERIES[_name] = _in_order(QUERIES[_name], _columns)
    _sorted = ", ".join(f"{c.lstrip('-')} DESC NULLS LAST" if c[0] == "-" else f"{c} NULLS FIRST" for c in _columns)
    SQL[_name] = f"SELECT *, row_number() OVER (ORDER BY {_sorted})::INT AS position FROM ({SQL[_name]})"
