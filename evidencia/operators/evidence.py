"""Denominator, test evidence, gaps, coverage by layer and the readiness score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import percent, priority_rank, reasons, round_half_up, saturate
from ..registry import query
from ..schema import BEHAVIORS, GAP_EVIDENCE, HARD_TYPES, LAYERS, WEAK_TYPES, rank_of
from ..sources.driver_tables import Graph

#: Reasons for leaving a symbol out (fixed values).
BOILERPLATE, INFRA, GENERATED = "boilerplate accessor", "infra code", "generated code"


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.coalesce("stale", F.lit(False)))


def denominator(nodes: DataFrame) -> DataFrame:
    """The one definition of what counts: eligible and not stale."""
    return live(nodes).where("eligible")


def endpoints(edges: DataFrame, types: list[str]) -> DataFrame:
    """Distinct ids at either end of edges of these types."""
    return edges.where(F.col("type").isin(types)).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def marked(rows: DataFrame, ids: DataFrame, name: str, key: str = "external_id") -> DataFrame:
    """Rows with a flag whether their key is among the ids."""
    found = ids.select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(name))
    return rows.join(found, F.col(key) == F.col(f"{name}_id"), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(f"{name}_id")


def denominator_composition(nodes: DataFrame) -> DataFrame:
    eligible, source, reason = F.col("eligible"), F.col("behavior_source"), F.col("reason")
    inferred = ~eligible & F.coalesce(source == "test_inferred", F.lit(False))
    other = ~eligible & ~F.coalesce(source == "test_inferred", F.lit(False))
    explicit = ["code_export", "requirement_template", "markdown_requirement"]
    counts = [F.count_if(eligible).alias("total")] + [F.count_if(eligible & (source == s)).alias(s) for s in explicit]
    counts += [F.count_if(inferred).alias("excluded_test_inferred")] + [F.count_if(other & (reason == r)).alias(n) for n, r in (("excluded_boilerplate", BOILERPLATE), ("excluded_infra", INFRA), ("excluded_generated", GENERATED))]
    counts += [F.count_if(F.col("kind") == "CodeSymbol").alias("code_symbols_total"), F.count_if(eligible & ~F.coalesce(source.isin(explicit), F.lit(False))).alias("unattributed")]
    return live(nodes).agg(*counts)


@query(
    "denominator_composition",
    "nodes",
    """select count(*) filter (eligible) as total, count(*) filter (eligible and behavior_source = 'code_export') as code_export, count(*) filter (eligible and behavior_source = 'requirement_template') as requirement_template,
    count(*) filter (eligible and behavior_source = 'markdown_requirement') as markdown_requirement, count(*) filter (not eligible and behavior_source = 'test_inferred') as excluded_test_inferred,
    count(*) filter (not eligible and behavior_source is distinct from 'test_inferred' and reason = 'boilerplate accessor') as excluded_boilerplate, count(*) filter (not eligible and behavior_source is distinct from 'test_inferred' and reason = 'infra code') as excluded_infra,
    count(*) filter (not eligible and behavior_source is distinct from 'test_inferred' and reason = 'generated code') as excluded_generated, count(*) filter (kind = 'CodeSymbol') as code_symbols_total,
    count(*) filter (eligible and (behavior_source is null or behavior_source not in ('code_export', 'requirement_template', 'markdown_requirement'))) as unattributed from nodes where stale is not true""",
)
def _denominator_composition(g: Graph) -> DataFrame:
    return denominator_composition(g.nodes)


def gap_evidence(behaviors: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Behaviours with ``evidence``: covered, weak or none. Strength doesn't matter here."""
    found = marked(marked(behaviors, endpoints(edges, HARD_TYPES), "hard"), endpoints(candidates, WEAK_TYPES), "weak")
    return found.withColumn("evidence", F.when(F.col("hard"), "covered").when(F.col("weak"), "weak").otherwise("none"))


EVIDENCE_SQL = """, hard as (select from_id as id from edges where type in ('TESTED_BY', 'COVERS') union select to_id from edges where type in ('TESTED_BY', 'COVERS')),
    weak as (select from_id as id from candidates where type in ('MAY_BE_TESTED_BY', 'MAY_COVER') union select to_id from candidates where type in ('MAY_BE_TESTED_BY', 'MAY_COVER')),
    judged as (select n.*, case when external_id in (select id from hard) then 'covered' when external_id in (select id from weak) then 'weak' else 'none' end as evidence from nodes n)"""
NSC_SQL = """, linked as (select distinct c.from_id as id, n.layer from candidates c join nodes n on n.external_id = c.to_id and n.kind = 'TestCase' join nodes m on m.external_id = c.from_id and m.kind <> 'TestCase' where c.type in ('MAY_BE_TESTED_BY', 'MAY_COVER')),
    nsc as (select id, case when bool_or(layer = 'e2e') then 'layer_e2e' else 'layer_api' end as reason from linked where id not in (select id from hard) group by id having bool_and(layer in ('e2e', 'api')))"""


def of_kinds(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    return nodes.where(F.col("kind").isin(kinds))


@query("gap_evidence", ("nodes", "edges", "candidates"), EVIDENCE_SQL + " select external_id, evidence from judged where kind in ('Requirement', 'UserFlow', 'BusinessRule')")
def _gap_evidence(g: Graph) -> DataFrame:
    return gap_evidence(of_kinds(g.nodes, BEHAVIORS), g.edges, g.candidates).select("external_id", "evidence")


def not_confirmable(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids without hard edges all of whose candidate tests are e2e or api, with the reason to defer them."""
    tests = of_kinds(nodes, ["TestCase"]).select(F.col("external_id").alias("test_id"), "layer")
    weak = candidates.where(F.col("type").isin(WEAK_TYPES))
    either = weak.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(weak.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    linked = either.join(tests, F.col("other") == F.col("test_id")).join(tests.select(F.col("test_id").alias("id")), "id", "left_anti")
    free = linked.join(endpoints(edges, HARD_TYPES), "id", "left_anti")
    layer = F.coalesce("layer", F.lit("unknown"))
    by_id = free.groupBy("id").agg(F.bool_and(layer.isin("e2e", "api")).alias("all_far"), F.bool_or(layer == "e2e").alias("any_e2e"))
    return by_id.where("all_far").select(F.col("id").alias("external_id"), F.when(F.col("any_e2e"), "layer_e2e").otherwise("layer_api").alias("reason"))


@query("nsc_behaviors", ("nodes", "edges", "candidates"), EVIDENCE_SQL + NSC_SQL + " select id as external_id, reason from nsc")
def _nsc(g: Graph) -> DataFrame:
    return not_confirmable(g.nodes, g.edges, g.candidates)


def with_criteria(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    owners = edges.where("type = 'HAS_ACCEPTANCE_CRITERION'").select(F.col("from_id").alias("id")).distinct()
    return marked(nodes, owners, "linked_criteria").withColumn("has_criteria", F.col("linked_criteria") | F.coalesce("inline_criteria", F.lit(False)))


@query(
    "acceptance_criteria",
    ("nodes", "edges"),
    """select external_id, inline_criteria or external_id in (select from_id from edges where type = 'HAS_ACCEPTANCE_CRITERION') as has_criteria from nodes where kind in ('Requirement', 'UserFlow')""",
)
def _criteria(g: Graph) -> DataFrame:
    return with_criteria(of_kinds(g.nodes, BEHAVIORS), g.edges).select("external_id", "has_criteria")


def rank_gaps(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, limit: int | None = 10, least_priority: int = -1) -> DataFrame:
    """Gaps, weakest evidence and highest priority first, in node order."""
    rows = with_criteria(gap_evidence(of_kinds(nodes, BEHAVIORS), edges, candidates), edges)
    rows = rows.join(not_confirmable(nodes, edges, candidates).select("external_id"), "external_id", "left_anti")
    rows = rows.withColumn("rank", priority_rank(F.col("priority"))).where(F.col("rank") >= least_priority).where("evidence <> 'covered' or not has_criteria")
    none, weak, bare = F.col("evidence") == "none", F.col("evidence") == "weak", ~F.col("has_criteria")
    reason = reasons((none, "No test evidence linked"), (weak, "Only weak (candidate) test evidence linked"), (bare, "Missing acceptance criteria"))
    ordered = rows.orderBy(rank_of(F.col("evidence"), GAP_EVIDENCE), F.desc("rank"), "ord")
    out = ordered if limit is None else ordered.limit(limit)
    return out.select("external_id", "title", "kind", F.coalesce("priority", F.lit("unknown")).alias("priority"), reason.alias("reason"), "has_criteria", "evidence")


@query(
    "gap_ranking",
    ("nodes", "edges", "candidates"),
    EVIDENCE_SQL
    + NSC_SQL
    + """, rows as (select *, inline_criteria or external_id in (select from_id from edges where type = 'HAS_ACCEPTANCE_CRITERION') as has_criteria,
        case when lower(priority) like '%crit%' or lower(priority) = 'p0' then 4 when lower(priority) like '%high%' or lower(priority) = 'p1' then 3 when lower(priority) like '%med%' or lower(priority) = 'p2' then 2 when lower(priority) like '%low%' or lower(priority) = 'p3' then 1 else 0 end as rank
        from judged where kind in ('Requirement', 'UserFlow', 'BusinessRule') and external_id not in (select id from nsc))
    select external_id, title, kind, coalesce(priority, 'unknown') as priority, concat_ws('; ', case evidence when 'none' then 'No test evidence linked' when 'weak' then 'Only weak (candidate) test evidence linked' end, case when not has_criteria then 'Missing acceptance criteria' end) as reason, has_criteria, evidence
    from rows where evidence <> 'covered' or not has_criteria order by case evidence when 'none' then 0 when 'weak' then 1 else 2 end, rank desc, ord limit 10""",
)
def _gap_ranking(g: Graph) -> DataFrame:
    return rank_gaps(g.nodes, g.edges, g.candidates)


def confirming_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and test_id of hard test edges, whichever way they run; the other end may be any node."""
    hard = edges.where(F.col("type").isin(HARD_TYPES) & (F.col("strength") == "hard"))
    tests = of_kinds(nodes, ["TestCase"]).select(F.col("external_id").alias("test_id"), "layer")
    forth = hard.join(tests, F.col("from_id") == F.col("test_id")).select(F.col("to_id").alias("id"), "test_id", "layer")
    back = hard.join(tests, F.col("to_id") == F.col("test_id")).select(F.col("from_id").alias("id"), "test_id", "layer")
    return forth.unionByName(back).distinct()


def coverage_by_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Confirmed behaviours by the first of their tests' layers; layer ``all`` for the total."""
    primary = confirming_tests(nodes, edges).groupBy("id").agg(F.min(rank_of(F.coalesce("layer", F.lit("unknown")), LAYERS)).alias("rank"))
    behaviors = denominator(nodes).select("external_id").join(primary, F.col("external_id") == F.col("id"), "left")
    names = F.array(*map(F.lit, LAYERS))
    layer = F.when(F.col("rank").isNotNull(), F.get(names, F.least(F.col("rank"), F.lit(len(LAYERS) - 1))))
    counts = behaviors.withColumn("layer", layer).agg(F.count("*").alias("total"), F.count("layer").alias("all"), *[F.count_if(F.col("layer") == x).alias(x) for x in LAYERS])
    rows = counts.select("total", F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("confirmed")) for x in ["all", *LAYERS]])).alias("r")).select("total", "r.*")
    return rows.select("layer", "confirmed", F.col("total").alias("total_behaviors"), percent(F.col("confirmed"), F.col("total")).alias("confirmed_pct"))


CONFIRM_SQL = """, confirming as (select distinct e.to_id as id, n.external_id as test_id, n.layer from edges e join nodes n on n.external_id = e.from_id and n.kind = 'TestCase' where e.type in ('TESTED_BY', 'COVERS') and e.strength = 'hard'
    union select distinct e.from_id, n.external_id, n.layer from edges e join nodes n on n.external_id = e.to_id and n.kind = 'TestCase' where e.type in ('TESTED_BY', 'COVERS') and e.strength = 'hard')"""


@query(
    "coverage_by_layer",
    ("nodes", "edges"),
    CONFIRM_SQL
    + """, layers as (select * from (values ('unit', 0), ('component', 1), ('integration', 2), ('api', 3), ('e2e', 4), ('manual', 5), ('unknown', 6)) v(layer, rank)),
    firsts as (select c.id, min(l.rank) as rank from confirming c join layers l using (layer) group by c.id),
    base as (select n.external_id, f.rank from nodes n left join firsts f on f.id = n.external_id where n.eligible and not n.stale),
    counts as (select l.layer, count(b.external_id) as confirmed from layers l left join base b using (rank) group by l.layer union all select 'all', count(rank) from base)
    select layer, confirmed, (select count(*) from base) as total_behaviors, floor(100.0 * confirmed / (select count(*) from base) * 10 + 0.5) / 10 as confirmed_pct from counts""",
)
def _coverage_by_layer(g: Graph) -> DataFrame:
    return coverage_by_layer(g.nodes, g.edges)


def evidence_index(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """What the score counts for each behaviour: hard, weak (a symbol's file link too) or none."""
    files = endpoints(candidates, ["MAY_RELATE_TO"])
    rows = marked(gap_evidence(denominator(nodes), edges, candidates), files, "file_linked", "file")
    weak = F.col("weak") | (F.col("file_linked") & (F.col("behavior_source") == "code_export"))
    return rows.select("external_id", F.when(F.col("hard"), "hard").when(weak, "weak").otherwise("none").alias("evidence"))


@query(
    "evidence_index",
    ("nodes", "edges", "candidates"),
    EVIDENCE_SQL + """ select external_id, case evidence when 'covered' then 'hard' else evidence end as evidence from judged where eligible and not stale""",
)
def _evidence_index(g: Graph) -> DataFrame:
    return evidence_index(g.nodes, g.edges, g.candidates)


#: Weights of the score's dimensions (fixed values).
WEIGHTS = {"behavior_anchors": 0.22, "acceptance_criteria": 0.2, "provenance": 0.15, "interface_mapping": 0.15, "validation_evidence": 0.18, "known_regressions": 0.1}


def readiness_score(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Six saturating dimensions, each rounded before it is weighted, and the overall score with its band."""
    kinds = nodes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("AcceptanceCriterion", "TestCase", "Incident", "Service", "Endpoint")], F.count("*").alias("nodes"), F.count("file").alias("with_ref"))
    counted = with_criteria(denominator(nodes), edges)
    explicit = F.col("behavior_source").isin("requirement_template", "markdown_requirement")
    behaviors = counted.agg(F.count("*").alias("behaviors"), F.count_if(F.coalesce(explicit, F.lit(False))).alias("explicit"), F.count_if(F.coalesce(explicit, F.lit(False)) & F.col("linked_criteria")).alias("explicit_with_criteria"), F.count_if(F.col("confidence") >= 0.8).alias("strong"), F.count_if(F.col("confidence") < 0.8).alias("weak_anchors"))
    tested = evidence_index(nodes, edges, candidates).agg(F.count_if(F.col("evidence") == "hard").alias("hard"), F.count_if(F.col("evidence") == "weak").alias("weak"))
    interfaces = candidates.agg(F.count_if(F.col("type") == "MAY_REQUIRE_INTERFACE").alias("interface_edges"))
    one = kinds.crossJoin(behaviors).crossJoin(tested).crossJoin(interfaces)  # four single rows
    c = F.col
    anchors = F.least(saturate(c("strong") + c("weak_anchors") * 0.4, 6), 0.5 + 0.5 * saturate(c("explicit"), 8))
    criteria = F.when(c("explicit") == 0, saturate(c("AcceptanceCriterion"), 4) * 0.5).otherwise(0.7 * (c("explicit_with_criteria") / c("explicit")) + 0.3 * saturate(c("AcceptanceCriterion"), 4))
    share = F.when(c("behaviors") == 0, 0.0).otherwise((c("hard") + c("weak") * 0.5) / c("behaviors"))
    parts = {"behavior_anchors": anchors, "acceptance_criteria": criteria, "provenance": c("with_ref") / F.greatest(c("nodes"), F.lit(1)), "interface_mapping": saturate(c("Service") + c("Endpoint") + c("interface_edges") * 0.5, 5), "validation_evidence": 0.6 * share + 0.4 * saturate(c("TestCase"), 8), "known_regressions": saturate(c("Incident"), 3)}
    scored = one.select(*[round_half_up(e, 2).alias(n) for n, e in parts.items()])
    total: Column = F.lit(0.0)
    for n, w in WEIGHTS.items():
        total = total + F.lit(w) * F.col(n)
    overall = F.floor(100.0 * total + 0.5)
    return scored.withColumn("overall", overall).withColumn("band", F.when(F.col("overall") >= 75, "strong").when(F.col("overall") >= 60, "good").when(F.col("overall") >= 40, "usable").otherwise("thin"))


@query(
    "readiness_score",
    ("nodes", "edges", "candidates"),
    EVIDENCE_SQL
    + """, k as (select count(*) filter (kind = 'AcceptanceCriterion') as acs, count(*) filter (kind = 'TestCase') as tests, count(*) filter (kind = 'Incident') as incidents, count(*) filter (kind in ('Service', 'Endpoint')) as interfaces, count(*) as nodes, count(file) as refs from nodes),
    b as (select count(*) as n, count(*) filter (behavior_source in ('requirement_template', 'markdown_requirement')) as explicit, count(*) filter (behavior_source in ('requirement_template', 'markdown_requirement') and external_id in (select from_id from edges where type = 'HAS_ACCEPTANCE_CRITERION')) as owners,
        count(*) filter (confidence >= 0.8) as strong, count(*) filter (confidence < 0.8) as weak_anchors, count(*) filter (evidence = 'covered') as hard, count(*) filter (evidence = 'weak') as weak from judged where eligible and not stale),
    d as (select floor(least(least(1.0, (strong + weak_anchors * 0.4) / 6.0), 0.5 + 0.5 * least(1.0, explicit / 8.0)) * 100 + 0.5) / 100 as behavior_anchors,
        floor((case when explicit = 0 then least(1.0, acs / 4.0) * 0.5 else 0.7::double * (owners::double / explicit) + 0.3::double * least(1.0, acs / 4.0) end) * 100 + 0.5) / 100 as acceptance_criteria, floor(refs::double / nodes * 100 + 0.5) / 100 as provenance,
        floor(least(1.0, interfaces / 5.0) * 100 + 0.5) / 100 as interface_mapping, floor((0.6::double * ((hard + weak * 0.5) / n) + 0.4::double * least(1.0, tests / 8.0)) * 100 + 0.5) / 100 as validation_evidence, floor(least(1.0, incidents / 3.0) * 100 + 0.5) / 100 as known_regressions from k, b),
    o as (select *, floor(100.0::double * (0.22::double * behavior_anchors + 0.2::double * acceptance_criteria + 0.15::double * provenance + 0.15::double * interface_mapping + 0.18::double * validation_evidence + 0.1::double * known_regressions) + 0.5)::bigint as overall from d)
    select behavior_anchors::double as behavior_anchors, acceptance_criteria::double as acceptance_criteria, provenance::double as provenance, interface_mapping::double as interface_mapping, validation_evidence::double as validation_evidence, known_regressions::double as known_regressions, overall,
        case when overall >= 75 then 'strong' when overall >= 60 then 'good' when overall >= 40 then 'usable' else 'thin' end as band from o""",
)
def _readiness(g: Graph) -> DataFrame:
    return readiness_score(g.nodes, g.edges, g.candidates)


@query("kind_tally", "nodes", "select kind, count(*) as n from nodes group by kind")
def _kind_tally(g: Graph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n"))


@query("relationship_tally", ("edges", "candidates"), "select type, sum(hard) as edges, sum(may) as candidates from (select type, 1 as hard, 0 as may from edges union all select type, 0, 1 from candidates) x group by type")
def _relationship_tally(g: Graph) -> DataFrame:
    both = g.edges.select("type", F.lit(1).alias("hard"), F.lit(0).alias("may")).unionByName(g.candidates.select("type", F.lit(0).alias("hard"), F.lit(1).alias("may")))
    return both.groupBy("type").agg(F.sum("hard").alias("edges"), F.sum("may").alias("candidates"))


@query("endpoint_degree", "edges", "select id, count(*) as degree, count(distinct type) as types from (select from_id as id, type from edges union all select to_id, type from edges) x group by id")
def _endpoint_degree(g: Graph) -> DataFrame:
    """Edges at either end of each id."""
    ends = g.edges.select("type", F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.countDistinct("type").alias("types"))
