"""Call paths from entries, ranked by risk, calls and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import stored, unbroadcast
from ..operators.graphs import HIGH_ROUTE, MUTATION, adjacency, endpoint_entries, entry_order, flow_chain, flow_limits, flow_paths, ranked_entries
from ..operators.graphs import _flow_entries as behavior_entries
from ..registry import query
from ..sources.driver_tables import Graph
from .risk import RISK_SQL, risk_rows
from .risk import RELATIONS as RISK_RELATIONS

RELATIONS = (*RISK_RELATIONS, "endpoints")

FLOWS_SQL = (
    RISK_SQL
    + f""", live_ids as (select external_id as id from nodes where kind = 'CodeSymbol' and not stale), eligible_ids as (select external_id as id from nodes where kind = 'CodeSymbol' and eligible and not stale),
    call_pairs as (select from_id as caller, to_id as callee, min(strength) as strength from edges where type = 'CALLS' and strength in ('hard', 'framework-derived') and from_id in (select id from live_ids) and to_id in (select id from live_ids) group by 1, 2),
    starts as (select id, 'Behavior' as kind, '' as title, id as start from eligible_ids where id not in (select to_id from edges where type = 'CALLS' and from_id in (select id from eligible_ids)) union all select external_id, 'Endpoint', title, symbol from endpoints where symbol in (select id from live_ids)),
    fans as (select caller, count(*) as n from call_pairs group by caller),
    scored_starts as (select s.*, coalesce(f.n, 0) as fans, greatest(coalesce(r.score, 0.0::double), (case when kind = 'Endpoint' then 500 + case when regexp_matches(s.title || ' ' || s.id, '{MUTATION}') then 250 else 0 end + case when regexp_matches(s.title || ' ' || s.id, '{HIGH_ROUTE}') then 250 else 0 end else 0 end + coalesce(f.n, 0) * 10)::double) as score from starts s left join fans f on f.caller = s.start left join risk r on r.id = s.start),
    flow_walk(path, derived) as (select [start], false from (select distinct start from scored_starts) x union all select list_append(w.path, c.callee), w.derived or c.strength = 'framework-derived' from flow_walk w join call_pairs c on c.caller = w.path[-1] where not list_contains(w.path, c.callee) and len(w.path) <= 8),
    whole as (select *, path[1] as start from flow_walk w where len(path) > 1 and (len(path) = 9 or not exists (select 1 from call_pairs c where c.caller = w.path[-1] and not list_contains(w.path, c.callee)))),
    placed as (select *, row_number() over (partition by start order by path) as n from whole),
    named as (select *, array_to_string(path, '>') as key, case when derived then 'framework-derived: reachable' else 'hard: reachable' end as tier from placed where n <= 21),
    every_flow as (select 'flow:' || left(sha256('flow|' || s.kind || '|' || s.id || '|' || key || '|' || tier), 12) as id, s.id as entry, s.kind, key as path, len(path) - 1 as depth, tier, len(path) = 9 as truncated, s.score, s.start, n from named join scored_starts s using (start)),
    flows as (select * from every_flow where n <= 20 order by score desc, kind <> 'Endpoint', entry, start, id limit 500)"""
)


class Flows:
    """Ranked entries and calls of a graph; its relations are written first, as risk and walks read them many times. So are calls
    and risk, and no large one is broadcast, for the driver holds a plan's broadcasts all at once."""

    def __init__(self, g: Graph):
        g.settle("symbols", "tests", "calls", "nodes", "edges", "commits", "endpoints", broadcast=False)
        self.calls = unbroadcast(stored(adjacency(g.nodes, g.edges), "adjacency"))
        ends = g.endpoints.select(F.col("external_id"), "title", "symbol")
        nodes = ends.select("external_id", F.lit("Endpoint").alias("kind"), "title", F.lit(False).alias("stale")).distinct()
        edges = ends.select(F.col("external_id").alias("from_id"), F.col("symbol").alias("to_id"), F.lit("IMPLEMENTED_IN").alias("type"))
        every = unbroadcast(nodes.unionByName(g.nodes.select("external_id", "kind", "title", "stale")))  # a hint inside a union is none
        routes = endpoint_entries(every, edges)
        own = behavior_entries(g).select("id", F.lit("Behavior").alias("kind"), F.lit("").alias("title"), F.col("id").alias("start"))
        risk = unbroadcast(stored(risk_rows(g.nodes, g.edges, g.candidates, g.ledger, g.commits).select("id", "score"), "risk"))
        self.ranked = ranked_entries(own.unionByName(routes), self.calls, risk)

    def paths(self) -> DataFrame:
        return flow_paths(self.ranked, self.calls)


@query("flow_paths", RELATIONS, FLOWS_SQL + " select id, entry, kind, path, depth, tier, truncated from flows")
def _flow_paths(g: Graph) -> DataFrame:
    return Flows(g).paths()


@query("flow_tiers", RELATIONS, FLOWS_SQL + " select tier, count(*) as flows, count(*) filter (truncated) as truncated, max(depth) as longest from flows group by tier")
def _flow_tiers(g: Graph) -> DataFrame:
    return Flows(g).paths().groupBy("tier").agg(F.count("*").alias("flows"), F.count_if("truncated").alias("truncated"), F.max("depth").alias("longest"))


@query("flow_entry_ranking", RELATIONS, FLOWS_SQL + " select id, kind, start, score from scored_starts order by score desc, kind <> 'Endpoint', id, start")
def _entry_ranking(g: Graph) -> DataFrame:
    ranked = stored(Flows(g).ranked.select("id", "kind", "start", "score"), "ranked")  # a sort over all tasks reads its rows twice
    return ranked.orderBy(*entry_order())


@query("flow_chain", RELATIONS, FLOWS_SQL + """, steps as (select id, string_split(path, '>') as steps, unnest(string_split(path, '>')) as target from flows),
    chosen as (select target, arg_min(steps, id) as steps from steps group by target) select target, unnest(range(1, len(steps) + 1)) as position, unnest(steps) as step from chosen""")
def _flow_chain(g: Graph) -> DataFrame:
    return flow_chain(Flows(g).paths(), g.nodes.where("kind = 'CodeSymbol'").select(F.col("external_id").alias("id")))


@query(
    "flow_limits",
    RELATIONS,
    FLOWS_SQL
    + """, by_entry as (select entry, kind, start, score, count(*) filter (n <= 20) as flows, count(*) filter (truncated) as deep, count(*) filter (n > 20) as more from every_flow group by all),
    in_order as (select *, coalesce(sum(flows) over (order by score desc, kind <> 'Endpoint', entry, start rows between unbounded preceding and 1 preceding), 0) as before from by_entry),
    entry_order as (select s.*, row_number() over (order by score desc, kind <> 'Endpoint', id, start) as place from scored_starts s),
    filled as (select min(o.place) as place from in_order i join entry_order o on o.id = i.entry and o.kind = i.kind and o.start = i.start where before + flows >= 500)
    select (select count(*) from flows) as total_flows, (select count(*) from flows where truncated) as truncated_flows, coalesce(sum(deep), 0)::bigint as dropped_max_depth, coalesce(sum(more), 0)::bigint as dropped_max_flows_per_entry,
        (coalesce(sum(greatest(before + flows - 500, 0)), 0) + (select count(*) from entry_order, filled f where fans > 0 and entry_order.place > f.place))::bigint as dropped_global_cap from in_order where before < 500""",
)
def _flow_limits(g: Graph) -> DataFrame:
    f = Flows(g)
    return flow_limits(f.ranked, f.calls)
