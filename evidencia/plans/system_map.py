"""The map of a system: lanes of triggers, the services that their flows are about, and the flows between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..registry import query
from ..sources.driver_tables import Graph

#: Services of a map, those that each lane has at least, and those that risks add (fixed values).
MOST_SERVICES, OF_A_LANE, BY_RISK = 12, 2, 3
#: An owner in this share of all flows, and in three at least, is shared infrastructure (fixed values).
SHARED, LEAST_SHARED = 0.4, 3
TIERS = ["proven", "assoc", "candidate", "none"]


def representatives(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """flow, lane and service: the owner that a flow (flow, lane) is about. Of the owners of its steps (flow, place, owner) that is the one
    in fewest flows, of equal ones the deepest; shared infrastructure only if there is nothing else, and then the last step's owner."""
    mine = steps.join(flows.select("flow"), "flow", "left_semi").select("flow", "place", F.nullif("owner", F.lit("")).alias("owner"))
    often = mine.where("owner is not null").select("flow", "owner").distinct().groupBy("owner").agg(F.count("*").alias("n"))
    cutoff = F.broadcast(flows.agg(F.greatest(F.lit(LEAST_SHARED), F.floor(F.count("*") * SHARED)).alias("cutoff")))  # one row
    met = mine.join(often, "owner", "left").crossJoin(cutoff)
    own = F.col("n") < F.col("cutoff")
    best = met.groupBy("flow").agg(F.min_by(F.when(own, F.col("owner")), F.when(own, F.struct("n", -F.col("place")))).alias("own"), F.max_by("owner", "place").alias("last"))
    return best.join(flows, "flow").select("flow", "lane", F.coalesce("own", "last").alias("service")).where("service is not null")


def shown_services(chosen: DataFrame, lanes: DataFrame, risks: DataFrame) -> DataFrame:
    """service, flows and lane (the place of the lane that most of its flows are in) of the services that a map shows, of the
    representatives ``chosen``: the first two of each lane, up to three more by risk (rank, owner), and the most frequent others."""
    edges = chosen.groupBy("service", "lane").agg(F.count("*").alias("n"), F.min("flow").alias("first")).join(F.broadcast(lanes.select("lane", "place")), "lane")  # a row for each lane
    services = cut(edges.groupBy("service").agg(F.sum("n").alias("flows"), F.min_by("place", F.struct(-F.col("n"), "first")).alias("lane")))
    by_traffic = [F.desc("flows"), F.col("service")]
    of_lane = services.withColumn("i", F.row_number().over(Window.partitionBy("lane").orderBy(*by_traffic))).where(F.col("i") <= OF_A_LANE).select("service")
    risky = risks.groupBy(F.col("owner").alias("service")).agg(F.min("rank").alias("rank")).join(services, "service", "left_semi").join(of_lane, "service", "left_anti").orderBy("rank").limit(BY_RISK).select("service")
    must = cut(of_lane.unionByName(risky))
    room = max(0, MOST_SERVICES + risky.count() - must.count())  # BY_RISK rows, and OF_A_LANE for each lane
    others = services.join(must, "service", "left_anti").orderBy(*by_traffic).limit(room).select("service")
    return services.join(must.unionByName(others), "service", "left_semi")


def system_map(flows: DataFrame, steps: DataFrame, risks: DataFrame, tiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services and edges of the map. Flows have their lane's id, label and priority. What a map leaves out is one more
    service ``rest:`` for each lane, so that a lane's edges sum up to its flows."""
    lanes = flows.groupBy("lane").agg(F.min("label").alias("label"), F.min("priority").alias("priority"))
    lanes = cut(lanes.withColumn("place", F.row_number().over(Window.orderBy("priority", "label", "lane"))))  # few rows
    chosen = cut(representatives(flows, steps))
    shown = cut(shown_services(chosen, lanes, risks))
    counts = chosen.groupBy("lane", "service").agg(F.count("*").alias("flows"))
    edges = counts.join(shown.select("service"), "service", "left_semi").select("lane", "service", "flows")
    rest = counts.join(shown.select("service"), "service", "left_anti").groupBy("lane").agg(F.sum("flows").alias("flows"), F.count("*").alias("hidden"))
    rest_id = F.concat(F.lit("rest:"), "lane").alias("service")
    ranked = tiers.withColumnRenamed("owner", "service").join(shown.select("service"), "service", "left_semi").groupBy("service").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS[:-1]], F.count_if(~F.col("tier").isin(TIERS[:-1])).alias("none"))
    risky = risks.withColumnRenamed("owner", "service").join(shown.select("service"), "service", "left_semi").groupBy("service").agg(F.count("*").alias("risks"), F.min("rank").alias("first_rank"), F.bool_or("critical").alias("critical"))
    zero = F.lit(0).cast("long")
    services = shown.join(ranked, "service", "left").join(risky, "service", "left").select("service", "flows", *[F.coalesce(t, zero).alias(t) for t in TIERS], F.coalesce("risks", zero).alias("risks"), "first_rank", F.coalesce("critical", F.lit(False)).alias("critical"), zero.alias("hidden"))
    folded = rest.select(rest_id, "flows", *[zero.alias(t) for t in TIERS], zero.alias("risks"), F.lit(None).cast(services.schema["first_rank"].dataType).alias("first_rank"), F.lit(False).alias("critical"), "hidden")
    return services.unionByName(folded), edges.unionByName(rest.select("lane", rest_id, "flows"))


RELATIONS = ("trigger_flows", "flow_steps", "owner_risks", "owner_tiers")
MAP_SQL = """, seen as (select distinct flow, owner from flow_steps where owner <> '' and flow in (select flow from trigger_flows)), often as (select owner, count(*) as n from seen group by owner), cutoff as (select greatest(3, floor(count(*) * 0.4)) as c from trigger_flows),
    lasts as (select flow, arg_max(nullif(owner, ''), place) as ignored, max(place) as place from flow_steps group by flow),
    last_owner as (select l.flow, max(nullif(s.owner, '')) as owner from lasts l join flow_steps s on s.flow = l.flow and s.place = l.place group by l.flow),
    own as (select s.flow, arg_min(s.owner, (o.n, -s.place)) as owner from flow_steps s join often o on o.owner = s.owner, cutoff where o.n < c group by s.flow),
    about as (select t.flow, t.lane, coalesce(o.owner, l.owner) as service from trigger_flows t left join own o on o.flow = t.flow left join last_owner l on l.flow = t.flow where coalesce(o.owner, l.owner) is not null),
    lanes as (select lane, row_number() over (order by min(priority), min(label), lane) as place from trigger_flows group by lane),
    counts as (select lane, service, count(*) as flows, min(flow) as first from about group by lane, service),
    services as (select service, sum(c.flows)::bigint as flows, arg_min(l.place, (-c.flows, c.first)) as lane from counts c join lanes l on l.lane = c.lane group by service),
    of_lane as (select service from services qualify row_number() over (partition by lane order by flows desc, service) <= 2),
    risky as (select owner as service from owner_risks where owner in (select service from services) and owner not in (select service from of_lane) group by owner order by min(rank) limit 3),
    must as (select service from of_lane union all select service from risky),
    others as (select service from services where service not in (select service from must) qualify row_number() over (order by flows desc, service) <= 12 + (select count(*) from risky) - (select count(*) from must)),
    shown as (select * from services where service in (select service from must union all select service from others)),
    rest as (select lane, sum(flows)::bigint as flows, count(*) as hidden from counts where service not in (select service from shown) group by lane)"""


def _map(g: Graph) -> tuple[DataFrame, DataFrame]:
    g.settle("symbols")
    return system_map(g.trigger_flows, g.flow_steps, g.owner_risks, g.owner_tiers)


@query(
    "system_map_services",
    RELATIONS,
    MAP_SQL
    + """, tallies as (select owner as service, count(*) filter (tier = 'proven') as proven, count(*) filter (tier = 'assoc') as assoc, count(*) filter (tier = 'candidate') as candidate, count(*) filter (tier = 'none') as none from owner_tiers group by owner), dangers as (select owner as service, count(*) as risks, min(rank) as first_rank, bool_or(critical) as critical from owner_risks group by owner)
    select s.service, flows, coalesce(proven, 0) as proven, coalesce(assoc, 0) as assoc, coalesce(candidate, 0) as candidate, coalesce(none, 0) as none, coalesce(risks, 0) as risks, first_rank, coalesce(critical, false) as critical, 0 as hidden from shown s left join tallies t on t.service = s.service left join dangers d on d.service = s.service
    union all select 'rest:' || lane, flows, 0, 0, 0, 0, 0, null, false, hidden from rest""",
)
def _services(g: Graph) -> DataFrame:
    return _map(g)[0]


@query("system_map_edges", RELATIONS, MAP_SQL + " select lane, service, flows from counts where service in (select service from shown) union all select lane, 'rest:' || lane, flows from rest")
def _edges(g: Graph) -> DataFrame:
    return _map(g)[1]
