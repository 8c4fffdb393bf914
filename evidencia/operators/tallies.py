"""Splits and summaries of clusters, and tallies for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import MODULE_SQL, basename, dirname, module_key, percent
from ..registry import query
from ..sources.driver_tables import Graph
from .evidence import denominator
from .graphs import LINKS_SQL, cluster_links, components, shared


#: Members that a cluster may have, clusters that are shown, samples of each (fixed values).
MOST_MEMBERS, MOST_CLUSTERS, SAMPLES = 250, 50, 8
#: Path segments of the first split by directory (fixed value).
FIRST_DEPTH = 5


def split_clusters(members: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(component, member, file) rows with the part of each: the whole component if it is small enough,
    else its modules, else ever longer path prefixes within them, else files."""
    parts = F.filter(F.split(dirname(F.col("file")), "/"), lambda x: x != "")
    rows = members.withColumn("dirs", parts).withColumn("part", F.lit(""))
    deepest = rows.agg(F.max(F.size("dirs"))).first()[0] or 0
    prefix = lambda d: F.coalesce(F.nullif(F.array_join(F.slice("dirs", 1, d), "/"), F.lit("")), F.lit("(root)"))
    finer = [module_key(F.col("file"))] + [prefix(d) for d in range(FIRST_DEPTH, max(FIRST_DEPTH, deepest) + 1)] + [F.col("file")]
    done = None
    for key in finer:
        sizes = rows.groupBy("component", "part").agg(F.count("*").alias("n"))
        sized = rows.join(sizes, ["component", "part"])
        fits = sized.where(F.col("n") <= most).select("component", "member", "file", "part")
        done = fits if done is None else done.unionByName(fits)
        rows = shared(sized.where(F.col("n") > most).drop("n").withColumn("part", F.concat("part", F.lit("|"), key)))
        if rows.isEmpty():
            return done
    return done.unionByName(rows.select("component", "member", "file", "part"))


SPLIT_SQL = (
    LINKS_SQL
    + f""", k as (select *, {MODULE_SQL.format("file")} as m, coalesce(nullif(array_to_string(list_slice(list_filter(string_split(regexp_replace(file, '/?[^/]*$', ''), '/'), lambda x: x <> ''), 1, 5), '/'), ''), '(root)') as p from labels),
    n as (select *, count(*) over (partition by component) as n0, count(*) over (partition by component, m) as n1, count(*) over (partition by component, m, p) as n2 from k),
    split_parts as (select component, member, file, case when n0 <= 250 then '' when n1 <= 250 then '|' || m when n2 <= 250 then '|' || m || '|' || p else '|' || m || '|' || p || '|' || file end as part from n)"""
)


def labelled(g: Graph) -> DataFrame:
    g.settle("symbols", "calls", "may_calls")  # the links read them many times
    live = g.live_symbols.select(F.col("external_id").alias("member"), "file")
    found = components(cluster_links(g.nodes, g.edges, g.candidates).select("a", "b"))
    return shared(live.join(found, live.member == found.id, "left").select("member", "file", F.coalesce("component", "member").alias("component")))


@query("cluster_split", ("nodes", "edges", "candidates"), SPLIT_SQL + " select component, member, part from split_parts")
def _split(g: Graph) -> DataFrame:
    return split_clusters(labelled(g)).select("component", "member", "part")


def cluster_summaries(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Clusters of two members and more: id, sizes, samples, links within by kind and title, the largest first.

    A part has ``MOST_MEMBERS`` members at most, or is one file, so its ids may be gathered."""
    key = ["component", "part"]
    files = parts.groupBy(*key, "file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("member")).alias("ids"))
    dirs = F.transform("paths", lambda f: F.split(dirname(f), "/"))
    common = F.aggregate(dirs, F.get(dirs, F.lit(0)), lambda acc, d: F.slice(acc, 1, F.coalesce(F.nullif(F.array_position(F.zip_with(acc, d, lambda x, y: F.coalesce(x == y, F.lit(False))), False), F.lit(0)) - 1, F.size(acc)).cast("int")))
    label = F.coalesce(F.nullif(F.array_join("common", "/"), F.lit("")), dirname(F.get("paths", F.lit(0))))
    last = F.regexp_extract(label, "([^/]*)$", 1)
    title = F.when(label == "", basename(F.get("paths", F.lit(0)))).when(last == label, label).otherwise(F.concat(last, F.lit(" ("), label, F.lit(")")))
    groups = files.groupBy(*key).agg(F.sum("n").alias("size"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"), F.array_sort(F.collect_list("file")).alias("paths")).where("size >= 2")
    one, other = (parts.select(F.col("member").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in key]) for c in "ab")
    inside = links.where("kind <> 'file'").join(one, "a").join(other, "b").where("a_component = b_component and a_part = b_part")
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s")
    counts = inside.groupBy(F.col("a_component").alias("component"), F.col("a_part").alias("part")).agg(n("hard_call"), n("likely_call"), n("import"))
    joined = groups.join(counts, key, "left").withColumn("common", common)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(F.concat(F.lit("cluster:"), F.substring(F.sha2(F.array_join("ids", "|"), 256), 1, 12)).alias("id"), title.alias("title"), "size", F.size("paths").cast("long").alias("files"), F.slice("paths", 1, SAMPLES).alias("top_files"), F.slice("ids", 1, SAMPLES).alias("top_symbols"), zero("hard_calls"), zero("likely_calls"), zero("imports"))


@query(
    "cluster_summary",
    ("nodes", "edges", "candidates"),
    SPLIT_SQL
    + """, inside as (select x.component, x.part, l.kind from links l join split_parts x on x.member = l.a join split_parts y on y.member = l.b and y.component = x.component and y.part = x.part where l.kind <> 'file'),
    counts as (select component, part, count(*) filter (kind = 'hard_call') as hard_calls, count(*) filter (kind = 'likely_call') as likely_calls, count(*) filter (kind = 'import') as imports from inside group by component, part),
    grouped as (select component, part, count(*) as size, list_sort(list(member)) as ids, list_sort(list(distinct file)) as paths from split_parts group by component, part having count(*) >= 2),
    named as (select g.*, coalesce(c.hard_calls, 0) as hard_calls, coalesce(c.likely_calls, 0) as likely_calls, coalesce(c.imports, 0) as imports, (select regexp_replace(case when bool_and(starts_with(regexp_replace(f, '/[^/]*$', '') || '/', 'src/' || split_part(paths[1], '/', 2) || '/')) then 'src/' || split_part(paths[1], '/', 2) else 'src' end, '/$', '') from (select unnest(paths) as f) u) as label from grouped g left join counts c on c.component = g.component and c.part = g.part)
    select 'cluster:' || left(sha256(array_to_string(ids, '|')), 12) as id, case when contains(label, '/') then regexp_extract(label, '([^/]*)$', 1) || ' (' || label || ')' else label end as title, size, len(paths) as files, list_slice(paths, 1, 8) as top_files, list_slice(ids, 1, 8) as top_symbols, hard_calls, likely_calls, imports
    from named order by size desc, hard_calls + likely_calls + imports desc, id limit 50""",
)
def _summary(g: Graph) -> DataFrame:
    members = labelled(g)  # first, as it writes what the links read
    found = cluster_summaries(split_clusters(members), cluster_links(g.nodes, g.edges, g.candidates))
    return found.orderBy(F.desc("size"), F.desc(F.col("hard_calls") + F.col("likely_calls") + F.col("imports")), "id").limit(MOST_CLUSTERS)


@query("citation_summary", ("generated", "nodes"), "select count(*) as tests, count(*) filter (valid > 0) as with_proof, count(*) filter (valid = 0) as without, sum(cited - valid)::bigint as invalid from (select test_id, count(*) as cited, count(n.external_id) as valid from generated g left join nodes n on n.external_id = g.entity_id group by test_id) x")
def _citation_summary(g: Graph) -> DataFrame:
    known = g.nodes.select(F.col("external_id").alias("entity_id"), F.lit(1).alias("known")).dropDuplicates(["entity_id"])
    tests = g.generated.join(known, "entity_id", "left").groupBy("test_id").agg(F.count("*").alias("cited"), F.count("known").alias("valid"))
    return tests.agg(F.count("*").alias("tests"), F.count_if(F.col("valid") > 0).alias("with_proof"), F.count_if(F.col("valid") == 0).alias("without"), F.sum(F.col("cited") - F.col("valid")).alias("invalid"))


@query("ai_links", "candidates", "select count(*) as links, count(distinct from_id) as symbols, count(distinct to_id) as tests from candidates where ai_suggested")
def _ai_links(g: Graph) -> DataFrame:
    return g.candidates.where("ai_suggested").agg(F.count("*").alias("links"), F.countDistinct("from_id").alias("symbols"), F.countDistinct("to_id").alias("tests"))


@query("directory_noise", "symbols", "select dir, count(*) as other from symbols where not eligible and dir not in (select dir from symbols where eligible and k % 3 = 0 and k % 10 in (1, 3)) group by dir having count(*) >= 25 order by count(*) desc, dir limit 10")
def _noise(g: Graph) -> DataFrame:
    """Directories with nothing useful and much else."""
    useful = g.symbols.where("eligible and k % 3 = 0 and k % 10 in (1, 3)").select("dir").distinct()
    return g.symbols.where("not eligible").join(useful, "dir", "left_anti").groupBy("dir").agg(F.count("*").alias("other")).where("other >= 25").orderBy(F.desc("other"), "dir").limit(10)


@query("scan_block", ("nodes",), "select coalesce(layer, 'unknown') as layer, count(*) as tests, floor(100.0 * count(*) / (select count(*) from nodes where kind = 'TestCase') * 10 + 0.5) / 10 as pct from nodes where kind = 'TestCase' group by 1")
def _scan(g: Graph) -> DataFrame:
    tests = g.nodes.where("kind = 'TestCase'")
    total = tests.agg(F.count("*").alias("all"))
    return tests.groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("tests")).crossJoin(F.broadcast(total)).select("layer", "tests", percent(F.col("tests"), F.col("all")).alias("pct"))  # one row beside


@query("behavior_groups", "nodes", "select split_part(coalesce(file, 'none/'), '/', 1) as top, kind, count(*) as n from nodes where eligible and not stale group by 1, 2")
def _groups(g: Graph) -> DataFrame:
    return denominator(g.nodes).groupBy(F.split(F.coalesce("file", F.lit("none/")), "/")[0].alias("top"), "kind").agg(F.count("*").alias("n"))


@query("explain_links", ("generated", "candidates"), "select g.test_id, c.from_id, c.to_id, c.type, floor(c.confidence * 100 + 0.5) / 100 as confidence from (select distinct test_id, entity_id from generated) g join candidates c on c.from_id = g.entity_id and c.type = 'MAY_BE_TESTED_BY'")
def _explain(g: Graph) -> DataFrame:
    """The weak links behind each generated test."""
    from ..functions.expressions import round_half_up

    cited = g.generated.select("test_id", F.col("entity_id").alias("from_id")).distinct()
    return g.candidates.where("type = 'MAY_BE_TESTED_BY'").join(cited, "from_id").select("test_id", "from_id", "to_id", "type", round_half_up(F.col("confidence"), 2).alias("confidence"))
