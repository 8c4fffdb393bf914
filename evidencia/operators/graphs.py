"""Entries, call depth, call paths, clusters and neighbourhoods. Loops have known bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import extension, local_pair
from ..lineage import cut as shared
from ..registry import query
from ..sources.driver_tables import Graph

#: Paths, files and names of entry points (fixed values).
ENTRY_PATH = r"(?i)(^|/)(routes?|controllers?|handlers?|jobs?|workers?|processors?|queues?|consumers?|subscribers?|listeners?|server|cmd)/"
ENTRY_FILE = r"(?i)(^|/)[^/]*(controller|handler|route|router|job|processor|worker|queue|consumer|subscriber|listener|command|gateway)\.[^./]+$"
API_NAME = r"(?i)^(GET|POST|PUT|PATCH|DELETE|handle.*|handler|route|controller|endpoint)$"
API_PATH = r"(?i)(^|/)api(s)?/"
ENTRY_NAME = r"(?i)(^|[.#])(main|serve|request|endpoint)"
DEPTH = 6


def entry_point(file: Column, title: Column) -> Column:
    api = title.rlike(API_NAME) & file.rlike(API_PATH)
    return F.coalesce(api | file.rlike(ENTRY_PATH) | file.rlike(ENTRY_FILE) | F.concat(file, F.lit("#"), title).rlike(ENTRY_NAME), F.lit(False))


def entries(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'CodeSymbol'").where(entry_point(F.col("file"), F.coalesce("title", "name"))).select(F.col("external_id").alias("id"))


ENTRY_SQL = """, entries as (select external_id as id from nodes where kind = 'CodeSymbol' and (regexp_matches(file, '(?i)(^|/)(routes?|controllers?|handlers?|jobs?|workers?|processors?|queues?|consumers?|subscribers?|listeners?|server|cmd)/')
    or regexp_matches(file, '(?i)(^|/)[^/]*(controller|handler|route|router|job|processor|worker|queue|consumer|subscriber|listener|command|gateway)\\.[^./]+$') or regexp_matches(file || '#' || title, '(?i)(^|[.#])(main|serve|request|endpoint)')))"""


@query("entry_points", "nodes", ENTRY_SQL + " select id from entries")
def _entries(g: Graph) -> DataFrame:
    return entries(g.nodes)


def call_pairs(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'CALLS'").select(F.col("from_id").alias("caller"), F.col("to_id").alias("callee")).distinct()


def flow_depth(symbols: DataFrame, edges: DataFrame, entry_ids: DataFrame) -> DataFrame:
    """id and depth: calls from the nearest entry, six at most; without an entry, how many levels of callers there are.

    One walk goes from all entries at once and labels each symbol that it reaches within six calls. Only the others
    are followed back level by level; there a node counts once in a walk, but for the start itself."""
    calls = shared(call_pairs(edges))
    starts = symbols.select(F.col("external_id").alias("id"))
    frontier = shared(entry_ids.select("id").distinct())
    reached = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, DEPTH + 1):
        after = frontier.join(calls, frontier.id == calls.caller).select(F.col("callee").alias("id")).distinct()
        frontier = shared(after.join(reached, "id", "left_anti"))
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(depth)))
    reached = shared(reached)
    open_ = starts.join(reached, "id", "left_anti")
    frontier = shared(open_.join(calls, open_.id == calls.callee).select("id", F.col("caller").alias("node")))
    seen, levels = frontier, frontier.select("id").distinct().withColumn("depth", F.lit(1))
    for depth in range(2, DEPTH + 1):
        after = frontier.join(calls, frontier.node == calls.callee).select("id", F.col("caller").alias("node")).distinct()
        frontier = shared(after.join(seen, ["id", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        levels = levels.unionByName(frontier.select("id").distinct().withColumn("depth", F.lit(depth)))
    last = levels.groupBy("id").agg(F.max("depth").alias("levels"))
    return starts.join(reached, "id", "left").join(last, "id", "left").select("id", F.coalesce("depth", "levels", F.lit(0)).alias("depth"))


@query(
    "flow_depth",
    ("nodes", "edges"),
    ENTRY_SQL
    + """, call_pairs as (select distinct from_id as caller, to_id as callee from edges where type = 'CALLS'), starts as (select external_id as id from nodes where kind = 'CodeSymbol' and eligible and not stale),
    walk(id, node, depth) as (select s.id, c.caller, 1 from starts s join call_pairs c on c.callee = s.id where s.id not in (select id from entries) union select w.id, c.caller, w.depth + 1 from walk w join call_pairs c on c.callee = w.node where w.depth < 6),
    first_seen as (select id, node, min(depth) as depth from walk group by id, node),
    hits as (select f.id, min(f.depth) as depth from first_seen f join entries e on e.id = f.node group by f.id), deepest as (select id, max(depth) as depth from first_seen group by id)
    select s.id, case when s.id in (select id from entries) then 0 else coalesce(h.depth, d.depth, 0) end as depth from starts s left join hits h using (id) left join deepest d using (id)""",
)
def _flow_depth(g: Graph) -> DataFrame:
    return flow_depth(g.live_symbols, g.edges, entries(g.nodes))


@query(
    "flow_entries",
    ("nodes", "edges"),
    """, live as (select external_id as id from nodes where kind = 'CodeSymbol' and eligible and not stale) select id from live where id not in (select to_id from edges where type = 'CALLS' and from_id in (select id from live))""",
)
def _flow_entries(g: Graph) -> DataFrame:
    """Eligible symbols that no eligible symbol calls."""
    live = g.live_symbols.select(F.col("external_id").alias("id"))
    called = g.edges.where("type = 'CALLS'").join(live.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    return live.join(called, "id", "left_anti")


#: Calls of a path, paths of an entry, paths in all (fixed values).
MOST_CALLS, MOST_OF_ENTRY, MOST_PATHS = 8, 20, 500


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """caller, callee and strength of hard and derived calls between live symbols; of parallel ones the first by name."""
    live = nodes.where("kind = 'CodeSymbol' and not stale").select("external_id")
    calls = edges.where("type = 'CALLS' and strength in ('hard', 'framework-derived')").select(F.col("from_id").alias("caller"), F.col("to_id").alias("callee"), "strength")
    kept = calls.join(live.withColumnRenamed("external_id", "caller"), "caller", "left_semi").join(live.withColumnRenamed("external_id", "callee"), "callee", "left_semi")
    return kept.groupBy("caller", "callee").agg(F.min("strength").alias("strength"))


def endpoint_entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, title and start of endpoints, one row for each live symbol that they are implemented in."""
    live = nodes.where("kind = 'CodeSymbol' and not stale").select(F.col("external_id").alias("to_id"))
    ends = nodes.where("kind = 'Endpoint'").select(F.col("external_id").alias("from_id"), "title")
    met = edges.where("type = 'IMPLEMENTED_IN'").join(live, "to_id", "left_semi").join(ends, "from_id")
    return met.groupBy(F.col("from_id").alias("id"), F.col("to_id").alias("start")).agg(F.min("title").alias("title")).select("id", F.lit("Endpoint").alias("kind"), "title", "start")


def ranked_entries(entry_ids: DataFrame, calls: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """Entries (id, kind, title and the symbol where they start, which is the id unless told) with their score: that of the symbol's
    risk (id, score), or of its calls and, for endpoints, of the route, whichever is greater."""
    if "start" not in entry_ids.columns:
        entry_ids = entry_ids.withColumn("start", F.col("id"))
    once = entry_ids.groupBy("kind", "id", "start").agg(F.min("title").alias("title"))
    fans = calls.groupBy(F.col("caller").alias("start")).agg(F.count("*").alias("fans"))
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("id"))
    route = F.when(F.col("kind") == "Endpoint", 500 + F.when(said.rlike(MUTATION), 250).otherwise(0) + F.when(said.rlike(HIGH_ROUTE), 250).otherwise(0)).otherwise(0)
    rows, known = once.join(fans, "start", "left"), F.lit(0.0)
    if risk is not None:
        rows, known = rows.join(risk.select(F.col("id").alias("start"), F.col("score").alias("risk")), "start", "left"), F.coalesce("risk", F.lit(0.0))
    fans = F.coalesce("fans", F.lit(0))
    return rows.select("id", "kind", "title", "start", fans.cast("long").alias("fans"), F.greatest(known, (route + fans * 10).cast("double")).alias("score"))


#: Routes that change things and routes that matter most (fixed values).
MUTATION = r"(?i)^(POST|PUT|PATCH|DELETE)\b"
HIGH_ROUTE = r"(?i)payment|refund|checkout|cart|order|auth|login|token|customer|user|tax|fulfillment|ship"


def entry_order() -> list[Column]:
    return [F.desc("score"), F.col("kind") != "Endpoint", F.col("id"), F.col("start")]


def walked_flows(ranked: DataFrame, calls: DataFrame) -> DataFrame:
    """Simple call paths from entries (id, kind, title, start, fans, score) that end where no call goes on, or at ``MOST_CALLS`` calls.

    Depth-first order is that of the paths themselves, so of the first paths of an entry every start is among its first
    starts: no level keeps more of an entry than ``MOST_OF_ENTRY`` paths and one that tells of more. A path looks at no
    more callees than that and those that lie on it. As each entry that calls another symbol has a path, the best
    ``MOST_PATHS`` of them fill the list, and the others are not walked."""
    kept = MOST_OF_ENTRY + 1
    first = Window.partitionBy("id", "kind", "start").orderBy("path")
    others = calls.where("caller <> callee").withColumn("n", F.row_number().over(Window.partitionBy("caller").orderBy("callee"))).where(F.col("n") <= kept + MOST_CALLS + 1)
    nexts = shared(others.groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("callee", "strength"))).alias("calls")))
    walked = ranked.join(others.select(F.col("caller").alias("start")).distinct(), "start", "left_semi").orderBy(*entry_order()).limit(MOST_PATHS)
    paths = shared(walked.select("id", "kind", "title", "start", "score", F.array("start").alias("path"), F.lit(False).alias("derived"), F.lit(False).alias("ended")))
    for _ in range(MOST_CALLS):
        met = paths.join(nexts, F.element_at("path", -1) == F.col("caller"), "left").drop("caller")
        on = F.filter(F.coalesce(F.when(~F.col("ended"), F.col("calls")), F.array().cast(nexts.schema["calls"].dataType)), lambda c: ~F.array_contains("path", c["callee"]))
        each = met.withColumn("on", on).select("*", F.explode_outer("on").alias("c"))
        here = ["id", "kind", "title", "start", "score"]
        every = each.select(*here, F.when(F.col("c").isNull(), F.col("path")).otherwise(F.concat("path", F.array("c.callee"))).alias("path"), (F.col("derived") | (F.coalesce("c.strength", F.lit("")) == "framework-derived")).alias("derived"), F.col("c").isNull().alias("ended"))
        paths = shared(every.withColumn("n", F.row_number().over(first)).where(F.col("n") <= kept).drop("n"))
    rows = paths.where("size(path) > 1").withColumn("n", F.row_number().over(first))
    tier = F.when(F.col("derived"), "framework-derived: reachable").otherwise("hard: reachable")
    rows = rows.withColumn("tier", tier).withColumn("key", F.array_join("path", ">"))
    return rows.withColumn("flow", F.concat(F.lit("flow:"), F.substring(F.sha2(F.concat_ws("|", F.lit("flow"), "kind", "id", "key", "tier"), 256), 1, 12)))


def best_flows(walked: DataFrame) -> DataFrame:
    """Of all walked flows, ``MOST_OF_ENTRY`` of an entry, those of the best entries: ``MOST_PATHS`` at most. A flow is as strong as its weakest call."""
    best = walked.where(F.col("n") <= MOST_OF_ENTRY).orderBy(*entry_order(), "flow").limit(MOST_PATHS)
    return best.select(F.col("flow").alias("id"), F.col("id").alias("entry"), "kind", F.col("key").alias("path"), (F.size("path") - 1).cast("long").alias("depth"), "tier", (F.size("path") == MOST_CALLS + 1).alias("truncated"))


def flow_paths(ranked: DataFrame, calls: DataFrame) -> DataFrame:
    return best_flows(walked_flows(ranked, shared(calls)))


def flow_limits(ranked: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: flows in all, truncated ones, and what the caps have left out: steps at the greatest depth, entries with further
    flows, and flows and entries beyond the list's end.

    An entry is walked while the list isn't full, and stops at the first flow beyond its own cap."""
    calls, ranked = shared(calls), shared(ranked)
    walked = shared(walked_flows(ranked, calls))
    deep = F.size("path") == MOST_CALLS + 1
    each = walked.groupBy("id", "kind", "start", "score").agg(F.count_if(F.col("n") <= MOST_OF_ENTRY).alias("flows"), F.count_if(deep).alias("deep"), F.count_if(F.col("n") > MOST_OF_ENTRY).alias("more"))
    before = F.coalesce(F.sum("flows").over(Window.orderBy(*entry_order()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # MOST_PATHS rows at most
    used = each.withColumn("before", before)
    begun = used.where(F.col("before") < MOST_PATHS)
    cut_off = begun.agg(F.coalesce(F.sum("deep"), F.lit(0)).alias("dropped_max_depth"), F.coalesce(F.sum("more"), F.lit(0)).alias("dropped_max_flows_per_entry"), F.coalesce(F.sum(F.greatest(F.col("before") + F.col("flows") - MOST_PATHS, F.lit(0))), F.lit(0)).alias("cut"), F.count("*").alias("begun"))
    calling = ranked.where("fans > 0")
    last = begun.orderBy(F.desc("before")).limit(1).select(F.col("score").alias("s"), (F.col("kind") != "Endpoint").alias("k"), F.col("id").alias("i"), F.col("start").alias("st"), (F.col("before") + F.col("flows") >= MOST_PATHS).alias("full"))
    after = (F.col("score") < F.col("s")) | (F.col("score") == F.col("s")) & (F.struct(F.col("kind") != "Endpoint", "id", "start") > F.struct("k", "i", "st"))
    beyond = calling.crossJoin(F.broadcast(last)).where(F.col("full") & after).agg(F.count("*").alias("beyond"))  # one row
    best = best_flows(walked).agg(F.count("*").alias("total_flows"), F.count_if("truncated").alias("truncated_flows"))
    rows = best.crossJoin(cut_off).crossJoin(beyond)  # one row each
    return rows.select("total_flows", "truncated_flows", "dropped_max_depth", "dropped_max_flows_per_entry", (F.col("cut") + F.col("beyond")).alias("dropped_global_cap"))


def flow_chain(flows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each wanted id the first flow that holds it, as its steps in order."""
    steps = flows.select(F.col("id").alias("flow"), F.split("path", ">").alias("steps")).withColumn("target", F.explode("steps"))
    first = steps.join(ids.select(F.col("id").alias("target")), "target", "left_semi").groupBy("target").agg(F.min_by("steps", "flow").alias("steps"))
    return first.select("target", F.posexplode("steps").alias("position", "step")).select("target", (F.col("position") + 1).cast("long").alias("position"), "step")


#: A node with at least one link in so many is a hub, if it has that many at all: there are 2 * SHARE hubs at most.
SHARE, LEAST_HUB = 2048, 128
#: Links of a partition in the loop over components.
LINKS = 50_000


def components(pairs: DataFrame) -> DataFrame:
    """id and the smallest id that its links (a, b) reach, for all ids but the smallest ones themselves.

    Large and small stars by turns until nothing changes. A large star ties each node's larger neighbours to
    the least of its neighbours, a small star the smaller ones and itself."""
    now = shared(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not total[0] or tuple(total) == state:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state = tuple(total)
        few = max(8, total[0] // LINKS)
        many = max(LEAST_HUB, total[0] // SHARE)
        both = now.coalesce(few).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        large = shared(with_least(both, many).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        small = with_least(large.coalesce(few), many).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = shared(small.select("e.*").where("a <> b").distinct())


def with_least(edges: DataFrame, many: int) -> DataFrame:
    """The edges with ``m``, the least b of their a. Those of hubs get it from a small table and then spread over
    all tasks, where they would all go to the hub's own task else."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    hubs = F.broadcast(least.where(F.col("degree") >= many).select("a", F.col("m").alias("hub_m")))  # 2 * SHARE rows at most
    rest = least.where(F.col("degree") < many).select("a", "m", F.lit(0).alias("salt"))
    salted = edges.join(hubs, "a", "left").withColumn("salt", F.when(F.col("hub_m").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("b"), F.lit(SHARE)).cast("int")))
    return salted.join(rest, ["a", "salt"], "left").select("a", "b", F.coalesce("hub_m", "m").alias("m"))


def cluster_links(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links (a, b, kind) of eligible symbols: one file, calls, possible calls, and imports of files that aren't hubs
    from their own directory or one above or below it."""
    live = nodes.where("kind = 'CodeSymbol' and eligible and not stale").select("external_id", "file")
    first = live.groupBy("file").agg(F.min("external_id").alias("first"))
    same_file = live.join(first, "file").select(F.col("external_id").alias("a"), F.col("first").alias("b"), F.lit("file").alias("kind"))
    ids = live.select("external_id")
    hard = edges.where("type = 'CALLS' and strength in ('hard', 'framework-derived')").select("from_id", "to_id", F.lit("hard_call").alias("kind"))
    calls = hard.unionByName(candidates.where("type = 'MAY_CALL'").select("from_id", "to_id", F.lit("likely_call").alias("kind")))
    calls = calls.join(ids.withColumnRenamed("external_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("external_id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "kind")
    own = first.select("file")
    imports = edges.where("type = 'IMPORTS'").select("from_id", "to_id").join(own.withColumnRenamed("file", "from_id"), "from_id", "left_semi").join(own.withColumnRenamed("file", "to_id"), "to_id", "left_semi")
    files = first.agg(F.count("*").alias("n"))
    local = imports.where((F.col("from_id") != F.col("to_id")) & local_pair(F.col("from_id"), F.col("to_id")))
    hubs = imports.groupBy("to_id").agg(F.count("*").alias("importers")).crossJoin(F.broadcast(files)).where(F.col("importers") > F.greatest(F.lit(25), F.ceil(F.col("n") * 0.02))).select("to_id")  # one row beside
    joined = local.join(hubs, "to_id", "left_anti").join(first.select(F.col("file").alias("from_id"), F.col("first").alias("a")), "from_id").join(first.select(F.col("file").alias("to_id"), F.col("first").alias("b")), "to_id").select("a", "b", F.lit("import").alias("kind"))
    return same_file.unionByName(calls).unionByName(joined)


LINKS_SQL = """, live as (select external_id as id, file from nodes where kind = 'CodeSymbol' and eligible and not stale), firsts as (select file, min(id) as first from live group by file),
    imports_in as (select from_id, to_id from edges where type = 'IMPORTS' and from_id in (select file from firsts) and to_id in (select file from firsts)), hubs as (select to_id from imports_in group by to_id having count(*) > greatest(25, ceil((select count(*) from firsts) * 0.02))),
    links as (select l.id as a, f.first as b, 'file' as kind from live l join firsts f using (file) union all select from_id, to_id, 'hard_call' from edges where type = 'CALLS' and strength in ('hard', 'framework-derived') and from_id in (select id from live) and to_id in (select id from live)
        union all select from_id, to_id, 'likely_call' from candidates where type = 'MAY_CALL' and from_id in (select id from live) and to_id in (select id from live)
        union all select fa.first, fb.first, 'import' from imports_in i join firsts fa on fa.file = i.from_id join firsts fb on fb.file = i.to_id where i.from_id <> i.to_id and i.to_id not in (select to_id from hubs)
            and (starts_with(regexp_replace(i.from_id, '/?[^/]*$', '') || '/', regexp_replace(i.to_id, '/?[^/]*$', '') || '/') or starts_with(regexp_replace(i.to_id, '/?[^/]*$', '') || '/', regexp_replace(i.from_id, '/?[^/]*$', '') || '/'))),
    both_ways as (select a, b from links where a <> b union select b, a from links where a <> b),
    reach(id, low) as (select id, id from live union select x.b, r.low from reach r join both_ways x on x.a = r.id where r.low < x.b),
    lows as (select id, min(low) as component from reach group by id), labels as (select w.id as member, l.file, w.component from lows w join live l using (id))"""


@query("clusters", ("nodes", "edges", "candidates"), LINKS_SQL + " select component, count(*) as members, count(distinct file) as files from labels group by component having count(*) > 1")
def _clusters(g: Graph) -> DataFrame:
    g.settle("symbols", "calls", "may_calls")
    live = g.live_symbols.select(F.col("external_id").alias("member"), "file")
    found = components(cluster_links(g.nodes, g.edges, g.candidates).select("a", "b"))
    labelled = live.join(found, live.member == found.id, "left").withColumn("component", F.coalesce("component", "member"))
    return labelled.groupBy("component").agg(F.count("*").alias("members"), F.countDistinct("file").alias("files")).where("members > 1")


def neighbourhood(edges: DataFrame, starts: DataFrame, rounds: int = 3) -> DataFrame:
    """id and level of everything that calls reach from the starts in a few rounds."""
    calls = call_pairs(edges)
    seen = starts.select("id", F.lit(0).alias("level"))
    frontier = seen
    for level in range(1, rounds + 1):
        after = frontier.join(calls, frontier.id == calls.caller).select(F.col("callee").alias("id")).distinct()
        frontier = shared(after.join(seen, "id", "left_anti").select("id", F.lit(level).alias("level")))
        seen = seen.unionByName(frontier)
    return seen


@query(
    "bfs_neighbourhood",
    ("nodes", "edges"),
    ENTRY_SQL + """, call_pairs as (select distinct from_id as caller, to_id as callee from edges where type = 'CALLS'), walk(id, level) as (select id, 0 from entries union select c.callee, w.level + 1 from walk w join call_pairs c on c.caller = w.id where w.level < 3) select id, min(level) as level from walk group by id""",
)
def _bfs(g: Graph) -> DataFrame:
    return neighbourhood(g.edges, entries(g.nodes))


@query(
    "call_adjacency",
    ("nodes", "edges"),
    """ select e.from_id, list_sort(list(e.to_id || ' ' || e.strength)) as callees from edges e join nodes a on a.external_id = e.from_id and a.kind = 'CodeSymbol' and not a.stale join nodes b on b.external_id = e.to_id and b.kind = 'CodeSymbol' and not b.stale where e.type = 'CALLS' and e.strength in ('hard', 'framework-derived') group by e.from_id""",
)
def _adjacency(g: Graph) -> DataFrame:
    live = g.nodes.where("kind = 'CodeSymbol' and not stale").select("external_id")
    calls = g.edges.where("type = 'CALLS' and strength in ('hard', 'framework-derived')").join(live.withColumnRenamed("external_id", "from_id"), "from_id", "left_semi").join(live.withColumnRenamed("external_id", "to_id"), "to_id", "left_semi")
    return calls.groupBy("from_id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "to_id", "strength"))).alias("callees"))


@query("languages", "nodes", "select case when file is null then 'none' else lower(regexp_extract(file, '\\.([^./]+)$', 1)) end as ext, count(*) as n from nodes group by 1")
def _languages(g: Graph) -> DataFrame:
    return g.nodes.groupBy(F.when(F.col("file").isNull(), "none").otherwise(extension(F.col("file"))).alias("ext")).agg(F.count("*").alias("n"))
