"""Proposals, verdicts, batches, slots and tallies over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import percent_or_null, slug
from ..functions.rules import any_sql, first_of, first_sql, quoted
from ..lineage import cut as shared
from ..registry import query
from ..sources.driver_tables import Graph
from .graphs import ENTRY_SQL, call_pairs, entries

#: Calls that a proposed flow may have, and flows that may be accepted (fixed values).
MOST_HOPS, MOST_FLOWS = 8, 25


def proposals(g: Graph) -> DataFrame:
    """Proposed call paths, one for each order: the part of its first line is the entry, those of the other
    lines are the hops. Each ninth part has an id that no node has; some orders name no entry."""
    lines = g.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("l"))
    known = g.symbols.select("k", "external_id")
    id_ = F.when(F.col("k") % 9 != 0, F.col("external_id")).otherwise(F.concat(F.lit("sym:missing#"), F.col("l.l_partkey").cast("string")))
    named = lines.join(known, F.col("l.l_partkey") == F.col("k"), "left").select("l_orderkey", F.struct("l", id_.alias("id")).alias("h"))
    paths = named.groupBy(F.col("l_orderkey").alias("flow")).agg(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["id"]).alias("path"))
    return paths.select("flow", F.when(F.col("flow") % 101 != 0, F.get("path", F.lit(0))).alias("entry_id"), F.slice("path", 2, 2**30).alias("hops"))


PROPOSALS_SQL = (
    ENTRY_SQL
    + """, hops as (select l_orderkey as flow, case when k % 9 <> 0 then external_id else 'sym:missing#' || l_partkey end as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem left join symbols on k = l_partkey),
    flows as (select flow, case when flow % 101 <> 0 then max(id) filter (n = 1) end as entry_id, list(id order by n) as path, count(*) - 1 as n, count(distinct id) as different, bool_and(n = 1 or id in (select external_id from nodes where kind = 'CodeSymbol' and not stale)) as known from hops group by flow),
    first_verdict as (select *, case when entry_id is null or n = 0 then 'malformed' when entry_id not in (select id from entries) then 'missing anchor' when not known then 'unresolved hop' when different < n + 1 then 'cycle' when n > 8 then 'over cap' end as v from flows),
    ranked as (select *, case when v is null then row_number() over (partition by v, path order by flow) end as again from first_verdict),
    firsts as (select path, row_number() over (order by flow) as place from ranked where again = 1),
    verdicts as (select r.flow, r.entry_id, r.path, coalesce(r.v, case when f.place > 25 then 'over cap' when r.again > 1 then 'duplicate' else 'accepted' end) as verdict from ranked r left join firsts f on f.path = r.path and r.v is null)"""
)


def classify_flows(flows: DataFrame, entry_ids: DataFrame, hop_ids: DataFrame, most_flows: int = MOST_FLOWS) -> DataFrame:
    """The first verdict that fits each proposal (flow, entry_id, hops): every one gets exactly one.

    A proposal without an entry or hops is malformed; then its entry must be one, its hops must be known,
    no node may come twice, and there is a limit of calls. Of equal ones the first counts, and of those
    only so many are accepted; later ones are over the cap, as are repeats of what isn't accepted."""
    start = entry_ids.select(F.col("id").alias("entry_id"), F.lit(True).alias("anchored")).distinct()
    known = hop_ids.select(F.col("id").alias("hop"), F.lit(True).alias("known")).distinct()
    steps = flows.select("flow", F.explode("hops").alias("hop")).join(known, "hop", "left")
    open_hops = steps.where("known is null").select(F.col("flow").alias("open_flow")).distinct()
    rows = flows.join(start, "entry_id", "left").join(open_hops, F.col("flow") == F.col("open_flow"), "left")
    n, path = F.size("hops"), F.concat(F.array("entry_id"), F.col("hops"))
    v = first_of([(F.col("entry_id").isNull() | F.col("hops").isNull() | (n == 0), "malformed"), (F.col("anchored").isNull(), "missing anchor"), (F.col("open_flow").isNotNull(), "unresolved hop"), (F.size(F.array_distinct(path)) < n + 1, "cycle"), (n > MOST_HOPS, "over cap")])
    rows = rows.withColumn("v", v)
    fit = rows.where("v is null").groupBy("entry_id", "hops").agg(F.min("flow").alias("first"))
    accepted = fit.orderBy("first").limit(most_flows).select(F.col("entry_id").alias("a_entry"), F.col("hops").alias("a_hops"), "first")
    met = rows.join(F.broadcast(accepted), F.col("v").isNull() & (F.col("entry_id") == F.col("a_entry")) & (F.col("hops") == F.col("a_hops")), "left")  # most_flows rows
    verdict = F.coalesce("v", F.when(F.col("first").isNull(), "over cap").when(F.col("first") < F.col("flow"), "duplicate").otherwise("accepted"))
    return met.select("flow", "entry_id", "hops", verdict.alias("verdict"))


def verdicts(g: Graph) -> DataFrame:
    live = g.nodes.where("kind = 'CodeSymbol' and not stale").select(F.col("external_id").alias("id"))
    return classify_flows(proposals(g), entries(g.nodes), live)


@query("candidate_flow_verdicts", ("nodes", "symbols"), PROPOSALS_SQL + " select flow, verdict from verdicts")
def _verdicts(g: Graph) -> DataFrame:
    return verdicts(g).select("flow", "verdict")


@query("candidate_flow_accounting", ("nodes", "symbols"), PROPOSALS_SQL + " select verdict, count(*) as n, (select count(*) from flows) as proposed from verdicts group by verdict")
def _accounting(g: Graph) -> DataFrame:
    tally = verdicts(g).groupBy("verdict").agg(F.count("*").alias("n"))
    total = proposals(g).agg(F.count("*").alias("proposed"))
    return tally.crossJoin(F.broadcast(total))  # one row beside


@query("hop_status", ("nodes", "symbols", "edges"), PROPOSALS_SQL + ", steps as (select flow, entry_id, unnest(range(1, len(path))) as n, path from verdicts), pairs as (select distinct from_id, to_id from edges where type = 'CALLS') select s.flow, s.n, case when p.from_id is not null then 'matches_known_edge' else 'unverified' end as status from steps s left join pairs p on p.from_id = case when s.n = 1 then s.entry_id else s.path[s.n] end and p.to_id = s.path[s.n + 1]")
def _hops(g: Graph) -> DataFrame:
    """Each proposed hop matched to a known call; strength never changes."""
    paths = proposals(g).select("flow", F.concat(F.array(F.coalesce("entry_id", F.lit(""))), F.col("hops")).alias("path"), "entry_id")
    whole = paths.where("size(path) > 1")
    hops = whole.select("flow", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))).alias("n", "h"))
    rows = hops.select("flow", (F.col("n") + 1).cast("long").alias("n"), "h.*")
    calls = call_pairs(g.edges).withColumn("known", F.lit(True))
    met = rows.join(calls, (F.col("a") == F.col("caller")) & (F.col("b") == F.col("callee")), "left")
    return met.select("flow", "n", F.when(F.col("known"), "matches_known_edge").otherwise("unverified").alias("status"))


def batches(rows: DataFrame, key: str, items: str, most: int) -> DataFrame:
    """Numbers of batches of an array of sizes: a new one when the next item would overflow it."""
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        full = (acc["held"] > 0) & (acc["held"] + x > most)
        number = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(number.alias("batch"), F.when(full, x).otherwise(acc["held"] + x).alias("held"), F.array_append(acc["out"], number).alias("out"))

    return rows.select(key, F.posexplode(F.aggregate(items, start, step, lambda acc: acc["out"])).alias("place", "batch"))


@query(
    "prompt_batches",
    (),
    """with recursive items as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, ceil(o_totalprice / 1000)::bigint as size from orders),
    run as (select k, n, size, size as held, 0::bigint as batch from items where n = 1 union all select i.k, i.n, i.size, case when r.held > 0 and r.held + i.size > 300 then i.size else r.held + i.size end, case when r.held > 0 and r.held + i.size > 300 then r.batch + 1 else r.batch end from run r join items i on i.k = r.k and i.n = r.n + 1)
    select k, n - 1 as place, batch from run""",
)
def _batches(g: Graph) -> DataFrame:
    sizes = g.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.ceil(F.col("o_totalprice") / 1000).alias("size")))).alias("o"))
    return batches(sizes.select("k", F.transform("o", lambda x: x["size"]).alias("sizes")), "k", "sizes", 300).withColumn("place", F.col("place").cast("long"))


#: Kinds of test by the room there is: of each slot the first kind with evidence (fixed values).
SLOTS = {
    1: [["happy_path"]],
    2: [["happy_path"], ["validation_error", "edge_case"]],
    3: [["happy_path"], ["validation_error", "edge_case"], ["integration_flow", "regression"]],
    4: [["happy_path"], ["validation_error"], ["edge_case"], ["integration_flow"]],
    5: [["happy_path"], ["validation_error"], ["edge_case"], ["integration_flow"], ["security_privacy", "regression"]],
}
#: Words that are evidence for a kind (fixed values).
SIGNALS = {
    "validation_error": r"\b(invalid|errors?|required|reject(ed|s)?|validation|validate|forbidden|not allowed|unauthorized|400|422|constraint|missing (field|value|required)|bad request|must not)\b",
    "edge_case": r"\b(limits?|empty|nulls?|nullable|boundary|missing data|concurren\w*|stale|retr(y|ies)|timeouts?|edge[\s-]?cases?|maximum|minimum|overflow|underflow|zero|negative|out of range|race condition|duplicate)\b",
    "integration_flow": r"\b(routes?|endpoints?|api|https?|requests?|responses?|services?|workflows?|flows?|integration|fetch|client|navigat\w*|pages?|screens?|redirect|webhooks?|pipeline|composable|store)\b",
    "security_privacy": r"\b(auth\w*|permissions?|tokens?|secrets?|pii|privacy|sessions?|invites?|oauth|api[\s-]?keys?|roles?|access control|login|logout|passwords?|credentials?|csrf|xss|encrypt\w*)\b",
    "regression": r"\b(regressions?|bugs?|incidents?|fixed|broke(n)?|known issue|changelog|hotfix|defects?|reproduc\w*)\b",
}


def bucket_signals(rows: DataFrame) -> DataFrame:
    """Adds a flag for each kind of test. ``rows``: corpus (lower case), related_files, workflow_steps, test_names, testable, inferred."""
    said = {k: F.coalesce(F.col("corpus").rlike(p), F.lit(False)) for k, p in SIGNALS.items()}
    said["happy_path"] = F.col("testable")
    said["integration_flow"] = said["integration_flow"] | (F.col("related_files") >= 2) | (F.col("workflow_steps") > 0)
    said["regression"] = said["regression"] | (F.col("test_names") > 0) | F.col("inferred")
    return rows.select("*", *[v.alias(k) for k, v in said.items()])


def chosen_buckets(limit: Column) -> Column:
    """The kinds of test, in order, that the flags of ``bucket_signals`` justify; slots are never padded."""
    room = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.floor(limit), F.lit(1)))).cast("int")
    by_room = [(room == n, F.array_compact(F.array(*[F.coalesce(*[F.when(F.col(k), k) for k in slot]) for slot in slots]))) for n, slots in SLOTS.items()]
    out = F.when(*by_room[0])
    for condition, kinds in by_room[1:]:
        out = out.when(condition, kinds)
    return out


def evidence_rows(g: Graph) -> DataFrame:
    """One behaviour for each document, with what is known of it."""
    k = F.col("doc_id")
    return g.documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("corpus"), (k % 3).alias("related_files"), (k % 11 == 0).cast("int").alias("workflow_steps"), (k % 7 == 0).cast("int").alias("test_names"), (k % 10 != 0).alias("testable"), (k % 13 == 0).alias("inferred"), (k % 7).alias("room"))


_FLAGS_SQL = ", ".join(f"{any_sql('corpus', [p])} as {k}" for k, p in SIGNALS.items() if k not in ("integration_flow", "regression"))
BUCKETS_SQL = f"""with facts as (select doc_id, lower(coalesce(text, '')) as corpus, doc_id % 3 as related_files, doc_id % 11 = 0 as steps, doc_id % 7 = 0 as tested, doc_id % 10 <> 0 as happy_path, doc_id % 13 = 0 as inferred, greatest(1, least(5, doc_id % 7)) as room from documents),
    flags as (select doc_id, room, happy_path, {_FLAGS_SQL}, {any_sql("corpus", [SIGNALS["integration_flow"]])} or related_files >= 2 or steps as integration_flow, {any_sql("corpus", [SIGNALS["regression"]])} or tested or inferred as regression from facts),
    chosen as (select doc_id, list_filter(case room {" ".join(f"when {n} then [" + ", ".join("coalesce(" + ", ".join(f"case when {k} then {quoted(k)} end" for k in slot) + ")" for slot in slots) + "]" for n, slots in SLOTS.items())} end, lambda x: x is not null) as buckets from flags)"""


@query("bucket_selection", (), BUCKETS_SQL + " select doc_id, buckets from chosen")
def _slots(g: Graph) -> DataFrame:
    return bucket_signals(evidence_rows(g)).select("doc_id", chosen_buckets(F.col("room")).alias("buckets"))


def bucket_plan(targets: DataFrame, limit: int, several: bool) -> DataFrame:
    """(target, bucket) pairs from targets (target_pos, buckets, thin): thin ones are passed over; of one
    wanted target the first that is left takes all; of several each gets its first kind, then its second, to the limit."""
    fit, wanted = targets.where("not thin"), limit if several else 1
    # pairs come by depth, so of several targets none counts after the first ``limit`` that have a kind: kinds are worked out only up
    # to these, in place of all targets, and as far as it takes to find them
    while True:
        ends = fit.select("target_pos").orderBy("target_pos").limit(wanted).agg(F.max("target_pos").alias("last"), F.count("*").alias("n")).first()
        all_of_them = ends.n < wanted or ends.last is None
        found = shared((fit if all_of_them else fit.where(F.col("target_pos").isNull() | (F.col("target_pos") <= ends.last))).select("target_pos", "buckets"))
        if all_of_them or not several or found.where(F.size("buckets") > 0).count() >= limit:
            break
        wanted *= 8
    if not several:
        found = found.orderBy("target_pos").limit(1)
    pairs = found.select("target_pos", F.posexplode("buckets").alias("depth", "bucket"))
    return pairs.orderBy("depth", "target_pos").limit(limit)


@query("bucket_plan", (), BUCKETS_SQL + """, viable as (select doc_id as target_pos, buckets from chosen where doc_id % 4 <> 1 and doc_id > 2),
    each as (select target_pos, unnest(range(len(buckets))) as depth, buckets from viable)
    (select 'several' as mode, target_pos, depth, buckets[depth + 1] as bucket from each order by depth, target_pos limit 40)
    union all (select 'single', target_pos, depth, buckets[depth + 1] from each where target_pos = (select min(target_pos) from viable) order by depth limit 3)""")
def _plan(g: Graph) -> DataFrame:
    """Plans for several wanted targets and for one; every fourth target's evidence is too thin, and that of the first ones."""
    targets = bucket_signals(evidence_rows(g)).select(F.col("doc_id").alias("target_pos"), chosen_buckets(F.col("room")).alias("buckets"), ((F.col("doc_id") % 4 == 1) | (F.col("doc_id") <= 2)).alias("thin"))
    shown = lambda mode, rows: rows.select(F.lit(mode).alias("mode"), "target_pos", F.col("depth").cast("long").alias("depth"), "bucket")
    return shown("several", bucket_plan(targets, 40, True)).unionByName(shown("single", bucket_plan(targets, 3, False)))


#: Assets by extension (fixed value), and the categories of import specifiers in their order of report (fixed values).
ASSET = r"(?i)\.(scss|sass|css|less|styl|png|jpe?g|gif|svg|webp|ico|bmp|woff2?|ttf|eot|otf|mp4|webm|mp3|wav|avif)$"
CATEGORIES = ["rel-js-specifier", "rel-ts-ext", "rel-extensionless", "path-alias", "baseurl-internal", "bare-external", "node-builtin", "asset"]
INTERNAL = ["rel-js-specifier", "rel-ts-ext", "rel-extensionless", "path-alias", "baseurl-internal"]


def specifier_category(specifier: Column, aliases: list[str] = (), base_names: list[str] = ()) -> Column:
    """What an import asks for. ``aliases`` are the keys of configured paths (a star stands for any rest),
    ``base_names`` the top-level names below the configured base folder."""
    local = specifier.startswith(".") | specifier.startswith("/")
    alias = F.lit(False)
    for key in aliases:
        alias = alias | (specifier.startswith(key.split("*")[0]) if "*" in key else specifier == key)
    rules = [
        (specifier.rlike(ASSET), "asset"),
        (local & specifier.rlike(r"\.(js|jsx|mjs|cjs)$"), "rel-js-specifier"),
        (local & specifier.rlike(r"\.(ts|tsx|mts|cts)$"), "rel-ts-ext"),
        (local, "rel-extensionless"),
        (specifier.startswith("node:"), "node-builtin"),
        (alias, "path-alias"),
        (F.split(specifier, "/")[0].isin(list(base_names)) if base_names else F.lit(False), "baseurl-internal"),
    ]
    return first_of(rules, "bare-external")


def category_sql(s: str) -> str:
    local = f"(starts_with({s}, '.') or starts_with({s}, '/'))"
    return first_sql([(any_sql(s, [ASSET]), "'asset'"), (f"{local} and regexp_matches({s}, '\\.(js|jsx|mjs|cjs)$')", "'rel-js-specifier'"), (f"{local} and regexp_matches({s}, '\\.(ts|tsx|mts|cts)$')", "'rel-ts-ext'"), (local, "'rel-extensionless'"), (f"starts_with({s}, 'node:')", "'node-builtin'"), (f"starts_with({s}, '@/') or {s} = 'config'", "'path-alias'"), (f"split_part({s}, '/', 1) in ('shared', 'core')", "'baseurl-internal'")], "'bare-external'")


#: Aliases and top-level names of the driver's imports.
ALIASES, BASE_NAMES = ["@/*", "config"], ["shared", "core"]


def import_edges(g: Graph) -> DataFrame:
    """The driver's imports with their category and whether they stay inside the repository."""
    category = specifier_category(F.col("specifier"), ALIASES, BASE_NAMES)
    return g.imports.withColumn("category", category).withColumn("internal", category.isin(INTERNAL) & ~F.col("external"))


def gate_axes(edges: DataFrame) -> DataFrame:
    """One row for each axis of import health: how many imports it counts, how many are resolved, and their share.
    ``edges``: category, internal, external, resolved, from_role, target_role, kind, barrel (the target only
    passes names on), named (a name is bound) and covered (every name leads to code)."""
    c = F.col
    test_internal = (c("from_role") == "test") & c("internal")
    to_test = c("resolved") & (c("target_role") == "test")
    barrel = test_internal & (c("kind") == "runtime") & c("resolved") & ~to_test & c("named") & c("barrel")
    axes = [
        ("all_internal", c("internal"), c("resolved")),
        ("test_file", c("from_role") == "test", c("resolved")),
        ("test_internal", test_internal, c("resolved")),
        ("test_to_test", test_internal & to_test, c("resolved")),
        ("test_to_source", test_internal & (c("kind") == "runtime") & ~to_test, c("resolved")),
        ("test_unresolved_internal", test_internal & ~c("resolved"), c("resolved")),
        ("source_to_source", (c("from_role") == "source") & c("internal"), c("resolved")),
        ("barrel_terminal", barrel, c("covered")),
        ("workspace_package", c("category").isin("path-alias", "baseurl-internal") & ~(c("resolved") & c("external")), c("resolved")),
    ]
    counted = edges.agg(F.array(*[F.struct(F.lit(name).alias("axis"), F.count_if(F.coalesce(of, F.lit(False))).alias("n"), F.count_if(F.coalesce(of & good, F.lit(False))).alias("resolved")) for name, of, good in axes]).alias("a"))
    return counted.select(F.explode("a").alias("a")).select("a.axis", "a.n", "a.resolved", percent_or_null(F.col("a.resolved"), F.col("a.n")).alias("pct"))


IMPORTS_SQL = f""", edges_in as (select *, {category_sql("specifier")} as category from imports), import_edges as (select *, category in ({", ".join(map(quoted, INTERNAL))}) and not external as internal from edges_in)"""
_PCT = "case when count(*) filter ({0}) > 0 then floor(100.0 * count(*) filter (({0}) and {1}) / count(*) filter ({0}) * 10 + 0.5) / 10 end"
_AXES = [
    ("all_internal", "internal", "resolved"),
    ("test_file", "from_role = 'test'", "resolved"),
    ("test_internal", "from_role = 'test' and internal", "resolved"),
    ("test_to_test", "from_role = 'test' and internal and resolved and target_role = 'test'", "resolved"),
    ("test_to_source", "from_role = 'test' and internal and kind = 'runtime' and not (resolved and target_role = 'test')", "resolved"),
    ("test_unresolved_internal", "from_role = 'test' and internal and not resolved", "resolved"),
    ("source_to_source", "from_role = 'source' and internal", "resolved"),
    ("barrel_terminal", "from_role = 'test' and internal and kind = 'runtime' and resolved and target_role <> 'test' and named and barrel", "covered"),
    ("workspace_package", "category in ('path-alias', 'baseurl-internal') and not (resolved and external)", "resolved"),
]


@query("import_gate_axes", "imports", IMPORTS_SQL + " union all ".join(f" select '{n}' as axis, count(*) filter ({of}) as n, count(*) filter (({of}) and {good}) as resolved, {_PCT.format(of, good)} as pct from import_edges" for n, of, good in _AXES))
def _axes(g: Graph) -> DataFrame:
    return gate_axes(import_edges(g))


@query(
    "import_categories",
    "imports",
    IMPORTS_SQL + f", kinds as (select unnest([{', '.join(map(quoted, CATEGORIES))}]) as category) select k.category, count(i.specifier) as n, count(*) filter (i.resolved) as resolved, case when count(i.specifier) > 0 then floor(100.0 * count(*) filter (i.resolved) / count(i.specifier) * 10 + 0.5) / 10 end as pct from kinds k left join import_edges i using (category) group by k.category",
)
def _categories(g: Graph) -> DataFrame:
    """Imports by category and how many are resolved; every category has its row."""
    sums = import_edges(g).groupBy("category").agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"))
    kinds = g.spark.sql("select explode(array(" + ", ".join(map(quoted, CATEGORIES)) + ")) as category")
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("resolved", F.lit(0))
    return kinds.join(sums, "category", "left").select("category", n.alias("n"), r.alias("resolved"), percent_or_null(r, n).alias("pct"))


@query("import_predicates", "imports", IMPORTS_SQL + " select k, category, internal, from_role = 'test' and internal as test_internal from import_edges")
def _predicates(g: Graph) -> DataFrame:
    return import_edges(g).select("k", "category", "internal", ((F.col("from_role") == "test") & F.col("internal")).alias("test_internal"))


def confirmation(imported, type_only, mocked, reexported, used, observed):
    """Verdict on a test and symbol from facts that a type checker has found, the first that fits."""
    return F.when(~imported, "none").when(type_only, "inferred/2").when(mocked, "inferred/4").when(used & observed, "confirmed").when(reexported, "inferred/1").when(~used, "inferred/3").otherwise("inferred/5")


@query("confirmation_cascade", (), "select verdict, count(*) as n from (select case when l_linenumber = 1 then 'none' when l_linenumber = 2 then 'inferred/2' when l_returnflag = 'A' then 'inferred/4' when l_linestatus = 'F' and l_linenumber < 6 then 'confirmed' when l_linenumber = 7 then 'inferred/1' when l_linestatus <> 'F' then 'inferred/3' else 'inferred/5' end as verdict from lineitem) x group by verdict")
def _cascade(g: Graph) -> DataFrame:
    k = F.col("l_linenumber")
    v = confirmation(k != 1, k == 2, F.col("l_returnflag") == "A", k == 7, F.col("l_linestatus") == "F", k < 6)
    return g.lineitem.select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def csv_requirements(rows: DataFrame) -> DataFrame:
    """(file, line, behavior_name, acceptance_criteria) rows to requirements and their criteria; ids count rows with a name within their file."""
    named = rows.where(F.trim("behavior_name") != "")
    n = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    required = named.select("file", F.concat(F.format_string("REQ-%03d-", n), slug(F.col("behavior_name"))).alias("id"), F.filter(F.transform(F.split("acceptance_criteria", r"[;\n]"), lambda x: F.trim(x)), lambda x: x != "").alias("criteria"))
    return required.select("file", "id", F.posexplode_outer("criteria").alias("place", "criterion"))


@query("csv_template", (), "select o_orderpriority as file, printf('REQ-%03d-order-%d', n, o_orderkey) as id, place::int as place, case place when 0 then 'pays ' || o_custkey else 'ships' end as criterion from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as n from orders where o_orderkey % 2 = 0) x, range(2) r(place)")
def _csv(g: Graph) -> DataFrame:
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    name = F.when(F.col("o_orderkey") % 2 == 0, text("Order ", F.col("o_orderkey").cast("string"))).otherwise("  ")
    rows = g.orders.select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("line"), name.alias("behavior_name"), text("pays ", F.col("o_custkey").cast("string"), " ; ships\n").alias("acceptance_criteria"))
    return csv_requirements(rows)


#: Packages and the frameworks that they show (fixed values).
PACKAGES = {"react": "React", "next": "Next.js", "express": "Express", "@nestjs/core": "NestJS", "fastify": "Fastify", "vue": "Vue", "jest": "Jest", "vitest": "Vitest"}


def frameworks(manifests: DataFrame) -> DataFrame:
    """(path, content) of package manifests to the frameworks among their dependencies."""
    parsed = manifests.select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    empty = F.array().cast("array<string>")
    names = parsed.select("path", F.explode(F.array_distinct(F.concat(F.coalesce(F.map_keys("m.dependencies"), empty), F.coalesce(F.map_keys("m.devDependencies"), empty)))).alias("package"))
    table = manifests.sparkSession.createDataFrame(list(PACKAGES.items()), "package string, framework string")
    return names.join(table, "package").select("path", "framework")


@query("framework_detection", (), "select doc_id::varchar as path, unnest(case when doc_id % 2 = 0 then ['React', 'Jest'] else ['Express'] end) as framework from documents where doc_id % 3 <> 0")
def _frameworks(g: Graph) -> DataFrame:
    content = F.when(F.col("doc_id") % 3 == 0, "not json").when(F.col("doc_id") % 2 == 0, '{"dependencies": {"react": "1", "left-pad": "1"}, "devDependencies": {"jest": "2", "react": "1"}}').otherwise('{"dependencies": {"express": "4"}}')
    return frameworks(g.documents.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


#: Route calls of routers: verb and path.
ROUTES = r"(?:app|router|server)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)"


def contracts(sources: DataFrame) -> DataFrame:
    """(file, content) to the routes that its router calls declare, each once."""
    verbs, paths = (F.regexp_extract_all("content", F.lit(ROUTES), i) for i in (1, 2))
    rows = sources.select("file", F.explode(F.arrays_zip(verbs.alias("verb"), paths.alias("path"))).alias("r"))
    return rows.select("file", F.upper("r.verb").alias("method"), F.col("r.path").alias("path")).distinct()


@query("contract_extraction", (), "select page_id::varchar as file, m as method, case m when 'GET' then '/a/' || page_id else '/b' end as path from pages, (values ('GET'), ('POST')) v(m)")
def _contracts(g: Graph) -> DataFrame:
    content = F.concat(F.lit("app.get('/a/"), F.col("page_id").cast("string"), F.lit("', h); router.post(\"/b\", h); router.post(\"/b\", h2); other.get('/c')"))
    return contracts(g.pages.select(F.col("page_id").cast("string").alias("file"), content.alias("content")))


@query("report_delta", ("nodes",), ", before as (select external_id from nodes where kind = 'CodeSymbol' and ord % 2 = 0 order by ord limit 20), now as (select external_id from nodes where kind = 'CodeSymbol' and ord % 3 = 0 order by ord limit 20) select list_sort(list(external_id) filter (side = 'now')) as entered, list_sort(list(external_id) filter (side = 'before')) as dropped from (select external_id, 'now' as side from now where external_id not in (select external_id from before) union all select external_id, 'before' from before where external_id not in (select external_id from now)) x")
def _delta(g: Graph) -> DataFrame:
    """What entered and left the first twenty between two rankings."""
    symbols = g.nodes.where("kind = 'CodeSymbol'")
    top = lambda k: symbols.where(f"ord % {k} = 0").orderBy("ord").limit(20).agg(F.collect_list("external_id").alias(f"top{k}"))
    both = top(2).crossJoin(top(3))  # two single rows
    return both.select(F.array_sort(F.array_except("top3", "top2")).alias("entered"), F.array_sort(F.array_except("top2", "top3")).alias("dropped"))
