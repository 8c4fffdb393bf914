"""What a report says beside its tables: missing evidence, advice, summaries, status flags, links, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import AREA_SQL, area, top_area
from ..functions.rules import quoted
from ..operators.evidence import EVIDENCE_SQL, NSC_SQL, gap_evidence, not_confirmable
from ..operators.graphs import call_pairs
from ..registry import query
from ..schema import HARD_TYPES
from ..sources.driver_tables import Graph
from .traceability import MATRIX_RELATIONS, MATRIX_SQL, of

#: Messages (fixed values).
NOTHING = "Nothing to measure coverage against: no countable behaviors found. Add a requirements list (CSV/markdown) or analyze code that has functions/classes."
GUESSED = ("Nothing to measure coverage against: we found ", " behavior(s) guessed from test names, but those don't count (a test can't prove its own requirement). Add a requirements list (CSV/markdown) or analyze code that has functions/classes.")
WRITE_SOME = "Add a few written requirements (we only found code and test names so far) — a short CSV/markdown list, or acceptance criteria."
ONLY = ("Only ", " written requirement(s) for ", " behaviors — add a requirements list so coverage reflects what the app should do, not just how much code exists.")
#: Dimension, least value and message (fixed values).
LACKS = [
    ("acceptance_criteria", 0.5, "Add acceptance criteria so behaviors can be tested with concrete checks."),
    ("interface_mapping", 0.4, "Add API/screen/service mapping (OpenAPI or route docs) for more specific tests."),
    ("validation_evidence", 0.4, "Link existing tests or add manual QA steps so we can tell what's already covered."),
    ("known_regressions", 0.2, "Add known bugs/incidents to enable targeted regression tests."),
    ("provenance", 0.6, "Add source links so each behavior can be traced back to real code."),
]
#: Dimension, least value, weight of what lacks, action and expected gain (fixed values).
ADVICE = [
    ("acceptance_criteria", 0.6, 20, "Add acceptance criteria or a small requirements template (CSV/Markdown).", "+10 to +20"),
    ("interface_mapping", 0.5, 15, "Add an OpenAPI spec or route/screen docs.", "+5 to +12"),
    ("known_regressions", 0.3, 10, "List known bugs or past incidents (even a short Markdown list).", "+4 to +10"),
    ("validation_evidence", 0.5, 12, "Reference existing test names/links or manual QA steps.", "+4 to +10"),
]
NO_REQUIREMENT = (16.0, "Add a few explicit requirements with descriptions and actors.", "+8 to +18")


def missing_evidence() -> Column:
    """Messages on what a scored graph lacks, in order, from its dimensions and the composition of its denominator."""
    c, lit = F.col, F.lit
    explicit = c("requirement_template") + c("markdown_requirement")
    guessed = F.concat(lit(GUESSED[0]), c("excluded_test_inferred").cast("string"), lit(GUESSED[1]))
    few = F.concat(lit(ONLY[0]), explicit.cast("string"), lit(ONLY[1]), c("total").cast("string"), lit(ONLY[2]))
    said = [
        F.when(c("total") == 0, F.when(c("excluded_test_inferred") > 0, guessed).otherwise(NOTHING)),
        F.when((c("total") > 0) & (explicit == 0), WRITE_SOME).when((explicit > 0) & (explicit < 5) & (c("code_export") >= explicit * 20), few),
        *[F.when(c(name) < least, text) for name, least, text in LACKS],
    ]
    return F.array_compact(F.array(*said))


_FEW_SQL = f"{quoted(ONLY[0])} || (requirement_template + markdown_requirement) || {quoted(ONLY[1])} || total || {quoted(ONLY[2])}"


@query(
    "missing_evidence",
    "scored",
    f"""select k, list_filter([case when total = 0 then case when excluded_test_inferred > 0 then {quoted(GUESSED[0])} || excluded_test_inferred || {quoted(GUESSED[1])} else {quoted(NOTHING)} end end,
    case when total > 0 and requirement_template + markdown_requirement = 0 then {quoted(WRITE_SOME)} when requirement_template + markdown_requirement between 1 and 4 and code_export >= (requirement_template + markdown_requirement) * 20 then {_FEW_SQL} end,
    {", ".join(f"case when {n} < {v} then {quoted(t)} end" for n, v, t in LACKS)}], lambda x: x is not null) as missing from scored""",
)
def _missing(g: Graph) -> DataFrame:
    return g.scored.select("k", missing_evidence().alias("missing"))


def advice() -> Column:
    """Up to four pieces of advice (priority, action, impact) for a scored graph, those with the greatest gain first."""
    found = [F.when(F.col(n) < least, F.struct((-(F.lit(least) - F.col(n)) * weight).alias("loss"), F.lit(i).alias("place"), F.lit(action).alias("action"), F.lit(impact).alias("impact"))) for i, (n, least, weight, action, impact) in enumerate(ADVICE)]
    gain, action, impact = NO_REQUIREMENT
    found.append(F.when(F.col("requirements") == 0, F.struct(F.lit(-gain).alias("loss"), F.lit(len(ADVICE)).alias("place"), F.lit(action).alias("action"), F.lit(impact).alias("impact"))))
    first = F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, 4)
    return F.transform(first, lambda x, i: F.concat_ws(" ", (i + 1).cast("string"), x["impact"], x["action"]))


_ADVICE_SQL = " union all ".join(f"select k, ({least}::double - {n}) * {weight} as gain, {i} as place, {quoted(impact + ' ' + action)} as said from scored where {n} < {least}" for i, (n, least, weight, action, impact) in enumerate(ADVICE))


@query(
    "doctor_advice",
    "scored",
    f""", found as ({_ADVICE_SQL} union all select k, {NO_REQUIREMENT[0]}, {len(ADVICE)}, {quoted(NO_REQUIREMENT[2] + ' ' + NO_REQUIREMENT[1])} from scored where requirements = 0),
    ranked as (select *, row_number() over (partition by k order by gain desc, place) as n from found)
    select s.k, coalesce(list(r.n || ' ' || r.said order by r.n) filter (r.n <= 4), []) as advice, any_value(s.overall >= 40) as can_continue from scored s left join ranked r using (k) group by s.k""",
)
def _doctor(g: Graph) -> DataFrame:
    return g.scored.select("k", advice().alias("advice"), (F.col("overall") >= 40).alias("can_continue"))


def reveal_line() -> Column:
    """How much ran against how much is proven, of one denominator; null where nothing ran or nothing counts."""
    t, ran, proven = (F.col(c) for c in ("total", "runtime_covered", "coverage_confirmed"))
    pct = lambda n: F.floor(n / t * 100 + 0.5).cast("long").cast("string")
    text = [F.lit("Coverage vs proof: "), ran.cast("string"), F.lit("/"), t.cast("string"), F.lit(" behaviors are runtime-covered but not Dynamically Proven ("), pct(ran), F.lit("%) vs "), proven.cast("string"), F.lit("/"), t.cast("string"), F.lit(" Dynamically Proven ("), pct(proven)]
    end = "%) — coverage only proves execution; the unproven side may be unattempted, blocked, or covered by tests that never assert these behaviors."
    return F.when((ran > 0) & (t > 0), F.concat(*text, F.lit(end)))


@query("coverage_reveal", "scored", """select k, case when runtime > 0 and total > 0 then 'Coverage vs proof: ' || runtime || '/' || total || ' behaviors are runtime-covered but not Dynamically Proven (' || floor(runtime::double / total * 100 + 0.5)::bigint || '%) vs ' || proven || '/' || total || ' Dynamically Proven (' || floor(proven::double / total * 100 + 0.5)::bigint
    || '%) — coverage only proves execution; the unproven side may be unattempted, blocked, or covered by tests that never assert these behaviors.' end as line from (select *, (k * 3) % 41 as runtime, k % 37 as proven from scored) x""")
def _reveal(g: Graph) -> DataFrame:
    rows = g.scored.withColumn("runtime_covered", F.col("k") * 3 % 41).withColumn("coverage_confirmed", F.col("k") % 37)
    return rows.select("k", reveal_line().alias("line"))


def report_summary(rows: DataFrame, flow_ids: DataFrame) -> DataFrame:
    """Counts of a matrix by tier; what has none is split into what some flow reaches and what gives no signal."""
    reached = flow_ids.select(F.col("id").alias("flow_id")).distinct()
    joined = rows.join(reached, F.col("behavior_id") == F.col("flow_id"), "left")
    inside, tier = ~F.col("off_denominator"), F.col("evidence_tier")
    nothing = inside & ~tier.isin("proven", "associated", "runtime", "candidate")
    n = lambda c, name: F.count_if(c).alias(name)
    return joined.agg(n(inside, "total"), n(tier == "proven", "proven"), n(~inside & (tier == "proven"), "proven_outside"), n(inside & tier.isin("associated", "runtime"), "associated"), n(inside & (tier == "candidate"), "candidate"), n(nothing, "none"), n(nothing & F.col("flow_id").isNotNull(), "reachable_untested"), n(nothing & F.col("flow_id").isNull(), "no_signal"))


@query(
    "report_summary",
    MATRIX_RELATIONS,
    MATRIX_SQL
    + """, flow_ids as (select from_id as id from edges where type = 'CALLS' union select to_id from edges where type = 'CALLS'), j as (select r.*, f.id as flow_id from rtm r left join flow_ids f on f.id = r.behavior_id)
    select count(*) filter (not off_denominator) as total, count(*) filter (evidence_tier = 'proven') as proven, count(*) filter (off_denominator and evidence_tier = 'proven') as proven_outside, count(*) filter (not off_denominator and evidence_tier in ('associated', 'runtime')) as associated, count(*) filter (not off_denominator and evidence_tier = 'candidate') as candidate,
    count(*) filter (not off_denominator and evidence_tier = 'none') as none, count(*) filter (not off_denominator and evidence_tier = 'none' and flow_id is not null) as reachable_untested, count(*) filter (not off_denominator and evidence_tier = 'none' and flow_id is null) as no_signal from j""",
)
def _report_summary(g: Graph) -> DataFrame:
    """Here every symbol of a call counts as one that flows reach."""
    ids = call_pairs(g.edges).select(F.explode(F.array("caller", "callee")).alias("id"))
    return report_summary(of(g), ids)


@query(
    "behavior_order",
    MATRIX_RELATIONS,
    MATRIX_SQL
    + """, flow_ids as (select from_id as id from edges where type = 'CALLS' union select to_id from edges where type = 'CALLS')
    select behavior_id, case when evidence_tier = 'proven' then 0 when evidence_tier in ('associated', 'runtime') then 1 when f.id is not null then 2 else 3 end as rank from rtm r left join flow_ids f on f.id = r.behavior_id where not off_denominator order by rank, ord""",
)
def _behavior_order(g: Graph) -> DataFrame:
    """Proven rows, then linked ones, then those that flows reach, then the rest; within each as in the graph."""
    ids = call_pairs(g.edges).select(F.explode(F.array("caller", "callee")).alias("flow_id")).distinct()
    rows = of(g).where("not off_denominator").join(ids, F.col("behavior_id") == F.col("flow_id"), "left")
    rank = F.when(F.col("evidence_tier") == "proven", 0).when(F.col("evidence_tier").isin("associated", "runtime"), 1).when(F.col("flow_id").isNotNull(), 2).otherwise(3)
    return rows.select("behavior_id", rank.alias("rank"), "ord").orderBy("rank", "ord").drop("ord")


def pipeline_flags() -> Column:
    """Whether each part of an analysis found all it looks for (1), something (partial) or nothing (0)."""
    c = F.col
    on = lambda whole, part=None: F.when(whole, "1").otherwise(F.when(part, "partial").otherwise("0") if part is not None else F.lit("0"))
    flows = F.when(c("flows") > 0, F.when((c("longest") <= 1) | (c("truncated") > c("flows") / 2), "partial").otherwise("1")).otherwise("0")
    flags = {"behaviors": on(c("total") > 0), "endpoints": on(c("implemented") > 0, c("endpoints") > 0), "calls": on(c("injected") > 0, c("calls") > 0), "fw": on(c("derived") > 0), "flows": flows, "proof": on(c("proven") > 0, c("attempted") > 0)}
    return F.array(*[F.concat(F.lit(k + "="), v) for k, v in flags.items()])


_FLAG_COUNTS = {"implemented": "k % 3", "endpoints": "k % 2", "injected": "k % 5", "calls": "k % 4", "derived": "k % 6", "flows": "k % 7", "longest": "k % 3", "truncated": "k % 5", "proven": "k % 8", "attempted": "k % 9"}


@query(
    "pipeline_flags",
    "scored",
    f"""select k, ['behaviors=' || case when total > 0 then '1' else '0' end, 'endpoints=' || case when implemented > 0 then '1' when endpoints > 0 then 'partial' else '0' end, 'calls=' || case when injected > 0 then '1' when calls > 0 then 'partial' else '0' end, 'fw=' || case when derived > 0 then '1' else '0' end,
    'flows=' || case when flows = 0 then '0' when longest <= 1 or truncated * 2 > flows then 'partial' else '1' end, 'proof=' || case when proven > 0 then '1' when attempted > 0 then 'partial' else '0' end] as flags from (select k, total, {", ".join(f"{v} as {n}" for n, v in _FLAG_COUNTS.items())} from scored) x""",
)
def _flags(g: Graph) -> DataFrame:
    return g.scored.select("k", "total", *[F.expr(v).alias(n) for n, v in _FLAG_COUNTS.items()]).select("k", pipeline_flags().alias("flags"))


def proof_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Eligible symbols and the tests that hard edges tie to them; of several edges the last counts."""
    ends = nodes.select(F.col("external_id").alias("id"), "kind", F.coalesce("title", "external_id").alias("label"), "file", "eligible", "stale")
    one, other = (ends.select(*[F.col(c).alias(f"{p}_{c}") for c in ends.columns]) for p in ("a", "b"))
    met = edges.where(F.col("type").isin(HARD_TYPES)).join(one, F.col("from_id") == F.col("a_id")).join(other, F.col("to_id") == F.col("b_id"))
    first = F.col("a_kind") == "CodeSymbol"
    side = lambda c, of_symbol: F.when(first == of_symbol, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    rows = met.select(side("id", F.lit(True)).alias("symbol"), side("id", F.lit(False)).alias("test"), side("kind", F.lit(True)).alias("s_kind"), side("kind", F.lit(False)).alias("t_kind"), side("label", F.lit(True)).alias("symbol_label"), side("label", F.lit(False)).alias("test_label"), side("file", F.lit(True)).alias("file"), side("eligible", F.lit(True)).alias("eligible"), "strength", "ord")
    kept = rows.where("s_kind = 'CodeSymbol' and t_kind = 'TestCase' and eligible is distinct from false")
    return kept.groupBy("symbol", "test").agg(F.max_by(F.struct("symbol_label", "test_label", top_area(F.col("file")).alias("area"), "strength"), "ord").alias("l")).select("symbol", "test", "l.*")


@query(
    "symbol_proof_links",
    ("nodes", "edges"),
    """, pairs as (select case when a.kind = 'CodeSymbol' then a.external_id else b.external_id end as symbol, case when a.kind = 'CodeSymbol' then b.external_id else a.external_id end as test, e.strength, e.ord from edges e join nodes a on a.external_id = e.from_id join nodes b on b.external_id = e.to_id where e.type in ('TESTED_BY', 'COVERS'))
    select p.symbol, p.test, max(coalesce(s.title, s.external_id)) as symbol_label, max(coalesce(t.title, t.external_id)) as test_label, max(split_part(s.file, '/', 1)) as area, arg_max(p.strength, p.ord) as strength from pairs p join nodes s on s.external_id = p.symbol and s.kind = 'CodeSymbol' and s.eligible is distinct from false join nodes t on t.external_id = p.test and t.kind = 'TestCase' group by p.symbol, p.test""",
)
def _proof_links(g: Graph) -> DataFrame:
    return proof_links(g.nodes, g.edges)


@query(
    "gap_view",
    ("nodes", "edges", "candidates"),
    EVIDENCE_SQL
    + NSC_SQL
    + """, flows as (select j.external_id, case when j.evidence = 'covered' then 'confirmed' when n.id is not null then 'not_structurally_confirmable' when j.evidence = 'weak' then 'inferred' else 'none' end as coverage from judged j left join nsc n on n.id = j.external_id where j.kind = 'UserFlow')
    select count(*) as userflows, (select count(*) from nodes where kind = 'TestCase') as testcases, count(*) filter (coverage = 'confirmed') as confirmed, count(*) filter (coverage = 'inferred') as inferred, count(*) filter (coverage = 'not_structurally_confirmable') as not_structurally_confirmable, count(*) filter (coverage = 'none') as none,
    count(*) filter (coverage <> 'not_structurally_confirmable') as confirmable_total, case when count(*) filter (coverage <> 'not_structurally_confirmable') > 0 then 100.0::double * count(*) filter (coverage = 'confirmed') / count(*) filter (coverage <> 'not_structurally_confirmable') else 0 end as confirmed_pct from flows""",
)
def _gap_view(g: Graph) -> DataFrame:
    """User flows by how their tests cover them; what only end-to-end tests could confirm stays out of the share."""
    flows = gap_evidence(g.nodes.where("kind = 'UserFlow'"), g.edges, g.candidates)
    nsc = not_confirmable(g.nodes, g.edges, g.candidates).select(F.col("external_id").alias("nsc_id"))
    rows = flows.join(nsc, F.col("external_id") == F.col("nsc_id"), "left")
    coverage = F.when(F.col("evidence") == "covered", "confirmed").when(F.col("nsc_id").isNotNull(), "not_structurally_confirmable").when(F.col("evidence") == "weak", "inferred").otherwise("none")
    names = ("confirmed", "inferred", "not_structurally_confirmable", "none")
    counts = rows.select(coverage.alias("coverage")).agg(F.count("*").alias("userflows"), *[F.count_if(F.col("coverage") == n).alias(n) for n in names])
    tests = g.nodes.where("kind = 'TestCase'").agg(F.count("*").alias("testcases"))
    total = F.col("confirmed") + F.col("inferred") + F.col("none")
    return counts.crossJoin(tests).withColumn("confirmable_total", total).withColumn("confirmed_pct", F.when(total > 0, 100.0 * F.col("confirmed") / total).otherwise(0.0))  # two single rows


def first_per_file(rows: DataFrame, rank: str) -> DataFrame:
    """The best-ranked row of each file."""
    return rows.groupBy("file").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "file"]), rank).alias("r")).select("file", "r.*")


@query("first_row_per_file", "commits", "select file, min(ts) as ts, arg_min(adds, (ts, adds, dels)) as adds, arg_min(dels, (ts, adds, dels)) as dels from commits group by file")
def _first_row(g: Graph) -> DataFrame:
    """The first change of each file."""
    return first_per_file(g.commits.withColumn("rank", F.struct("ts", "adds", "dels")), "rank").drop("rank")


@query("weak_name_behaviors", "nodes", "select external_id from nodes where coalesce(behavior_source = 'test_inferred', false) and kind in ('Requirement', 'UserFlow', 'BusinessRule')")
def _weak_names(g: Graph) -> DataFrame:
    """Behaviours that were guessed from the names of tests."""
    return g.nodes.where("behavior_source = 'test_inferred' and kind in ('Requirement', 'UserFlow', 'BusinessRule')").select("external_id")


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The first node of each wanted external_id (column ``id``)."""
    first = nodes.join(ids.select(F.col("id").alias("external_id")).distinct(), "external_id", "left_semi")
    return first.groupBy("external_id").agg(F.min_by(F.struct("kind", "title", "ord"), "ord").alias("n")).select("external_id", "n.*")


@query("point_lookup", ("nodes", "generated"), "select external_id, arg_min(kind, ord) as kind, arg_min(title, ord) as title, min(ord) as ord from nodes where external_id in (select entity_id from generated) group by external_id")
def _lookup(g: Graph) -> DataFrame:
    return lookup(g.nodes, g.generated.select(F.col("entity_id").alias("id")))


def around(edges: DataFrame, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges at either end of the wanted ids: id, direction, type and the other end."""
    kept = edges if types is None else edges.where(F.col("type").isin(types))
    ends = kept.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit("out").alias("direction"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("id"), F.lit("in").alias("direction"), F.col("from_id").alias("other")))).alias("e"), "type")
    return ends.select("e.*", "type").join(ids.select("id").distinct(), "id", "left_semi")


@query("edge_neighbourhood", ("nodes", "edges", "changed_files"), ", wanted as (select external_id as id from nodes where kind = 'CodeSymbol' and file in (select file from changed_files)) select from_id as id, 'out' as direction, to_id as other, type from edges where type in ('CALLS', 'TESTED_BY') and from_id in (select id from wanted) union all select to_id, 'in', from_id, type from edges where type in ('CALLS', 'TESTED_BY') and to_id in (select id from wanted)")
def _around(g: Graph) -> DataFrame:
    ids = g.nodes.where("kind = 'CodeSymbol'").join(g.changed_files, "file", "left_semi").select(F.col("external_id").alias("id"))
    return around(g.edges, ids, ["CALLS", "TESTED_BY"])


def nearest_ancestor(paths: DataFrame, marked: DataFrame) -> DataFrame:
    """Of each path (column ``path``) the nearest directory at or above it that is marked (``dir`` and ``value``)."""
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    met = paths.select("path", F.explode(F.array_distinct(above)).alias("a")).select("path", "a.*").join(marked, "dir")
    best = met.groupBy("path").agg(F.max_by(F.struct("dir", "value"), "depth").alias("m"))
    return paths.join(best, "path", "left").select("path", "m.dir", "m.value")


_MARKED_SQL = "(values ('', 'root'), ('src', 'module-src'), ('src/services', 'module-services'), ('server', 'module-server'), ('webapp/channels', 'module-web'))"


@query("nearest_config", "source_files", f""", marked(dir, value) as {_MARKED_SQL}, paths as (select distinct path, regexp_replace(path, '/?[^/]*$', '') as d from source_files)
    select path, arg_max(m.dir, length(m.dir)) as dir, arg_max(m.value, length(m.dir)) as value from paths p join marked m on m.dir = '' or p.d = m.dir or starts_with(p.d, m.dir || '/') group by path""")
def _nearest(g: Graph) -> DataFrame:
    """The module or configuration that each file falls under."""
    marked = g.spark.sql(f"select * from {_MARKED_SQL} as m(dir, value)")
    return nearest_ancestor(g.source_files.select("path").distinct(), marked)


def suggested_links(links: DataFrame, nodes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Suggested links (place, behavior_id, symbol_id) with a verdict: unknown behaviour, unknown symbol, not among the
    candidates that were shown (behavior_id, symbol_id), repeated, or accepted, which is the first that passes."""
    known = lambda kinds, c: nodes.where(F.col("kind").isin(kinds)).select(F.col("external_id").alias(c), F.lit(True).alias(f"known_{c}")).distinct()
    rows = links.join(known(["Requirement", "UserFlow", "BusinessRule"], "behavior_id"), "behavior_id", "left").join(known(["CodeSymbol"], "symbol_id"), "symbol_id", "left")
    shown = F.lit(True)
    if allowed is not None:
        rows = rows.join(allowed.select("behavior_id", "symbol_id").distinct().withColumn("shown", F.lit(True)), ["behavior_id", "symbol_id"], "left")
        shown = F.col("shown").isNotNull()
    dropped = F.when(F.col("known_behavior_id").isNull(), "behavior_id is not an existing behavior node").when(F.col("known_symbol_id").isNull(), "symbol_id is not an existing CodeSymbol node").when(~shown, "symbol_id was not in the provided candidate set for behavior_id")
    rows = rows.withColumn("dropped", dropped)
    first = rows.where("dropped is null").groupBy("behavior_id", "symbol_id").agg(F.min("place").alias("first"))
    judged = rows.join(first, ["behavior_id", "symbol_id"], "left")
    return judged.select("place", "behavior_id", "symbol_id", F.coalesce("dropped", F.when(F.col("place") == F.col("first"), "accepted").otherwise("repeated")).alias("verdict"))


@query(
    "suggestion_verdicts",
    ("nodes", "behaviors", "symbols"),
    """, links as (select o_orderkey as place, case when o_orderkey % 17 = 0 then 'REQ-none' else b.external_id end as behavior_id, case when o_orderkey % 13 = 0 then 'test:none' else s.external_id end as symbol_id from orders join behaviors b on b.k = o_custkey join symbols s on s.k = 1 + o_custkey % 50),
    judged as (select *, case when behavior_id not in (select external_id from behaviors) then 'behavior_id is not an existing behavior node' when symbol_id not in (select external_id from symbols) then 'symbol_id is not an existing CodeSymbol node' when length(behavior_id) % 5 = 0 then 'symbol_id was not in the provided candidate set for behavior_id' end as dropped from links)
    select place, behavior_id, symbol_id, coalesce(dropped, case when row_number() over (partition by dropped, behavior_id, symbol_id order by place) = 1 then 'accepted' else 'repeated' end) as verdict from judged""",
)
def _suggestions(g: Graph) -> DataFrame:
    behavior = g.behaviors.select("k", F.col("external_id").alias("b"))
    symbol = g.symbols.select(F.col("k").alias("sk"), F.col("external_id").alias("s"))
    rows = g.orders.join(behavior, F.col("o_custkey") == F.col("k")).join(symbol, F.col("sk") == 1 + F.col("o_custkey") % 50)
    n = F.col("o_orderkey")
    links = rows.select(n.alias("place"), F.when(n % 17 == 0, "REQ-none").otherwise(F.col("b")).alias("behavior_id"), F.when(n % 13 == 0, "test:none").otherwise(F.col("s")).alias("symbol_id"))
    return suggested_links(links, g.nodes, links.where(F.length("behavior_id") % 5 != 0))


@query("attempt_backfill", "ledger", "select l.idx, coalesce(case when l.idx % 4 = 0 then l.status end, b.status) as mutant_status from ledger l left join (select target_id, arg_max(status, idx) as status from ledger where status in ('unproven', 'reproven') group by target_id) b using (target_id)")
def _backfill(g: Graph) -> DataFrame:
    """Attempts without an outcome take that of their target's last record that has one."""
    last = g.ledger.where("status in ('unproven', 'reproven')").groupBy("target_id").agg(F.max_by("status", "idx").alias("last"))
    own = F.when(F.col("idx") % 4 == 0, F.col("status"))
    return g.ledger.join(last, "target_id", "left").select("idx", F.coalesce(own, "last").alias("mutant_status"))


@query("contract_tallies", "imports", "select category as framework, kind, count(*) as n, count(*) filter (named) as handler_edges from (select from_role as category, kind, named from imports) x group by grouping sets ((category), (kind), ())")
def _contract_tallies(g: Graph) -> DataFrame:
    """Contracts by framework, by kind and in all, with those that have a handler; here imports stand for contracts."""
    rows = g.imports.select(F.col("from_role").alias("framework"), "kind", "named")
    return rows.groupingSets([["framework"], ["kind"], []], "framework", "kind").agg(F.count("*").alias("n"), F.count_if("named").alias("handler_edges"))


@query("pack_tally", "nodes", "select kind as entity_type, count(*) as count from nodes where kind <> 'File' group by kind order by kind")
def _pack_tally(g: Graph) -> DataFrame:
    return g.nodes.where("kind <> 'File'").groupBy(F.col("kind").alias("entity_type")).agg(F.count("*").alias("count")).orderBy("entity_type")


#: Test frameworks of scripts by what a test's text says, the first that fits, and their order in a tie (fixed values).
SCRIPT_FRAMEWORKS = [
    ("ava", r"""from\s+["']ava["']|require\(["']ava["']\)"""),
    ("playwright", r"""@playwright/test|from\s+["']playwright["']|require\(["']@playwright/test["']\)"""),
    ("vitest", r"""from\s+["']vitest["']|require\(["']vitest["']\)|\bvi\."""),
    ("jest", r"""from\s+["']@jest/globals["']|require\(["']@jest/globals["']\)|\bjest\."""),
    ("cypress", r"""from\s+["']cypress["']|require\(["']cypress["']\)|\bcy\."""),
    ("mocha", r"""from\s+["']mocha["']|require\(["']mocha["']\)|from\s+["']chai["']|require\(["']chai["']\)"""),
]
FRAMEWORK_ORDER = ["vitest", "jest", "ava", "playwright", "cypress", "mocha"]


def framework_of(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SCRIPT_FRAMEWORKS):
        out = F.when(content.rlike(pattern), name).otherwise(out)
    return out


def framework_vote(tests: DataFrame) -> DataFrame:
    """The framework that most related tests (area, content) of each area use; ties go by a fixed order."""
    votes = tests.select("area", framework_of(F.col("content")).alias("framework")).where("framework is not null").groupBy("area", "framework").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, FRAMEWORK_ORDER)), F.col("framework"))
    return votes.groupBy("area").agg(F.max_by("framework", F.struct("n", -order)).alias("framework"))


_FRAMEWORK_SQL = "case " + " ".join(f"when regexp_matches(content, {quoted(p)}) then '{n}'" for n, p in SCRIPT_FRAMEWORKS) + " end"


@query("framework_vote", "source_files", f""", votes as (select {AREA_SQL.format("path")} as area, {_FRAMEWORK_SQL} as framework, count(*) as n from source_files group by 1, 2)
    select area, framework from votes where framework is not null qualify row_number() over (partition by area order by n desc, list_position(['vitest', 'jest', 'ava', 'playwright', 'cypress', 'mocha'], framework)) = 1""")
def _vote(g: Graph) -> DataFrame:
    return framework_vote(g.source_files.select(area(F.col("path")).alias("area"), "content"))


def sibling(tests: DataFrame, files: DataFrame) -> DataFrame:
    """The source file that a test's name and place point to, by the customs of its language: path, sibling, confidence.

    Go: the same directory. Java and Kotlin: the mirrored source root, else the same directory. Python: the same
    directory, else the only file of that name below the longest tail of the test's directories that has any, else
    the only file of that name."""
    p = F.col("path")
    base, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_replace("path", "/?[^/]*$", "")
    at = lambda d, b: F.when(d == "", b).otherwise(F.concat(d, F.lit("/"), b))
    go, jvm, ext = F.regexp_extract(base, r"^(.+)_test\.go$", 1), F.regexp_extract(base, r"^(.+?)(Tests?|IT|ITCase|TestCase|Spec)\.(java|kt)$", 1), F.regexp_extract(base, r"\.(java|kt)$", 1)
    py = F.coalesce(F.nullif(F.regexp_extract(base, r"^test_(.+)\.py$", 1), F.lit("")), F.regexp_extract(base, r"^(.+)_test\.py$", 1))
    mirror = F.regexp_replace(folder, r"(^|/)src/(test|integration-test|it|androidTest)(/|$)", "$1src/main$3")
    guess = lambda path, confidence, rank: F.struct(path.alias("sibling"), F.lit(confidence).alias("confidence"), F.lit(rank).alias("rank"))
    jvm_base = F.concat(jvm, F.lit("."), ext)
    guesses = F.array_compact(F.array(F.when(go != "", guess(at(folder, F.concat(go, F.lit(".go"))), 0.7, 0)), F.when((jvm != "") & (mirror != folder), guess(at(mirror, jvm_base), 0.7, 0)), F.when(jvm != "", guess(at(folder, jvm_base), 0.65, 1)), F.when(py != "", guess(at(folder, F.concat(py, F.lit(".py"))), 0.65, 1))))
    known = files.select(F.col("path").alias("sibling")).distinct()
    tests = tests.select("path").distinct()
    direct = tests.select("path", F.explode(guesses).alias("g")).select("path", "g.*").where("path <> sibling").join(known, "sibling").groupBy("path").agg(F.min_by(F.struct("sibling", "confidence"), "rank").alias("m"))
    # Python modules: every tail of a file's path that ends in its name
    left = tests.where(py != "").select("path", F.concat(py, F.lit(".py")).alias("name"), F.filter(F.split(folder, "/"), lambda s: (s != "") & ~s.rlike(PYTHON_TEST_ROOT)).alias("dirs"))
    tails = left.select("path", "name", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("dirs")), lambda i: F.concat_ws("/", F.slice("dirs", i + 1, F.size("dirs")), F.array("name")))).alias("start", "tail"), F.size("dirs").alias("depth"))
    parts = F.split("sibling", "/")
    ends = known.where("sibling like '%.py'").select("sibling", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))).alias("tail"))
    met = tails.join(ends, "tail").where("path <> sibling").groupBy("path", "start", "depth").agg(F.count("*").alias("n"), F.min("sibling").alias("sibling"))
    longest = met.groupBy("path").agg(F.min_by(F.struct("n", "sibling", (F.col("depth") - F.col("start")).alias("dirs")), "start").alias("m"))
    mirrored = longest.where("m.n = 1").select("path", F.struct(F.col("m.sibling").alias("sibling"), F.when(F.col("m.dirs") >= 2, 0.62).when(F.col("m.dirs") == 1, 0.58).otherwise(0.5).alias("confidence")).alias("m"))
    both = direct.unionByName(mirrored.join(direct, "path", "left_anti"))
    return both.select("path", "m.sibling", "m.confidence")


#: Directories that hold tests and say nothing of the module (fixed value).
PYTHON_TEST_ROOT = r"(?i)^(tests?|unit_?tests?|integration_?tests?|functional_?tests?|e2e|it|specs?)$"


@query(
    "convention_siblings",
    "source_files",
    r""", files as (select distinct path, regexp_extract(path, '([^/]*)$', 1) as base, regexp_replace(path, '/?[^/]*$', '') as dir from source_files),
    named as (select *, regexp_extract(base, '^(.+)_test\.go$', 1) as go, regexp_extract(base, '^(.+?)(Tests?|IT|ITCase|TestCase|Spec)\.(java|kt)$', 1) as jvm, regexp_extract(base, '\.(java|kt)$', 1) as ext, coalesce(nullif(regexp_extract(base, '^test_(.+)\.py$', 1), ''), regexp_extract(base, '^(.+)_test\.py$', 1)) as py,
        regexp_replace(dir, '(^|/)src/(test|integration-test|it|androidTest)(/|$)', '\1src/main\3') as mirror from files),
    guesses as (select path, dir || '/' || go || '.go' as sibling, 0.7 as confidence, 0 as rank from named where go <> '' union all select path, mirror || '/' || jvm || '.' || ext, 0.7, 0 from named where jvm <> '' and mirror <> dir union all select path, dir || '/' || jvm || '.' || ext, 0.65, 1 from named where jvm <> '' union all select path, dir || '/' || py || '.py', 0.65, 1 from named where py <> ''),
    direct as (select path, arg_min(sibling, rank) as sibling, arg_min(confidence, rank) as confidence from guesses where path <> sibling and sibling in (select path from files) group by path),
    mods as (select path, py || '.py' as name, list_filter(string_split(dir, '/'), lambda s: s <> '' and not regexp_matches(s, '(?i)^(tests?|unit_?tests?|integration_?tests?|functional_?tests?|e2e|it|specs?)$')) as dirs from named where py <> '' and path not in (select path from direct)),
    tails as (select path, dirs, unnest(range(len(dirs) + 1)) as start, name from mods), tailed as (select path, start, len(dirs) - start as depth, array_to_string(list_append(list_slice(dirs, start + 1, len(dirs)), name), '/') as tail from tails),
    met as (select t.path, t.start, any_value(t.depth) as depth, count(*) as n, min(f.path) as sibling from tailed t join files f on (f.path = t.tail or ends_with(f.path, '/' || t.tail)) and f.path <> t.path group by t.path, t.start),
    longest as (select *, row_number() over (partition by path order by start) as k from met)
    select path, sibling, confidence::double as confidence from direct union all select path, sibling, case when depth >= 2 then 0.62 when depth = 1 then 0.58 else 0.5 end from longest where k = 1 and n = 1""",
)
def _siblings(g: Graph) -> DataFrame:
    return sibling(g.source_files, g.source_files)


def tests_of_risks(risks: DataFrame, tests: DataFrame, most: int = 2) -> DataFrame:
    """Generated tests (ord, target, runnable, title) of each risk row (id, file, rank): those that aim at it; at the
    first row of a file also those that aim at a symbol of the file which is no row itself. Where one can run, those
    that can't are left out; the first ``most`` are shown."""
    rows = risks.join(risks.groupBy("file").agg(F.min("rank").alias("first")), "file").withColumn("is_first", F.col("rank") == F.col("first")).drop("first")
    aimed = tests.where("target is not null").withColumn("target_file", F.nullif(F.regexp_extract("target", "^sym:(.+)#", 1), F.lit("")))
    exact = rows.select("id").join(aimed, F.col("id") == F.col("target")).select("id", "ord", "title", "runnable", F.lit(False).alias("same_file"))
    others = aimed.join(risks.select(F.col("id").alias("target")), "target", "left_anti")
    near = rows.where("is_first").select("id", "file").join(others, F.col("file") == F.col("target_file")).select("id", "ord", "title", "runnable", F.lit(True).alias("same_file"))
    runs = F.coalesce("runnable", F.lit(True))
    linked = exact.unionByName(near).withColumn("runnable", runs)
    best = linked.groupBy("id").agg(F.max("runnable").alias("any_runs"))
    shown = linked.join(best, "id").where("runnable or not any_runs")
    place = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return shown.withColumn("place", place).where(F.col("place") <= most).select("id", F.col("place").cast("long").alias("place"), "title", "same_file", "runnable")


@query(
    "risk_tests",
    ("symbols", "orders_in_order"),
    """, risks as (select external_id as id, file, k as rank from symbols where end_line >= 30), firsts as (select file, min(rank) as rank from risks group by file), tests as (select o.ord, s.external_id as target, s.file as target_file, o.runnable, 'gen:' || o.ord as title from orders_in_order o join symbols s on s.k = o.k),
    linked as (select r.id, t.ord, t.title, coalesce(t.runnable, true) as runnable, false as same_file from risks r join tests t on t.target = r.id union all select r.id, t.ord, t.title, coalesce(t.runnable, true), true from risks r join firsts f on f.file = r.file and f.rank = r.rank join tests t on t.target_file = r.file where t.target not in (select id from risks)),
    shown as (select *, row_number() over (partition by id order by ord) as place from (select *, bool_or(runnable) over (partition by id) as any_runs from linked) x where runnable or not any_runs)
    select id, place, title, same_file, runnable from shown where place <= 2""",
)
def _risk_tests(g: Graph) -> DataFrame:
    """Symbols of 30 lines and more count as the risk rows, in the order of their keys."""
    risks = g.symbols.where("end_line >= 30").select(F.col("external_id").alias("id"), "file", F.col("k").alias("rank"))
    tests = g.orders_in_order.join(g.symbols.select("k", F.col("external_id").alias("target")), "k").select("ord", "target", "runnable", F.concat(F.lit("gen:"), F.col("ord").cast("string")).alias("title"))
    return tests_of_risks(risks, tests)


@query("job_listing", (), "select event_id, event_type, ts from events order by ts desc, event_id")
def _jobs(g: Graph) -> DataFrame:
    """Jobs, the newest first."""
    return g.events.select("event_id", "event_type", "ts").orderBy(F.desc("ts"), "event_id")


def patched(nodes: DataFrame, edges: DataFrame, proofs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test nodes and the two edges of each proof (test_file, symbol) that the graph lacks: the test and COVERS, and
    TESTED_BY back."""
    test = F.concat(F.lit("test:"), "test_file")
    wanted = proofs.select(test.alias("external_id"), F.col("test_file").alias("file")).distinct()
    new_nodes = wanted.join(nodes.select("external_id"), "external_id", "left_anti").withColumn("kind", F.lit("TestCase"))
    forth = proofs.select(test.alias("from_id"), F.col("symbol").alias("to_id"), F.lit("COVERS").alias("type"))
    back = proofs.select(F.col("symbol").alias("from_id"), test.alias("to_id"), F.lit("TESTED_BY").alias("type"))
    new_edges = forth.unionByName(back).distinct().join(edges.select("from_id", "to_id", "type"), ["from_id", "to_id", "type"], "left_anti")
    return new_nodes, new_edges


@query("scoped_patch", ("nodes", "edges", "symbols", "orders_in_order"), """, proofs as (select distinct 'tests/s' || (ord % 40) || '.test.ts' as test_file, s.external_id as symbol from orders_in_order o join symbols s on s.k = o.k), wanted as (select 'test:' || test_file as from_id, symbol as to_id, 'COVERS' as type from proofs union select symbol, 'test:' || test_file, 'TESTED_BY' from proofs)
    select 'node' as what, 'test:' || test_file as from_id, 'TestCase' as type, file as to_id from (select distinct test_file, test_file as file from proofs) x where 'test:' || test_file not in (select external_id from nodes) union all select 'edge', from_id, type, to_id from (select * from wanted except select from_id, to_id, type from edges) y""")
def _patch(g: Graph) -> DataFrame:
    proofs = g.orders_in_order.join(g.symbols.select("k", F.col("external_id").alias("symbol")), "k").select(F.concat(F.lit("tests/s"), (F.col("ord") % 40).cast("string"), F.lit(".test.ts")).alias("test_file"), "symbol").distinct()
    new_nodes, new_edges = patched(g.nodes, g.edges, proofs)
    return new_nodes.select(F.lit("node").alias("what"), F.col("external_id").alias("from_id"), F.col("kind").alias("type"), F.col("file").alias("to_id")).unionByName(new_edges.select(F.lit("edge").alias("what"), "from_id", "type", "to_id"))
