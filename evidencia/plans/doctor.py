"""Why proof attempts did not close: blockers with their smallest next step, survivors, and one status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import any_sql, first_of, first_sql, quoted
from ..operators.classification import language
from ..operators.text import ASSERTION, FAILURES, failure_kind, in_node_range
from ..registry import query
from ..sources.driver_tables import Graph
from .reports import nearest_ancestor

#: Reasons that tell their category whatever was recorded, the first that fits (fixed values).
REASONS = [("runner_missing", r"(?i)runner binary not found|unsupported or unknown test runner"), ("module_root_missing", r"(?i)no go\.mod found|no pom\.xml|no maven or gradle|build\.gradle"), ("assertion_binding", r"(?i)ambiguous|appears more than once|uniquely passed|not uniquely")]
#: Labels of the categories (fixed values).
LABELS = {
    "module_not_found": "a module or dependency is missing in the proof sandbox",
    "tsconfig_missing": "the package extends a monorepo tsconfig the sandbox cannot resolve",
    "experimental_builtin": "the target needs an experimental Node builtin runtime flag",
    "engine_mismatch": "the runner Node is outside the package's declared engines range",
    "db_or_external": "the test needs a database or external service the sandbox lacks",
    "runner_missing": "no supported test runner is available for the target's package",
    "module_root_missing": "no module root (go.mod / pom.xml / build.gradle) was found under the analyzed path",
    "assertion_binding": "the proof could not bind exactly one test to the target (ambiguous test identity)",
    "unsupported_language": "no dynamic-proof profile exists for this language yet",
    "setup_failed": "proof setup failed before the oracle could run",
}
#: What to do next, by category.
NEXT_STEPS = {
    "module_not_found": "install the package's dependencies so that its imports resolve",
    "tsconfig_missing": "run from the monorepo's root, so that parent configurations are at hand",
    "experimental_builtin": "run with the flag that the reason names, or on a version where the builtin is stable",
    "engine_mismatch": "switch to a version within the package's engines range",
    "db_or_external": "provide the service or a double of it in the setup commands",
    "runner_missing": "install the package's test framework",
    "module_root_missing": "run from the module root that owns the target",
    "assertion_binding": "give the covering test a title of its own",
    "unsupported_language": "targets in this language stay in their static tiers",
    "setup_failed": "read the reason and mend the setup step that it names",
}
NOT_ASSERTED = "associated_non_assertion_failure"
#: Languages with a proof, and files that mark a module root (fixed values).
PROVABLE = ["typescript", "javascript", "python", "go", "java"]
MARKERS = {"go": ["go.mod"], "java": ["pom.xml", "build.gradle", "build.gradle.kts"]}
#: Targets that are named for a blocker, and targets of the check before any attempt (fixed values).
NAMED, CHECKED = 5, 10


def blocker_category(reason: Column, category: Column) -> Column:
    said = F.coalesce(reason, F.lit(""))
    return first_of([(said.rlike(p), name) for name, p in REASONS] + [(category.isin(list(LABELS)), category)], "setup_failed")


def grouped(blocked: DataFrame, source: str) -> DataFrame:
    """category, label, n, targets (the first ``NAMED``), representative and next_step of blocked attempts (ord, category, target_symbol,
    test_path, reason); the most frequent first, of equal ones that which came first."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("ord"))  # limited before the shuffle, too
    named = blocked.withColumn("place", place).where(F.col("place") <= NAMED).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target_symbol"))), lambda x: x["target_symbol"]).alias("targets"))
    counts = blocked.groupBy("category").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by(F.struct("target_symbol", "test_path", "reason"), "ord").alias("r"))
    texts = lambda values: first_of([(F.col("category") == c, t) for c, t in values.items()])
    rows = counts.join(named, "category").orderBy(F.desc("n"), "first")
    return rows.select("category", texts(LABELS).alias("label"), "n", "first", "targets", F.col("r.target_symbol").alias("target_symbol"), F.col("r.test_path").alias("test_path"), F.col("r.reason").alias("reason"), texts(NEXT_STEPS).alias("next_step"), F.lit(source).alias("source"))


def attempt_blockers(attempts: DataFrame) -> DataFrame:
    """Blockers of attempts (ord, target_symbol, test_path, classification, category, reason) that need a setup."""
    rows = attempts.where("classification = 'needs_setup'")
    return grouped(rows.select("ord", blocker_category(F.col("reason"), F.col("category")).alias("category"), "target_symbol", "test_path", "reason"), "attempt")


def survivors(attempts: DataFrame, ledger: DataFrame) -> DataFrame:
    """target_symbol, test_path, mutant_status and note of attempts that ran and did not close, one for each target and test; a
    missing status is that of the target's last record in the ledger (target_symbol, ord, mutant_status) that has one."""
    rows = attempts.where("classification = 'non_killing'").groupBy("target_symbol", "test_path").agg(F.min_by("mutant_status", "ord").alias("own"), F.min("ord").alias("ord"))
    last = ledger.where("mutant_status is not null").groupBy("target_symbol").agg(F.max_by("mutant_status", "ord").alias("last"))
    status = F.coalesce("own", "last")
    return rows.join(last, "target_symbol", "left").select("target_symbol", "test_path", status.alias("mutant_status"), F.when(status == NOT_ASSERTED, "the test failed by an error, not by an assertion").otherwise("the mutant survived").alias("note"))


def preflight(targets: DataFrame, files: DataFrame, engines: DataFrame, runner: str) -> DataFrame:
    """Blockers that need no attempt, of the first ``CHECKED`` unproven targets (ord, target_symbol): a language without a proof, no file
    (path) that marks a module root above, a runner outside of the engines range (dir, value) of the nearest package."""
    rows = targets.where(F.col("target_symbol").startswith("sym:")).orderBy("ord").limit(CHECKED).withColumn("path", F.regexp_extract("target_symbol", "^sym:(.+)#", 1)).withColumn("language", language(F.col("path")))
    paths = rows.select("path").distinct()
    flags = rows
    for lang, names in MARKERS.items():
        marked = files.where(F.element_at(F.split("path", "/"), -1).isin(names)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.lit("root").alias("value")).distinct()
        flags = flags.join(nearest_ancestor(paths, marked).select("path", F.col("value").alias(f"{lang}_root")), "path", "left")
    flags = flags.join(nearest_ancestor(paths, engines).select("path", F.col("value").alias("engines")), "path", "left")
    rootless = F.lit(False)
    for lang in MARKERS:
        rootless = rootless | (F.col("language") == lang) & F.col(f"{lang}_root").isNull()
    category = first_of([(~F.col("language").isin(PROVABLE), "unsupported_language"), (rootless, "module_root_missing"), (F.col("language").isin("typescript", "javascript") & ~in_node_range(F.lit(runner), F.col("engines")), "engine_mismatch")])
    text = F.lit(None).cast("string")
    return grouped(flags.select("ord", category.alias("category"), "target_symbol", text.alias("test_path"), text.alias("reason")).where("category is not null"), "preflight")


def doctor_status(blockers: DataFrame, surviving: DataFrame, proven: DataFrame, fresh: bool) -> DataFrame:
    """One row: status, headline, proven and denominator of ``proven`` (a row of both), and the top blocker."""
    top = blockers.agg(F.max_by(F.struct("label", "n"), F.struct("n", -F.col("first"))).alias("top"))
    rows = proven.crossJoin(top).crossJoin(surviving.agg(F.count("*").alias("survivors")))  # one row each
    n, label = F.col("top.n"), F.col("top.label")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    cases = [
        (F.lit(not fresh), "stale", F.lit("attempts are older than the graph or its commit")),
        (F.col("proven") > 0, "proven", say(F.col("proven").cast("string"), " of ", F.col("denominator").cast("string"), " behaviors are proven; blockers explain the rest")),
        (n > 1, "blocked", say("none proven: one cause blocked ", n.cast("string"), " targets: ", label)),
        (n == 1, "blocked", say("none proven: top blocker: ", label)),
        (F.col("survivors") > 0, "blocked", say("none proven: ", F.col("survivors").cast("string"), " attempts ran and did not close")),
    ]
    return rows.select(first_of([(c, s) for c, s, _ in cases], "no_data").alias("status"), first_of([(c, h) for c, _, h in cases], "no attempts yet").alias("headline"), "proven", "denominator", F.when(F.lit(fresh), label).alias("top_blocker"))


_KIND = first_sql([(any_sql("said", [ASSERTION]), quoted("logic_failure")), ("engines in ('>=24.2.0 <25', '^18', '~20.1', '>24', '<=22')", quoted("engine_mismatch")), *[(any_sql("said", [p]), quoted(name)) for name, p in FAILURES]], quoted("unknown"))
DOCTOR_SQL = f""", judged as (select *, {_KIND} as kind from (select *, reason as said from attempts) x),
    categorised as (select *, {first_sql([(any_sql("reason", [p]), quoted(name)) for name, p in REASONS] + [(f"kind in ({', '.join(map(quoted, LABELS))})", "kind")], quoted("setup_failed"))} as category from judged where classification = 'needs_setup'),
    counted as (select category, count(*) as n, min(ord) as first, list(target_symbol order by ord)[1:5] as targets, arg_min(target_symbol, ord) as target_symbol, arg_min(test_path, ord) as test_path, min(ord) as at_ord from categorised group by category),
    blockers as (select c.*, a.reason from counted c join attempts a on a.ord = c.at_ord),
    surviving as (select target_symbol, test_path, coalesce(first_own, last) as mutant_status from (select target_symbol, test_path, min_by(coalesce(mutant_status, '-'), ord) as f, nullif(min_by(coalesce(mutant_status, '-'), ord), '-') as first_own from attempts where classification = 'non_killing' group by 1, 2) x
        left join (select target_id as target_symbol, max_by(status, idx) as last from ledger where status in ('unproven', 'reproven') group by 1) l using (target_symbol))"""


def _attempts(g: Graph) -> DataFrame:
    return g.attempts.withColumn("category", failure_kind(F.col("reason"), F.lit("v23.5.1"), F.col("engines")))


def _outcomes(g: Graph) -> DataFrame:
    return g.ledger.select(F.col("target_id").alias("target_symbol"), F.col("idx").alias("ord"), F.when(F.col("status").isin("unproven", "reproven"), F.col("status")).alias("mutant_status"))


@query("proof_blockers", ("attempts",), DOCTOR_SQL.split("surviving as")[0].rstrip().rstrip(",") + f" select category, {first_sql([(f'category = {quoted(c)}', quoted(t)) for c, t in LABELS.items()])} as label, n, targets, target_symbol, test_path, reason from blockers")
def _proof_blockers(g: Graph) -> DataFrame:
    return attempt_blockers(_attempts(g)).select("category", "label", "n", "targets", "target_symbol", "test_path", "reason")


@query("proof_survivors", ("attempts", "ledger"), DOCTOR_SQL + f" select target_symbol, test_path, mutant_status, case when mutant_status = {quoted(NOT_ASSERTED)} then 'the test failed by an error, not by an assertion' else 'the mutant survived' end as note from surviving")
def _proof_survivors(g: Graph) -> DataFrame:
    return survivors(_attempts(g), _outcomes(g))


@query(
    "proof_doctor",
    ("attempts", "ledger", "behaviors"),
    DOCTOR_SQL
    + f""", totals as (select (select count(distinct target_id) from ledger where closed and dynamic_proof and fingerprint_matches) as proven, (select count(*) from behaviors) as denominator), top as (select category, n from blockers order by n desc, first limit 1)
    select 'proven' as status, proven || ' of ' || denominator || ' behaviors are proven; blockers explain the rest' as headline, proven, denominator, (select {first_sql([(f'category = {quoted(c)}', quoted(t)) for c, t in LABELS.items()])} from top) as top_blocker from totals""",
)
def _proof_doctor(g: Graph) -> DataFrame:
    attempts = _attempts(g)
    proven = g.ledger.where("closed and dynamic_proof and fingerprint_matches").agg(F.count_distinct("target_id").alias("proven")).crossJoin(g.behaviors.agg(F.count("*").alias("denominator")))
    return doctor_status(attempt_blockers(attempts), survivors(attempts, _outcomes(g)), proven, fresh=True)
