"""Traceability matrix: one row for each behaviour with its evidence tier, test signal and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import AREA_SQL, CODE_AREA_SQL, area, code_area, csv_cell, markdown_cell, round_half_up
from ..functions.rules import any_sql, first_of, first_sql, quoted
from ..operators.classification import label_sql, language, language_label, language_sql
from ..operators.evidence import CONFIRM_SQL, confirming_tests, denominator
from ..operators.ledger import best_records
from ..registry import query
from ..schema import SIGNAL_TYPES, STATUSES, TIERS, rank_of
from ..sources.driver_tables import Graph


def candidate_signals(candidates: DataFrame) -> DataFrame:
    """id and other end of candidate test edges, both ways; what a model suggested doesn't count."""
    kept = candidates.where(F.col("type").isin(SIGNAL_TYPES) & ~F.coalesce("ai_suggested", F.lit(False)))
    return kept.select("from_id", "to_id").unionByName(kept.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).distinct()


def first_three(rows: DataFrame, of: str, name: str) -> DataFrame:
    """The three smallest distinct values of ``of`` for each id, joined; no more are ever gathered for one id."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(of))  # the limit is applied before the shuffle, too
    first = rows.select("id", of).distinct().withColumn("place", place).where("place <= 3")
    return first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(of)), "; ").alias(name))


#: Words that suggest a kind of test, the first that fits (fixed values).
SUGGESTIONS = [
    ("auth-permission", "auth|permission|role|rbac|login|session|token"),
    ("validation", "valid|parse|schema|sanitize|input|required"),
    ("state-transition", "create|update|delete|remove|archive|status|enable|disable|transition"),
    ("error-handling", "error|fail|recover|retry|exception"),
    ("boundary", "limit|range|empty|max|min|overflow|boundary"),
    ("idempotency-concurrency", "concurrent|lock|race|idempot|duplicate"),
]


def suggestion(status):
    """What to test next; nothing for what is proven or runs already."""
    said = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "external_id", F.coalesce("file", F.lit(""))))
    kind = first_of([(said.rlike(p), name) for name, p in SUGGESTIONS], "happy-path")
    return F.when(status.isin(*STATUSES[4:]), "").otherwise(F.concat(F.lit("Add a "), kind, F.lit(" test that asserts this behavior.")))


def matrix(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, ledger: DataFrame, runtime_ids: DataFrame | None = None) -> DataFrame:
    """Behaviours of the denominator, then proven symbols beside it (``off_denominator``)."""
    static = first_three(confirming_tests(nodes, edges), "test_id", "static_tests")
    signals = candidate_signals(candidates)
    by_id = first_three(signals, "other", "leads")
    by_file = by_id.where("not (id like 'sym:%' or id like 'test:%' or id like 'flow:%')").withColumnRenamed("leads", "file_leads")
    best = best_records(ledger).select(F.col("target_id").alias("best_id"), F.col("status").alias("run_status"), F.col("closed").alias("run_closed"), "proven")

    live = F.col("eligible") & ~F.coalesce("stale", F.lit(False))
    rows = nodes.where(live | (F.col("kind") == "CodeSymbol")).withColumn("off_denominator", ~live)
    rows = rows.join(best, F.col("external_id") == F.col("best_id"), "left").withColumn("proven", F.coalesce("proven", F.lit(False))).where("not off_denominator or proven")
    rows = rows.join(static.withColumnRenamed("id", "static_id"), F.col("external_id") == F.col("static_id"), "left")
    rows = rows.join(by_id.withColumnRenamed("id", "lead_id"), F.col("external_id") == F.col("lead_id"), "left")
    rows = rows.join(by_file.withColumnRenamed("id", "lead_file"), F.col("file") == F.col("lead_file"), "left")
    if runtime_ids is not None:
        rows = rows.join(runtime_ids.select(F.col("id").alias("ran_id")).distinct(), F.col("external_id") == F.col("ran_id"), "left")
    ran = F.col("ran_id").isNotNull() if runtime_ids is not None else F.lit(False)
    tier = F.when(F.col("proven"), "proven").when(ran & (F.col("kind") == "CodeSymbol"), "runtime").when(F.col("static_id").isNotNull(), "associated").when(F.col("lead_id").isNotNull() | F.col("lead_file").isNotNull(), "candidate").otherwise("none")
    rows = rows.withColumn("tier", tier)
    status = (
        F.when((F.col("tier") == "proven") & (F.col("run_status") == "reproven") & F.col("run_closed"), STATUSES[6])
        .when(F.col("tier") == "proven", STATUSES[5])
        .when(F.col("tier") == "runtime", STATUSES[4])
        .when(F.col("run_status") == "generated_unverifiable", STATUSES[3])
        .when(F.col("tier") == "associated", STATUSES[2])
        .when(F.col("tier") == "candidate", STATUSES[1])
        .otherwise(STATUSES[0])
    )
    signal = F.when(F.col("tier") == "proven", "dynamic proof").when(F.col("static_tests").isNotNull(), F.concat(F.lit("static candidate: "), "static_tests")).otherwise(F.coalesce("leads", "file_leads", F.lit("")))
    outcome = F.when(F.col("run_status").isNotNull(), F.concat("run_status", F.when(F.col("run_closed"), " closed").otherwise(""))).otherwise("")
    return rows.select(F.coalesce("title", "external_id").alias("behavior"), F.col("external_id").alias("behavior_id"), "kind", F.coalesce("file", F.lit("")).alias("file"), area(F.col("file")).alias("area"), F.col("tier").alias("evidence_tier"), signal.alias("test_signal"), status.alias("status"), outcome.alias("ledger_outcome"), suggestion(status).alias("suggested_next_test"), "off_denominator", "ord")


MATRIX_SQL = (
    CONFIRM_SQL
    + """, best as (select *, status = 'reproven' and closed and dynamic_proof and fingerprint_matches as proven from ledger qualify row_number() over (partition by target_id order by status = 'reproven' and closed and dynamic_proof and fingerprint_matches desc, ts desc, idx desc) = 1),
    kept as (select from_id, to_id from candidates where type in ('MAY_RELATE_TO', 'MAY_BE_TESTED_BY', 'MAY_COVER') and not ai_suggested),
    signals as (select from_id as id, to_id as other from kept union select to_id, from_id from kept),
    static as (select id, array_to_string(list_slice(list_sort(list(distinct test_id)), 1, 3), '; ') as tests from confirming group by id),
    leads as (select id, array_to_string(list_slice(list_sort(list(distinct other)), 1, 3), '; ') as leads from signals group by id),
    base as (select n.*, not (n.eligible and not n.stale) as off_denominator, b.status as run_status, b.closed as run_closed, coalesce(b.proven, false) as proven, s.tests, l.leads, fl.leads as file_leads
        from nodes n left join best b on b.target_id = n.external_id left join static s on s.id = n.external_id left join leads l on l.id = n.external_id
        left join leads fl on fl.id = n.file and not (fl.id like 'sym:%' or fl.id like 'test:%' or fl.id like 'flow:%')
        where (n.eligible and not n.stale) or (n.kind = 'CodeSymbol' and b.proven)),
    tiers as (select *, case when proven then 'proven' when tests is not null then 'associated' when leads is not null or file_leads is not null then 'candidate' else 'none' end as evidence_tier from base),
    rtm as (select coalesce(title, external_id) as behavior, external_id as behavior_id, kind, coalesce(file, '') as file, """ + AREA_SQL.format("file") + """ as area, evidence_tier,
        case when evidence_tier = 'proven' then 'dynamic proof' when tests is not null then 'static candidate: ' || tests else coalesce(leads, file_leads, '') end as test_signal,
        case when evidence_tier = 'proven' then 'Reproven (this run)' when run_status = 'generated_unverifiable' then 'Generated-unverifiable' when evidence_tier = 'associated' then 'Associated signal' when evidence_tier = 'candidate' then 'Candidate signal (unconfirmed)' else 'No integration signal' end as status,
        case when run_status is null then '' else run_status || case when run_closed then ' closed' else '' end end as ledger_outcome,
        case when evidence_tier in ('proven', 'runtime') then '' else 'Add a ' || """ + first_sql([(any_sql("lower(concat_ws(' ', coalesce(title, ''), external_id, coalesce(file, '')))", [p]), quoted(name)) for name, p in SUGGESTIONS], "'happy-path'") + """ || ' test that asserts this behavior.' end as suggested_next_test, off_denominator, ord from tiers)"""
)
MATRIX_RELATIONS = ("nodes", "edges", "candidates", "ledger")


def of(g: Graph) -> DataFrame:
    return matrix(g.nodes, g.edges, g.candidates, g.ledger)


@query("rtm_rows", MATRIX_RELATIONS, MATRIX_SQL + " select * exclude (ord) from rtm")
def rtm_rows(g: Graph) -> DataFrame:
    return of(g).drop("ord")


def ordered(rows: DataFrame) -> DataFrame:
    """The report's order: denominator rows first, by status, area, file and title."""
    return rows.orderBy("off_denominator", F.when(F.col("off_denominator"), 0).otherwise(rank_of(F.col("status"), STATUSES)), "area", "file", "behavior", "behavior_id")


def summary(rows: DataFrame) -> DataFrame:
    base = ~F.col("off_denominator")
    tier = lambda t: F.count_if(base & (F.col("evidence_tier") == t))
    tried = F.count_if(base & (F.col("ledger_outcome").startswith("reproven") | F.col("ledger_outcome").startswith("unproven")))
    kept = F.count_if(base & (F.col("status") == STATUSES[6]))
    total = F.count_if(base)
    return rows.agg(
        total.alias("total"),
        F.count_if(F.col("evidence_tier") == "proven").alias("proven"),
        tier("runtime").alias("runtime_covered"),
        tier("associated").alias("associated"),
        tier("candidate").alias("candidate"),
        tier("none").alias("no_link"),
        kept.alias("reproven_this_run"),
        F.count_if(base & (F.col("status") == STATUSES[3])).alias("generated_unverifiable"),
        tried.alias("attempted"),
        F.when(tried == 0, 0.0).otherwise(round_half_up(100.0 * kept / tried, 2)).alias("kept_rate"),
        tier("proven").alias("coverage_confirmed"),
        F.when(total == 0, 0.0).otherwise(round_half_up(100.0 * tier("proven") / total, 1)).alias("coverage_pct"),
    )


@query(
    "rtm_summary",
    MATRIX_RELATIONS,
    MATRIX_SQL
    + """ select count(*) filter (not off_denominator) as total, count(*) filter (evidence_tier = 'proven') as proven, count(*) filter (not off_denominator and evidence_tier = 'runtime') as runtime_covered, count(*) filter (not off_denominator and evidence_tier = 'associated') as associated,
    count(*) filter (not off_denominator and evidence_tier = 'candidate') as candidate, count(*) filter (not off_denominator and evidence_tier = 'none') as no_link, count(*) filter (not off_denominator and status = 'Reproven (this run)') as reproven_this_run, count(*) filter (not off_denominator and status = 'Generated-unverifiable') as generated_unverifiable,
    count(*) filter (not off_denominator and (ledger_outcome like 'reproven%' or ledger_outcome like 'unproven%')) as attempted,
    floor(100.0 * count(*) filter (not off_denominator and status = 'Reproven (this run)') / count(*) filter (not off_denominator and (ledger_outcome like 'reproven%' or ledger_outcome like 'unproven%')) * 100 + 0.5) / 100 as kept_rate,
    count(*) filter (not off_denominator and evidence_tier = 'proven') as coverage_confirmed, floor(100.0 * count(*) filter (not off_denominator and evidence_tier = 'proven') / count(*) filter (not off_denominator) * 10 + 0.5) / 10 as coverage_pct from rtm""",
)
def _summary(g: Graph) -> DataFrame:
    return summary(of(g))


@query("area_rollup", MATRIX_RELATIONS, MATRIX_SQL + " select coalesce(area, 'all') as area, evidence_tier, count(*) as n from rtm where not off_denominator group by grouping sets ((area, evidence_tier), (evidence_tier))")
def _area_rollup(g: Graph) -> DataFrame:
    rows = of(g).where("not off_denominator")
    each = rows.groupBy("area", "evidence_tier").agg(F.count("*").alias("n"))
    return each.unionByName(each.groupBy("evidence_tier").agg(F.sum("n").alias("n")).withColumn("area", F.lit("all")))


def eligible_symbols(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'CodeSymbol' and not off_denominator")


@query(
    "language_tiers",
    MATRIX_RELATIONS,
    MATRIX_SQL
    + f""" select {label_sql(language_sql("file"))} as language, count(*) as total, count(*) filter (evidence_tier = 'proven') as proven, count(*) filter (evidence_tier = 'runtime') as runtime_covered, count(*) filter (evidence_tier = 'associated') as associated, count(*) filter (evidence_tier in ('candidate', 'none')) as unlinked,
    100.0::double * count(*) filter (evidence_tier = 'proven') / count(*) as proven_pct, 100.0::double * count(*) filter (evidence_tier = 'runtime') / count(*) as runtime_pct, 100.0::double * count(*) filter (evidence_tier = 'associated') / count(*) as associated_pct from rtm where kind = 'CodeSymbol' and not off_denominator group by 1""",
)
def _language_tiers(g: Graph) -> DataFrame:
    """Eligible symbols by language: how many are proven, run, are linked or have no link."""
    n = lambda *t: F.count_if(F.col("evidence_tier").isin(*t))
    rows = eligible_symbols(of(g)).groupBy(language_label(language(F.col("file"))).alias("language"))
    pct = lambda t: 100.0 * n(t) / F.count("*")
    return rows.agg(F.count("*").alias("total"), n("proven").alias("proven"), n("runtime").alias("runtime_covered"), n("associated").alias("associated"), n("candidate", "none").alias("unlinked"), pct("proven").alias("proven_pct"), pct("runtime").alias("runtime_pct"), pct("associated").alias("associated_pct"))


@query(
    "code_areas",
    MATRIX_RELATIONS,
    MATRIX_SQL
    + f""", a as (select *, {CODE_AREA_SQL.format("file")} as code_area, row_number() over (partition by {CODE_AREA_SQL.format("file")}, evidence_tier in ('proven', 'runtime') order by case when evidence_tier = 'none' then 0 else 1 end, ord) as n from rtm where kind = 'CodeSymbol' and not off_denominator)
    select code_area as area, count(*) as total, count(*) filter (evidence_tier = 'proven') as confirmed, count(*) filter (evidence_tier = 'runtime') as runtime_covered, count(*) filter (evidence_tier in ('associated', 'candidate')) as inferred, count(*) filter (evidence_tier = 'none') as none, 100.0::double * count(*) filter (evidence_tier = 'proven') / count(*) as confirmed_pct,
        coalesce(list(behavior || ' ' || evidence_tier order by n) filter (n <= 6 and evidence_tier not in ('proven', 'runtime')), []) as sample_gaps from a group by 1""",
)
def _code_areas(g: Graph) -> DataFrame:
    """Eligible symbols by code area, with the first samples of those without a link, then of the others."""
    rows = eligible_symbols(of(g)).withColumn("code_area", code_area(F.col("file")))
    n = lambda *t: F.count_if(F.col("evidence_tier").isin(*t))
    counts = rows.groupBy("code_area").agg(F.count("*").alias("total"), n("proven").alias("confirmed"), n("runtime").alias("runtime_covered"), n("associated", "candidate").alias("inferred"), n("none").alias("none"), (100.0 * n("proven") / F.count("*")).alias("confirmed_pct"))
    open_ = rows.where("evidence_tier not in ('proven', 'runtime')")
    place = F.row_number().over(Window.partitionBy("code_area").orderBy(F.when(F.col("evidence_tier") == "none", 0).otherwise(1), "ord"))
    first = open_.withColumn("n", place).where("n <= 6").groupBy("code_area").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "behavior", "evidence_tier").alias("s")))), lambda x: x["s"]).alias("sample_gaps"))
    return counts.join(first, "code_area", "left").withColumn("sample_gaps", F.coalesce("sample_gaps", F.array().cast("array<string>"))).withColumnRenamed("code_area", "area")


@query(
    "code_behaviors",
    MATRIX_RELATIONS,
    MATRIX_SQL
    + f""" select behavior_id as id, behavior as title, file, {CODE_AREA_SQL.format("file")} as area, {label_sql(language_sql("file"))} as language, evidence_tier as evidence from rtm where kind = 'CodeSymbol' and not off_denominator
    order by case evidence_tier when 'none' then 0 when 'candidate' then 1 when 'associated' then 2 when 'runtime' then 3 else 4 end, area, file, title, id""",
)
def _code_behaviors(g: Graph) -> DataFrame:
    """Eligible symbols by how little evidence they have, then area, file and title."""
    rows = eligible_symbols(of(g)).select(F.col("behavior_id").alias("id"), F.col("behavior").alias("title"), "file", code_area(F.col("file")).alias("area"), language_label(language(F.col("file"))).alias("language"), F.col("evidence_tier").alias("evidence"))
    return rows.orderBy(F.desc(rank_of(F.col("evidence"), TIERS)), "area", "file", "title", "id")


@query(
    "rtm_csv",
    MATRIX_RELATIONS,
    MATRIX_SQL + """ select behavior_id, '"' || replace(behavior, '"', '""') || '",' || status as csv, '| ' || replace(behavior, '|', '\\|') || ' | ' || status || ' |' as markdown from rtm""",
)
def _csv(g: Graph) -> DataFrame:
    """Cells of the matrix as CSV and Markdown lines; titles always quoted."""
    quoted = lambda c: F.when(csv_cell(c).startswith('"'), csv_cell(c)).otherwise(F.concat(F.lit('"'), csv_cell(c), F.lit('"')))
    return of(g).select("behavior_id", F.concat(quoted(F.col("behavior")), F.lit(","), "status").alias("csv"), F.concat(F.lit("| "), markdown_cell(F.col("behavior")), F.lit(" | "), "status", F.lit(" |")).alias("markdown"))


#: Short names of statuses (fixed values).
ALIASES = {
    "proven": "Proven", "runtime": "Runtime-covered", "runtime-covered": "Runtime-covered", "runtimecovered": "Runtime-covered", "associated": "Associated signal",
    "candidate": "Candidate signal (unconfirmed)", "candidate-signal": "Candidate signal (unconfirmed)", "no-link": "No integration signal", "nolink": "No integration signal", "none": "No integration signal",
    "reproven": "Reproven (this run)", "reproven-this-run": "Reproven (this run)", "generated-unverifiable": "Generated-unverifiable", "unverifiable": "Generated-unverifiable",
}


def with_statuses(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the statuses with these short names; unknown names are passed over, and none at all means no filter."""
    known = {ALIASES[n] for w in wanted if (n := w.strip().lower().replace("_", "-")) in ALIASES}
    return rows.where(F.col("status").isin(*sorted(known))) if known else rows


@query("status_filter", MATRIX_RELATIONS, MATRIX_SQL + " select behavior_id, status from rtm where status in ('No integration signal', 'Generated-unverifiable')")
def _status_filter(g: Graph) -> DataFrame:
    return with_statuses(of(g), [" No_Link", "unverifiable", "gap", "no such status"]).select("behavior_id", "status")


@query(
    "rtm_scope",
    ("nodes", "edges", "candidates", "ledger", "changed_files"),
    MATRIX_SQL + " select behavior_id, evidence_tier from rtm where file in (select file from changed_files)",
)
def _scope(g: Graph) -> DataFrame:
    """The rows of changed files."""
    return of(g).join(g.changed_files, "file", "left_semi").select("behavior_id", "evidence_tier")


__all__ = ["denominator", "matrix", "ordered", "summary", "with_statuses"]
