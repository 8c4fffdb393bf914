"""Risk of untested symbols: probability x impact x detection difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import round_half_up
from ..lineage import stored, unbroadcast
from ..operators.evidence import CONFIRM_SQL, HARD_TYPES, confirming_tests, denominator, marked
from ..functions.rules import any_sql, first_sql, quoted
from ..operators.graphs import API_NAME, API_PATH, ENTRY_FILE, ENTRY_NAME, ENTRY_PATH, ENTRY_SQL, call_pairs, entries, entry_point, flow_depth, shared
from ..operators.ledger import best_records
from ..registry import query
from ..sources.driver_tables import Graph
from .traceability import candidate_signals

WINDOW_DAYS, NEW_DAYS = 180, 30

#: Words that make data sensitive, and how much (fixed values).
SENSITIVE = [
    (10, ["payment", "stripe", "refund", "charge", "billing", "payout", "chargeback"]),
    (9, ["auth", "token", "session", "password", "credential", "jwt", "oauth"]),
    (7, ["order", "cart", "checkout", "invoice", "transaction"]),
    (6, ["customer", "user", "account", "profile", "pii", "gdpr"]),
    (3, ["notification", "email", "sms", "webhook", "push"]),
]


def sensitivity(text: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    has = lambda w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    out = F.when(has(SENSITIVE[0][1]) | has(["capture"]) & has(["payment", "stripe", "transaction"]), 10)
    for weight, w in SENSITIVE[1:]:
        out = out.when(has(w), weight)
    return out.otherwise(1)


def route_weight(file: Column, title: Column) -> Column:
    verb = F.upper(title)
    http = title.rlike("(?i)^(GET|POST|PUT|PATCH|DELETE)$") & file.rlike(API_PATH)
    store, admin = file.rlike(r"(?i)/store(/|\b)"), file.rlike(r"(?i)/admin(/|\b)")
    by = lambda pairs, other: F.when(F.lit(False), 0) if not pairs else _cases(verb, pairs, other)
    inner = by([("POST", 10), ("DELETE", 9), ("PUT", 8), ("GET", 5)], 7)
    outer = by([("POST", 6), ("GET", 3)], 5)
    return F.when(http & store, inner).when(http & admin, outer).when(entry_point(file, title), 4).when(file.rlike(r"(?i)(^|/)(services?|controllers?|handlers?|modules?)/"), 4).otherwise(2)


def _cases(value: Column, pairs: list[tuple[str, int]], other: int) -> Column:
    out = F.when(value == pairs[0][0], pairs[0][1])
    for name, weight in pairs[1:]:
        out = out.when(value == name, weight)
    return out.otherwise(other)


def confirmed_ids(nodes: DataFrame, edges: DataFrame, proven: DataFrame) -> DataFrame:
    """Symbols and requirements with a hard test edge, and containers all of whose members are confirmed or proven."""
    hard = edges.where(F.col("type").isin(HARD_TYPES) & (F.col("strength") == "hard")).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    direct = nodes.where(F.col("kind").isin("CodeSymbol", "Requirement")).select(F.col("external_id").alias("id")).join(hard, "id", "left_semi")
    return direct.unionByName(suppressed_containers(nodes, direct, proven)).distinct()


def suppressed_containers(nodes: DataFrame, confirmed: DataFrame, proven: DataFrame) -> DataFrame:
    symbols = nodes.where("kind = 'CodeSymbol'").select("external_id", "file", "name", "member_of", "eligible")
    done = confirmed.unionByName(proven).distinct()
    members = marked(symbols.where("member_of is not null and member_of <> ''"), done, "done").select("file", F.col("member_of").alias("name"), F.col("external_id").alias("member"), "done")
    held = symbols.where("eligible").select(F.col("external_id").alias("id"), "file", "name").join(members, ["file", "name"]).where("id <> member")
    return held.groupBy("id").agg(F.bool_and("done").alias("all_done")).where("all_done").select("id").join(confirmed, "id", "left_anti")


SUPPRESSED_SQL = """, best_record as (select *, status = 'reproven' and closed and dynamic_proof and fingerprint_matches as proven from ledger qualify row_number() over (partition by target_id order by status = 'reproven' and closed and dynamic_proof and fingerprint_matches desc, ts desc, idx desc) = 1),
    proven_ids as (select target_id as id from best_record where proven),
    hard_ids as (select from_id as id from edges where type in ('TESTED_BY', 'COVERS') and strength = 'hard' union select to_id from edges where type in ('TESTED_BY', 'COVERS') and strength = 'hard'),
    direct as (select external_id as id from nodes where kind in ('CodeSymbol', 'Requirement') and external_id in (select id from hard_ids)),
    suppressed as (select c.external_id as id from nodes c join nodes m on m.file = c.file and m.member_of = c.name and m.external_id <> c.external_id and m.kind = 'CodeSymbol' where c.kind = 'CodeSymbol' and c.eligible and c.external_id not in (select id from direct)
        group by c.external_id having bool_and(m.external_id in (select id from direct) or m.external_id in (select id from proven_ids)))"""
RELATIONS = ("nodes", "edges", "candidates", "ledger", "commits")


def proven_ids(ledger: DataFrame) -> DataFrame:
    return best_records(ledger).where("proven").select(F.col("target_id").alias("id"))


@query("container_suppression", ("nodes", "edges", "ledger"), SUPPRESSED_SQL + " select id from suppressed")
def _containers(g: Graph) -> DataFrame:
    hard = g.edges.where(F.col("type").isin(HARD_TYPES) & (F.col("strength") == "hard")).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    direct = g.nodes.where(F.col("kind").isin("CodeSymbol", "Requirement")).select(F.col("external_id").alias("id")).join(hard, "id", "left_semi")
    return suppressed_containers(g.nodes, direct, proven_ids(g.ledger))


def untested(nodes: DataFrame, edges: DataFrame, ledger: DataFrame) -> DataFrame:
    symbols = denominator(nodes).where("kind = 'CodeSymbol'").join(confirmed_ids(nodes, edges, proven_ids(ledger)).withColumnRenamed("id", "external_id"), "external_id", "left_anti")
    span = F.when((F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")), F.col("end_line") - F.col("start_line") + 1).otherwise(0)
    return symbols.withColumn("span", span)


def references(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, incoming references (calls, and a share of the file's imports) and number of callees."""
    ids = symbols.select(F.col("external_id").alias("id"), "file")
    calls = edges.where("type = 'CALLS'")
    into = calls.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("calls"))
    out = call_pairs(edges).groupBy(F.col("caller").alias("id")).agg(F.count("*").alias("fan_out"))
    imports = edges.where("type = 'IMPORTS'").groupBy(F.col("to_id").alias("file")).agg(F.count("*").alias("imports"))
    sizes = ids.groupBy("file").agg(F.count("*").alias("in_file"))
    share = imports.join(sizes, "file").select("file", (F.col("imports") / F.col("in_file")).alias("share"))
    joined = ids.join(into, "id", "left").join(share, "file", "left").join(out, "id", "left")
    return joined.select("id", (F.coalesce("calls", F.lit(0)) + F.coalesce("share", F.lit(0.0))).alias("refs"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def file_churn(commits: DataFrame) -> DataFrame:
    """Lines changed in the window before the newest commit, and whether the file is new."""
    head = commits.agg(F.max("ts").alias("head"))
    rows = commits.crossJoin(F.broadcast(head))  # one row
    recent = F.col("ts") >= F.col("head") - F.expr(f"interval {WINDOW_DAYS} days")
    new = F.max("head") < F.min("ts") + F.expr(f"interval {NEW_DAYS} days")
    return rows.groupBy("file").agg(F.sum(F.when(recent, F.col("adds") + F.col("dels")).otherwise(0)).alias("churn"), new.alias("is_new"))


@query(
    "fan_in_out",
    RELATIONS,
    SUPPRESSED_SQL
    + """, universe as (select * from nodes where kind = 'CodeSymbol' and eligible and not stale and external_id not in (select id from direct) and external_id not in (select id from suppressed)),
    sizes as (select file, count(*) as n from universe group by file), imports as (select to_id as file, count(*) as n from edges where type = 'IMPORTS' group by to_id), calls_in as (select to_id as id, count(*) as n from edges where type = 'CALLS' group by to_id), calls_out as (select from_id as id, count(distinct to_id) as n from edges where type = 'CALLS' group by from_id)
    select u.external_id as id, floor((coalesce(c.n, 0) + coalesce(i.n::double / s.n, 0)) * 10 + 0.5) / 10 as refs, coalesce(o.n, 0) as fan_out from universe u join sizes s using (file) left join imports i using (file) left join calls_in c on c.id = u.external_id left join calls_out o on o.id = u.external_id""",
)
def _fan(g: Graph) -> DataFrame:
    return references(untested(g.nodes, g.edges, g.ledger), g.edges).withColumn("refs", round_half_up(F.col("refs"), 1))


@query(
    "churn_attribution",
    ("nodes", "commits"),
    """, head as (select max(ts) as head from commits), churned as (select file, sum(case when ts >= head - interval 180 days then adds + dels else 0 end) as churn from commits, head group by file),
    live as (select external_id as id, file, greatest(end_line - start_line + 1, 1) as span from nodes where kind = 'CodeSymbol' and eligible and not stale), totals as (select file, sum(span) as total from live group by file)
    select id, floor(coalesce(churn, 0) * (span::double / total) + 0.5)::bigint as churn from live join totals using (file) left join churned using (file)""",
)
def _churn(g: Graph) -> DataFrame:
    live = denominator(g.nodes).where("kind = 'CodeSymbol'").withColumn("span", F.col("end_line") - F.col("start_line") + 1)
    return attributed(live, file_churn(g.commits)).select(F.col("external_id").alias("id"), F.floor(F.col("own_churn") + 0.5).alias("churn"))


def attributed(symbols: DataFrame, churn: DataFrame) -> DataFrame:
    """A file's churn dealt out to its symbols by their line spans."""
    totals = symbols.groupBy("file").agg(F.sum(F.greatest("span", F.lit(1))).alias("total"))
    rows = symbols.join(totals, "file").join(churn, "file", "left")
    return rows.withColumn("own_churn", F.coalesce("churn", F.lit(0)) * (F.greatest("span", F.lit(1)) / F.col("total")))


def stretched(rows: DataFrame, *columns: str) -> DataFrame:
    """Each column on 1 to 10 between its least and greatest value; 5 when they are equal."""
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    out = rows.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        low, high = F.col(f"low_{c}"), F.col(f"high_{c}")
        out = out.withColumn(c, F.when(low == high, 5.0).otherwise(1 + ((F.col(c) - low) / (high - low)) * 9))
    return out.drop(*ends.columns)


#: Concerns in their order (fixed values).
CONCERNS = ["contract", "authorization_safety", "boundary_limits", "integration_flow", "state_lifecycle", "failure_recovery", "data_integrity", "concurrency_ordering"]


def applicable_concerns(title: Column, file: Column, sensitive: Column, entry: Column, flow_position: Column, fan_out: Column, churn: Column) -> Column:
    """What tests of a symbol should look at, from the parts of its score."""
    verb = title.rlike(r"(?i)^(GET|POST|PUT|PATCH|DELETE)\s+.+$")
    holds = [F.lit(True), sensitive >= 9, entry | verb, (flow_position >= 3) | (fan_out >= 1), (fan_out >= 1) & (churn > 0), fan_out >= 2, sensitive >= 6, F.concat_ws(" ", title, file).rlike("(?i)job|queue|cron|stream|lock|worker")]
    return F.array_compact(F.array(*[F.when(h, c) for c, h in zip(CONCERNS, holds)]))


def risk_rows(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, ledger: DataFrame, commits: DataFrame) -> DataFrame:
    """Every untested symbol with its score and what it is made of. The leads and the rows that are stretched between their own ends
    are written, so that no plan holds all that they are made of, and that twice over."""
    symbols = shared(untested(nodes, edges, ledger))
    depth = shared(flow_depth(symbols, edges, shared(entries(nodes))))
    rows = attributed(symbols, file_churn(commits)).withColumnRenamed("external_id", "id").join(references(symbols, edges), "id").join(depth, "id")
    rows = marked(rows, confirming_tests(nodes, edges).select("id").distinct(), "static", "id")
    rows = marked(rows, unbroadcast(stored(candidate_signals(candidates).select("id").distinct(), "leads")), "lead", "id")
    file, title = F.col("file"), F.coalesce("title", "id")
    rows = rows.withColumn("difficulty", F.when(F.col("static"), 5).when(F.col("lead"), 8).otherwise(10))
    rows = rows.withColumn("route_weight", route_weight(file, title)).withColumn("sensitivity", sensitivity(F.concat_ws(" ", "id", file, title)))
    rows = rows.withColumn("is_new", F.coalesce("is_new", F.lit(False))).withColumn("flow_position", F.greatest(F.lit(0), 5 - F.col("depth")))
    rows = rows.withColumn("p", F.col("own_churn") * 0.35 + F.col("fan_out") * 0.3 + F.when(F.col("is_new"), 15).otherwise(0) + F.col("span") * 0.2)
    rows = rows.withColumn("i", F.col("refs") * 0.3 + F.col("route_weight") * 0.3 + F.col("flow_position") * 0.2 + F.col("sensitivity") * 0.2)
    scored = stretched(stored(rows, "rows"), "p", "i")
    score = F.floor(F.col("p") * F.col("i") * F.col("difficulty") * 10 + 0.5) / 10
    lone = (round_half_up(F.col("refs"), 1) == 0) & (F.col("fan_out") == 0)
    scored = scored.withColumn("score", F.when(lone, F.floor(score * 0.25 * 10 + 0.5) / 10).otherwise(score)).withColumn("disconnected", lone)
    scored = scored.withColumn("entry_point", entry_point(file, title))
    concerns = applicable_concerns(title, file, F.col("sensitivity"), F.col("entry_point"), F.col("flow_position"), F.col("fan_out"), F.floor(F.col("own_churn") + 0.5))
    return scored.select("id", title.alias("title"), "file", "score", round_half_up(F.col("refs"), 1).alias("refs"), F.floor(F.col("own_churn") + 0.5).alias("churn"), "entry_point", F.floor(F.col("p") + 0.5).alias("probability"), F.floor(F.col("i") + 0.5).alias("impact"), F.col("difficulty").cast("long").alias("difficulty"), F.col("fan_out").cast("long").alias("fan_out"), F.col("route_weight").cast("long").alias("route_weight"), F.col("sensitivity").cast("long").alias("sensitivity"), F.col("flow_position").cast("long").alias("flow_position"), F.array_join(concerns, ", ").alias("concerns"))


def by_risk(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.desc("refs"), F.desc("churn"), "id")


def rank_risks(g: Graph, limit: int = 20) -> DataFrame:
    g.settle("symbols", "tests", "calls", "nodes", "edges", "commits")
    return by_risk(risk_rows(g.nodes, g.edges, g.candidates, g.ledger, g.commits)).limit(limit)


RISK_SQL = (
    ENTRY_SQL
    + SUPPRESSED_SQL
    + CONFIRM_SQL
    + """, universe as (select external_id as id, coalesce(title, external_id) as title, file, end_line - start_line + 1 as span from nodes where kind = 'CodeSymbol' and eligible and not stale and external_id not in (select id from direct) and external_id not in (select id from suppressed)),
    pairs as (select distinct from_id as caller, to_id as callee from edges where type = 'CALLS'),
    walk(id, node, depth) as (select s.id, c.caller, 1 from universe s join pairs c on c.callee = s.id where s.id not in (select id from entries) union select w.id, c.caller, w.depth + 1 from walk w join pairs c on c.callee = w.node where w.depth < 6),
    first_seen as (select id, node, min(depth) as depth from walk group by id, node), hits as (select f.id, min(f.depth) as depth from first_seen f join entries e on e.id = f.node group by f.id), deepest as (select id, max(depth) as depth from first_seen group by id),
    head as (select max(ts) as head from commits), churned as (select file, sum(case when ts >= head - interval 180 days then adds + dels else 0 end) as churn, epoch(max(head)) - epoch(min(ts)) < 30 * 86400 as is_new from commits, head group by file),
    sizes as (select file, count(*) as n, sum(greatest(span, 1)) as total from universe group by file), imports as (select to_id as file, count(*) as n from edges where type = 'IMPORTS' group by to_id), calls_in as (select to_id as id, count(*) as n from edges where type = 'CALLS' group by to_id), calls_out as (select caller as id, count(*) as n from pairs group by caller),
    leads as (select from_id as id from candidates where type <> 'MAY_CALL' and not ai_suggested union select to_id from candidates where type <> 'MAY_CALL' and not ai_suggested),
    pieces as (select u.*, coalesce(c.churn, 0) * (greatest(u.span, 1)::double / s.total) as own_churn, coalesce(c.is_new, false) as is_new, coalesce(ci.n, 0) + coalesce(i.n::double / s.n, 0.0::double) as refs, coalesce(co.n, 0) as fan_out,
        case when u.id in (select id from entries) then 0 else coalesce(h.depth, d.depth, 0) end as depth, case when u.id in (select id from confirming) then 5 when u.id in (select id from leads) then 8 else 10 end as difficulty,
        case when u.id in (select id from entries) or regexp_matches(u.file, '(^|/)(services?|controllers?|handlers?|modules?)/') then 4 else 2 end as route_weight, 1 as sensitivity
        from universe u join sizes s using (file) left join churned c using (file) left join imports i using (file) left join calls_in ci on ci.id = u.id left join calls_out co on co.id = u.id left join hits h on h.id = u.id left join deepest d on d.id = u.id),
    raws as (select *, greatest(0, 5 - depth) as flow_position, own_churn * 0.35::double + fan_out * 0.3::double + case when is_new then 15 else 0 end + span * 0.2::double as rp, refs * 0.3::double + route_weight * 0.3::double + greatest(0, 5 - depth) * 0.2::double + sensitivity * 0.2::double as ri from pieces),
    ends as (select min(rp) as lp, max(rp) as hp, min(ri) as li, max(ri) as hi from raws),
    normal as (select *, case when lp = hp then 5.0::double else 1 + ((rp - lp) / (hp - lp)) * 9 end as p, case when li = hi then 5.0::double else 1 + ((ri - li) / (hi - li)) * 9 end as i from raws, ends),
    risk as (select id, title, file, floor((case when floor(refs * 10 + 0.5) / 10 = 0 and fan_out = 0 then floor(p * i * difficulty * 10 + 0.5) / 10 * 0.25::double else floor(p * i * difficulty * 10 + 0.5) / 10 end) * 10 + 0.5) / 10 as score, floor(refs * 10 + 0.5) / 10 as refs, floor(own_churn + 0.5)::bigint as churn, id in (select id from entries) as entry_point,
        floor(p + 0.5)::bigint as probability, floor(i + 0.5)::bigint as impact, difficulty::bigint as difficulty, fan_out, route_weight::bigint as route_weight, sensitivity::bigint as sensitivity, flow_position::bigint as flow_position,
        concat_ws(', ', 'contract', case when sensitivity >= 9 then 'authorization_safety' end, case when id in (select id from entries) or regexp_matches(title, '(?i)^(GET|POST|PUT|PATCH|DELETE)\\s+.+$') then 'boundary_limits' end, case when flow_position >= 3 or fan_out >= 1 then 'integration_flow' end,
        case when fan_out >= 1 and floor(own_churn + 0.5) > 0 then 'state_lifecycle' end, case when fan_out >= 2 then 'failure_recovery' end, case when sensitivity >= 6 then 'data_integrity' end, case when regexp_matches(title || ' ' || file, '(?i)job|queue|cron|stream|lock|worker') then 'concurrency_ordering' end) as concerns from normal)"""
)


_SAID = "list_filter(regexp_split_to_array(lower(regexp_replace(path || ' ' || name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_HAS = lambda words: f"list_has_any(w, [{', '.join(map(quoted, words))}])"
_HTTP = "regexp_matches(name, '(?i)^(GET|POST|PUT|PATCH|DELETE)$') and regexp_matches(path, '(?i)(^|/)api(s)?/')"
_ENTRY = f"({any_sql('path', [ENTRY_PATH, ENTRY_FILE])} or {any_sql("path || '#' || name", [ENTRY_NAME])} or ({any_sql('name', [API_NAME])} and {any_sql('path', [API_PATH])}))"


@query(
    "risk_weights",
    "source_symbols",
    f"""select k, path, name, {first_sql([(f"{_HAS(SENSITIVE[0][1])} or (list_contains(w, 'capture') and {_HAS(['payment', 'stripe', 'transaction'])})", "10"), *[(_HAS(words), str(n)) for n, words in SENSITIVE[1:]]], "1")} as sensitivity,
    case when {_HTTP} and regexp_matches(path, '(?i)/store(/|\\b)') then case upper(name) when 'POST' then 10 when 'DELETE' then 9 when 'PUT' then 8 when 'GET' then 5 else 7 end when {_HTTP} and regexp_matches(path, '(?i)/admin(/|\\b)') then case upper(name) when 'POST' then 6 when 'GET' then 3 else 5 end
        when {_ENTRY} then 4 when regexp_matches(path, '(?i)(^|/)(services?|controllers?|handlers?|modules?)/') then 4 else 2 end as route_weight, {_ENTRY} as entry_point from (select *, {_SAID} as w from source_symbols) x""",
)
def _weights(g: Graph) -> DataFrame:
    """The parts of a score that depend on words: sensitivity, route and entry."""
    path, name = F.col("path"), F.col("name")
    return g.source_symbols.select("k", "path", "name", sensitivity(F.concat_ws(" ", path, name)).alias("sensitivity"), route_weight(path, name).alias("route_weight"), entry_point(path, name).alias("entry_point"))


@query("risk_rows", RELATIONS, RISK_SQL + " select * from risk")
def _risk_rows(g: Graph) -> DataFrame:
    g.settle("symbols", "tests", "calls", "nodes", "edges", "commits")
    return risk_rows(g.nodes, g.edges, g.candidates, g.ledger, g.commits)


@query("risk_ranking", RELATIONS, RISK_SQL + " select * from risk order by score desc, refs desc, churn desc, id limit 20")
def _risk_ranking(g: Graph) -> DataFrame:
    return rank_risks(g)


@query("legacy_risk", RELATIONS, RISK_SQL + ", whole as (select file, sum(case when ts >= head - interval 180 days then adds + dels else 0 end) as churn from commits, head group by file) select p.id, floor((p.refs * 0.4::double + least(coalesce(w.churn, 0), 500) * 0.4::double + case when p.id in (select id from entries) then 20 else 0 end) * 10 + 0.5) / 10 as score from pieces p left join whole w using (file)")
def _legacy(g: Graph) -> DataFrame:
    g.settle("symbols", "tests", "calls", "nodes", "edges", "commits")
    symbols = untested(g.nodes, g.edges, g.ledger)
    rows = symbols.withColumnRenamed("external_id", "id").join(references(symbols, g.edges), "id").join(file_churn(g.commits), "file", "left")
    entry = F.when(entry_point(F.col("file"), F.coalesce("title", "id")), 20).otherwise(0)
    return rows.select("id", round_half_up(F.col("refs") * 0.4 + F.least(F.coalesce("churn", F.lit(0)), F.lit(500)) * 0.4 + entry, 1).alias("score"))


def portfolio(rows, limit: int = 20, per_file: int = 3, per_title: int = 1) -> list:
    """Greedy choice from rows in rank order under two caps; what fills up may break the cap of files alone.

    Reads on only until ``limit`` rows are found, and holds back no more rows than it can still use."""
    files: dict = {}
    titles: dict = {}
    taken, held, waiting = [], [], {}
    for r in rows:
        title = (r.title or "").split("(")[0].strip()
        if files.get(r.file, 0) < per_file and titles.get(title, 0) < per_title:
            files[r.file], titles[title] = files.get(r.file, 0) + 1, titles.get(title, 0) + 1
            taken.append(r)
        elif waiting.get(title, 0) < per_title and len(held) < 2 * limit * per_title:
            waiting[title] = waiting.get(title, 0) + 1
            held.append((title, r))
        if len(taken) >= limit:
            break
    for title, r in held:
        if len(taken) >= limit:
            break
        if titles.get(title, 0) < per_title:
            titles[title] = titles.get(title, 0) + 1
            taken.append(r)
    return sorted(taken, key=lambda r: (-r.score, -r.refs, -r.churn, r.id))


def contenders(rows: DataFrame, limit: int = 20, per_file: int = 3, per_title: int = 1) -> DataFrame:
    """The rows that ``portfolio`` can choose: of each file and title the first ``per_title``, and of each title as many
    as there can be files that are full, and ``per_title`` more. Both limits hold before the shuffle, too."""
    rank = [F.desc("score"), F.desc("refs"), F.desc("churn"), F.col("id")]
    key = F.trim(F.substring_index(F.coalesce("title", F.lit("")), "(", 1))
    one = Window.partitionBy("file", "title_key").orderBy(*rank)
    kept = rows.withColumn("title_key", key).withColumn("n", F.row_number().over(one)).where(F.col("n") <= per_title)
    few = Window.partitionBy("title_key").orderBy(*rank)
    return kept.withColumn("n", F.row_number().over(few)).where(F.col("n") <= limit // per_file + per_title).drop("n", "title_key")


@query("risk_portfolio")
def _portfolio(g: Graph) -> DataFrame:
    g.settle("symbols", "tests", "calls", "nodes", "edges", "commits")
    rows = risk_rows(g.nodes, g.edges, g.candidates, g.ledger, g.commits)
    return g.spark.createDataFrame(portfolio(by_risk(contenders(rows)).toLocalIterator()), rows.schema)


__all__ = ["API_NAME", "rank_risks", "risk_rows"]
