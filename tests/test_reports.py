"""Proof doctor, system map, answers of models, endpoint entries and shortlists: inputs and wanted results by hand."""

import random

from pyspark.sql import functions as F

from evidencia.operators import answers, graphs, text
from evidencia.plans import doctor, system_map


def test_json_is_recovered_from_answers(spark):
    wanted = {
        'Sure:\n```json\n{"a": 1}\n```\nbye {': '{"a": 1}',
        "```\n [1, 2] \n```": "[1, 2]",
        'text {"a": "} \\" {"} more': '{"a": "} \\" {"}',
        'open { then "x" [1, [2]] end': "[1, [2]]",
        'first [1 then {"b": 2} end': '{"b": 2}',
        "  {already: json} tail": "{already: json} tail",
        "nothing here ": "nothing here",
        'a "quoted { brace" then {"c": [}]}': "[}]",  # the scan starts at the first brace, be it in quotes, and never comes to its end
        "": "",
    }
    rows = spark.createDataFrame([(t, w) for t, w in wanted.items()], "t string, w string").select("t", "w", answers.recovered(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows if r.got != r.w] == []


def test_links_of_answers_are_checked_row_by_row(spark):
    rows = [
        (1, '{"links": [{"behavior_id": "B", "symbol_id": "S", "confidence": 7}, {"behavior_id": "", "symbol_id": "S"}, {"symbol_id": "S"}]}'),
        (2, '[{"behavior_id": "B", "symbol_id": "S", "confidence": -1}, {"behavior_id": "B", "symbol_id": "T"}]'),
        (3, '{"links": ['),
        (4, None),
        (5, "{}"),
    ]
    got = {(r.k, r.place, r.behavior_id, r.symbol_id, r.confidence) for r in answers.recovered_links(spark.createDataFrame(rows, "k long, text string")).collect()}
    assert got == {(1, 0, "B", "S", 1.0), (2, 0, "B", "S", 0.0), (2, 1, "B", "T", 0.5)}


ATTEMPTS = "ord long, target_symbol string, test_path string, classification string, mutant_status string, category string, reason string"


def test_doctor_groups_blockers_and_tells_one_status(spark):
    rows = [(i, f"sym:a{i}", "t", "needs_setup", None, "module_not_found", "no x") for i in range(7)]
    rows += [(10, "sym:b", "t", "needs_setup", None, "logic_failure", None), (11, "sym:c", "t", "needs_setup", None, "db_or_external", "Runner binary not found"), (12, "sym:d", "t", "needs_setup", None, None, "test appears more than once"), (13, "sym:e", "t", "needs_setup", None, "nonsense", "build.gradle is gone")]
    rows += [(20, "sym:f", "t", "non_killing", None, None, None), (21, "sym:f", "t", "non_killing", "survived", None, None), (22, "sym:g", None, "non_killing", "survived", None, None), (23, "sym:h", "t", "proven", None, None, None)]
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    blockers = doctor.attempt_blockers(attempts)
    got = [(r.category, r.n, list(r.targets), r.target_symbol) for r in blockers.collect()]
    assert got == [("module_not_found", 7, [f"sym:a{i}" for i in range(5)], "sym:a0"), ("setup_failed", 1, ["sym:b"], "sym:b"), ("runner_missing", 1, ["sym:c"], "sym:c"), ("assertion_binding", 1, ["sym:d"], "sym:d"), ("module_root_missing", 1, ["sym:e"], "sym:e")]
    ledger = spark.createDataFrame([("sym:f", 1, "survived"), ("sym:f", 2, doctor.NOT_ASSERTED), ("sym:f", 3, None)], "target_symbol string, ord long, mutant_status string")
    left = doctor.survivors(attempts, ledger)
    assert {(r.target_symbol, r.test_path, r.mutant_status, r.note) for r in left.collect()} == {("sym:f", "t", doctor.NOT_ASSERTED, "the test failed by an error, not by an assertion"), ("sym:g", None, "survived", "the mutant survived")}
    count = lambda proven: spark.createDataFrame([(proven, 9)], "proven long, denominator long")
    status = lambda b, s, proven, fresh=True: tuple(doctor.doctor_status(b, s, count(proven), fresh).first())[:2]
    assert status(blockers, left, 0) == ("blocked", f"none proven: one cause blocked 7 targets: {doctor.LABELS['module_not_found']}")
    assert status(blockers, left, 2)[0] == "proven" and status(blockers, left, 2, fresh=False)[0] == "stale"
    none = doctor.attempt_blockers(attempts.limit(0))
    assert status(none, left, 0) == ("blocked", "none proven: 2 attempts ran and did not close")
    assert status(none, left.limit(0), 0)[0] == "no_data"


def test_blockers_before_any_attempt(spark):
    targets = [(1, "sym:a/x.rb#f"), (2, "sym:go/in/x.go#f"), (3, "sym:lone/x.go#f"), (4, "sym:web/x.ts#f"), (5, "sym:web/new/x.ts#f"), (6, "sym:j/X.java#f"), (7, "REQ-1"), (8, "sym:p/x.py#f")]
    files = spark.createDataFrame([("go/go.mod",), ("web/package.json",)], "path string")
    engines = spark.createDataFrame([("web", "^18"), ("web/new", ">=20")], "dir string, value string")
    found = doctor.preflight(spark.createDataFrame(targets, "ord long, target_symbol string"), files, engines, "v23.5.1")
    assert [(r.category, r.n, list(r.targets), r.source) for r in found.collect()] == [("module_root_missing", 2, ["sym:lone/x.go#f", "sym:j/X.java#f"], "preflight"), ("unsupported_language", 1, ["sym:a/x.rb#f"], "preflight"), ("engine_mismatch", 1, ["sym:web/x.ts#f"], "preflight")]


def test_map_picks_distinctive_owners_and_loses_no_flow(spark):
    r = random.Random(3)
    flows = [(f, f"l{f % 3}", f"Lane {f % 3}", f % 3) for f in range(60)]
    steps = [(f, 1, "entry") for f in range(60)] + [(f, 2, f"s{r.randint(0, 19)}") for f in range(58)] + [(f, 3, "cache") for f in range(60)] + [(5, 4, "rare"), (5, 5, "deep"), (59, 4, "")]
    risks = [(i, f"s{i}", i == 2) for i in range(20)]
    tiers = [("s1", "proven"), ("s1", "none"), ("s2", "odd")]
    services, edges = system_map.system_map(spark.createDataFrame(flows, "flow long, lane string, label string, priority int"), spark.createDataFrame(steps, "flow long, place long, owner string"), spark.createDataFrame(risks, "rank long, owner string, critical boolean"), spark.createDataFrame(tiers, "owner string, tier string"))
    about = {x.flow: x.service for x in system_map.representatives(spark.createDataFrame(flows, "flow long, lane string, label string, priority int"), spark.createDataFrame(steps, "flow long, place long, owner string")).collect()}
    assert about[5] == "deep" and about[58] == "cache" and 59 not in about  # the deepest of equal ones; the last step where all is shared
    rows, drawn = services.collect(), edges.collect()
    assert sum(e.flows for e in drawn) == len(about) == sum(s.flows for s in rows)
    shown = [s for s in rows if not s.service.startswith("rest:")]
    assert 12 <= len(shown) <= 15 and sum(s.hidden for s in rows) >= len(set(about.values())) - len(shown)
    for s in shown:
        assert s.critical == (s.service == "s2") and s.flows == sum(v == s.service for v in about.values())


def test_endpoints_start_where_they_are_implemented(spark):
    nodes = spark.createDataFrame([("e1", "Endpoint", "POST /cart", False), ("e2", "Endpoint", "GET /x", False), ("a", "CodeSymbol", "a", False), ("b", "CodeSymbol", "b", False), ("old", "CodeSymbol", "c", True)], "external_id string, kind string, title string, stale boolean")
    edges = spark.createDataFrame([("e1", "a", "IMPLEMENTED_IN"), ("e1", "b", "IMPLEMENTED_IN"), ("e1", "a", "IMPLEMENTED_IN"), ("e2", "old", "IMPLEMENTED_IN"), ("a", "b", "IMPLEMENTED_IN"), ("e2", "a", "CALLS")], "from_id string, to_id string, type string")
    found = graphs.endpoint_entries(nodes, edges)
    assert sorted((r.id, r.start) for r in found.collect()) == [("e1", "a"), ("e1", "b")]
    calls = spark.createDataFrame([("a", "b", "hard"), ("b", "c", "hard"), ("z", "a", "hard")], "caller string, callee string, strength string")
    own = spark.createDataFrame([("z", "Behavior", "", "z"), ("b", "Behavior", "", "b")], "id string, kind string, title string, start string")
    risk = spark.createDataFrame([("z", 5000.0), ("b", 3.0)], "id string, score double")
    ranked = graphs.ranked_entries(own.unionByName(found), calls, risk)
    assert [(r.id, r.start, r.score) for r in ranked.orderBy(*graphs.entry_order()).collect()] == [("z", "z", 5000.0), ("e1", "a", 1010.0), ("e1", "b", 1010.0), ("b", "b", 10.0)]
    row = graphs.flow_limits(ranked, calls).first()
    assert (row.total_flows, row.dropped_max_depth, row.dropped_global_cap) == (4, 0, 0)


def test_flows_stop_at_their_caps(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MOST_OF_ENTRY", 2)
    monkeypatch.setattr(graphs, "MOST_PATHS", 3)
    calls = spark.createDataFrame([(e, f"{e}{i}", "hard") for e in "pqr" for i in range(3)], "caller string, callee string, strength string")
    ranked = graphs.ranked_entries(spark.createDataFrame([(e, "Behavior", "") for e in "pqrs"], "id string, kind string, title string"), calls)
    assert sorted(r.path for r in graphs.flow_paths(ranked, calls).collect())[:2] == ["p>p0", "p>p1"]
    row = graphs.flow_limits(ranked, calls).first()
    # p and q are walked and stop at their third flow, q's second is beyond the list's end, r isn't walked, s calls nothing
    assert tuple(row) == (3, 0, 0, 2, 2)


def test_shortlists_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(text, "FREQUENT", 4)
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    name = lambda n: " ".join(r.sample(words, n))
    symbols = [(f"sym:src/{r.choice(words)}/f{i % 9}.ts#s{i}", name(2), f"src/{r.choice(words)}/f{i % 9}.ts", "function") for i in range(150)]
    behaviors = [(f"REQ-{i}", name(2), "Requirement", f"src/{r.choice(words)}/docs/{r.choice(words)}.md", [name(1)]) for i in range(12)]
    b, s = spark.createDataFrame(behaviors, "id string, title string, kind string, source_ref string, criteria array<string>"), spark.createDataFrame(symbols, "id string, title string, file string, detail string")
    got = text.shortlist(b, s, 5).groupBy("b_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("score"), "s_id"))).alias("x"))
    monkeypatch.setattr(text, "FREQUENT", 1)  # no word is frequent: every shared word makes a pair
    want = text.shortlist(b, s, 5).groupBy("b_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("score"), "s_id"))).alias("x"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
