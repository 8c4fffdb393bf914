"""Steps whose work once grew faster than their input."""

from pyspark.sql import functions as F

from evidencia import lineage
from evidencia.operators import barrels, calls, coverage, selection, symbols, text
from evidencia.plans import flows
from evidencia.sources.driver_tables import RUN, Graph, numbered

DIR = "/root/testdata/sf0.001"


def test_places_across_runs(spark):
    keys = [5 * RUN, 3, RUN, RUN - 1, 2, 5 * RUN + 1]
    rows = numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.n)] == sorted(keys) and sorted(r.n for r in rows) == [1, 2, 3, 4, 5, 6]


def test_endpoints_meet_symbols_by_equal_keys(spark):
    found = Graph(spark, DIR).endpoints
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner, " in line and "%" in line]


def test_equal_stars_are_one_step_and_count_as_many(spark, monkeypatch):
    most, plain = [0], barrels.cut

    def counted(df):
        rows = plain(df)
        most[0] = max(most[0], rows.count())
        return rows

    monkeypatch.setattr(barrels, "cut", counted)
    star = lambda path, n: [(path, "star", None, None, "./next", None, False, p) for p in range(n)]
    index = star("a", 100) + star("b", 100) + star("c", 30) + star("d", 30) + [("e", "local", "x", "function", None, None, False, 0)]
    index = spark.createDataFrame(index, "path string, entry string, name string, kind string, specifier string, source string, of_type boolean, place int")
    targets = spark.createDataFrame([("a", "./next", "b"), ("b", "./next", "e"), ("c", "./next", "d"), ("d", "./next", "e")], "path string, specifier string, target string")
    starts = spark.createDataFrame([("a", "x"), ("c", "x")], "file string, binding string")
    found = {r.file: (r.status, r.depth, r.terminal_file) for r in barrels.walk_barrels(starts, index, targets).collect()}
    assert found == {"a": ("budget-exhausted", 0, None), "c": ("terminal", 2, "e")}  # 1 + 100 + 10,000 steps and 1 + 30 + 900
    assert most[0] < 50


def test_calls_and_symbols_beyond_the_caps_of_a_file(spark):
    code = "export function a(x) {\n" + "  b();\n" * 2100 + "}\n" + "".join(f"export function f{i}() {{\n  a();\n}}\n" for i in range(1100))
    sources = spark.createDataFrame([("src/a.ts", code)], "path string, content string")
    found = calls.raw_calls(sources, capped=False).groupBy("caller", "callee").count().collect()
    assert {(r.caller, r.callee): r["count"] for r in found} == {("a", "b"): 2100} | {(f"f{i}", "a"): 1 for i in range(1100)}
    assert calls.raw_calls(sources).count() == 2000
    assert calls.script_symbols(sources, capped=False).count() == 1101 and calls.script_symbols(sources).count() == 1000
    python = spark.createDataFrame([("a.py", "".join(f"def f{i}():\n    pass\n" for i in range(1100)))], "path string, content string")
    assert symbols.pattern_symbols(python, capped=False).count() == 1100 and symbols.pattern_symbols(python).count() == 1000


def test_spans_and_ranges_never_meet_in_pairs(spark):
    symbols = spark.createDataFrame([(f"s{i}", "a.ts", i, i + 2) for i in range(1, 400)] + [("t", "a.ts", 1000, 1001), ("u", "b.ts", 9, 9), ("v", "b.ts", None, 9)], "external_id string, file string, start_line int, end_line int")
    ranges = spark.createDataFrame([("a.ts", i, i + 40, "lcov") for i in range(1, 300)] + [("a.ts", 1001, 1005, "go"), ("b.ts", 1, 8, "go"), ("b.ts", 9, 9, "lcov"), ("b.ts", 10, 20, "go")], "file string, start_line int, end_line int, format string")
    found = coverage.overlaps(symbols, ranges)
    assert {(r.external_id, tuple(r.formats)) for r in found.collect()} == {(f"s{i}", ("lcov",)) for i in range(1, 340)} | {("t", ("go",)), ("u", ("lcov",))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and "<=" in line] and "explode" not in plan


def test_files_that_belong_together_are_not_grouped_as_pairs(spark):
    nodes = spark.createDataFrame([("s", "CodeSymbol", "a.ts", True, False), ("t", "CodeSymbol", "a.ts", True, False)] + [(f"x{i}", "TestCase", f"x{i}.ts", False, False) for i in range(3)], "external_id string, kind string, file string, eligible boolean, stale boolean")
    edges = spark.createDataFrame([("s", "x0", "TESTED_BY", 1)], "from_id string, to_id string, type string, ord long")
    candidates = spark.createDataFrame([("s", "x1", "MAY_COVER", 1, False), ("s", "x0", "MAY_COVER", 1, False), ("t", "x0", "MAY_COVER", 2, True)], "from_id string, to_id string, type string, ord long, ai_suggested boolean")
    links = spark.createDataFrame([("a.ts", f"x{i}.ts", k) for i in range(3) for k in ("stem", "import")], "code_file string, test_file string, kind string")
    strict = spark.createDataFrame([("s", "a.ts"), ("t", "a.ts")], "id string, file string")
    found = coverage.associated_tests(nodes, edges, candidates, links, strict)
    assert {tuple(r) for r in found.collect()} == {("s", "x0.ts", True, 0), ("s", "x1.ts", False, 1), ("s", "x2.ts", False, 2), ("t", "x0.ts", False, 2), ("t", "x1.ts", False, 2), ("t", "x2.ts", False, 2)}
    assert found.count() == 6
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # the pairs of files are given out as they are made


def test_symbols_that_score_alike_are_weighed_once(spark, monkeypatch):
    seen, plain = [], text.shortlist_of
    monkeypatch.setattr(text, "shortlist_of", lambda b, s, top: seen.append(s.count()) or plain(b, s, top))
    behaviors = spark.createDataFrame([(f"REQ {w}", f"{w} order", "Requirement", "src/a/x.md", [f"{w} expected"]) for w in ("green", "getUser", "blue")], "id string, title string, kind string, source_ref string, criteria array<string>")
    symbols = spark.createDataFrame([(f"sym:{f}#fn{n}", t, f, "function") for n, (t, f) in enumerate((t, f) for _ in range(60) for t in ("green", "getUser", "pale blue", None) for f in ("src/a/b.ts", "lib/c.ts"))], "id string, title string, file string, detail string")
    shown = lambda rows: {tuple(r) for r in rows.select("b_id", "s_id", "score").collect()}
    found = text.shortlist(behaviors, symbols, 5)
    assert shown(found) == shown(plain(behaviors, symbols, 5)) and found.count() == 15
    assert seen == [8]  # of 480 symbols


def test_kinds_are_worked_out_for_the_first_targets_alone(spark):
    seen = spark.sparkContext.accumulator(0)

    def kinds(k):
        seen.add(1)
        return [] if k < 30 and k % 2 else ["a", "b"]

    targets = spark.range(4000).select(F.col("id").alias("target_pos"), F.udf(kinds, "array<string>")("id").alias("buckets"), (F.col("id") < 2).alias("thin"))
    assert [tuple(r)[0] for r in selection.bucket_plan(targets, 20, True).collect()] == [*range(2, 30, 2), *range(30, 36)]
    assert [tuple(r) for r in selection.bucket_plan(targets, 2, False).collect()] == [(2, 0, "a"), (2, 1, "b")]
    assert seen.value < 500
    few = targets.where("target_pos < 6")
    assert [tuple(r) for r in selection.bucket_plan(few, 20, True).collect()] == [(2, 0, "a"), (4, 0, "a"), (2, 1, "b"), (4, 1, "b")]


def test_no_task_ranks_all_owners(spark):
    found = Graph(spark, DIR).owner_risks
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "row_number()" in line and "run#" not in line]
    ranks = [r.rank for r in found.orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))


def test_generated_tests_are_not_sorted_by_their_targets(spark):
    g = Graph(spark, DIR)
    stale, cited = (f(g)._jdf.queryExecution().executedPlan().toString() for f in (coverage._stale, coverage._citations))
    assert all("ShuffledHashJoin [entity_id" in p and "Sort [entity_id" not in p for p in (stale, cited))
    assert stale.index("HashAggregate(keys=[test_id") < stale.index("Exchange hashpartitioning(test_id") < stale.index("ShuffledHashJoin") and stale.count("HashAggregate(keys=[test_id", stale.index("Exchange hashpartitioning(test_id")) == 0


def test_entries_are_ranked_from_written_tables_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MANY", 0)
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    read = lambda rows: [line for line in plan(rows).splitlines() if "Relation [" in line or "LogicalRDD" in line]
    seen, plain = [], flows.Flows
    monkeypatch.setattr(flows, "Flows", lambda g: seen.append(plain(g)) or seen[-1])
    assert len(read(flows._entry_ranking(Graph(spark, DIR)))) == 1
    assert len(read(seen[0].calls)) == 1
    joins = [line for line in plan(seen[0].ranked).splitlines() if "Join " in line]
    assert len(joins) > 3 and not [line for line in joins if "strategy=merge" not in line]
