"""Every query with SQL against DuckDB on the smallest tables, and rules that the tables don't show."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evidencia import catalogue
from evidencia.functions import expressions as X
from evidencia.operators import evidence, graphs, merge, text
from evidencia.plans import risk
from evidencia.sources.driver_tables import TABLES, Graph
from evidencia.streaming import telemetry
from scripts.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    assert compare(catalogue.queries()[name](spark, SMALL), db.execute(catalogue.oracle_sql()[name])) == ""


def test_rounding_is_on_the_binary_double(spark):
    row = spark.range(1).select(X.round_half_up(F.lit(0.285), 2).alias("a"), X.round_half_up(F.lit(-0.5)).alias("b"), X.percent(F.lit(1), F.lit(0)).alias("c"), X.percent_or_null(F.lit(1), F.lit(0)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (0.28, 0.0, 0.0, None)


def test_names_routes_and_cells(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    lit = F.lit
    assert one(X.slug(lit("  Ünï Code! x "))) == "n-code-x" and one(X.slug(lit("!!"))) == "item"
    assert one(X.route(lit("/a/[id]/[...rest]/"))) == "/a/:id/:rest*" and one(X.route(lit(""))) == "/"
    assert sorted(one(X.tokens(lit("getUserName the for a b2b_test apiRoute")))) == ["b2b", "for", "get", "name", "the", "user"]
    assert one(X.csv_cell(lit("=1+1"))) == "'=1+1" and one(X.csv_cell(lit('a"b'))) == '"a""b"'
    assert [one(X.priority_rank(lit(p))) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "P0", "xp0", None)] == [0, 3, 2, 1, 4, 0, 0]
    assert one(X.clamp_confidence(lit(float("nan")))) == 0.5 and one(X.bucket(lit(7), [5, 10])) == "5-9" and one(X.bucket(lit(1), [5, 10])) == "1-4" and one(X.bucket(lit(10), [5, 10])) == "10+"
    assert one(X.short_hash(lit("a"), lit(None).cast("string"))) is not None


def test_redaction_leaves_no_secret(spark):
    secrets = ["sk-ant-" + "a" * 20, "sk-" + "b" * 24, "ghp_" + "c" * 24, "AKIA" + "D" * 16, "xoxb-" + "1" * 12, "password = hunter2hunter2", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"]
    rows = spark.createDataFrame([(s,) for s in secrets], "t string").select(text.redact(F.col("t")).alias("t"), text.has_secret(F.col("t")).alias("had")).select("t", "had", text.has_secret(F.col("t")).alias("left")).collect()
    assert all(r.had and not r.left and "<redacted:" in r.t for r in rows)


def test_merge_is_idempotent_and_order_free(spark):
    g = Graph(spark, SMALL)
    rows = merge.fragments(g)
    once = merge.dedup_nodes(rows)
    again = merge.dedup_nodes(once)
    mixed = merge.dedup_nodes(rows.orderBy(F.rand(3)))
    plain = lambda df: sorted(map(tuple, df.select("external_id", "ord", "title", "confidence").collect()))
    assert plain(once) == plain(again) == plain(mixed)


def test_depth_of_unreachable_symbols_counts_levels(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("x", "y", "CALLS"), ("y", "x", "CALLS"), ("z", "x", "CALLS")], "from_id string, to_id string, type string")
    symbols = spark.createDataFrame([(s,) for s in "abcxyz"] + [("alone",)], "external_id string")
    entry = spark.createDataFrame([("a",)], "id string")
    found = {r.id: r.depth for r in graphs.flow_depth(symbols, edges, entry).collect()}
    assert found["a"] == 0 and found["b"] == 1 and found["c"] == 2 and found["alone"] == 0 and found["z"] == 0
    assert found["x"] == 2 and found["y"] == 2


def test_paths_are_simple_and_end_where_no_call_goes_on(spark):
    edges = spark.createDataFrame([("a", "b", "hard"), ("b", "a", "hard"), ("b", "c", "framework-derived"), ("a", "c", "hard")], "caller string, callee string, strength string")
    ranked = graphs.ranked_entries(spark.createDataFrame([("a", "Behavior", ""), ("z", "Behavior", "")], "id string, kind string, title string"), edges)
    assert {r.id: r.score for r in ranked.collect()} == {"a": 20.0, "z": 0.0}
    found = {r.path: (r.tier, r.truncated, r.depth) for r in graphs.flow_paths(ranked, edges).collect()}
    assert found == {"a>b>c": ("framework-derived: reachable", False, 2), "a>c": ("hard: reachable", False, 1)}


def test_paths_keep_to_their_caps(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MOST_OF_ENTRY", 3)
    monkeypatch.setattr(graphs, "MOST_CALLS", 2)
    edges = spark.createDataFrame([("a", f"b{i}", "hard") for i in range(5)] + [(f"b{i}", f"c{j}", "hard") for i in range(5) for j in range(2)] + [("c0", "d", "hard")], "caller string, callee string, strength string")
    ranked = graphs.ranked_entries(spark.createDataFrame([("a", "Behavior", "")], "id string, kind string, title string"), edges)
    found = sorted((r.path, r.truncated) for r in graphs.flow_paths(ranked, edges).collect())
    assert found == [("a>b0>c0", True), ("a>b0>c1", True), ("a>b1>c0", True)]


def test_components_of_a_long_chain_and_shuffled_links(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("p", "q")]
    random.Random(1).shuffle(pairs)
    found = {r.id: r.component for r in graphs.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert set(found.values()) == {"n000", "p"} and len(found) == 61


def test_portfolio_caps(spark):
    rows = spark.createDataFrame([(i, f"f{i % 2}", f"t{i % 5}", float(100 - i), 0.0, 0) for i in range(40)], "id long, file string, title string, score double, refs double, churn long").collect()
    got = risk.portfolio(rows, limit=5, per_file=2, per_title=1)
    assert [r.id for r in got] == [0, 1, 2, 3, 4]
    assert len(risk.portfolio(rows, limit=20, per_file=1, per_title=1)) == 5


def test_empty_graph(spark):
    g = Graph(spark, SMALL)
    nodes, edges, candidates = g.nodes.limit(0), g.edges.limit(0), g.candidates.limit(0)
    assert evidence.denominator_composition(nodes).first().total == 0
    assert evidence.rank_gaps(nodes, edges, candidates).count() == 0
    score = evidence.readiness_score(nodes, edges, candidates).first()
    assert score.band == "thin" and score.overall == 0


def test_hourly_stream_equals_batch(spark, tmp_path):
    pings = Graph(spark, SMALL).pings.limit(300).withColumn("ts", F.col("ts").cast("timestamp"))
    pings.coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    q = telemetry.hourly_stream(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(spark.table("hourly")) == plain(telemetry.hourly(stored))


def test_file_scan_ignores_and_hashes(spark, tmp_path):
    from evidencia.sources.files import scan_files

    for name in ("a.ts", "src/b.ts", "node_modules/c.ts", "src/gen/d.ts", "src/e.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = {r.rel_path: r.hash for r in scan_files(spark, str(tmp_path), ["src/gen", "*.log"]).collect()}
    assert set(rows) == {"a.ts", "src/b.ts"} and len(set(rows.values())) == 2


def test_pack_leaves_out_imports_and_secrets(spark, tmp_path):
    from evidencia.sources.files import export_pack

    g = Graph(spark, SMALL)
    nodes = g.nodes.limit(5).withColumn("title", F.lit("ghp_" + "a" * 24))
    export_pack(nodes, g.edges, str(tmp_path))
    assert {r.title for r in spark.read.json(f"{tmp_path}/entities").collect()} == {"<redacted:github-token>"}
    assert not {r.type for r in spark.read.json(f"{tmp_path}/relationships").collect()} & {"IMPORTS"}


def test_markdown_lines_skip_fences(spark):
    rows = text.markdown_lines(spark.createDataFrame([(1, "# A\n```\n# no\n```\n- x\n## B #\n* y")], "id long, text string")).where("bullet is not null").orderBy("line").collect()
    assert [(r.under, r.bullet) for r in rows] == [("A", "x"), ("B", "y")]
