"""Files, coverage reports, stored graphs, ledgers and caches."""

import pytest
from pyspark.sql import functions as F

from evidencia.sources import files


def test_scan_reads_rules_and_keeps_to_its_limit(spark, tmp_path):
    for name in ("a.ts", "src/b.ts", "src/b.test.ts", "gen/c.ts", "d.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / ".gitignore").write_text("# comment\n*.log\ngen\n!keep\n.gitignore\n")
    rules = files.read_rules(spark, str(tmp_path))
    rows = {r.rel_path: (r.role, r.language) for r in files.scan_files(spark, str(tmp_path), rules).collect()}
    assert rows == {"a.ts": ("code", "typescript"), "src/b.ts": ("code", "typescript"), "src/b.test.ts": ("test", "typescript")}
    assert [r.rel_path for r in files.scan_files(spark, str(tmp_path), rules, most=2).collect()] == ["a.ts", "src/b.test.ts"]


def test_source_kinds(spark):
    rows = spark.createDataFrame([("a.csv", ""), ("b.MD", ""), ("c.mdx", ""), ("d.txt", "behavior_name,acceptance_criteria"), ("e.txt", "hello"), ("f.ts", "behavior_name,x")], "p string, h string")
    assert [r.k for r in rows.select(files.source_kind(F.col("p"), F.col("h")).alias("k")).collect()] == ["template", "markdown", "markdown", "template", None, None]


def test_coverage_reports_are_found(spark):
    rows = spark.createDataFrame([("coverage/lcov.info",), ("web/coverage/lcov.info",), ("cover.out",), ("src/a.ts",), ("svc/target/site/jacoco/jacoco.xml",), (".coverage",)], "rel_path string")
    got = [(r.path, r.format, r.ingestible) for r in files.coverage_artifacts(rows).collect()]
    assert got == [(".coverage", "coverage-py", False), ("cover.out", "go-coverprofile", True), ("coverage/lcov.info", "lcov", True), ("svc/target/site/jacoco/jacoco.xml", "jacoco", True), ("web/coverage/lcov.info", "lcov", True)]


def test_coverage_paths_are_normalised(spark):
    known = spark.createDataFrame([("src/a.ts",), ("web/src/b.ts",), ("x/lib/c.ts",), ("y/lib/c.ts",), ("x/lib/d.ts",)], "rel_path string")
    cases = {"./src/a.ts": "src/a.ts", "file:///repo/src/a.ts": "src/a.ts", "/repo/src/a.ts": "src/a.ts", "src/b.ts": "web/src/b.ts", "lib/c.ts": None, "lib/d.ts": "x/lib/d.ts", "d.ts": None, "http://x/src/a.ts": None, "src\\a.ts": "src/a.ts", "../src/a.ts": None, "/other/src/a.ts": None}
    ranges = spark.createDataFrame([("web/coverage.info", f, i) for i, f in enumerate(cases)], "artifact string, file string, n int")
    got = {r.n: r.file for r in files.normalised_coverage(ranges, known, "/repo").collect()}
    assert got == {i: w for i, w in enumerate(cases.values()) if w}


def test_graph_round_trip_and_version(spark, tmp_path, monkeypatch):
    nodes = spark.createDataFrame([(1, "a")], "ord long, external_id string")
    files.save_graph({"nodes": nodes}, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g"), ["nodes"])["nodes"].collect() == nodes.collect()
    monkeypatch.setattr(files, "SCHEMA_VERSION", "2")
    with pytest.raises(ValueError):
        files.load_graph(spark, str(tmp_path / "g"), ["nodes"])


def test_ledger_grows_and_numbers_on(spark, tmp_path):
    rows = lambda first: spark.createDataFrame([(i, ["b", "a", "b"]) for i in range(first, first + 2)], "idx long, evidence_ids array<string>")
    files.append_ledger(rows(1), str(tmp_path / "l"))
    files.append_ledger(rows(3), str(tmp_path / "l"))
    got = sorted((r.idx, r.run_id, tuple(r.evidence_ids)) for r in spark.read.parquet(str(tmp_path / "l")).collect())
    assert got == [(i, f"run:{i:06}", ("a", "b")) for i in range(1, 5)]


def test_cache_gives_hits_and_misses(spark):
    found = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h1")], "rel_path string, hash string")
    cache = spark.createDataFrame([("h1", "v1", "x"), ("h1", "v1", "x"), ("h2", "v0", "y"), ("h9", "v1", "z")], "hash string, version string, payload string")
    hits, misses = files.cached(found, cache, "v1")
    assert sorted(r.rel_path for r in hits.collect()) == ["a", "c"] and [r.rel_path for r in misses.collect()] == ["b"]
    config = spark.createDataFrame([("tsconfig.json", "1")], "rel_path string, hash string")
    assert files.gate_hash(found, config) == files.gate_hash(found.repartition(3), config) != files.gate_hash(found.limit(2), config)


def test_xml_reports_give_covered_lines(spark):
    from evidencia.operators.coverage import xml_lines

    cobertura = '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'
    jacoco = '<report><package name="org/shop"><sourcefile name="A.java"><line nr="3" ci="0" cb="1"/><line nr="4" ci="0" cb="0"/></sourcefile></package></report>'
    got = lambda xml, kind: [(r.file, r.start_line, r.end_line, r.format) for r in xml_lines(spark.createDataFrame([("r", xml)], "artifact string, xml string"), kind).collect()]
    assert got(cobertura, "cobertura") == [("a.py", 1, 1, "cobertura")]
    assert got(jacoco, "jacoco") == [("org/shop/A.java", 3, 3, "jacoco")]


def test_csv_cells_hold_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "t.csv").write_text('behavior_name,acceptance_criteria\r\n"pays ""now""","a;\nb"\r\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [('pays "now"', "a;\nb")]


def test_ids_of_nodes_and_edges(spark):
    import hashlib

    from evidencia.functions.expressions import edge_id, node_id

    row = spark.range(1).select(node_id(F.lit("File"), F.lit("a.ts")).alias("n"), edge_id("edge", F.lit("a"), F.lit("CALLS"), F.lit("b")).alias("e")).first()
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    assert row.n == f"File:{short('File|a.ts')}" and row.e == f"edge:{short('a|CALLS|b')}"
