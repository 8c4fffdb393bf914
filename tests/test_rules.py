"""Rules on tables of inputs and wanted results."""

import pytest
from pyspark.sql import functions as F

from evidencia.functions import expressions as X
from evidencia.lineage import shared_folder
from evidencia.operators import classification as C
from evidencia.operators import coverage, ledger, selection, tallies, text
from evidencia.plans import reports, risk, traceability
from evidencia.streaming import telemetry


def table(spark, rule, cases: dict):
    """The rule's result for each key, as (key, result) pairs that differ from the wanted ones."""
    keys = list(cases)
    width = len(keys[0]) if isinstance(keys[0], tuple) else 1
    rows = [(i, *(k if isinstance(k, tuple) else (k,))) for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{j} string" for j in range(width)))
    found = {r.i: r.x for r in frame.select("i", rule(*[F.col(f"c{j}") for j in range(width)]).alias("x")).collect()}
    return [(k, found[i]) for i, k in enumerate(keys) if found[i] != cases[k]]


def test_test_files(spark):
    yes = ["src/foo.test.ts", "tests/foo.spec.ts", "test.js", "packages/p-limit/test.ts", "src/UnitTests/FooTests.cs", "src/UnitTests/FooTest.cs", "src/FooTests.cs", "src/UserTest.java", "src/UserTest.kt", "src/FooIT.java", "src/user_test.rb"]
    no = ["src/contest.js", "src/FooTest.cs", "src/foo.ts", "src/Contest.cs", "src/Contests.cs", "src/ABTest.cs", "src/LoadTest.cs", "src/Latest.java", "src/Greatest.kt", "src/Contest.rb", "src/EDIT.java", "src/UNIT.java", "src/AUDIT.java"]
    assert table(spark, C.is_test, {p: True for p in yes} | {p: False for p in no}) == []


def test_test_support(spark):
    yes = ["src/__mocks__/api.ts", "src/__fixtures__/user.ts", "src/saveUser.fixture.ts", "src/data.fixtures.json", "src/dom-helpers.ts", "src/render-helper.ts", "src/test-utils.ts", "src/test_utils.py", "src/testUtils.ts", "src/mocks/api.ts", "src/mock/api.ts", "src/fixtures/user.ts", "src/fixture/user.ts", "src/api.mock.ts", "src/payment.mocks.ts"]
    no = ["src/saveUser.ts", "src/mockingbird.ts", "src/helpers/format.ts", "src/contest-rules.ts"]
    assert table(spark, C.is_test_support, {p: True for p in yes} | {p: False for p in no}) == []


def test_product_paths(spark):
    assert table(spark, C.is_non_product, {"src/playwright/runner.ts": False, "playwright/a.ts": True, "src/date-helper.ts": False, ".github/x.ts": True, "a/.github/b": True, "server/api4/apitestlib.go": True, "./tests/x.ts": True, "src/tests/x.ts": False, "src/__tests__/x.ts": True, "scripts/x.ts": False}) == []


def test_roles_and_languages(spark):
    assert table(spark, C.role, {"a/b.test.ts": "test", "package.json": "config", "x/Vite.config.mts": "config", "README.md": "doc", "src/a.ts": "code", "a.json": "other", "b.sql": "code", "Makefile": "other", "notes.txt": "doc", "requirements.txt": "config"}) == []
    assert table(spark, C.language, {"a.TSX": "typescript", "a.mjs": "javascript", "a/b.hh": "cpp", "a.b/c": "other", "x.kt": "kotlin"}) == []
    assert table(spark, lambda p: C.language_label(C.language(p)), {"a.ts": "TypeScript/JavaScript", "a.cs": "C#", "a": "other", "a.sql": "sql"}) == []


def test_path_layers(spark):
    wanted = {"e2e/checkout.test.ts": "e2e", "playwright/login.spec.ts": "e2e", "tests/payments/card.test.ts": "unknown", "a/integration/x.ts": "integration", "x.int.test.ts": "integration", "integrations/x.ts": "unknown", "a/api/x.ts": "api", "x.api.test.ts": "api", "x.comp.test.tsx": "component", "a/components/x.tsx": "component", "component/x.ts": "unknown", "a/unit/x.ts": "unit", "x.unit.ts": "unit", "units/x.ts": "unknown"}
    assert table(spark, C.path_layer, wanted) == []


def test_layers_by_imports_and_calls(spark):
    layer = lambda p, c: F.concat_ws(" ", *C.test_layer(p, c))
    wanted = {
        ("a.test.ts", 'import { test } from "@playwright/test"'): "e2e high e2e:@playwright/test",
        ("a.test.ts", "cy.visit('/')"): "e2e high e2e:cy.visit",
        ("a.test.ts", 'import x from "./x";\npage.next()'): "unit medium unit:internal-import",
        ("a.test.ts", 'import request from "supertest";'): "api high api:supertest",
        ("a.test.ts", 'import { Pool } from "pg";'): "integration high integration:pg",
        ("a.test.ts", 'import type { Pool } from "pg";'): "unknown none ",
        ("a.test.ts", 'import { type Pool } from "pg";\nimport { y } from "../y";'): "unit medium unit:internal-import",
        ("a.test.ts", 'import "pgx";'): "unknown none ",
        ("a.test.tsx", "const a = <Cart/>;"): "component high component:jsx",
        ("a.test.ts", "const a = b < c;"): "unknown none ",
        ("a/e2e/b_test.go", "package x"): "e2e low path:e2e",
        ("a/b_test.go", None): "unknown none ",
    }
    assert table(spark, layer, wanted) == []


def test_generated_code(spark):
    wanted = {"// Code generated by x. DO NOT EDIT.\npackage a": True, "package a\n\n/* Code generated by y\n * DO NOT EDIT\n */": True, "package a\nimport b\n// Code generated. DO NOT EDIT.": False, "# Code generated, edit freely\nx = 1": False, "x = 'Code generated DO NOT EDIT'": False, None: False, "": False}
    assert table(spark, C.is_generated, wanted) == []


def test_boilerplate(spark):
    rule = lambda n, lang, kind, trivial: C.is_boilerplate(n, lang, kind, trivial.cast("boolean"))
    wanted = {("getId", "java", "method", "true"): True, ("getId", "java", "method", "false"): False, ("getId", "java", "method", None): False, ("toString", "java", "method", None): True, ("calculateTotal", "java", "method", "true"): False, ("getopt", "java", "method", "true"): False, ("getId", "java", "class", "true"): False, ("getName", "kotlin", "method", "true"): True, ("__repr__", "python", "function", None): True, ("get_x", "python", "function", None): False, ("main", "go", "function", None): False, ("getId", "ruby", "method", None): False, ("getId", "java", "const", None): False}
    assert table(spark, rule, wanted) == []


def test_behavior_surface(spark):
    rule = lambda p, n, m: F.concat_ws("|", F.coalesce(C.exclusion_reason(p, n, m), F.lit("-")), F.coalesce(C.surface_reason(p, n, m), F.lit("-")))
    wanted = {
        ("src/utils/a.ts", "createOrder", None): f"{C.REASON_UTILITY}|-",
        ("src/icons/a.ts", "render", None): f"{C.REASON_ASSET}|-",
        ("src/a.ts", "Order.__hooks", None): f"{C.REASON_HOOK}|-",
        ("src/a.ts", "CacheProviderService.get", None): "Method of infrastructure service CacheProviderService — excluded from the behavior denominator.|-",
        ("src/a.ts", "PaymentProviderService.capture", None): "-|Method of PaymentProviderService — service/API/job-adjacent behavior surface.",
        ("src/a.ts", "getUserConfig", None): f"{C.REASON_METHOD}|-",
        ("src/a.ts", "loadModules", None): f"{C.REASON_BOOTSTRAP}|-",
        ("src/api/a.ts", "x", None): f"-|{C.REASON_PATH}",
        ("src/services/a.ts", "x", None): "-|-",
        ("src/services/a.ts", "createOrder", None): f"-|{C.REASON_SERVICE}",
        ("src/a.ts", "getRedisClient", None): "-|-",
        ("src/a.ts", "createOrder", None): f"-|{C.REASON_NAME}",
        ("src/a.ts", "handle", "OrderJob"): "-|Method of OrderJob — service/API/job-adjacent behavior surface.",
        ("src/a.ts", "parse", None): "-|-",
    }
    assert table(spark, rule, wanted) == []


def test_specifiers(spark):
    plain = {"./impl.js": "rel-js-specifier", "../impl.ts": "rel-ts-ext", "./util": "rel-extensionless", "./styles.scss": "asset", "./icon.png": "asset", "node:path": "node-builtin", "fs": "bare-external", "vitest": "bare-external", "/abs/x.cts": "rel-ts-ext"}
    assert table(spark, selection.specifier_category, plain) == []
    known = lambda s: selection.specifier_category(s, ["@app/*"], ["components"])
    assert table(spark, known, {"@app/foo": "path-alias", "@apple/x": "bare-external", "components/Button": "baseurl-internal", "react": "bare-external"}) == []
    exact = lambda s: selection.specifier_category(s, ["@app"])
    assert table(spark, exact, {"@app": "path-alias", "@apple/x": "bare-external", "@app/foo": "bare-external"}) == []


def test_node_ranges(spark):
    wanted = {
        ("26.3.0", ">=24.2.0 <25"): False, ("24.3.0", ">=24.2.0 <25"): True, ("22.5.0", ">=24.2.0"): False, ("26.3.0", "^22.18.0 || >=24.2.0"): True, ("22.20.0", "^22.18.0 || >=24.2.0"): True, ("22.10.0", "^22.18.0 || >=24.2.0"): False,
        ("26.3.0", ">=22.18.0 <23 || >=24.2.0 <25"): False, ("22.19.0", ">=22.18.0 <23 || >=24.2.0 <25"): True, ("24.5.0", ">=24.2 <25"): True, ("22.20.0", ">=22.18 <23"): True, ("24.5.0", ">=22 <=24"): True, ("24.9.0", "<=24"): True, ("25.0.0", "<=24"): False,
        ("24.5.0", ">24"): False, ("25.0.0", ">24"): True, ("24.0.0", ">=24"): True, ("24.3.0", ">24.2"): True, ("26.0.0", "garbage!!"): None, ("26.0.0", "1.2.3 - 2.3.4"): None, ("v24.1.0-rc.1", "~24.1"): True, ("24.2.0", "~24.1"): False, ("24.2.0", "24"): True, ("24.2.0", "24.2.0"): True, ("24.2.1", "24.2.0"): False, ("24.2.1", "*"): True, ("24.2.1", ""): True, ("0.2.5", "^0.2.3"): True, ("0.3.0", "^0.2.3"): False, ("junk", ">=1"): None, ("24.0.0", "junk || >=20"): True,
    }
    assert table(spark, text.in_node_range, wanted) == []


def test_failure_kinds(spark):
    wanted = {
        ("Error: Cannot find module './order.service'", None, None): "module_not_found", ("Error: Cannot find module 'node:sqlite'", None, None): "experimental_builtin", ("TypeError: DatabaseSync is not a constructor", None, None): "experimental_builtin",
        ("SyntaxError: unexpected token", "v26.3.0", ">=24.2.0 <25"): "engine_mismatch", ("boom", "v22.5.0", ">=24.2.0"): "engine_mismatch", ("Error: Cannot find module 'node:sqlite'", "v26.3.0", "^22.18.0 || >=24.2.0"): "experimental_builtin",
        ("Error: connect ECONNREFUSED 127.0.0.1:5432", None, None): "db_or_external", ('[WARNING] Cannot find base config file "../../tsconfig.json"', None, None): "tsconfig_missing", ("AssertionError: expected [Function] to throw 'Cannot find module'", None, None): "logic_failure",
        ("expect(db).toBeInstanceOf(DatabaseSync) failed", None, None): "logic_failure", ("AssertionError: expected 5 to equal 6", "v26.3.0", ">=24.2.0 <25"): "logic_failure", (None, None, None): "unknown", ("boom", None, ">=24"): "unknown",
    }
    assert table(spark, text.failure_kind, wanted) == []


def test_buckets(spark):
    kinds = ["happy_path", *text_kinds()]
    def chosen(limit, *on):
        frame = spark.range(1).select(*[F.lit(k in on).alias(k) for k in kinds])
        return frame.select(selection.chosen_buckets(F.lit(limit)).alias("b")).first().b

    assert chosen(3, *kinds) == ["happy_path", "validation_error", "integration_flow"]
    assert chosen(5, *kinds) == chosen(99, *kinds) == ["happy_path", "validation_error", "edge_case", "integration_flow", "security_privacy"]
    assert chosen(0, *kinds) == ["happy_path"] and chosen(5) == [] and chosen(5, "happy_path") == ["happy_path"]
    assert chosen(2, "edge_case") == ["edge_case"] and chosen(3, "regression") == ["regression"] and chosen(5, "regression") == ["regression"]


def text_kinds():
    return list(selection.SIGNALS)


def test_bucket_plans(spark):
    rows = spark.createDataFrame([(1, ["a"], True), (2, ["a", "b", "c"], False), (3, ["a", "b"], False), (4, [], False)], "target_pos int, buckets array<string>, thin boolean")
    plain = lambda df: [(r.target_pos, r.bucket) for r in df.collect()]
    assert plain(selection.bucket_plan(rows, 4, True)) == [(2, "a"), (3, "a"), (2, "b"), (3, "b")]
    assert plain(selection.bucket_plan(rows, 2, False)) == [(2, "a"), (2, "b")]


def test_flow_verdicts(spark):
    flows = [(1, "e", ["a", "b"]), (2, "e", ["a", "b"]), (3, "x", ["zz"]), (4, "e", ["zz"]), (5, "e", ["a", "a"]), (6, "e", ["e"]), (7, None, ["a"]), (8, "e", []), (9, "e", list("abcdfghij")), (10, "e", ["a"]), (11, "e", ["b"]), (12, "e", ["b"]), (13, "e", None)]
    frame = spark.createDataFrame(flows, "flow int, entry_id string, hops array<string>")
    ids = lambda names: spark.createDataFrame([(n,) for n in names], "id string")
    got = {r.flow: r.verdict for r in selection.classify_flows(frame, ids(["e"]), ids(list("abcdefghij")), most_flows=2).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "missing anchor", 4: "unresolved hop", 5: "cycle", 6: "cycle", 7: "malformed", 8: "malformed", 9: "over cap", 10: "accepted", 11: "over cap", 12: "over cap", 13: "malformed"}


def test_siblings(spark):
    cases = [
        ("pkg/user/auth_test.go", ["pkg/user/auth.go"], "pkg/user/auth.go", 0.7),
        ("pkg/user/auth_test.go", ["pkg/other/auth.go"], None, None),
        ("src/test/java/com/acme/OwnerControllerTests.java", ["src/main/java/com/acme/OwnerController.java"], "src/main/java/com/acme/OwnerController.java", 0.7),
        ("app/owner/OwnerControllerTest.java", ["app/owner/OwnerController.java"], "app/owner/OwnerController.java", 0.65),
        ("src/test/java/a/AuditTest.java", ["src/main/java/a/Audi.java"], None, None),
        ("app/services/test_billing.py", ["app/services/billing.py"], "app/services/billing.py", 0.65),
        ("app/tests/test_billing.py", ["app/billing.py"], "app/billing.py", 0.58),
        ("tests/unit_tests/core/security/providers/test_c.py", ["libs/core/security/providers/c.py", "other/c.py"], "libs/core/security/providers/c.py", 0.62),
        ("tests/test_card.py", ["src/card.py"], "src/card.py", 0.5),
        ("tests/core/providers/test_x.py", ["a/core/providers/x.py", "b/core/providers/x.py"], None, None),
        ("tests/test_card.py", ["a/card.py", "b/card.py"], None, None),
        ("src/card.test.ts", ["src/card.ts"], None, None),
    ]
    for test, files, want, confidence in cases:
        found = reports.sibling(spark.createDataFrame([(test,)], "path string"), spark.createDataFrame([(f,) for f in [*files, test]], "path string")).collect()
        assert [(r.sibling, r.confidence) for r in found] == ([(want, confidence)] if want else []), test


def test_areas_and_modules(spark):
    assert table(spark, X.area, {"src/a/b.ts": "src/a", "a/b.ts": "a", "b.ts": "b.ts", None: "core", "server/channels/app/x.go": "server/app", "webapp/channels/src/actions/x.ts": "webapp/actions", "./a/b/c.py#x": "a/b"}) == []
    assert table(spark, X.code_area, {"x/src/main/java/org/shop/A.java": "shop", "a/B.kt": "a", "app/core/x.py": "core/x.py", "app/core/sub/x.py": "core/sub", "lib/core/x.py": "lib/core", "src/a/b.ts": "src/a"}) == []
    assert table(spark, X.module_key, {"a.ts": "(root)", "p/src/x/y/z/a.ts": "p/src/x/y", "a/b/c/d/e/f.go": "a/b/c/d", "m/java/org/shop/deep/A.java": "m/java/org/shop"}) == []
    assert table(spark, X.local_pair, {("a/x.ts", "a/b/y.ts"): True, ("a/x.ts", "ab/y.ts"): False, ("x.ts", "y.ts"): True, ("x.ts", "a/y.ts"): False}) == []
    assert table(spark, X.shared_depth, {("a/b/c.ts", "a/b/d.ts"): 2, ("a/b", "a/b"): 2, ("x", "y"): 0, ("/a//b", "a/b/c"): 2, (None, "a"): 0}) == []


def test_median_is_rounded_for_even_counts_alone(spark):
    rows = spark.createDataFrame([("a", 1.25), ("b", 1.0), ("b", 2.0), ("c", 1.2), ("c", 3.7), ("c", 2.4), ("d", None), ("d", float("nan")), ("b", float("inf"))], "k string, v double")
    assert {r.k: r["median"] for r in telemetry.medians(rows, "k", "v").collect()} == {"a": 1.25, "b": 2.0, "c": 2.4, "d": None}


def test_run_ids_number_the_whole_ledger(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}", "own" if i == 4 else None) for i in range(1, 8)], "idx long, target_id string, run_id string").repartition(3)
    assert {r.idx: r.run_id for r in ledger.numbered(rows).collect()} == {1: "run:000001", 2: "run:000002", 3: "run:000003", 4: "own", 5: "run:000005", 6: "run:000006", 7: "run:000007"}


def test_statuses_by_short_names(spark):
    rows = spark.createDataFrame([(s,) for s in ["Proven", "No integration signal", "Runtime-covered"]], "status string")
    names = lambda *w: sorted(r.status for r in traceability.with_statuses(rows, list(w)).collect())
    assert names("no_link") == names("NOLINK ") == ["No integration signal"] and names("runtimecovered", "proven") == ["Proven", "Runtime-covered"]
    assert len(names("gap")) == len(names()) == 3


def test_concerns(spark):
    rule = lambda t, f, s, e, d, o, c: F.array_join(risk.applicable_concerns(t, f, s.cast("int"), e.cast("boolean"), d.cast("int"), o.cast("int"), c.cast("int")), " ")
    wanted = {("x", "a.ts", "1", "false", "0", "0", "0"): "contract", ("x", "a.ts", "9", "false", "0", "0", "0"): "contract authorization_safety data_integrity", ("GET /a", "a.ts", "6", "false", "3", "0", "5"): "contract boundary_limits integration_flow data_integrity", ("x", "worker.ts", "1", "true", "0", "2", "1"): "contract boundary_limits integration_flow state_lifecycle failure_recovery concurrency_ordering"}
    assert table(spark, rule, wanted) == []


def test_split_goes_by_module_then_prefix_then_file(spark):
    rows = [("c", f"m{i}", f"src/a/b/c/d/e{i % 2}/f{i % 3}.ts") for i in range(12)] + [("small", "s1", "x.ts")]
    got = {r.member: r.part for r in tallies.split_clusters(spark.createDataFrame(rows, "component string, member string, file string"), 4).collect()}
    assert got["s1"] == "" and len(set(got.values())) == 7 and all(p.endswith(".ts") for m, p in got.items() if m != "s1")
    got = {r.member: r.part for r in tallies.split_clusters(spark.createDataFrame(rows, "component string, member string, file string"), 6).collect()}
    assert len(set(got.values())) == 3 and got["m0"].endswith("/e0")


def test_impact_passes_over_hubs_and_falls_back_to_areas(spark):
    nodes = spark.createDataFrame([(f"test:t{i}", "TestCase", f"t{i}.test.ts", False) for i in range(30)] + [("REQ-1", "Requirement", None, False), ("REQ-2", "Requirement", None, False), ("REQ-3", "UserFlow", None, False)], "external_id string, kind string, file string, stale boolean")
    edges = spark.createDataFrame([("REQ-1", "test:t1", "TESTED_BY"), ("test:t2", "REQ-2", "COVERS")], "from_id string, to_id string, type string")
    candidates = spark.createDataFrame([("REQ-2", "test:t3", "MAY_COVER")], "from_id string, to_id string, type string")
    links = spark.createDataFrame([("src/a.ts", "t1.test.ts", "stem"), ("src/a.ts", "t2.test.ts", "import")] + [("src/hub/h.ts", f"t{i}.test.ts", "import") for i in range(25)], "code_file string, test_file string, kind string")
    areas = spark.createDataFrame([("REQ-3", "checkout"), ("REQ-1", "src")], "external_id string, area string")
    run = lambda *files: {r.id: r.link for r in coverage.impacted_behaviors(spark.createDataFrame([(f,) for f in files], "file string"), nodes, edges, candidates, links, areas).collect()}
    assert run("src/a.ts") == {"REQ-1": "stem", "REQ-2": "import"}
    assert run("src/hub/h.ts") == {} and run("t3.test.ts") == {"REQ-2": "direct"}
    assert run("src/checkout/x.ts") == {"REQ-3": "area"}


def test_budget_passes_over_whole_candidates():
    assert coverage.within_budget([("t1", "a"), ("t2", "b"), ("t1", "c"), ("t1", "a")], 3) == [("t1", "a"), ("t1", "c"), ("t1", "a")]


def test_nearest_ancestor(spark):
    marked = spark.createDataFrame([("", "root"), ("a/b", "ab")], "dir string, value string")
    paths = spark.createDataFrame([("a/b/c/x.ts",), ("a/bc/x.ts",), ("x.ts",), ("a/b/x.ts",)], "path string")
    assert {r.path: r.value for r in reports.nearest_ancestor(paths, marked).collect()} == {"a/b/c/x.ts": "ab", "a/bc/x.ts": "root", "x.ts": "root", "a/b/x.ts": "ab"}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_imports_are_read_and_resolved(spark):
    from evidencia.operators import imports

    content = """import a, { b as c, type T } from "./x.js";
import * as ns from '../lib';
import type { P } from "pg";
import {
  type Q,
} from "q";
import "./side.css";
export { z } from "./z";
export type { Y } from "./y";
// import no from "no";
const d = require("./d"); const e = await import("./e");
const s = 'import f from "g"';
/* import h from "h"; */
"""
    found = imports.extracted(spark.createDataFrame([("src/m.ts", content), ("n.ts", None)], "path string, content string"))
    got = {r.specifier: (r.kind, list(r.bindings)) for r in found.collect()}
    assert got == {"./x.js": ("runtime", ["default a", "b c"]), "../lib": ("runtime", ["* ns"]), "pg": ("type", ["P P"]), "q": ("type", []), "./side.css": ("runtime", []), "./z": ("runtime", []), "./y": ("type", []), "./d": ("runtime", []), "./e": ("runtime", [])}
    files = spark.createDataFrame([(p,) for p in ["src/x.ts", "src/x.js", "lib/index.ts", "src/z.tsx", "src/d/index.js", "src/e.mjs"]], "path string")
    targets = {r.specifier: r.target for r in imports.resolved(found, files).collect()}
    assert {k: v for k, v in targets.items() if v} == {"./x.js": "src/x.ts", "../lib": "lib/index.ts", "./z": "src/z.tsx", "./d": "src/d/index.js", "./e": "src/e.mjs"}
    assert table(spark, imports.normalised, {("a/b", "../c"): "a/c", ("a", "../../c"): None, ("", "./x"): "x", ("a", "./b/../c"): "a/c"}) == []
