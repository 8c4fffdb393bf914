"""Export index, walks through barrels, specifiers by configuration, calls and symbols: sources and wanted results by hand."""

import pytest
from pyspark.sql import functions as F

from evidencia.operators import barrels, calls, imports, scripts
from evidencia.operators.scripts import export_index

SOURCE = "path string, content string"


def files(spark, **content):
    return spark.createDataFrame([(p.replace("__", "/") + ".ts", c) for p, c in content.items()], SOURCE)


SURFACE = """import dep, { one as uno, type Two, three } from "./dep";
import * as all from "./all";
import type { Four } from "./four";
export function f(a: string, { b }: P) {
  const inner = 1;
}
export async function* gen() {}
export const x = f(1, 2), y = { p: 1, q: [2, 3] }, z = "a,b";
export const { d1, d2: d3 = 4, ...d4 } = obj;
export let [e1, e2] = arr;
export default class Foo {}
export abstract class Bar { m() { return 1; } }
export declare function amb(): void;
export interface I { a: string, b: number }
export type T = { a: string };
export enum E { A, B }
export const enum CE { A }
export namespace N {
  export interface Only {}
}
export namespace M {
  export function live() {}
}
class Later {}
function local1() {}
export {
  Later,
  local1 as renamed,
  uno, Two as Zwei, all as everything, Four,
  type three as drei,
  ghost,
};
export * from "./s1";
export type * from "./s2";
export * as ns from "./s3";
export type * as tns from "./s4";
export { a, b as default, type c } from "./n";
export type { t } from './t';
// export { no } from "./no";
/* export * from "./no2"; */
  export const indented = 1;
"""


def test_what_a_script_exposes(spark):
    rows = export_index(spark.createDataFrame([("m.ts", SURFACE), ("e.ts", None), ("f.ts", "")], SOURCE)).collect()
    local = {r.name: r.kind for r in rows if r.entry == "local"}
    runtime = dict.fromkeys(["x", "y", "z", "d1", "d3", "d4", "e1", "e2", "E", "CE"], "const") | {"f": "function", "gen": "function", "renamed": "function", "Bar": "class", "Later": "class", "default": "default", "ns": "namespace", "M": "namespace", "ghost": "unknown"}
    assert local == runtime | dict.fromkeys(["amb", "I", "T", "N", "tns"], "type")
    named = {r.name: (r.specifier, r.source, r.of_type) for r in rows if r.entry == "named"}
    assert named == {"uno": ("./dep", "one", False), "Zwei": ("./dep", "Two", True), "everything": ("./all", "*", False), "Four": ("./four", "Four", True), "drei": ("./dep", "three", True), "a": ("./n", "a", False), "default": ("./n", "b", False), "c": ("./n", "c", True), "t": ("./t", "t", True)}
    assert {(r.specifier, r.of_type) for r in rows if r.entry == "star"} == {("./s1", False), ("./s2", True)}
    assert {r.path for r in rows} == {"m.ts"}


def walked(spark, starts, **content):
    sources = files(spark, **content)
    index = export_index(sources)
    targets = imports.resolved(index.where("specifier is not null").select("path", "specifier").distinct(), sources.select("path"))
    rows = barrels.walk_barrels(spark.createDataFrame(starts, "file string, binding string"), index, targets).collect()
    return {(r.file, r.binding): (r.status, r.terminal_file, r.terminal_binding, r.depth, r.covered) for r in rows}


def test_walks_follow_names_types_and_stars(spark):
    content = {
        "leaf": "export function go() {}\nexport interface Shape { a: string }\nexport default function main() {}\nexport const both = 1;",
        "other": "export const go = 1;\nexport const lone = 2;\nexport const both = 3;",
        "chain": 'export { go as run } from "./middle";\nexport { default as start } from "./leaf";',
        "middle": 'export * from "./leaf";',
        "typed": 'export type { go } from "./leaf";\nexport { Shape } from "./leaf";',
        "twice": 'export { go } from "./leaf";\nexport { go } from "./other";',
        "stars": 'export * from "./leaf";\nexport * from "./other";\nexport * from "./middle";',
        "mixed": 'export type * from "./leaf";\nexport * from "./middle";',
        "blind": 'export * from "./leaf";\nexport * from "outside";',
        "shadow": 'export * from "./leaf";\nexport { lone as go } from "./other";',
        "x": 'export * from "./y";',
        "y": 'export * from "./x";',
        "round": 'export * from "./x";\nexport * from "./leaf";',
        "amb__d": "export declare function go(): void;",
    } | {f"c{i}": f'export {{ go }} from "./c{i + 1}";' for i in range(7)} | {"c7": "export const go = 1;", "deep": 'export * from "./c0";\nexport * from "./leaf";', "here": 'export * from "./c3";'}
    wanted = {
        ("chain.ts", "run"): ("terminal", "leaf.ts", "go", 2, True),
        ("chain.ts", "start"): ("terminal", "leaf.ts", "default", 1, True),
        ("middle.ts", "default"): ("unresolved", None, None, 0, False),
        ("middle.ts", "none"): ("unresolved", None, None, 1, False),
        ("typed.ts", "go"): ("terminal", "leaf.ts", "go", 1, False),
        ("typed.ts", "Shape"): ("terminal", "leaf.ts", "Shape", 1, False),
        ("twice.ts", "go"): ("ambiguous", None, None, 0, False),
        ("stars.ts", "go"): ("ambiguous", None, None, 0, False),
        ("stars.ts", "lone"): ("terminal", "other.ts", "lone", 1, True),
        ("mixed.ts", "go"): ("terminal", "leaf.ts", "go", 2, True),
        ("blind.ts", "go"): ("unresolved", None, None, 0, False),
        ("shadow.ts", "go"): ("terminal", "other.ts", "lone", 1, True),
        ("x.ts", "go"): ("cycle", None, None, 2, False),
        ("round.ts", "go"): ("terminal", "leaf.ts", "go", 1, True),
        ("c0.ts", "go"): ("depth-exceeded", None, None, 6, False),
        ("c2.ts", "go"): ("terminal", "c7.ts", "go", 5, True),
        ("deep.ts", "go"): ("depth-exceeded", None, None, 0, False),
        ("here.ts", "go"): ("terminal", "c7.ts", "go", 5, True),
        ("nowhere.ts", "go"): ("unresolved", None, None, 0, False),
        ("leaf.ts", "go"): ("terminal", "leaf.ts", "go", 0, True),
    }
    assert walked(spark, list(wanted), **content) == wanted


def test_a_walk_of_too_many_steps_is_given_up(spark, monkeypatch):
    monkeypatch.setattr(barrels, "MOST_STEPS", 6)
    content = {"top": 'export { go } from "./wide";', "wide": "\n".join(f'export * from "./w{i}";' for i in range(6)), "leaf": "export const go = 1;"} | {f"w{i}": 'export * from "./leaf";' for i in range(6)}
    assert walked(spark, [("top.ts", "go"), ("w0.ts", "go")], **content) == {("top.ts", "go"): ("budget-exhausted", None, None, 1, False), ("w0.ts", "go"): ("terminal", "leaf.ts", "go", 1, True)}


def test_declaration_files_define_no_runtime_name(spark):
    sources = spark.createDataFrame([("a.d.ts", "export function go(): void;"), ("b.ts", 'export * from "./a.d";')], SOURCE)
    index = export_index(sources)
    targets = spark.createDataFrame([("b.ts", "./a.d", "a.d.ts")], "path string, specifier string, target string")
    row = barrels.walk_barrels(spark.createDataFrame([("b.ts", "go")], "file string, binding string"), index, targets).first()
    assert (row.status, row.terminal_file, row.covered) == ("terminal", "a.d.ts", False)


CONFIGS = "dir string, base string, patterns array<struct<pattern:string,targets:array<string>>>"


@pytest.mark.parametrize(
    ("path", "specifier", "target"),
    [
        ("web/a/x.ts", "./y", "web/a/y.ts"),
        ("web/a/x.ts", "@/deep/tool", "web/src/deep/tool.ts"),
        ("web/a/x.ts", "@/special/tool", "web/special/tool.tsx"),  # the longer part before the star
        ("web/a/x.ts", "exact", "web/src/one.ts"),
        ("web/a/x.ts", "~lib/q.end", "web/lib2/q.ts"),  # the second target, star in the middle
        ("web/a/x.ts", "shared/z", "web/shared/z/index.ts"),  # below the base folder
        ("web/inner/x.ts", "@/deep/tool", None),  # the nearest configuration counts alone
        ("web/inner/x.ts", "#in/k", "web/inner/in/k.ts"),  # without a base folder targets lie below their configuration
        ("api/x.ts", "@org/kit", "packages/kit/index.ts"),
        ("api/x.ts", "@org/kit/part", "packages/kit/part.ts"),
        ("api/x.ts", "plain/part.js", "packages/plain/part.ts"),
        ("api/x.ts", "lodash", None),
        ("api/x.ts", "../../out", None),
    ],
)
def test_specifiers_by_configuration(spark, path, specifier, target):
    known = ["web/a/y.ts", "web/src/deep/tool.ts", "web/src/special/tool.ts", "web/special/tool.tsx", "web/src/one.ts", "web/lib2/q.ts", "web/shared/z/index.ts", "web/inner/in/k.ts", "packages/kit/index.ts", "packages/kit/part.ts", "packages/plain/part.ts"]
    configs = spark.createDataFrame([("web", "web", [("@/*", ["src/*"]), ("@/special/*", ["special/*", "src/special/*"]), ("exact", ["src/one"]), ("~lib/*.end", ["lib1/*", "lib2/*"])]), ("web/inner", None, [("#in/*", ["in/*"])])], CONFIGS)
    packages = spark.createDataFrame([("@org/kit", "packages/kit"), ("plain", "packages/plain")], "name string, dir string")
    rows = spark.createDataFrame([(path, specifier)], "path string, specifier string")
    found = imports.resolved_by_configuration(rows, spark.createDataFrame([(k,) for k in known], "path string"), configs, packages)
    assert [r.target for r in found.collect()] == [target]


CALLING = """import { helper, memo } from "./h";
import * as ns from "./n";
export function first(a: string, cb) {
  helper(a, "x(y)"); // ghost(1)
  cb();
  const inner = () => {
    lost();
  };
  items.map((x) => { x(); mapped(); });
  if (a) { ns.run(second(1)); }
  new Thing(made());
  first();
  return a?.b(c.d.e());
}
export const Wrapped = memo(() => {
  render();
});
const plain = () => draw();
export class Svc extends Base {
  private readonly repo: Repo;
  constructor(private dep: Dep, other: Other) {
    super();
    boot();
  }
  /* block
  hidden() { no(); } */
  async run(x: number): Promise<void> {
    this.save(x);
    this.dep.find(x);
    this.repo.load();
    this.other.gone();
    [1].forEach(function () { this.gone(); free(); });
    Svc.make();
  }
  private save(v) { store(v); }
  get value() { return calc(); }
}
namespace N {
  export function f() { nope(); }
}
export { plain };
top();
"""


def test_calls_know_their_callers(spark):
    source = spark.createDataFrame([("m.ts", CALLING), ("e.ts", None)], SOURCE)
    got = [(r.caller, r.callee, r.via, r.qualifier, r.injected_type) for r in calls.raw_calls(source).orderBy("place").collect()]
    assert got == [
        ("first", "helper", "free", None, None), ("first", "map", "static", "items", None), ("first", "mapped", "free", None, None), ("first", "run", "static", "ns", None), ("first", "second", "free", None, None), ("first", "made", "free", None, None),
        ("Wrapped", "render", "free", None, None), ("plain", "draw", "free", None, None), ("Svc.run", "save", "this", None, None), ("Svc.run", "find", "injected", "dep", "Dep"), ("Svc.run", "load", "injected", "repo", "Repo"), ("Svc.run", "free", "free", None, None), ("Svc.run", "make", "static", "Svc", None), ("Svc.save", "store", "free", None, None),
    ]
    symbols = {(r.name, r.kind, r.member_of) for r in calls.script_symbols(source).collect()}
    assert symbols == {("first", "function", None), ("Wrapped", "const", None), ("plain", "const", None), ("Svc", "class", None), ("Svc.run", "method", "Svc")}


def test_a_file_gives_so_many_calls_at_most(spark, monkeypatch):
    monkeypatch.setattr(calls, "MOST_CALLS", 3)
    source = spark.createDataFrame([("m.ts", "export function f() {\n" + "".join(f"  g{i}();\n" for i in range(5)) + "}\n")], SOURCE)
    assert [r.callee for r in calls.raw_calls(source).orderBy("place").collect()] == ["g0", "g1", "g2"]


def test_calls_resolve_tier_by_tier(spark):
    content = {
        "lib": "export function helper() {}\nexport class Tool {\n  build() { return 1; }\n  static make() { return 2; }\n}\nexport function odd() {}",
        "index": 'export * from "./lib";',
        "solo": "export class Only {\n  unique() { return 1; }\n}\nexport const only = new Only();",
        "fixtures__fake": "export function helper() {}",
        "use": """import { helper, odd as strange } from "./lib";
import { helper as far } from "./index";
import { only } from "./solo";
import { helper as fake } from "./fixtures/fake";
import * as lib from "./lib";
import * as all from "./index";
import type { Tool } from "./lib";
import { Tool as Far } from "./index";
export function near() {
  return 1;
}
export function caller() {
  near();
  helper();
  strange();
  far();
  fake();
  only.unique();
  lib.helper();
  all.odd();
  unknown();
  local.unique();
}
export class Job {
  constructor(private tool: Tool, private far: Far, private own: Own) {}
  run() {
    this.step();
    this.tool.build();
    this.far.build();
    this.own.work();
    Job.create();
  }
  step() { return 1; }
  static create() { return 2; }
}
export class Own {
  work() { return 1; }
}
function hidden() {
  near();
}
""",
    }
    sources = files(spark, **content)
    index = export_index(sources)
    wanted = index.where("specifier is not null").select("path", "specifier").unionByName(scripts.imported_names(scripts.statements(sources)).select("path", "specifier")).distinct()
    targets = imports.resolved(wanted, sources.select("path"))
    found = calls.resolved_calls(calls.raw_calls(sources), calls.script_symbols(sources), calls.bindings(sources, targets), index, targets)
    assert {(r.caller, r.to_path.removesuffix(".ts"), r.callee, r.type, r.resolution, r.confidence) for r in found.where(F.col("from_path") == "use.ts").collect()} == {
        ("caller", "use", "near", "CALLS", "same_file", 1.0), ("caller", "lib", "helper", "CALLS", "import", 1.0), ("caller", "lib", "odd", "CALLS", "import", 1.0), ("caller", "solo", "Only.unique", "MAY_CALL", "only_member", 0.65),
        ("Job.run", "use", "Job.step", "CALLS", "same_file", 1.0), ("Job.run", "use", "Job.create", "CALLS", "same_file", 1.0), ("Job.run", "lib", "Tool.build", "CALLS", "injected_import", 1.0), ("Job.run", "use", "Own.work", "CALLS", "same_file_type", 1.0),
    }  # fmt: skip  # far and lib.helper repeat exact pairs; a fixture is no product


def test_symbols_by_pattern(spark):
    from evidencia.operators import symbols

    python = 'def top(a):\n    pass\n\n"""\ndef no():\n"""\n\nclass Thing(Base):\n    def act(self):\n        s = "def no2("\n    async def top(self):\n        pass\n# class No:\nasync def late (x):\n    pass\nclass Bare:\n    pass\nx = \'\\\'def no3(\'\n'
    go = "package main\n\nfunc Run() {\n}\nfunc hidden() {}\nfunc (s *T) Method() {}\n/* func No() {\n*/\n  func Inner() {}\nvar s = `\nfunc Raw()\n`\n"
    java = 'import x;\npublic class A {\n  public static class B {}\n  class C {}\n}\n@Entity(name) @Getter public class D {}\nString t = """\npublic class No {}\n""";\n'
    rows = symbols.pattern_symbols(spark.createDataFrame([("a.py", python), ("b.go", go), ("C.java", java), ("d.ts", "export function f() {}"), ("e.py", None)], SOURCE))
    got = {(r.path, r.name, r.kind, r.start_line) for r in rows.collect()}
    assert got == {
        ("a.py", "top", "function", 1), ("a.py", "late", "function", 14), ("a.py", "act", "method", 9), ("a.py", "Thing", "class", 3), ("a.py", "Bare", "class", 16),
        ("b.go", "Run", "function", 2), ("b.go", "Inner", "function", 7), ("C.java", "A", "class", 2), ("C.java", "B", "class", 3), ("C.java", "D", "class", 6),
    }
    kept, dropped = symbols.within_total(rows, 4)
    assert [r.name for r in kept.collect()] == ["A", "B", "D", "top"] and dropped.first().dropped == 6


def test_a_file_gives_so_many_symbols_at_most(spark, monkeypatch):
    from evidencia.operators import symbols

    monkeypatch.setattr(symbols, "MOST_SYMBOLS", 2)
    rows = symbols.pattern_symbols(spark.createDataFrame([("a.py", "def a():\n  pass\ndef b():\n  pass\ndef c():\n  pass\n"), ("b.py", "def a(): pass\n")], SOURCE)).collect()
    assert {(r.path, r.name, r.truncated) for r in rows} == {("a.py", "a", True), ("a.py", "b", True), ("b.py", "a", False)}
