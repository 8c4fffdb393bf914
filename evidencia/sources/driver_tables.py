"""The evidence graph's relations over star-schema tables.

Each relation is one SELECT that Spark SQL and DuckDB both read; in braces stand the tables and
relations that it reads. ``Graph`` builds them as lazy frames, ``with_clause`` as one WITH list.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import stored, unbroadcast

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: Each line of an order and the part of the line after it.
_CHAIN = """select l_orderkey as k, l_partkey as a_id, l_linestatus, l_extendedprice, l_discount, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as b_id from {lineitem}"""


def _values(texts: list[str | None]) -> str:
    """A VALUES list of numbered texts; a tilde stands for a line's end."""
    shown = lambda t: "cast(null as varchar(20))" if t is None else f"'{t}'".replace("{", "{{").replace("}", "}}")
    return "(values " + ", ".join(f"({i}, {shown(t)})" for i, t in enumerate(texts)) + ")"


def _forms() -> str:
    """A VALUES list of the forms of code: kind, number, text and whether it is blank."""
    quote = lambda t: "'" + t.replace("{", "{{").replace("}", "}}") + "'"
    return "(values " + ", ".join(f"('{kind}', {i}, {quote(t)}, {str(blank).lower()})" for kind, forms in CODE_FORMS.items() for i, (t, blank) in enumerate(forms)) + ")"


#: Directories, file names, symbol names and file heads that the rules of classification tell apart.
DIRECTORIES = ["src/api/v1", "src/services", "src/utils/text", "src/components/cart", "src/playwright", "playwright/suites", "e2e-tests/lib", "tests/unit", "src/app/__tests__", "server/channels/app", "server/channels/testing", "webapp/channels/src/actions", "app/models", "src/main/java/org/shop/cart", "src/test/java/org/shop/cart", "app/models/tests", "tests/models", "cmd/worker", ".github/scripts", "lib/mock-store", "src/icons", "src/integration", "src/jobs", "core", "packages/cli/src", "src/fixtures", "src/api/store/carts", "src/api/admin/users"]
FILE_NAMES = ["order.ts", "orderService.ts", "order.test.ts", "order.spec.tsx", "order_test.go", "test_order.py", "OrderTest.java", "Latest.java", "OrderTests.cs", "LoadTest.cs", "order.d.ts", "order.e2e.ts", "cart.int.test.ts", "cart.api.test.ts", "cart.comp.test.tsx", "cart.unit.test.js", "order-helper.ts", "apitestlib.go", "README.md", "package.json", "jest.config.js", "schema.sql", "handler.py", "Makefile", "order_spec.rb", "OrderRepository.kt", "main.go", "index.ts", "testutils.ts", "order.py", "order.go", "Order.java", "text_test.py", "text.py", "CartIT.kt"]
FILE_HEADS = [
    "import { test } from \"@playwright/test\";~test(1)",
    "import request from \"supertest\";~import {app} from \"../app\";",
    "import {Pool} from \"pg\";~import {x} from \"./x\";",
    "import type {Pool} from \"pg\";~import {x} from \"./x\";",
    "import {type Pool} from \"pg\";~export const a = 1;",
    "import {render} from \"@testing-library/react\";",
    "cy.visit(\"/\");",
    "page.goto(\"/\");~import {x} from \"./x\";",
    "page.next();~import {x} from \"./x\";",
    "screen.getByText(\"a\");",
    "import {x} from \"./x\";~const a = <Cart/>;",
    "import {x} from \"pgx\";~request(app);",
    "// Code generated by protoc. DO NOT EDIT.~package main~func Run() {}",
    "package main~~// Code generated by mockgen~// DO NOT EDIT.~import \"fmt\"",
    "package main~import \"fmt\"~// Code generated by tpl. DO NOT EDIT.",
    "# Code generated by hand, edit freely~x = 1",
    None,
]
SYMBOL_NAMES = ["OrderService.createOrder", "OrderRepository.getOwner", "getOwner", "toString", "__repr__", "__init__", "CacheService.get", "PaymentProviderService.capture", "getUserConfig", "getRedisClient", "loadModules", "loadOrder", "Order.__joinerConfig", "listOrders", "parseText", "formatPrice", "Cart", "isOpen", "equals", "QueryBuilderService.buildQuery", "handleLogin", "main", "renderCart", "OrderController.find", "buildSchema", "archive_order", "MAX_SIZE", "hashCode", "get_x", "sumOf", "helper", "POST", "GET", "DELETE", "PUT", "PATCH", "captureStripe", "captureImage", "resetPassword", "sendEmail", "userProfile"]
SPECIFIERS = ["./a.css", "../order.js", "./cart.tsx", "./helpers", "/abs/path.mts", "node:fs", "fs", "lodash", "@scope/pkg", "@/store", "config", "config/x", "shared/text", "core", "corex/a", "./logo.SVG", "../lib/index.cjs"]
FAILURE_LINES = ["AssertionError: expected 1 to be 2", "expect(received).toBe(expected) redis", "Cannot find module node:sqlite", "Cannot find base config file ../tsconfig.json", "[TSCONFIG_ERROR] x", "Error: Cannot find package x", "Failed to resolve import y", "connect ECONNREFUSED 127.0.0.1", "PrismaClient init", "Connection timed out", "Segmentation fault", None, "SyntaxError: x to contain y", "Failed to load url z"]
NODE_RANGES = [None, ">=24.2.0 <25", ">=18", "^18", "^18 || ^23.1", "~23.5", "~20.1", "23", "23.5.1", ">24", ">22.9", "<=22", "<=23", "18 - 22", "latest", "*", ">=18 <23.6"]
#: Statements of scripts, which the words of conversations fill: names (%a to %d, %A), a file (%s) and a folder (%f).
SCRIPT_FORMS = [
    "export function %a(%b: string) {~  return %c(%b);~}",
    'export * from "./%s";',
    'export { %a, %b as %c } from "./%s.js";',
    'import { %a, type %b } from "./%s";',
    "export { %a as %c };",
    'export type { %a } from "../%f/%s";',
    "export const %a = %b(1), %c = [1, 2];",
    "export default class %A {~  %b() { return %c(); }~}",
    "export interface %A {~  %b: string;~}",
    'import %a from "@/%f/%s";',
    "class %A {~  %b() {~    return this.%c();~  }~  %c() { %a(); }~}",
    'export * as %a from "./%s";',
    "export declare function %a(): void;",
    'import * as %a from "%f/%s";',
    "async function %a() {~  await %b();~  %c.%d();~}",
    '// export { %a } from "./%s";',
    "export { %a };",
    'export { default as %a } from "./%s";',
    'import type { %a } from "./%s";~export { %a };',
    "export enum %A { %b }",
    'export abstract class %A {~  static %b() { return %A.%c(); }~}~export type * from "./%s";',
    "const %a = () => %b();",
    'import { %b, %a as %c } from "#kit/%s";',
]
#: Answers of models, which words fill; a tilde stands for a line's end, ^ for a backslash.
ANSWER_FORMS = [
    'Here you go:~```json~{"links": [{"behavior_id": "%a", "symbol_id": "%b", "confidence": 0.7}]}~```~Bye }',
    '```~[{"behavior_id": "%a", "symbol_id": "%b", "confidence": 1.7}, {"behavior_id": "%c", "symbol_id": "%d"}]~```',
    'Sure. {"links": [{"behavior_id": "%a", "symbol_id": "%b", "reasons": ["a } or { or ^" %c"]}]} ok?',
    'They are [{"behavior_id": "%a", "symbol_id": "", "confidence": 0.25}, {"behavior_id": "%b", "symbol_id": "%c ]", "confidence": 0.5}] as %d',
    "No links for %a and %b.",
    "Open { %a then [1, 2] follows",
    'Text ```JSON~  {"links": [{"symbol_id": "%a", "behavior_id": "%b", "confidence": 0}], "more": {"x": [1]}}  ~``` and {"links": [}',
    "%a [1, [2, {}]] and no more brackets",
    'First {"links": []} then %a ] [ }',
]
#: Statements of Python, Go and Java files, and whether nothing of them is left without comments and literals.
CODE_FORMS = {
    "py": [("def %a(%b):~    return %c", False), ("class %A(%B):~    def %b(self):~        pass~    async def %c(self):~        pass", False), ("# def %a(", True), ('"""~def %a():~class %A:~"""', True), ("class %A:~    x = 1", False), ("async def %a():~    pass", False), ('x = "def %a(" # class %A:', False), ("%a = lambda: %b(1)", False)],
    "go": [("func %A(x int) {~}", False), ("func %a() {~}", False), ("func (s *%A) %B() {~}", False), ("// func %A(", True), ("var x = `~func %A()~`", False), ("/* func %A() */", True), ("/*~func %B()~*/", True), ("type %A struct {~}", False)],
    "java": [("public class %A {~}", False), ("class %A {}", False), ("@Entity public class %A extends %B {~}", False), ('String s = "public class %A";', False), ("/*~public class %A~*/", True), ("  public static class %A {~  }", False), ("// public class %A", True), ("@Table(name) @Getter public class %B {~}", False)],
}
#: Where the configurations of scripts lie: base folder, pattern and targets in order.
SCRIPT_CONFIGS = [("", "src", "@/*", ["*"]), ("src/t", "src", "@/*", ["e/*", "*"]), ("src/a", None, "@/t/*", ["../t/*"])]
SCRIPT_PACKAGES = [("#kit", "src/t"), ("@scope/kit", "src/e")]
SYMBOL_KINDS = ["function", "method", "class", "const"]

RELATIONS: dict[str, str] = {
    "source_files": f"""
        select p_partkey as k, d.t || '/' || f.t as path, replace(c.t, '~', chr(10)) as content
        from {{part}} join {_values(DIRECTORIES)} d(i, t) on d.i = p_partkey % {len(DIRECTORIES)} join {_values(FILE_NAMES)} f(i, t) on f.i = cast(floor(p_partkey / 3) as bigint) % {len(FILE_NAMES)} join {_values(FILE_HEADS)} c(i, t) on c.i = cast(floor(p_partkey / 5) as bigint) % {len(FILE_HEADS)}""",
    "source_symbols": f"""
        select s.k, s.path, n.t as name, x.t as kind, case when s.k % 6 = 0 then 'OrderQueue' when s.k % 6 = 1 then '' end as member_of, case when s.k % 5 < 2 then s.k % 5 = 0 end as callable, case when s.k % 7 < 4 then s.k % 7 = 0 end as trivial, s.k % 19 = 0 as generated
        from {{source_files}} s join {_values(SYMBOL_NAMES)} n(i, t) on n.i = cast(floor(s.k / 2) as bigint) % {len(SYMBOL_NAMES)} join {_values(SYMBOL_KINDS)} x(i, t) on x.i = cast(floor(s.k / 7) as bigint) % {len(SYMBOL_KINDS)}""",
    "imports": f"""
        select x.k, s.t as specifier, case when x.k % 3 = 0 then 'test' else 'source' end as from_role, case when x.k % 5 = 1 then 'test' else 'source' end as target_role, case when x.k % 7 = 0 then 'type' else 'runtime' end as kind,
            x.returned <> 'R' as resolved, x.k % 11 = 0 or s.i in (6, 7, 8) as external, x.k % 4 = 0 as barrel, x.k % 9 <> 0 as named, x.k % 13 <> 0 as covered
        from (select l_orderkey * 8 + l_linenumber as k, l_returnflag as returned, l_partkey from {{lineitem}}) x join {_values(SPECIFIERS)} s(i, t) on s.i = x.l_partkey % {len(SPECIFIERS)}""",
    "file_links": """
        select distinct s.file as code_file, t.file as test_file, case when l_linestatus = 'F' then 'import' else 'stem' end as kind from {lineitem} join {symbols} s on s.k = l_partkey join {tests} t on t.k = l_suppkey where l_quantity <= 2 or (s.dir = 'utils' and l_quantity <= 20)""",
    "behavior_areas": """
        select external_id, case k % 6 when 0 then 'checkout' when 1 then 'utils' when 2 then 'medium' when 3 then 'promo' when 4 then 'controllers' end as area from {behaviors}""",
    "failures": f"""
        select e.event_id as k, replace(s.t, '~', chr(10)) as said, n.t as engines from {{events}} e join {_values(FAILURE_LINES)} s(i, t) on s.i = e.event_id % {len(FAILURE_LINES)} join {_values(NODE_RANGES)} n(i, t) on n.i = e.user_id % {len(NODE_RANGES)}""",
    "modules": """
        select distinct case when p_size % 4 = 0 then 'src/' || lower(p_type) || '/m' || p_size || '.test.ts' else 'src/' || lower(p_type) || '/m' || p_size || '.ts' end as path, p_size % 4 = 0 as is_test,
            case when p_size % 3 = 0 then 'src/' || lower(p_type) || '/n' || q || '.ts' when p_size % 3 = 1 then 'src/shared/n' || q || '/index.ts' else 'src/' || lower(p_type) || '/n' || q || '.test.tsx' end as target, p_size % 3 = 2 as target_is_test,
            case when p_size % 3 = 0 then './n' || q || '.js' when p_size % 3 = 1 then '../shared/n' || q else './n' || q || '.test' end as specifier, case when p_size % 5 = 0 then 'type' else 'runtime' end as kind
        from (select p_size, p_type, cast(floor(p_retailprice) as bigint) % 7 as q from {part}) x""",
    "orders_in_order": """
        select o_orderkey as ord, 1 + (o_custkey * 7 + o_orderkey) % n.n as k, case when o_orderkey % 4 = 0 then false when o_orderkey % 4 = 1 then true end as runnable from {orders} cross join (select count(*) as n from {part}) n""",
    "scored": """
        select event_id as k, ((event_id * 7) % 11) / 10.0 as acceptance_criteria, ((event_id * 3) % 11) / 10.0 as interface_mapping, ((event_id * 5) % 11) / 10.0 as validation_evidence, (event_id % 11) / 10.0 as known_regressions, ((event_id * 9) % 11) / 10.0 as provenance,
            (user_id % 4) * 50 as total, user_id % 3 as excluded_test_inferred, case when event_id % 5 < 2 then 0 else user_id % 4 end as requirement_template, case when event_id % 5 < 2 then 0 else event_id % 2 end as markdown_requirement, (event_id % 6) * 20 as code_export, event_id % 3 as requirements, event_id % 101 as overall from {events}""",
    "script_sentences": """
        select path, conv_id * 1000000 + turn * 10000 + i as ord, regexp_extract_all(try_element_at(said, cast(i as integer)), '[a-z]+', 0) as w
        from (select *, explode(sequence(1, array_size(said))) as i from (select conv_id, turn, regexp_extract_all(lower(text), '[^.]+', 0) as said, 'src/' || substr(regexp_extract(lower(text), '([a-z]+)', 1), 1, 1) || '/' || substr(regexp_extract(lower(text), '[a-z]+[^a-z]+([a-z]+)', 1), 1, 2) || case when role = 'user' and length(text) % 2 = 0 then '.test.ts' else '.ts' end as path
            from {conversations} where regexp_extract(lower(text), '[a-z]+[^a-z]+([a-z]+)', 1) <> '') t where array_size(said) > 0) x""",
    "script_words": """
        select path, ord, array_size(w) + length(try_element_at(w, 1)) as n, try_element_at(w, 1) as p, coalesce(try_element_at(w, 2), try_element_at(w, 1)) as q, coalesce(try_element_at(w, 3), try_element_at(w, 1)) as r, coalesce(try_element_at(w, 4), try_element_at(w, 2), try_element_at(w, 1)) as s from {script_sentences} where array_size(w) > 0""",
    "script_lines": f"""
        select x.path, x.ord, replace(replace(replace(replace(replace(replace(replace(replace(f.t, '%A', upper(substr(p, 1, 1)) || substr(p, 2, 2)), '%a', substr(p, 1, 2) || '1'), '%b', substr(q, 1, 2) || '1'), '%c', substr(r, 1, 2) || '1'), '%d', substr(s, 1, 2) || '1'), '%s', substr(s, 1, 2)), '%f', substr(r, 1, 1)), '~', chr(10)) as code
        from {{script_words}} x join {_values(SCRIPT_FORMS)} f(i, t) on f.i = x.n % {len(SCRIPT_FORMS)}""",
    "code_lines": f"""
        select x.path, x.ord, f.blank, replace(replace(replace(replace(replace(replace(f.t, '%A', upper(substr(p, 1, 1)) || substr(p, 2, 2)), '%B', upper(substr(q, 1, 1)) || substr(q, 2, 2)), '%a', substr(p, 1, 3)), '%b', substr(q, 1, 3)), '%c', substr(r, 1, 3)), '~', chr(10)) as code
        from (select replace(replace(path, '.test', ''), '.ts', '.' || kind) as path, ord, n, p, q, r, kind from (select *, case when substr(path, 5, 1) < 'f' then 'py' when substr(path, 5, 1) < 'o' then 'go' else 'java' end as kind from {{script_words}}) y) x
        join {_forms()} f(kind, i, t, blank) on f.kind = x.kind and f.i = x.n % 8""",
    "endpoints": """
        select e.external_id, e.title, s.external_id as symbol from (select 'endpoint:' || page_id as external_id, case length(url) % 4 when 0 then 'POST ' when 1 then 'DELETE ' else 'GET ' end || regexp_extract(url, '://[^/]*([^?#]*)', 1) as title, length(url) * 7 as n from {pages}) e
        join (select external_id, row_number() over (order by k) as n, count(*) over () as m from {symbols}) s on s.n = 1 + e.n % s.m""",
    "answers": f"""
        select x.ord as k, x.form, replace(replace(replace(replace(replace(replace(f.t, '%a', x.p), '%b', x.q), '%c', x.r), '%d', x.s), '~', chr(10)), '^', chr(92)) as text from (select *, (n + length(q)) % {len(ANSWER_FORMS)} as form from {{script_words}}) x join {_values(ANSWER_FORMS)} f(i, t) on f.i = x.form""",
    "attempts": """
        select f.k as ord, l.target_id as target_symbol, 'tests/t' || cast(f.k % 50 as varchar(20)) || '.test.ts' as test_path, case when f.k % 4 = 0 then 'non_killing' when f.k % 4 = 3 then 'proven' else 'needs_setup' end as classification,
            case when f.k % 13 = 0 then 'runner binary not found: vitest' when f.k % 13 = 1 then 'no go.mod found above ' || l.target_id when f.k % 13 = 2 then 'test title appears more than once' else f.said end as reason, f.engines, case when l.status = 'unproven' then 'associated_non_assertion_failure' when l.status = 'error' then 'survived' end as mutant_status
        from {failures} f join {ledger} l on l.idx = f.k""",
    "trigger_flows": """
        select o_orderkey as flow, lower(substr(o_orderpriority, 3)) as lane, substr(o_orderpriority, 3) as label, cast(substr(o_orderpriority, 1, 1) as integer) as priority from {orders} where o_orderpriority is not null""",
    "flow_steps": """
        select l_orderkey as flow, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place, case when s.end_line = 7 then '' when s.k % 3 = 0 then s.dir else s.file end as owner from {lineitem} join {symbols} s on s.k = l_partkey""",
    "owner_risks": """
        select row_number() over (order by p_retailprice desc, p_partkey) as rank, s.file as owner, p_size > 45 as critical from {part} join {symbols} s on s.k = p_partkey""",
    "owner_tiers": """
        select s.file as owner, case when t.strength = 'hard' then 'assoc' when t.strength is not null then 'candidate' when s.k % 11 = 0 then 'proven' else 'none' end as tier from {symbols} s left join (select p, min(strength) as strength from {symbol_tests} group by p) t on t.p = s.k""",
    "public_files": """
        select path from {source_files} where k % 8 = 0""",
    "parts": """
        select p_partkey as k, d as dir, 'src/' || d || '/' || lower(replace(p_brand, '#', '')) || '.ts' as file, 'fn' || cast(p_partkey as varchar(20)) as name, p_name as title, p_size, p_type
        from (select *, case p_partkey % 10 when 1 then 'controllers' when 2 then 'services' when 3 then 'utils' else lower(p_type) end as d from {part}) x""",
    "symbols": """
        select p.k, 'sym:' || p.file || '#' || p.name as external_id, p.file, p.dir, p.name, p.title, p.p_type, 1 as start_line, p.p_size as end_line, q.name as member_of,
            p.k % 5 <> 0 as eligible, p.k % 97 = 0 as stale,
            case when p.k % 5 <> 0 then null when cast(floor(p.k / 5) as bigint) % 3 = 0 then 'boilerplate accessor' when cast(floor(p.k / 5) as bigint) % 3 = 1 then 'infra code' else 'generated code' end as reason
        from {parts} p left join (select file, min(k) as k from {parts} group by file) f on f.file = p.file and f.k <> p.k and p.k % 3 = 0 left join {parts} q on q.k = f.k""",
    "tests": """
        select s_suppkey as k, 'test:tests/s' || cast(s_suppkey as varchar(20)) || '.test.ts' as external_id, 'tests/s' || cast(s_suppkey as varchar(20)) || '.test.ts' as file, s_name as title,
            case s_nationkey % 7 when 0 then 'unit' when 1 then 'component' when 2 then 'integration' when 3 then 'api' when 4 then 'e2e' when 5 then 'manual' else 'unknown' end as layer
        from {supplier}""",
    "behaviors": """
        select c_custkey as k, case when c_custkey % 3 = 0 then 'REQ-' else 'flow:' end || cast(c_custkey as varchar(20)) as external_id, case when c_custkey % 3 = 0 then 'Requirement' else 'UserFlow' end as kind, c_name as title, o.priority, c_custkey % 4 = 0 as inline_criteria
        from {customer} left join (select o_custkey, max_by(o_orderpriority, o_orderkey) as priority from {orders} group by o_custkey) o on o_custkey = c_custkey""",
    "nodes": """
        select k as ord, external_id, 'CodeSymbol' as kind, title, file, name, member_of, start_line, end_line, cast(null as varchar(20)) as layer, cast(null as varchar(20)) as priority, false as inline_criteria, eligible, reason, stale, 'code_export' as behavior_source, cast(0.9 as double) as confidence from {symbols}
        union all select 10000000 + k, external_id, 'TestCase', title, file, null, null, null, null, layer, null, false, false, null, false, null, cast(0.9 as double) from {tests}
        union all select 20000000 + k, external_id, kind, title, null, null, null, null, null, null, priority, inline_criteria, true, null, false, case when kind = 'Requirement' then 'requirement_template' else 'test_inferred' end, cast(0.8 as double) from {behaviors}
        union all select 30000000 + min(k), file, 'File', file, file, null, null, null, null, null, null, false, false, null, false, null, cast(1.0 as double) from {symbols} group by file
        union all select 40000000 + k, 'AC-' || cast(k as varchar(20)), 'AcceptanceCriterion', title, null, null, null, null, null, null, null, false, false, null, false, null, cast(0.8 as double) from {behaviors} where k % 6 = 0""",
    "symbol_tests": """
        select l_partkey as p, l_suppkey as s, case when min(l_linestatus) = 'F' then 'hard' else 'reviewed' end as strength from {lineitem} where l_returnflag = 'R' group by l_partkey, l_suppkey having sum(l_quantity) > 47""",
    "behavior_tests": """
        select o_custkey as c, l_suppkey as s from {orders} join {lineitem} on l_orderkey = o_orderkey where l_returnflag = 'R' group by o_custkey, l_suppkey having sum(l_quantity) > 48""",
    "calls": f"""
        select a_id, max_by(b_id, (l_extendedprice, k, b_id)) as b_id, case when max(k) % 3 = 0 then 'framework-derived' else 'hard' end as strength, min(k) as ord from ({_CHAIN}) x where b_id is not null and a_id <> b_id group by a_id, l_linestatus""",
    "may_calls": f"""
        select a_id, max_by(b_id, (l_discount, k, b_id)) as b_id, 'candidate' as strength, min(k) as ord from ({_CHAIN}) x where b_id is not null and a_id <> b_id group by a_id""",
    "edges": """
        select x.p * 10000 + x.s as ord, a.external_id as from_id, b.external_id as to_id, 'TESTED_BY' as type, x.strength from {symbol_tests} x join {symbols} a on a.k = x.p join {tests} b on b.k = x.s
        union all select x.p * 10000 + x.s, b.external_id, a.external_id, 'COVERS', x.strength from {symbol_tests} x join {symbols} a on a.k = x.p join {tests} b on b.k = x.s
        union all select 1000000000000 + x.c * 10000 + x.s, a.external_id, b.external_id, 'TESTED_BY', 'hard' from {behavior_tests} x join {behaviors} a on a.k = x.c join {tests} b on b.k = x.s
        union all select 2000000000000 + x.ord, a.external_id, b.external_id, 'CALLS', x.strength from {calls} x join {symbols} a on a.k = x.a_id join {symbols} b on b.k = x.b_id
        union all select 3000000000000 + min(x.ord), a.file, b.file, 'IMPORTS', 'hard' from {calls} x join {symbols} a on a.k = x.a_id join {symbols} b on b.k = x.b_id where a.file <> b.file group by a.file, b.file
        union all select 4000000000000 + k, external_id, 'AC-' || cast(k as varchar(20)), 'HAS_ACCEPTANCE_CRITERION', 'hard' from {behaviors} where k % 6 = 0""",
    "candidates": """
        select x.p * 10000 + x.s as ord, a.external_id as from_id, b.external_id as to_id, 'MAY_BE_TESTED_BY' as type, x.confidence, x.p % 11 = 0 as ai_suggested
        from (select l_partkey as p, l_suppkey as s, least(0.9, 0.28 + max(l_discount)) as confidence from {lineitem} where l_returnflag = 'A' group by l_partkey, l_suppkey having sum(l_quantity) > 47) x join {symbols} a on a.k = x.p join {tests} b on b.k = x.s
        union all select 1000000000000 + x.c * 10000 + x.s, a.external_id, b.external_id, 'MAY_BE_TESTED_BY', 0.5, false
        from (select o_custkey as c, l_suppkey as s from {orders} join {lineitem} on l_orderkey = o_orderkey where l_returnflag = 'A' group by o_custkey, l_suppkey having sum(l_quantity) > 47) x join {behaviors} a on a.k = x.c join {tests} b on b.k = x.s
        union all select 2000000000000 + x.ord, a.external_id, b.external_id, 'MAY_CALL', 0.55, false from {may_calls} x join {symbols} a on a.k = x.a_id join {symbols} b on b.k = x.b_id""",
    "commits": """
        select s.file, l_shipdate as ts, cast(l_quantity as bigint) as adds, cast(l_linenumber as bigint) as dels from {lineitem} join {symbols} s on s.k = l_partkey""",
    "ledger": """
        select event_id as idx, ts, s.external_id as target_id,
            case event_type when 'purchase' then 'reproven' when 'signup' then 'reproven' when 'error' then 'unproven' when 'view' then 'already_proven' else 'generated_unverifiable' end as status,
            event_type = 'purchase' as closed, event_type = 'purchase' as dynamic_proof, event_id % 3 <> 0 as fingerprint_matches
        from {events} cross join (select count(*) as n from {part}) p join {symbols} s on s.k = (user_id * 7 + event_id) % p.n""",
    "coverage_ranges": """
        select s.file, cast(20 + x.lines % 25 as integer) as start_line, cast(23 + x.lines % 25 as integer) as end_line, case when x.status = 'F' then 'lcov' else 'go' end as format from (select l_partkey as p, sum(l_linenumber) as lines, min(l_linestatus) as status from {lineitem} group by l_partkey, l_returnflag) x join {symbols} s on s.k = x.p""",
    "file_keys": """
        select file, min(k) as k from {symbols} group by file""",
    "manifest_before": """
        select file as rel_path, 'h' || cast(k as varchar(20)) as hash from {file_keys}""",
    "manifest_now": """
        select file as rel_path, 'h' || cast(k as varchar(20)) || case when k % 7 = 0 then 'x' else '' end as hash from {file_keys} where k % 11 <> 0
        union all select 'src/new/' || lower(replace(r_name, ' ', '-')) || '.ts', 'n' || cast(r_regionkey as varchar(20)) from {region}""",
    "generated": """
        select o_orderkey as ord, 'gen:' || cast(o_orderkey as varchar(20)) as test_id, l_linenumber as place, case when o_orderkey % 9 = 0 then 'sym:missing#' || cast(l_partkey as varchar(20)) else s.external_id end as entity_id, o_orderkey % 3 = 0 as runnable, o_orderkey % 40 as bucket_no, o_orderdate as created_at
        from {orders} join {lineitem} on l_orderkey = o_orderkey join {symbols} s on s.k = l_partkey""",
    "pings": """
        select event_id as id, event_type as lang, case when value < 10 then '0-10' when value < 50 then '10-50' when value < 100 then '50-100' else '100+' end as file_bucket, event_id % 2 as has_byok, value as duration, cast(user_id % 5 as varchar(20)) as version, ts from {events}""",
    "changed_files": """
        select distinct file from {symbols} where end_line = 50""",
}


#: Names of functions over lists that the relations use, as Spark and as DuckDB have them.
DIALECT = {"try_element_at(": "list_extract(", "array_size(": "len(", "explode(": "unnest(", "sequence(": "generate_series("}


def _in_duckdb(sql: str) -> str:
    for spark, other in DIALECT.items():
        sql = sql.replace(spark, other)
    return sql


def _names(sql: str) -> list[str]:
    import string

    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(sql) if f))


def with_clause(*wanted: str) -> str:
    """WITH list of the relations and of what they read, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in RELATIONS and name not in order:
            for n in _names(RELATIONS[name]):
                add(n)
            order.append(name)

    for name in wanted:
        add(name)
    return "with " + ", ".join(f"{n} as ({_in_duckdb(RELATIONS[n].format(**{x: x for x in _names(RELATIONS[n])}))})" for n in order)


#: Numbers of a run in ``numbered``.
RUN = 4096


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with ``n``, their place in the order of a whole number that none share: places in runs of numbers, and how
    many rows lie before each run, so that no task orders all rows."""
    rows = rows.withColumn("run", F.floor(F.col(key) / RUN))
    before = F.coalesce(F.sum("count").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each run
    starts = rows.groupBy("run").count().select("run", before.alias("before"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy(key))).join(starts, "run").withColumn("n", F.col("n") + F.col("before")).drop("run", "before")


def endpoints(g: Graph) -> DataFrame:
    """The relation ``endpoints`` by equal keys: its SELECT takes a remainder by the number of symbols inside the condition of a join,
    which holds every page against every symbol. Pages meet the symbols by the length of their url alone."""
    size = F.length("url")
    verb = F.when(size % 4 == 0, "POST ").when(size % 4 == 1, "DELETE ").otherwise("GET ")
    pages = g.pages.select(F.concat(F.lit("endpoint:"), F.col("page_id").cast("string")).alias("external_id"), F.concat(verb, F.regexp_extract("url", "://[^/]*([^?#]*)", 1)).alias("title"), size.alias("size"))
    count = g.symbols.agg(F.count("*").alias("m"))
    wanted = pages.select("size").distinct().crossJoin(F.broadcast(count)).select("size", (1 + F.col("size") * 7 % F.col("m")).alias("n"))  # one row beside
    chosen = numbered(g.symbols.select("k", F.col("external_id").alias("symbol")), "k").join(F.broadcast(wanted), "n").select("size", "symbol")  # one row for each length
    return pages.join(F.broadcast(chosen), "size").select("external_id", "title", "symbol")


def owner_risks(g: Graph) -> DataFrame:
    """The relation ``owner_risks`` with ranks that no task alone gives out: the rows lie in runs of the order, and a row's rank is
    its place in its run behind the rows of all runs before. The runs are written, so that both counts see the same ones."""
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    rows = g.part.select("p_retailprice", "p_partkey", "p_size").join(g.symbols.select(F.col("k").alias("p_partkey"), F.col("file").alias("owner")), "p_partkey")
    runs = stored(rows.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "runs")
    before = F.coalesce(F.sum("count").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each run
    starts = runs.groupBy("run").count().select("run", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(*order))
    return runs.withColumn("place", place).join(F.broadcast(starts), "run").select((F.col("before") + F.col("place")).alias("rank"), "owner", (F.col("p_size") > 45).alias("critical"))


#: Relations that Spark builds in a way of its own; DuckDB reads their SELECT.
BUILT = {"endpoints": endpoints, "owner_risks": owner_risks}


class Graph:
    """Lazy frames of the relations over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name in RELATIONS:
            return self.get(name)
        raise AttributeError(name)

    def get(self, name: str) -> DataFrame:
        if name not in self.frames:
            if name in BUILT:
                self.frames[name] = BUILT[name](self)
            elif name in RELATIONS:
                self.frames[name] = self.spark.sql(RELATIONS[name], **{n: self.get(n) for n in _names(RELATIONS[name])})
            else:
                self.frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.frames[name]

    def settle(self, *names: str, broadcast: bool = True) -> Graph:
        """Writes relations that a query reads many times, so that they are worked out once; in the order given. Without ``broadcast``,
        joins don't send large ones through the driver."""
        for name in names:
            rows = stored(self.get(name), name)
            self.frames[name] = rows if broadcast else unbroadcast(rows)
        return self

    @cached_property
    def live_symbols(self) -> DataFrame:
        return self.nodes.where("kind = 'CodeSymbol' and eligible and not stale")
