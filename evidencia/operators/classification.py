"""What a file and a symbol are: language, role, test layer, boilerplate, behaviour surface, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import any_of, any_sql, first_of, first_sql, quoted
from ..registry import query
from ..sources.driver_tables import Graph

#: Language of each file extension (fixed values).
LANGUAGES = {
    "typescript": ["ts", "tsx", "mts", "cts"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py"],
    "go": ["go"],
    "ruby": ["rb"],
    "java": ["java"],
    "kotlin": ["kt"],
    "rust": ["rs"],
    "php": ["php"],
    "csharp": ["cs"],
    "swift": ["swift"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "markdown": ["md"],
    "json": ["json"],
    "yaml": ["yaml", "yml"],
    "toml": ["toml"],
    "sql": ["sql"],
}
#: Shown names of languages (fixed values).
LABELS = {"typescript": "TypeScript/JavaScript", "javascript": "TypeScript/JavaScript", "python": "Python", "go": "Go", "java": "Java", "ruby": "Ruby", "kotlin": "Kotlin", "rust": "Rust", "php": "PHP", "csharp": "C#", "swift": "Swift", "c": "C", "cpp": "C++"}
DOC_EXTENSIONS = ["md", "mdx", "rst", "txt", "adoc"]
NOT_CODE = ["md", "json", "yaml", "yml", "toml"]
#: Base names of configuration files (fixed values).
CONFIG_NAMES = ["package.json", "tsconfig.json", "vitest.config.ts", "vitest.config.js", "jest.config.js", "jest.config.ts", "playwright.config.ts", "playwright.config.js", "cypress.config.ts", "cypress.config.js", "pytest.ini", "tox.ini", "pyproject.toml", "requirements.txt", "setup.cfg", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "gemfile", "dockerfile", ".eslintrc.js", ".eslintrc.json", "vite.config.ts", "next.config.js", "next.config.ts"]
CONFIG_PATTERN = r"\.config\.[cm]?[jt]s$"

#: Test files, by the path in lower case (fixed values).
TEST_PATHS = [r"\.(test|spec)\.[a-z]+$", r"(^|/)test\.[cm]?[jt]sx?$", r"(^|/)__tests__/", r"(^|/)(tests?|e2e|cypress|spec)/", r"(^|/)(unit|integration|functional|acceptance)tests?/", r"_test\.(py|go)$", r"test_.*\.py$"]
#: Test files, by the base name as written (fixed values).
TEST_NAMES = [r"Tests\.[cC][sS]$", r"(?:^Test[A-Z0-9_].*|.*(?:Test|Tests|ITCase|TestCase)|.*[a-z0-9]IT)\.(java|kt)$", r"(?i)(?:^test_[^/]+|[^/]+_(?:test|spec))\.rb$"]
#: Test support, by the path in lower case and by the base name in lower case (fixed values).
SUPPORT_PATHS = [r"(^|/)__mocks__/", r"(^|/)__fixtures__/", r"(^|/)(mocks?|fixtures?|testdata|testlib|mock[-_][^/]+|[^/]+[-_]mock)/", r"(^|/)testing/[^/]*(mock|test(?:ing)?[-_]?utils?)"]
SUPPORT_NAMES = [r"\.(mocks?|fixtures?)\.", r"^testdata\.[a-z0-9]+$", r"testlib\.[a-z0-9]+$", r"-helpers?\.[a-z0-9]+$", r"^test[-_]", r"^testutils?\."]
#: Test infrastructure beside test support (fixed value).
INFRA_PATH = r"(?i)(^|/)(e2e[-_]?tests?|e2e|__tests__|tests?|cypress|playwright|specs?|__mocks__|fixtures|testdata|testlib|test[-_]?utils?|mock[-_][^/]+|[^/]+[-_]mock)/"
#: Paths that are no product (fixed values).
NON_PRODUCT = [
    r"(^|/)\.github(/|$)",
    r"(^|/)(__mocks__|__fixtures__|__tests__|mocks?|fixtures?|testdata|testlib|mock[-_][^/]+|[^/]+[-_]mock)/",
    r"(?i)(^|/)[^/]*testlib\.[a-z0-9]+$",
    r"(?i)(^|/)testdata\.[a-z0-9]+$",
    r"(?i)(^|/)testing/[^/]*(mock|test(?:ing)?[-_]?utils?)[^/]*\.[a-z0-9]+$",
    r"^(?:\./)?(e2e|e2e[-_]tests?|cypress|playwright|tests?|specs?)/",
]
#: Test layers by path in lower case, the first that fits (fixed values).
PATH_LAYERS = [
    ("e2e", [r"(^|/)(e2e)/", r"\.e2e\.", "playwright", "cypress"]),
    ("integration", [r"(^|/)integration/", r"\.integration\.", r"\.int\."]),
    ("api", [r"(^|/)(api)/", r"\.api\."]),
    ("component", [r"\.(component|comp)\.", "/components/"]),
    ("unit", [r"(^|/)(unit)/", r"\.(unit)\."]),
]


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, in lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def extension_sql(path: str) -> str:
    return rf"lower(regexp_extract({path}, '\.([^./]*)$', 1))"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def base_sql(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def language(path: Column) -> Column:
    return first_of([(extension(path).isin(exts), name) for name, exts in LANGUAGES.items()], "other")


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def language_sql(path: str) -> str:
    return first_sql([(f"{extension_sql(path)} in {_in(exts)}", quoted(name)) for name, exts in LANGUAGES.items()], "'other'")


def language_label(name: Column) -> Column:
    return first_of([(name == k, v) for k, v in LABELS.items()], F.when(name == "", "Unknown").otherwise(name))


def label_sql(name: str) -> str:
    return first_sql([(f"{name} = {quoted(k)}", quoted(v)) for k, v in LABELS.items()], f"coalesce(nullif({name}, ''), 'Unknown')")


def is_test(path: Column) -> Column:
    return any_of(F.lower(path), TEST_PATHS) | any_of(base_name(path), TEST_NAMES)


def is_test_support(path: Column) -> Column:
    return any_of(F.lower(path), SUPPORT_PATHS) | any_of(F.lower(base_name(path)), SUPPORT_NAMES)


def is_test_infra(path: Column) -> Column:
    return any_of(path, [INFRA_PATH]) | is_test_support(path)


def is_non_product(path: Column) -> Column:
    return any_of(path, NON_PRODUCT)


def role(path: Column) -> Column:
    base, ext = F.lower(base_name(path)), extension(path)
    config = base.isin(CONFIG_NAMES) | base.rlike(CONFIG_PATTERN)
    code = (language(path) != "other") & ~ext.isin(NOT_CODE)
    return first_of([(is_test(path), "test"), (config, "config"), (ext.isin(DOC_EXTENSIONS), "doc"), (code, "code")], "other")


def path_layer(path: Column) -> Column:
    """The test layer that a path alone tells; a path never says ``unit`` for want of anything else."""
    return first_of([(any_of(F.lower(path), p), name) for name, p in PATH_LAYERS], "unknown")


def path_layer_sql(path: str) -> str:
    return first_sql([(any_sql(f"lower({path})", p), quoted(name)) for name, p in PATH_LAYERS], "'unknown'")


def is_test_sql(path: str) -> str:
    return f"({any_sql(f'lower({path})', TEST_PATHS)} or {any_sql(base_sql(path), TEST_NAMES)})"


def role_sql(path: str) -> str:
    base, ext = f"lower({base_sql(path)})", extension_sql(path)
    return first_sql(
        [
            (is_test_sql(path), "'test'"),
            (f"({base} in {_in(CONFIG_NAMES)} or regexp_matches({base}, {quoted(CONFIG_PATTERN)}))", "'config'"),
            (f"{ext} in {_in(DOC_EXTENSIONS)}", "'doc'"),
            (f"({language_sql(path)} <> 'other' and {ext} not in {_in(NOT_CODE)})", "'code'"),
        ],
        "'other'",
    )


SUPPORT_SQL = f"({any_sql('lower(path)', SUPPORT_PATHS)} or {any_sql(f'lower({base_sql("path")})', SUPPORT_NAMES)})"


@query(
    "path_roles",
    "source_files",
    f"""select k, path, {language_sql("path")} as language, {label_sql(language_sql("path"))} as label, {role_sql("path")} as role, {is_test_sql("path")} as is_test, {SUPPORT_SQL} as is_support,
    ({any_sql("path", [INFRA_PATH])} or {SUPPORT_SQL}) as is_infra, {any_sql("path", NON_PRODUCT)} as is_non_product from source_files""",
)
def _roles(g: Graph) -> DataFrame:
    p = F.col("path")
    return g.source_files.select("k", "path", language(p).alias("language"), language_label(language(p)).alias("label"), role(p).alias("role"), is_test(p).alias("is_test"), is_test_support(p).alias("is_support"), is_test_infra(p).alias("is_infra"), is_non_product(p).alias("is_non_product"))


@query("path_layers", "source_files", f"select k, path, {path_layer_sql('path')} as layer from source_files")
def _path_layers(g: Graph) -> DataFrame:
    return g.source_files.select("k", "path", path_layer(F.col("path")).alias("layer"))


#: Imports that pin a test's layer; one with a slash at its end stands for all below it (fixed values).
LAYER_IMPORTS = {
    "e2e": ["@playwright/test", "playwright", "cypress", "@cypress/", "puppeteer", "webdriverio", "@wdio/"],
    "api": ["supertest", "@nestjs/testing"],
    "integration": ["testcontainers", "@testcontainers/", "pg", "mongodb", "mongoose", "ioredis", "redis", "mysql", "mysql2", "better-sqlite3", "knex", "typeorm", "prisma"],
    "component": ["@testing-library/", "@vue/test-utils", "enzyme", "@solidjs/testing-library"],
}
#: Calls that do so (fixed values).
LAYER_CALLS = {
    "e2e": [r"\b(?:cy|browser)\.\w+\s*\(", r"\bpage\.(?:goto|waitForURL|waitForNavigation|locator|getBy\w+|click|fill|press|check|selectOption)\s*\("],
    "component": [r"\b(?:screen|userEvent)\.\w+\s*\("],
}
SCRIPT_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs"]
#: ``import`` statements that run code: ``import type`` and imports of types alone are left out.
RUNTIME_IMPORT = r"""(?m)^[ \t]*import(?:[ \t]+(?:\w[\w$]*[ \t]*(?:,[ \t]*)?)?(?:\*[ \t]+as[ \t]+\w+|\{[^}]*\})?[ \t]*from)?[ \t]*["']([^"']+)["']"""
TYPE_IMPORT = r"""(?m)^[ \t]*import[ \t]+(?:type[ \t]+[^'"]*|\{(?:[ \t\n]*type[ \t]+[\w$]+(?:[ \t]+as[ \t]+[\w$]+)?[ \t\n]*,?)+\}[ \t]*)from[ \t]*["'][^"']+["']"""
JSX = r"<[A-Za-z][\w.]*(?:\s[^<>]*)?/>|</[A-Za-z][\w.]*>|<>"


def _import_pattern(names: list[str]) -> str:
    """A specifier that is one of the names or below one of them."""
    import re

    return "^(?:" + "|".join(re.escape(n) + ("" if n.endswith("/") else "(?:/|$)") for n in names) + ")"


def runtime_imports(content: Column) -> Column:
    """Specifiers of the imports that run code."""
    return F.regexp_extract_all(F.regexp_replace(content, TYPE_IMPORT, ""), F.lit(RUNTIME_IMPORT), F.lit(1))


def test_layer(path: Column, content: Column) -> tuple[Column, Column, Column]:
    """Layer, confidence and signal of a test file by its imports and calls; by its path where the text
    says nothing to read. Statements are found by patterns: imports that begin a line, calls by name."""
    readable = extension(path).isin(SCRIPT_EXTENSIONS) & (F.coalesce(content, F.lit("")) != "")
    specs = runtime_imports(content)
    by_path = path_layer(path)

    def imported(layer: str) -> Column:
        pattern = _import_pattern(LAYER_IMPORTS[layer])
        return F.get(F.filter(specs, lambda s: s.rlike(pattern)), F.lit(0))

    def called(layer: str) -> Column:
        found = [F.nullif(F.regexp_extract(content, p, 0), F.lit("")) for p in LAYER_CALLS[layer]]
        return F.regexp_replace(F.coalesce(*found), r"\s*\($", "")

    jsx = F.when(content.rlike(JSX) & extension(path).isin("tsx", "jsx"), "jsx")
    signals = [
        ("e2e", F.coalesce(imported("e2e"), called("e2e"))),
        ("api", imported("api")),
        ("integration", imported("integration")),
        ("component", F.coalesce(imported("component"), called("component"), jsx)),
    ]
    internal = F.exists(specs, lambda s: s.startswith(".") | s.startswith("/"))
    layer = first_of([(~readable, by_path), *[(s.isNotNull(), name) for name, s in signals], (internal, "unit")], "unknown")
    confidence = first_of([(~readable & (by_path != "unknown"), "low"), (~readable, "none"), *[(s.isNotNull(), "high") for _, s in signals], (internal, "medium")], "none")
    signal = first_of([(~readable & (by_path != "unknown"), F.concat(F.lit("path:"), by_path)), (~readable, ""), *[(s.isNotNull(), F.concat(F.lit(f"{name}:"), s)) for name, s in signals], (internal, "unit:internal-import")], "")
    return layer, confidence, signal


def _layers_sql() -> str:
    specs = f"regexp_extract_all(regexp_replace(content, {quoted(TYPE_IMPORT)}, '', 'g'), {quoted(RUNTIME_IMPORT)}, 1)"
    imported = lambda layer: f"list_filter(specs, lambda s: regexp_matches(s, {quoted(_import_pattern(LAYER_IMPORTS[layer]))}))[1]"
    called = lambda layer: "regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract(content, {quoted(p)}, 0), '')" for p in LAYER_CALLS[layer]) + r"), '\s*\($', '')"
    jsx = f"case when regexp_matches(content, {quoted(JSX)}) and {extension_sql('path')} in ('tsx', 'jsx') then 'jsx' end"
    return f"""select k, path, {first_sql([("not readable", "by_path"), ("e2e is not null", "'e2e'"), ("api is not null", "'api'"), ("integration is not null", "'integration'"), ("component is not null", "'component'"), ("internal", "'unit'")], "'unknown'")} as layer,
        {first_sql([("not readable and by_path <> 'unknown'", "'low'"), ("not readable", "'none'"), ("coalesce(e2e, api, integration, component) is not null", "'high'"), ("internal", "'medium'")], "'none'")} as confidence,
        {first_sql([("not readable and by_path <> 'unknown'", "'path:' || by_path"), ("not readable", "''"), ("e2e is not null", "'e2e:' || e2e"), ("api is not null", "'api:' || api"), ("integration is not null", "'integration:' || integration"), ("component is not null", "'component:' || component"), ("internal", "'unit:internal-import'")], "''")} as signal
        from (select *, coalesce({imported("e2e")}, {called("e2e")}) as e2e, {imported("api")} as api, {imported("integration")} as integration, coalesce({imported("component")}, {called("component")}, {jsx}) as component,
            len(list_filter(specs, lambda s: starts_with(s, '.') or starts_with(s, '/'))) > 0 as internal
        from (select *, {specs} as specs, {path_layer_sql("path")} as by_path, {extension_sql("path")} in {_in(SCRIPT_EXTENSIONS)} and coalesce(content, '') <> '' as readable from source_files) x) y"""


@query("test_layers", "source_files", _layers_sql())
def _test_layers(g: Graph) -> DataFrame:
    layer, confidence, signal = test_layer(F.col("path"), F.col("content"))
    return g.source_files.select("k", "path", layer.alias("layer"), confidence.alias("confidence"), signal.alias("signal"))


#: Comment lines, and what stands before declarations begin (fixed values).
COMMENT = r"^(?://|#|/\*|\*)"
PACKAGE_LINE = r"^package\s+[A-Za-z_][A-Za-z0-9_]*\s*;?$"


def is_generated(content: Column) -> Column:
    """Whether the comments before the first declaration say that the file is generated."""
    lines = F.transform(F.split(F.substring(F.coalesce(content, F.lit("")), 1, 8192), "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    comment = lambda x: x.rlike(COMMENT)
    other = F.transform(lines, lambda x, i: F.when((x != "") & ~comment(x) & ~x.rlike(PACKAGE_LINE), i))
    head = F.slice(lines, 1, F.coalesce(F.array_min(other), F.size(lines)))
    marked = lambda x, i: comment(x) & x.rlike(r"\bCode generated\b") & F.exists(F.filter(F.slice(lines, i + 1, 6), lambda y: (y == "") | comment(y)), lambda y: y.contains("DO NOT EDIT"))
    return F.exists(F.transform(head, marked), lambda b: b)


@query(
    "generated_code",
    "source_files",
    f"""select k, path, coalesce(len(list_filter(list_transform(range(1, len(head) + 1), lambda i: regexp_matches(head[i], '{COMMENT}') and regexp_matches(head[i], '\\bCode generated\\b')
        and len(list_filter(list_slice(lines, i, i + 5), lambda y: (y = '' or regexp_matches(y, '{COMMENT}')) and contains(y, 'DO NOT EDIT'))) > 0), lambda b: b)) > 0, false) as is_generated
    from (select *, list_slice(lines, 1, coalesce(list_min(list_filter(range(1, len(lines) + 1), lambda i: lines[i] <> '' and not regexp_matches(lines[i], '{COMMENT}') and not regexp_matches(lines[i], '{PACKAGE_LINE}'))) - 1, len(lines))) as head
    from (select *, list_transform(regexp_split_to_array(left(coalesce(content, ''), 8192), '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as lines from source_files) x) y""",
)
def _generated(g: Graph) -> DataFrame:
    return g.source_files.select("k", "path", is_generated(F.col("content")).alias("is_generated"))


def is_boilerplate(name: Column, lang: Column, kind: Column, trivial: Column) -> Column:
    """Accessors and object methods without behaviour, by language."""
    jvm = F.when(name.rlike("^(get|set|is)[A-Z]"), F.coalesce(trivial, F.lit(False))).otherwise(name.isin("toString", "equals", "hashCode"))
    by_language = F.when(lang.isin("java", "kotlin"), jvm).when(lang == "python", name.isin("__repr__", "__str__")).otherwise(False)
    return kind.isin("method", "function") & F.coalesce(by_language, F.lit(False))


BOILERPLATE_SQL = """(kind in ('method', 'function') and case when language in ('java', 'kotlin') then case when regexp_matches(name, '^(get|set|is)[A-Z]') then coalesce(trivial, false) else name in ('toString', 'equals', 'hashCode') end
    when language = 'python' then name in ('__repr__', '__str__') else false end)"""

#: Where behaviour lives: paths, service paths, file names, symbol names, owners (fixed values).
SURFACE_PATH = r"(?i)(^|/)(api|apis|routes?|router|controllers?|handlers?|jobs?|workers?|queues?|processors?|resolvers?|commands?|cmd|webhooks?|listeners?|subscribers?|consumers?)(/|$)"
SERVICE_PATH = r"(?i)(^|/)(services?|svc)(/|$)|(^|/)[^/]*service\.[^./]+$"
SURFACE_FILE = r"(?i)(^|/)[^/]*(api|controller|service|handler|resolver|processor|job|worker|queue|consumer|subscriber|listener|command|gateway|route|router)\.[^./]+$"
SURFACE_NAME = r"(?i)(^|[.#])(__init__|handle|handler|route|controller|service|resolver|processor|job|worker|queue|consumer|subscriber|listener|command|gateway|execute|process|consume|dispatch|schedule|upload|download|sync|checkout|charge|refund|capture|authorize|login|logout|register|find|search|list|create|update|delete|remove|archive|enable|disable|validate|get|add|sub|sum|total|save|load|render|run|main|root|child|mul|about|behavior)([A-Z0-9_]|$)"
CLIENT_FACTORY = r"(^|[.#])get[A-Z0-9_].*Client$"
SURFACE_OWNER = r"(Service|Controller|Resolver|Handler|Processor|Job|Worker|Queue|Consumer|Subscriber|Listener|Command|Gateway|Route|Router)$"
#: What is no behaviour, in this order (fixed values).
UTILITY_PATH = r"(?i)/(utils?|helpers?|tools?|loaders?|dml|dal|orchestration|codemods?|oas|models?|migrations?|migration-scripts?|instrumentation|eslint-plugin)/"
ASSET_PATH = r"(?i)/(?:icons?|assets?)/"
HOOK_METHOD = r"^__(joinerConfig|hooks|definition)$"
INFRA_OWNER = r"^(?:(InMemory|Redis|Pg|Mongo|Mikro|TypeOrm|Knex).*Service|(Cache|Caching|EventBus|JobScheduler|RemoteQuery|Index|Search|QueryBuilder).*Service)$"
INFRA_METHOD = r"^get[A-Z0-9_].*(Identifier|RegistrationKey|Config|Registry|Options|Settings|Path|Directory|TmpDir|Program|PackageManager|Command|Expression|Recommendation|CircularReferences|PivotTableName|PropertyName|PropertyKey|UnderlyingType|ComputedColumnRegistry|EntityOverrideRegistry|InverseRegistry|RelativeDate|SelectsAndRelations|SetDifference|ResolvedPlugins|Token|Scope|Module|Column|Pivot|Ttl|Timeout|Interval|Size|Limit|Offset|Prefix|Suffix|Pattern|Handler|Resource)$"
BOOTSTRAP_METHOD = r"^(load|build|compile)(Modules?|Routes?|Routers?|Plugins?|Config|Schema|Program|Package|Project|Files?|Commands?|Migrations?|Definitions?|Manifest|Artifacts?)([A-Z0-9_]|$)"
#: Reasons (fixed values).
REASON_UTILITY = "Utility/model/tooling path — infrastructure plumbing, excluded from the behavior denominator."
REASON_ASSET = "Presentation asset/icon path — excluded from the behavior denominator."
REASON_HOOK = "Framework lifecycle hook — excluded from the behavior denominator."
REASON_OWNER = ("Method of infrastructure service ", " — excluded from the behavior denominator.")
REASON_METHOD = "Infrastructure accessor/registry method — excluded from the behavior denominator."
REASON_BOOTSTRAP = "Framework/build bootstrap method — excluded from the behavior denominator."
REASON_PATH = "API/service/route/job-adjacent source path — countable behavior surface."
REASON_SURFACE_OWNER = ("Method of ", " — service/API/job-adjacent behavior surface.")
REASON_SERVICE = "Service-adjacent behavior-like function — countable behavior surface."
REASON_NAME = "Handler/service/job-like symbol name — countable behavior surface."
REASON_DTS = "Type declaration (.d.ts/.d.mts/.d.cts) — no runtime behavior to test."
REASON_NON_PRODUCT = "CI/test-infra path (.github, e2e/cypress/playwright suite, mocks/fixtures/testdata/testlib) — not product behavior."
REASON_GENERATED = "Generated code (Code generated ... DO NOT EDIT) — not product-authored behavior."
REASON_BOILERPLATE = "Trivial accessor/object method — excluded from behavior denominator."
REASON_CLASS_SURFACE = "Non-TS class/constructor behavior surface — countable for language proof."
REASON_PUBLIC = "Callable export from a package public entry module — countable library behavior surface."
REASON_NOT_ADJACENT = "Callable export is not API/service/route/job-adjacent — kept for grounding, excluded from the behavior denominator."
REASON_CLASS = "Exported class container — kept for grounding; methods/functions carry behavior in v1."
REASON_CONST = "Exported const (not provably callable) — excluded from the denominator in v1."


def owner_of(name: Column, member_of: Column) -> Column:
    return F.coalesce(F.nullif(member_of, F.lit("")), F.regexp_extract(name, r"^([^.]*)\.", 1))


def exclusion_reason(path: Column, name: Column, member_of: Column) -> Column:
    """Why a symbol is plumbing and no behaviour; null if nothing says so."""
    rooted = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    owner, method = owner_of(name, member_of), F.regexp_extract(name, r"([^.]*)$", 1)
    return first_of(
        [
            (rooted.rlike(UTILITY_PATH), REASON_UTILITY),
            (rooted.rlike(ASSET_PATH), REASON_ASSET),
            (method.rlike(HOOK_METHOD), REASON_HOOK),
            (owner.rlike(INFRA_OWNER), F.concat(F.lit(REASON_OWNER[0]), owner, F.lit(REASON_OWNER[1]))),
            (method.rlike(INFRA_METHOD), REASON_METHOD),
            (method.rlike(BOOTSTRAP_METHOD), REASON_BOOTSTRAP),
        ]
    )


def surface_reason(path: Column, name: Column, member_of: Column) -> Column:
    """Why a symbol is observable behaviour; null if nothing says so or something excludes it."""
    owner, service = owner_of(name, member_of), path.rlike(SERVICE_PATH)
    found = first_of(
        [
            (path.rlike(SURFACE_PATH) | path.rlike(SURFACE_FILE) & ~service, REASON_PATH),
            (owner.rlike(SURFACE_OWNER), F.concat(F.lit(REASON_SURFACE_OWNER[0]), owner, F.lit(REASON_SURFACE_OWNER[1]))),
            (name.rlike(CLIENT_FACTORY), None),
            (service & name.rlike(SURFACE_NAME), REASON_SERVICE),
            (name.rlike(SURFACE_NAME), REASON_NAME),
        ]
    )
    return F.when(exclusion_reason(path, name, member_of).isNull(), found)


def eligibility(symbols: DataFrame, public_files: DataFrame) -> DataFrame:
    """The symbols with eligible, reason and reason_code. ``symbols``: path, name, kind, member_of,
    callable, trivial, generated. ``public_files``: path of the modules that packages make public."""
    path, name, member, kind = F.col("path"), F.col("name"), F.col("member_of"), F.col("kind")
    public = public_files.select(F.col("path").alias("public_path")).distinct()
    rows = symbols.join(public, path == F.col("public_path"), "left").withColumn("language", language(path))
    rows = rows.withColumn("dts", path.rlike(r"\.d\.[cm]?ts$")).withColumn("infra", is_non_product(path))
    product = ~F.col("dts") & ~F.col("infra") & ~F.col("generated")
    other_class = (kind == "class") & ~F.col("language").isin("typescript", "javascript")
    rows = rows.withColumn("boilerplate", product & kind.isin("function", "class", "method") & is_boilerplate(name, F.col("language"), kind, F.col("trivial")))
    rows = rows.withColumn("candidate", product & ~F.col("boilerplate") & (kind.isin("function", "method") | F.coalesce("callable", F.lit(False)) | other_class))
    rows = rows.withColumn("excluded", F.when(F.col("candidate"), exclusion_reason(path, name, member)))
    rows = rows.withColumn("surface", F.when(other_class, REASON_CLASS_SURFACE).when(F.col("candidate"), surface_reason(path, name, member)))
    rows = rows.withColumn("public", F.col("candidate") & F.col("excluded").isNull() & F.col("public_path").isNotNull())
    eligible = F.col("candidate") & (F.col("surface").isNotNull() | F.col("public"))
    reason = first_of(
        [
            (F.col("dts"), REASON_DTS),
            (F.col("infra"), REASON_NON_PRODUCT),
            (F.col("generated"), REASON_GENERATED),
            (F.col("boilerplate"), REASON_BOILERPLATE),
            (eligible & F.col("surface").isNotNull(), F.col("surface")),
            (F.col("public"), REASON_PUBLIC),
            (F.col("excluded").isNotNull(), F.col("excluded")),
            (F.col("candidate"), REASON_NOT_ADJACENT),
            (kind == "class", REASON_CLASS),
        ],
        REASON_CONST,
    )
    code = first_of([(F.col("excluded").isNotNull(), "infra_behavior_surface"), (F.col("candidate") & ~eligible, "not_entry_point_adjacent")])
    return rows.withColumn("eligible", eligible).withColumn("reason", reason).withColumn("reason_code", code).drop("public_path", "dts", "infra", "boilerplate", "candidate", "excluded", "surface", "public")


_SOME = lambda value, pattern: any_sql(value, [pattern])
EXCLUDED_SQL = first_sql(
    [
        (_SOME("'/' || path", UTILITY_PATH), quoted(REASON_UTILITY)),
        (_SOME("'/' || path", ASSET_PATH), quoted(REASON_ASSET)),
        (_SOME("method", HOOK_METHOD), quoted(REASON_HOOK)),
        (_SOME("owner", INFRA_OWNER), f"{quoted(REASON_OWNER[0])} || owner || {quoted(REASON_OWNER[1])}"),
        (_SOME("method", INFRA_METHOD), quoted(REASON_METHOD)),
        (_SOME("method", BOOTSTRAP_METHOD), quoted(REASON_BOOTSTRAP)),
    ]
)
SURFACE_SQL = first_sql(
    [
        (f"({_SOME('path', SURFACE_PATH)} or {_SOME('path', SURFACE_FILE)} and not {_SOME('path', SERVICE_PATH)})", quoted(REASON_PATH)),
        (_SOME("owner", SURFACE_OWNER), f"{quoted(REASON_SURFACE_OWNER[0])} || owner || {quoted(REASON_SURFACE_OWNER[1])}"),
        (_SOME("name", CLIENT_FACTORY), "null"),
        (f"({_SOME('path', SERVICE_PATH)} and {_SOME('name', SURFACE_NAME)})", quoted(REASON_SERVICE)),
        (_SOME("name", SURFACE_NAME), quoted(REASON_NAME)),
    ]
)
NAMED_SQL = r", named as (select *, coalesce(nullif(member_of, ''), regexp_extract(name, '^([^.]*)\.', 1)) as owner, regexp_extract(name, '([^.]*)$', 1) as method from source_symbols)"


@query("behavior_surface", "source_symbols", f"{NAMED_SQL} select k, path, name, excluded, case when excluded is null then {SURFACE_SQL} end as surface from (select *, {EXCLUDED_SQL} as excluded from named) x")
def _surface(g: Graph) -> DataFrame:
    args = F.col("path"), F.col("name"), F.col("member_of")
    return g.source_symbols.select("k", "path", "name", exclusion_reason(*args).alias("excluded"), surface_reason(*args).alias("surface"))


@query("boilerplate_symbols", "source_symbols", f"select k, name, language, kind, {BOILERPLATE_SQL} as boilerplate from (select *, {language_sql('path')} as language from source_symbols) x")
def _boilerplate(g: Graph) -> DataFrame:
    rows = g.source_symbols.withColumn("language", language(F.col("path")))
    return rows.select("k", "name", "language", "kind", is_boilerplate(F.col("name"), F.col("language"), F.col("kind"), F.col("trivial")).alias("boilerplate"))


@query(
    "symbol_eligibility",
    ("source_symbols", "public_files"),
    f"""{NAMED_SQL}, flags as (select n.*, {language_sql("n.path")} as language, regexp_matches(n.path, '\\.d\\.[cm]?ts$') as dts, {any_sql("n.path", NON_PRODUCT)} as infra, p.path is not null as is_public from named n left join (select distinct path from public_files) p using (path)),
    plain as (select *, not dts and not infra and not generated and {BOILERPLATE_SQL} as boilerplate, kind = 'class' and language not in ('typescript', 'javascript') as other_class from flags),
    chosen as (select *, not dts and not infra and not generated and not boilerplate and (kind in ('function', 'method') or coalesce(callable, false) or other_class) as candidate from plain),
    reasoned as (select *, case when candidate then {EXCLUDED_SQL} end as excluded from chosen),
    surfaced as (select *, case when other_class then {quoted(REASON_CLASS_SURFACE)} when candidate and excluded is null then {SURFACE_SQL} end as surface from reasoned),
    decided as (select *, candidate and excluded is null and is_public as public, candidate and (surface is not null or (excluded is null and is_public)) as eligible from surfaced)
    select k, path, name, kind, eligible, {first_sql([("dts", quoted(REASON_DTS)), ("infra", quoted(REASON_NON_PRODUCT)), ("generated", quoted(REASON_GENERATED)), ("boilerplate", quoted(REASON_BOILERPLATE)), ("eligible and surface is not null", "surface"), ("public", quoted(REASON_PUBLIC)), ("excluded is not null", "excluded"), ("candidate", quoted(REASON_NOT_ADJACENT)), ("kind = 'class'", quoted(REASON_CLASS))], quoted(REASON_CONST))} as reason,
    case when excluded is not null then 'infra_behavior_surface' when candidate and not eligible then 'not_entry_point_adjacent' end as reason_code from decided""",
)
def _eligibility(g: Graph) -> DataFrame:
    return eligibility(g.source_symbols, g.public_files).select("k", "path", "name", "kind", "eligible", "reason", "reason_code")


#: Source, eligibility and reason of kinds whose producer left them empty (fixed values).
DEFAULTS = [
    (["Requirement", "BusinessRule"], "requirement_template", True, "Explicit requirement — always countable."),
    (["UserFlow"], "test_inferred", False, "Inferred from test names — a test cannot witness its own requirement."),
    (["CodeSymbol"], "code_export", False, "Code export not proven countable (analyzer decides eligibility)."),
]


def with_defaults(nodes: DataFrame) -> DataFrame:
    """Nodes with behavior_source, eligible and reason filled by kind where they are null."""
    kind = F.col("kind")

    def filled(column: str, place: int, type_: str) -> Column:
        by_kind = F.lit(None).cast(type_)
        for d in DEFAULTS:
            by_kind = F.when(kind.isin(d[0]), F.lit(d[place])).otherwise(by_kind)
        return F.coalesce(F.col(column), by_kind).alias(column)

    return nodes.select(*[c for c in nodes.columns if c not in ("behavior_source", "eligible", "reason")], filled("behavior_source", 1, "string"), filled("eligible", 2, "boolean"), filled("reason", 3, "string"))


@query(
    "denominator_defaults",
    "nodes",
    """select external_id, kind, coalesce(behavior_source, case when kind in ('Requirement', 'BusinessRule') then 'requirement_template' when kind = 'UserFlow' then 'test_inferred' when kind = 'CodeSymbol' then 'code_export' end) as behavior_source,
        coalesce(eligible, case when kind in ('Requirement', 'BusinessRule') then true when kind in ('UserFlow', 'CodeSymbol') then false end) as eligible,
        coalesce(reason, case when kind in ('Requirement', 'BusinessRule') then 'Explicit requirement — always countable.' when kind = 'UserFlow' then 'Inferred from test names — a test cannot witness its own requirement.' when kind = 'CodeSymbol' then 'Code export not proven countable (analyzer decides eligibility).' end) as reason
    from (select external_id, kind, case when ord % 3 <> 0 then behavior_source end as behavior_source, case when ord % 2 = 0 then eligible end as eligible, case when ord % 2 = 0 then reason end as reason from nodes) x""",
)
def _defaults(g: Graph) -> DataFrame:
    """Every node, some of whose fields a producer left empty."""
    kept = lambda c, n, r: F.when(F.col("ord") % n != r, F.col(c)).alias(c)
    return with_defaults(g.nodes.select("external_id", "kind", kept("behavior_source", 3, 0), kept("eligible", 2, 1), kept("reason", 2, 1)))
