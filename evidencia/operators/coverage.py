"""Coverage artifacts and line intervals, impact of changes, generated tests, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import percent, stem
from ..registry import query
from ..schema import HARD_TYPES, WEAK_TYPES
from ..sources.driver_tables import Graph
from .classification import language, language_sql
from .evidence import denominator, of_kinds

_MOVED_SQL = r"(regexp_replace({0}, '\.ts$', '') || case when contains({0}, 'utils') then '.py' when contains({0}, 'economy') then '.go' when contains({0}, 'medium') then '.rb' else '.ts' end)"


def overlapped_spans(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """file, start_line, end_line and format where a range of the format overlaps the span, ends included.

    Spans and ranges never meet in pairs: a span overlaps one of the ranges that begin by its last line if the furthest end of
    those reaches its first. That is a running maximum over a file's lines, to which each line gives one row for a format and a span."""
    last = ranges.groupBy("file", "format", F.col("start_line").alias("line")).agg(F.max("end_line").alias("reach")).where("line is not null")
    asked = spans.where("file is not null and start_line is not null").select("file", "start_line", "end_line").distinct()
    asked = asked.join(ranges.select("file", "format").distinct(), "file").select("file", "format", F.col("end_line").alias("line"), F.lit(None).cast("int").alias("reach"), "start_line", "end_line")
    rows = last.select("*", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")).unionByName(asked)
    until = Window.partitionBy("file", "format").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("reach", F.max("reach").over(until)).where("reach >= start_line").select("file", "start_line", "end_line", "format")


def overlaps(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """external_id and format of the ranges of a symbol's file whose lines overlap it."""
    found = overlapped_spans(symbols, ranges).groupBy("file", "start_line", "end_line").agg(F.collect_set("format").alias("formats"))
    return symbols.select("external_id", "file", "start_line", "end_line").join(found, ["file", "start_line", "end_line"]).select("external_id", "formats")


@query("span_overlap", ("nodes", "coverage_ranges"), "select n.external_id, list_sort(list(distinct c.format)) as formats from nodes n join coverage_ranges c on c.file = n.file and n.start_line <= c.end_line and c.start_line <= n.end_line where n.kind = 'CodeSymbol' group by n.external_id")
def _spans(g: Graph) -> DataFrame:
    found = overlaps(of_kinds(g.nodes, ["CodeSymbol"]), g.coverage_ranges)
    return found.groupBy("external_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("formats")))).alias("formats"))  # ids are few that repeat


def runtime_summary(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """By language and for all: eligible symbols, those with lines, those that ran, and their share. Only
    languages with a range count, so a report on one language doesn't dilute another's."""
    named = ranges.select(language(F.col("file")).alias("language")).distinct()
    live = symbols.withColumn("language", language(F.col("file"))).join(F.broadcast(named), "language", "left_semi")  # languages are few
    ran = overlaps(live, ranges).select("external_id", F.lit(1).alias("ran")).distinct()
    spans = F.count_if((F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")))
    sums = live.join(ran, "external_id", "left").rollup("language").agg(F.count("*").alias("eligible"), spans.alias("with_spans"), F.count("ran").alias("covered"))
    return sums.select(F.coalesce("language", F.lit("all")).alias("language"), "eligible", "with_spans", "covered", percent(F.col("covered"), F.col("eligible")).alias("pct"))


@query(
    "runtime_coverage_rollup",
    ("nodes", "coverage_ranges"),
    f""", moved as (select n.*, {_MOVED_SQL.format("n.file")} as place from nodes n where kind = 'CodeSymbol' and eligible and not stale), hits as (select {_MOVED_SQL.format("file")} as place, start_line, end_line from coverage_ranges where not contains(file, 'medium')),
    ran as (select distinct n.external_id from moved n join hits c on c.place = n.place and n.start_line <= c.end_line and c.start_line <= n.end_line),
    base as (select {language_sql("place")} as language, external_id in (select external_id from ran) as covered, start_line > 0 and end_line >= start_line as spanned from moved),
    counted as (select * from base where language in (select {language_sql("place")} from hits))
    select coalesce(language, 'all') as language, count(*) as eligible, count(*) filter (spanned) as with_spans, count(*) filter (covered) as covered, floor(100.0 * count(*) filter (covered) / count(*) * 10 + 0.5) / 10 as pct from counted group by rollup (language)""",
)
def _runtime(g: Graph) -> DataFrame:
    """Files of some directories count as other languages; nothing has run of one of them."""
    moved = lambda rows: rows.withColumn("file", F.concat(F.regexp_replace("file", r"\.ts$", ""), F.when(F.col("file").contains("utils"), ".py").when(F.col("file").contains("economy"), ".go").when(F.col("file").contains("medium"), ".rb").otherwise(".ts")))
    return runtime_summary(moved(denominator(g.nodes).where("kind = 'CodeSymbol'")), moved(g.coverage_ranges.where("not file like '%medium%'")))


@query("artifact_stats", "coverage_ranges", "select format, count(distinct file) as files, count(*) as ranges from coverage_ranges group by format")
def _artifacts(g: Graph) -> DataFrame:
    return g.coverage_ranges.groupBy("format").agg(F.countDistinct("file").alias("files"), F.count("*").alias("ranges"))


def lcov(lines: DataFrame) -> DataFrame:
    """(artifact, n, value) lines of LCOV files to the covered lines of each source file."""
    w = Window.partitionBy("artifact").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("file", F.last(F.nullif(F.regexp_extract("value", r"^SF:(.+)$", 1), F.lit("")), ignorenulls=True).over(w))
    da = named.select("artifact", "file", F.regexp_extract("value", r"^DA:(\d+),(\d+)", 1).alias("line"), F.regexp_extract("value", r"^DA:(\d+),(\d+)", 2).alias("hits")).where("line <> ''")
    return da.where("cast(hits as bigint) > 0").select("artifact", "file", F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"), F.lit("lcov").alias("format"))


def go_profile(lines: DataFrame) -> DataFrame:
    """(artifact, n, value) lines of Go cover profiles to covered ranges; files without a mode line give none."""
    pattern = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    valid = lines.where("n = 0 and value rlike '^mode: (set|count|atomic)'").select("artifact").distinct()
    parts = lines.join(valid, "artifact", "left_semi").where(F.col("value").rlike(pattern))
    get = lambda i: F.regexp_extract("value", pattern, i)
    return parts.where(get(4).cast("bigint") > 0).select("artifact", get(1).alias("file"), get(2).cast("int").alias("start_line"), get(3).cast("int").alias("end_line"), F.lit("go").alias("format"))


def xml_lines(documents: DataFrame, kind: str) -> DataFrame:
    """(artifact, xml) of coverage.py or JaCoCo reports to covered lines."""
    if kind == "cobertura":
        schema = "packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, lines: struct<line: array<struct<_number: int, _hits: bigint>>>>>>>>>"
        one = documents.select("artifact", F.explode(F.from_xml("xml", schema)["packages"]["package"]).alias("p")).select("artifact", F.explode("p.classes.class").alias("c")).select("artifact", F.col("c._filename").alias("file"), F.explode("c.lines.line").alias("l"))
        hit, number = F.col("l._hits") > 0, F.col("l._number")
    else:
        schema = "package array<struct<_name: string, sourcefile: array<struct<_name: string, line: array<struct<_nr: int, _ci: bigint, _cb: bigint>>>>>>"
        one = documents.select("artifact", F.explode(F.from_xml("xml", schema)["package"]).alias("p")).select("artifact", F.col("p._name").alias("package"), F.explode("p.sourcefile").alias("s")).select("artifact", F.concat_ws("/", "package", "s._name").alias("file"), F.explode("s.line").alias("l"))
        hit, number = (F.col("l._ci") + F.col("l._cb")) > 0, F.col("l._nr")
    return one.where(hit).select("artifact", "file", number.alias("start_line"), number.alias("end_line"), F.lit(kind).alias("format"))


@query("lcov_reader", "coverage_ranges", "select file, start_line from (select distinct file, start_line from coverage_ranges where start_line % 2 = 1) x")
def _lcov(g: Graph) -> DataFrame:
    """LCOV lines made from the ranges and read again."""
    files = g.coverage_ranges.groupBy("file").agg(F.array_sort(F.collect_set("start_line")).alias("lines"))
    text = F.concat(F.array(F.concat(F.lit("SF:"), "file")), F.transform("lines", lambda x: F.concat(F.lit("DA:"), x.cast("string"), F.lit(","), (x % 2).cast("string"))), F.array(F.lit("end_of_record")))
    return lcov(files.select(F.col("file").alias("artifact"), F.posexplode(text).alias("n", "value"))).select("file", "start_line")


@query("go_reader", "coverage_ranges", "select distinct 'mod/' || file as file, start_line, end_line from coverage_ranges where end_line % 2 = 1")
def _go(g: Graph) -> DataFrame:
    ranges = g.coverage_ranges.select("file", "start_line", "end_line").distinct()
    files = ranges.groupBy("file").agg(F.collect_set(F.concat(F.lit("mod/"), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit(".1,"), F.col("end_line").cast("string"), F.lit(".9 1 "), (F.col("end_line") % 2).cast("string"))).alias("lines"))
    text = F.concat(F.array(F.lit("mode: set")), "lines")
    return go_profile(files.select(F.col("file").alias("artifact"), F.posexplode(text).alias("n", "value"))).select("file", "start_line", "end_line")


def changed_impact(changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tests and behaviours of changed files: direct by a symbol's tests, or through a file that imports them; hub files don't spread."""
    symbols = nodes.where("kind = 'CodeSymbol' and not stale").select(F.col("external_id").alias("id"), "file")
    tested = edges.where((F.col("type") == "TESTED_BY")).select(F.col("from_id").alias("id"), F.col("to_id").alias("test_id"))
    by_file = symbols.join(tested, "id").select("file", "test_id").distinct()
    n_tests = of_kinds(nodes, ["TestCase"]).agg(F.count("*").alias("n"))
    hubs = by_file.groupBy("file").agg(F.count("*").alias("fans")).crossJoin(n_tests).where(F.col("fans") > F.greatest(F.lit(20), F.ceil(F.col("n") * 0.02))).select("file")  # one row beside
    direct = changed.join(by_file, "file").select("file", "test_id", F.lit(3).alias("rank"))
    importers = edges.where("type = 'IMPORTS'").select(F.col("to_id").alias("file"), F.col("from_id").alias("importer"))
    through = changed.join(hubs, "file", "left_anti").join(importers, "file").join(by_file.withColumnRenamed("file", "importer"), "importer").select("file", "test_id", F.lit(2).alias("rank"))
    best = direct.unionByName(through).groupBy("test_id").agg(F.max("rank").alias("rank"), F.countDistinct("file").alias("files"))
    return best.select("test_id", F.when(F.col("rank") == 3, "direct").otherwise("import").alias("link"), "files")


@query(
    "changed_impact",
    ("nodes", "edges", "changed_files"),
    """, by_file as (select distinct n.file, e.to_id as test_id from nodes n join edges e on e.from_id = n.external_id and e.type = 'TESTED_BY' where n.kind = 'CodeSymbol' and not n.stale),
    hubs as (select file from by_file group by file having count(*) > greatest(20, ceil((select count(*) from nodes where kind = 'TestCase') * 0.02))),
    hit as (select file, test_id, 3 as rank from changed_files join by_file using (file) union all select c.file, b.test_id, 2 from changed_files c join edges i on i.type = 'IMPORTS' and i.to_id = c.file join by_file b on b.file = i.from_id where c.file not in (select file from hubs))
    select test_id, case max(rank) when 3 then 'direct' else 'import' end as link, count(distinct file) as files from hit group by test_id""",
)
def _impact(g: Graph) -> DataFrame:
    return changed_impact(g.changed_files, g.nodes, g.edges)


@query("stale_tests", ("generated", "changed_files", "symbols"), "select distinct g.test_id from generated g join symbols s on s.external_id = g.entity_id where s.file in (select file from changed_files)")
def _stale(g: Graph) -> DataFrame:
    """Generated tests that rest on a changed file. Symbols are hashed, so that the many more tests are not sorted by their targets,
    and tests are dealt out before they are made distinct, as few of one test share a task until then."""
    files = g.symbols.join(g.changed_files, "file", "left_semi").select(F.col("external_id").alias("entity_id"))
    return g.generated.join(files.hint("shuffle_hash"), "entity_id", "left_semi").select("test_id").repartition("test_id").distinct()


@query("citation_validation", ("generated", "nodes"), "select test_id, count(*) as cited, count(n.external_id) as valid, count(*) - count(n.external_id) as invalid from generated g left join nodes n on n.external_id = g.entity_id group by test_id")
def _citations(g: Graph) -> DataFrame:
    known = g.nodes.select(F.col("external_id").alias("entity_id"), F.lit(1).alias("known")).dropDuplicates(["entity_id"])
    rows = g.generated.join(known.hint("shuffle_hash"), "entity_id", "left").groupBy("test_id")
    return rows.agg(F.count("*").alias("cited"), F.count("known").alias("valid"), (F.count("*") - F.count("known")).alias("invalid"))


@query("pinned_drafts", "generated", "select entity_id, test_id from (select distinct entity_id, test_id, ord, created_at from generated where runnable) x qualify row_number() over (partition by entity_id order by created_at desc, ord desc) = 1")
def _pinned(g: Graph) -> DataFrame:
    """The newest runnable draft of each target."""
    return g.generated.where("runnable").groupBy("entity_id").agg(F.max_by("test_id", F.struct("created_at", "ord")).alias("test_id"))


@query("weak_cap_order", ("edges", "candidates"), "select id, test_id, hard from (select from_id as id, to_id as test_id, true as hard, ord, 0 as n from edges where type = 'TESTED_BY' union all select from_id, to_id, false, ord, row_number() over (partition by from_id order by ord, to_id) from candidates where type = 'MAY_BE_TESTED_BY') x where n <= 3")
def _weak_cap(g: Graph) -> DataFrame:
    """All hard tests of a symbol, and three weak ones."""
    hard = g.edges.where("type = 'TESTED_BY'").select(F.col("from_id").alias("id"), F.col("to_id").alias("test_id"), F.lit(True).alias("hard"))
    n = F.row_number().over(Window.partitionBy("from_id").orderBy("ord", "to_id"))
    weak = g.candidates.where("type = 'MAY_BE_TESTED_BY'").withColumn("n", n).where("n <= 3").select(F.col("from_id").alias("id"), F.col("to_id").alias("test_id"), F.lit(False).alias("hard"))
    return hard.unionByName(weak)


@query("target_resolution", ("nodes", "edges"), "select e.to_id as target, case when count(distinct e.from_id) = 1 then min(e.from_id) end as symbol from edges e join nodes n on n.external_id = e.from_id and n.kind = 'CodeSymbol' where e.type = 'TESTED_BY' and e.strength = 'hard' group by e.to_id")
def _targets(g: Graph) -> DataFrame:
    """A test's one hard symbol; null when it has several."""
    symbols = of_kinds(g.nodes, ["CodeSymbol"]).select(F.col("external_id").alias("from_id"))
    rows = g.edges.where(F.col("type").isin(HARD_TYPES[0]) & (F.col("strength") == "hard")).join(symbols, "from_id", "left_semi").groupBy(F.col("to_id").alias("target"))
    return rows.agg(F.when(F.countDistinct("from_id") == 1, F.min("from_id")).alias("symbol"))


@query("stem_links", ("tests", "file_keys"), ", names as (select file as test, 'fn' || regexp_extract(file, 's(\\d+)\\.', 1) as stem from tests), files as (select file, 'fn' || k as stem from file_keys) select n.test, case when count(f.file) = 1 then min(f.file) end as file, count(f.file) as candidates from names n left join files f using (stem) group by n.test")
def _stems(g: Graph) -> DataFrame:
    """Tests whose name has one source file of the same stem."""
    tests = g.tests.select(F.col("file").alias("test"), F.concat(F.lit("fn"), F.regexp_extract(stem(F.col("file")), r"s(\d+)$", 1)).alias("stem"))
    files = g.file_keys.select("file", F.concat(F.lit("fn"), F.col("k").cast("string")).alias("stem"))
    rows = tests.join(files, "stem", "left").groupBy("test")
    return rows.agg(F.when(F.count("file") == 1, F.min("file")).alias("file"), F.count("file").alias("candidates"))


@query("status_report", ("manifest_before", "manifest_now", "nodes"), "select (select count(*) from manifest_now) as files, (select count(*) from manifest_before b full outer join manifest_now n using (rel_path) where b.hash is distinct from n.hash) as changes, (select count(*) from nodes where eligible and not stale) as behaviors")
def _status(g: Graph) -> DataFrame:
    from .merge import manifest_diff

    files = g.manifest_now.agg(F.count("*").alias("files"))
    changes = manifest_diff(g.manifest_before, g.manifest_now).agg(F.count("*").alias("changes"))
    return files.crossJoin(changes).crossJoin(denominator(g.nodes).agg(F.count("*").alias("behaviors")))  # single rows


#: Directories that say nothing of an area, and how an area's behaviours are capped (fixed values).
AREA_SKIP = ["src", "app", "lib", "packages", "tests", "test", "e2e", "__tests__", "spec"]
MOST_OF_AREAS = 50
#: What ties a change to a behaviour, the strongest last (fixed values).
LINK_KINDS = ["area", "stem", "import", "direct"]


def meaningful_area(path: Column) -> Column:
    """The first directory that isn't one of ``AREA_SKIP``, else the first one, else ``core``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    named = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~F.lower(x).isin(AREA_SKIP))
    return F.coalesce(F.get(named, F.lit(0)), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))), F.lit("core"))


def impacted_behaviors(changed: DataFrame, nodes: DataFrame, edges: DataFrame, candidates: DataFrame, links: DataFrame, areas: DataFrame) -> DataFrame:
    """Behaviours that a change of files touches, with the strongest tie: a test of theirs changed (direct), imports a
    changed file (import) or has its name (stem); else they lie in an area of a changed file that has no such tie.

    ``links``: code_file, test_file, kind (import or stem); ``areas``: external_id, area. A changed file that more
    than 20 tests and 2 % of all are tied to ties nothing, neither by tests nor by its area. Of the areas only the
    first ``MOST_OF_AREAS`` behaviours by id count."""
    changed = changed.select("file").distinct()
    tests = of_kinds(nodes, ["TestCase"]).select(F.col("external_id").alias("test_id"), F.col("file").alias("test_file"))
    behaviors = nodes.where("kind in ('Requirement', 'UserFlow', 'BusinessRule')").select(F.col("external_id").alias("id"))
    rank = F.when(F.col("kind") == "import", 2).otherwise(1)
    files = tests.select("test_file").distinct()
    tied = links.join(changed, links.code_file == changed.file, "left_semi").join(files, "test_file", "left_semi").groupBy("code_file", "test_file").agg(F.max(rank).alias("rank"))
    total = files.agg(F.count("*").alias("n"))
    hubs = tied.groupBy("code_file").agg(F.count("*").alias("fans")).crossJoin(F.broadcast(total)).where(F.col("fans") > F.greatest(F.lit(20), F.ceil(F.col("n") * 0.02))).select("code_file")  # one row beside
    through = tied.join(hubs, "code_file", "left_anti").groupBy("test_file").agg(F.max("rank").alias("rank"))
    reached = tests.join(through, "test_file").select("test_id", "rank").unionByName(tests.join(changed, F.col("test_file") == F.col("file"), "left_semi").select("test_id", F.lit(3).alias("rank"))).groupBy("test_id").agg(F.max("rank").alias("rank"))
    ties = edges.where(F.col("type").isin(HARD_TYPES)).select("from_id", "to_id").unionByName(candidates.where(F.col("type").isin(WEAK_TYPES)).select("from_id", "to_id"))
    both = ties.select(F.explode(F.array(F.struct(F.col("from_id").alias("test_id"), F.col("to_id").alias("id")), F.struct(F.col("to_id").alias("test_id"), F.col("from_id").alias("id")))).alias("e")).select("e.*")
    precise = both.join(reached, "test_id").join(behaviors, "id", "left_semi").groupBy("id").agg(F.max("rank").alias("rank"))
    own = areas.select(F.col("external_id").alias("id"), "area").where("area is not null").join(behaviors, "id", "left_semi")
    known = precise.join(own, "id").select("area").distinct()
    open_areas = changed.join(hubs, changed.file == hubs.code_file, "left_anti").select(meaningful_area(F.col("file")).alias("area")).distinct().join(known, "area", "left_anti")
    by_area = own.join(open_areas, "area", "left_semi").join(precise, "id", "left_anti").select("id").distinct().orderBy("id").limit(MOST_OF_AREAS).withColumn("rank", F.lit(0))
    return precise.unionByName(by_area).select("id", F.element_at(F.array(*map(F.lit, LINK_KINDS)), F.col("rank") + 1).alias("link"))


@query(
    "impacted_behaviors",
    ("nodes", "edges", "candidates", "file_links", "behavior_areas", "changed_files"),
    """, changed as (select file from changed_files union select file from tests where k % 9 = 1), all_tests as (select external_id as test_id, file as test_file from nodes where kind = 'TestCase'), behs as (select external_id as id from nodes where kind in ('Requirement', 'UserFlow', 'BusinessRule')),
    tied as (select code_file, test_file, max(case kind when 'import' then 2 else 1 end) as rank from file_links where code_file in (select file from changed) and test_file in (select test_file from all_tests) group by 1, 2),
    hub_files as (select code_file from tied group by code_file having count(*) > greatest(20, ceil((select count(distinct test_file) from all_tests) * 0.02))),
    reached as (select test_id, max(rank) as rank from (select t.test_id, x.rank from all_tests t join tied x using (test_file) where x.code_file not in (select code_file from hub_files) union all select test_id, 3 from all_tests where test_file in (select file from changed)) y group by test_id),
    ties as (select from_id, to_id from edges where type in ('TESTED_BY', 'COVERS') union all select from_id, to_id from candidates where type in ('MAY_BE_TESTED_BY', 'MAY_COVER')), ends as (select from_id as test_id, to_id as id from ties union all select to_id, from_id from ties),
    precise as (select id, max(rank) as rank from ends join reached using (test_id) where id in (select id from behs) group by id), own as (select external_id as id, area from behavior_areas where area is not null),
    open_areas as (select distinct case when split_part(file, '/', 1) in ('src', 'tests') and split_part(file, '/', 3) <> '' then split_part(file, '/', 2) else split_part(file, '/', 1) end as area from changed where file not in (select code_file from hub_files)),
    by_area as (select id from own where area in (select area from open_areas) and area not in (select area from own where id in (select id from precise)) and id not in (select id from precise) order by id limit 50)
    select id, case rank when 3 then 'direct' when 2 then 'import' else 'stem' end as link from precise union all select id, 'area' from by_area""",
)
def _impacted(g: Graph) -> DataFrame:
    """Some tests are among the changed files."""
    changed = g.changed_files.unionByName(g.tests.where("k % 9 = 1").select("file"))
    return impacted_behaviors(changed, g.nodes, g.edges, g.candidates, g.file_links, g.behavior_areas)


#: Files that installing packages changes (fixed values).
INSTALL_ARTIFACTS = r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|node_modules/.*)$"


def provable(nodes: DataFrame) -> DataFrame:
    """Symbols that a proof may aim at: eligible, live, entry points by their surface and of a language and shape that
    can be run. ``nodes``: file, name, kind, eligible, stale, surface, reason_code, symbol_kind."""
    lang = language(F.col("file"))
    method = F.regexp_extract("name", r"([^.]*)$", 1)
    shape = F.when(lang.isin("typescript", "javascript"), True).when(lang == "go", ~F.col("name").contains(".")).when(lang.isin("java", "kotlin"), F.col("symbol_kind") == "method").when(lang == "python", ~method.rlike("^__.*__$")).otherwise(False)
    return nodes.where((F.col("kind") == "CodeSymbol") & F.col("eligible") & ~F.coalesce("stale", F.lit(False)) & (F.col("surface") == "entrypoint_adjacent") & F.col("reason_code").isNull() & shape)


#: Parts that a code file's symbols are dealt into, and its test files.
SALTS, CHUNKS = 4, 64


def associated_tests(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, links: DataFrame, strict: DataFrame) -> DataFrame:
    """Symbol, test file, whether a hard edge ties them, and the list of the first tie. Hard edges tie any eligible
    symbol; possible links, and files that belong together (all their symbols), only those of ``strict`` (id, file).
    What a model suggested doesn't count."""
    tests = of_kinds(nodes, ["TestCase"]).select(F.col("external_id").alias("t"), F.col("file").alias("test_file"))
    symbols = nodes.where("kind = 'CodeSymbol' and eligible and not stale").select(F.col("external_id").alias("s"))

    def pairs(rows: DataFrame, hard: bool, first: int, of: DataFrame) -> DataFrame:
        ends = rows.select(F.explode(F.array(F.struct(F.col("from_id").alias("s"), F.col("to_id").alias("t")), F.struct(F.col("to_id").alias("s"), F.col("from_id").alias("t")))).alias("e")).select("e.*")
        return ends.join(tests, "t").join(of, "s", "left_semi").select("s", "test_file", F.lit(hard).alias("hard"), F.lit(first).alias("list"))

    narrow = strict.select(F.col("id").alias("s"))
    kept = candidates.where(F.col("type").isin(WEAK_TYPES) & ~F.coalesce("ai_suggested", F.lit(False)))
    tied = pairs(edges.where(F.col("type").isin(HARD_TYPES)), True, 0, symbols).unionByName(pairs(kept, False, 1, narrow))
    tied = tied.groupBy("s", "test_file").agg(F.max("hard").alias("hard"), F.min("list").cast("long").alias("list"))
    # a symbol's test files by its file are as many as pairs: they meet what ties it already in the symbol's own row, so that no shuffle holds them
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    linked = links.join(files_of(tests), "test_file", "left_semi").groupBy("code_file", F.pmod(F.xxhash64("test_file"), F.lit(CHUNKS)).alias("chunk")).agg(F.collect_set("test_file").alias("test_files"))
    linked = linked.select("code_file", "test_files", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    known = tied.groupBy("s").agg(F.collect_list("test_file").alias("known"))
    rows = strict.select(F.col("id").alias("s"), F.col("file").alias("code_file")).distinct().join(known, "s", "left").withColumn("salt", salt("s"))
    by_file = rows.join(linked, ["code_file", "salt"]).select("s", "known", F.explode("test_files").alias("test_file")).where(~F.coalesce(F.array_contains("known", F.col("test_file")), F.lit(False)))
    return tied.select(F.col("s").alias("symbol"), "test_file", "hard", F.col("list").alias("first_list")).unionByName(by_file.select(F.col("s").alias("symbol"), "test_file", F.lit(False).alias("hard"), F.lit(2).cast("long").alias("first_list")))


def files_of(tests: DataFrame) -> DataFrame:
    return tests.select("test_file").distinct()


@query(
    "associated_tests",
    ("nodes", "edges", "candidates", "file_links"),
    """, t as (select external_id as t, file as test_file from nodes where kind = 'TestCase'), sym as (select external_id as s, file from nodes where kind = 'CodeSymbol' and eligible and not stale), strict as (select * from sym where contains(file, 'controllers') or contains(file, 'services')),
    hard_ends as (select from_id as s, to_id as t from edges where type in ('TESTED_BY', 'COVERS') union all select to_id, from_id from edges where type in ('TESTED_BY', 'COVERS')),
    weak_ends as (select from_id as s, to_id as t from candidates where type in ('MAY_BE_TESTED_BY', 'MAY_COVER') and not ai_suggested union all select to_id, from_id from candidates where type in ('MAY_BE_TESTED_BY', 'MAY_COVER') and not ai_suggested),
    found as (select s, test_file, true as hard, 0 as list from hard_ends join t using (t) where s in (select s from sym) union all select s, test_file, false, 1 from weak_ends join t using (t) where s in (select s from strict) union all select x.s, l.test_file, false, 2 from file_links l join strict x on x.file = l.code_file where l.test_file in (select test_file from t))
    select s as symbol, test_file, bool_or(hard) as hard, min(list) as first_list from found group by s, test_file""",
)
def _associated(g: Graph) -> DataFrame:
    """Symbols of controllers and services count as entry points here."""
    strict = g.live_symbols.where("file like '%controllers%' or file like '%services%'").select(F.col("external_id").alias("id"), "file")
    return associated_tests(g.nodes, g.edges, g.candidates, g.file_links, strict)


@query(
    "provable_targets",
    ("source_symbols", "public_files"),
    f""", shown as (select *, {language_sql("path")} as language, regexp_extract(name, '([^.]*)$', 1) as method, k % 4 <> 0 as eligible, case when k % 3 <> 0 then 'entrypoint_adjacent' else 'public_api_entry' end as surface, case when k % 11 = 0 then 'infra_behavior_surface' end as reason_code, k % 13 = 0 as stale from source_symbols)
    select k from shown where eligible and not stale and surface = 'entrypoint_adjacent' and reason_code is null and case when language in ('typescript', 'javascript') then true when language = 'go' then not contains(name, '.') when language in ('java', 'kotlin') then kind = 'method' when language = 'python' then not regexp_matches(method, '^__.*__$') else false end""",
)
def _provable(g: Graph) -> DataFrame:
    k = F.col("k")
    rows = g.source_symbols.select("k", F.col("path").alias("file"), "name", F.col("kind").alias("symbol_kind"), F.lit("CodeSymbol").alias("kind"), (k % 4 != 0).alias("eligible"), F.when(k % 3 != 0, "entrypoint_adjacent").otherwise("public_api_entry").alias("surface"), F.when(k % 11 == 0, "infra_behavior_surface").alias("reason_code"), (k % 13 == 0).alias("stale"))
    return provable(rows).select("k")


def proof_scope(changed: DataFrame, targets: DataFrame, explicit: bool) -> DataFrame:
    """The changed files that proofs are scoped to: all of an explicit diff; else those that installing didn't change,
    if a provable target lies in one of them; else none, which means no scope."""
    if explicit:
        return changed.select("file")
    kept = changed.select("file").where(~F.col("file").rlike(INSTALL_ARTIFACTS))
    touched = targets.select("file").join(kept, "file", "left_semi").limit(1).agg(F.count("*").alias("touched"))
    return kept.crossJoin(F.broadcast(touched)).where("touched > 0").select("file")  # one row beside


@query("proof_scope", ("nodes", "changed_files"), "select 'diff' as mode, file from (select file from changed_files union all select 'web/package-lock.json') x union all select 'auto', file from changed_files where exists (select 1 from nodes where kind = 'CodeSymbol' and eligible and not stale and file in (select file from changed_files))")
def _scope_of_proof(g: Graph) -> DataFrame:
    changed = g.changed_files.unionByName(g.spark.sql("select 'web/package-lock.json' as file"))
    shown = lambda mode, explicit: proof_scope(changed, g.live_symbols, explicit).select(F.lit(mode).alias("mode"), "file")
    return shown("diff", True).unionByName(shown("auto", False))


#: Languages whose targets can be proven dynamically (fixed values).
PROVABLE_LANGUAGES = ["typescript", "javascript", "go", "java", "python"]


def recorded_runs(attempts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Status and reason of attempts (id, target, language, test_file, vacuous) from the hard proof edges (target, test)
    before and after them. A static edge is only associated: nothing here is ever proven or closed."""
    had = before.groupBy("target").agg(F.count("*").alias("pre_edges"))
    new = after.join(before, ["target", "test"], "left_anti")
    rows = attempts.join(had, "target", "left").join(new.groupBy("target").agg(F.count("*").alias("any_new")), "target", "left")
    own = attempts.where("test_file is not null").select("id", "target", F.concat(F.lit("test:"), "test_file").alias("test")).join(new, ["target", "test"], "left_semi").select("id", "target", F.lit(1).alias("own")).distinct()
    rows = rows.join(own, ["id", "target"], "left")
    credited = F.when(F.col("test_file").isNull(), F.coalesce("any_new", F.lit(0))).otherwise(F.coalesce("own", F.lit(0)))
    verifiable, had_edges = F.col("language").isin(PROVABLE_LANGUAGES), F.coalesce("pre_edges", F.lit(0)) > 0
    status = F.when(verifiable, "unproven").otherwise("generated_unverifiable")
    reason = F.when(~verifiable, "not verifiable").when(had_edges, "already associated").when(credited > 0, "static edge found").when(F.col("vacuous"), "vacuous").otherwise("no new edge")
    return rows.select("id", status.alias("status"), F.lit(False).alias("closed"), F.when(verifiable & ~had_edges, credited).otherwise(0).alias("new_edges"), reason.alias("reason"))


@query(
    "recorded_runs",
    ("generated", "edges"),
    """, attempts as (select ord as id, 'A' || entity_id as target, case ord % 5 when 0 then 'rust' when 1 then 'go' else 'typescript' end as language, case when ord % 3 = 0 then null else 'tests/s' || (1 + ord % 10) || '.test.ts' end as test_file, ord % 7 = 0 as vacuous from generated where place = 1 group by all),
    post as (select distinct 'A' || from_id as target, to_id as test from edges where type = 'TESTED_BY' and strength = 'hard'), pre as (select * from post where length(target) % 3 = 0), fresh as (select * from post except select * from pre),
    j as (select a.*, exists (select 1 from pre p where p.target = a.target) as had, case when test_file is null then (select count(*) from fresh f where f.target = a.target) else (select count(*) from fresh f where f.target = a.target and f.test = 'test:' || a.test_file) end as credited from attempts a)
    select id, case when language = 'rust' then 'generated_unverifiable' else 'unproven' end as status, false as closed, case when language <> 'rust' and not had then credited else 0 end as new_edges, case when language = 'rust' then 'not verifiable' when had then 'already associated' when credited > 0 then 'static edge found' when vacuous then 'vacuous' else 'no new edge' end as reason from j""",
)
def _recorded(g: Graph) -> DataFrame:
    n = F.col("ord")
    attempts = g.generated.where("place = 1").select(n.alias("id"), F.concat(F.lit("A"), "entity_id").alias("target"), F.when(n % 5 == 0, "rust").when(n % 5 == 1, "go").otherwise("typescript").alias("language"), F.when(n % 3 != 0, F.concat(F.lit("tests/s"), (1 + n % 10).cast("string"), F.lit(".test.ts"))).alias("test_file"), (n % 7 == 0).alias("vacuous")).distinct()
    after = g.edges.where("type = 'TESTED_BY' and strength = 'hard'").select(F.concat(F.lit("A"), "from_id").alias("target"), F.col("to_id").alias("test")).distinct()
    return recorded_runs(attempts, after.where("length(target) % 3 = 0"), after)


def within_budget(rows, most: int) -> list:
    """Candidates (test, implementation) in rank order whose files together stay within ``most``; one that would
    exceed it is passed over whole. ``most`` bounds what is held, and the rows are read one by one."""
    taken, files = [], set()
    for test, implementation in rows:
        more = files | {test, implementation}
        if len(more) <= most:
            taken.append((test, implementation))
            files = more
    return taken
