"""Walks from an imported name through re-exports to the file that defines it.

All walks go on together, one re-export a round: each open step meets the definitions, the named re-exports and the
stars of its file in equi-joins. Then the steps' outcomes are passed back, round by round: a single re-export has its
target's outcome; of several stars, equal definitions count once, unlike ones are ambiguous, and a branch that was
cut short spoils all, as it might hide a second definition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import percent_or_null
from ..lineage import cut
from ..registry import query
from ..sources.driver_tables import SCRIPT_CONFIGS, SCRIPT_PACKAGES, Graph
from .imports import extracted, resolved_by_configuration
from .scripts import RUNTIME_KINDS, SURFACE_SQL, contents, export_index, imported_names, spread, statements

#: Re-exports of a walk, and steps of one with all its branches (fixed values).
MOST_HOPS, MOST_STEPS = 5, 4000
#: Outcomes that cut a branch short (fixed values).
CUT_SHORT = ["depth-exceeded", "budget-exhausted"]
DECLARATION_FILE = r"(?i)\.d\.[mc]?ts$"


def walk_barrels(starts: DataFrame, index: DataFrame, targets: DataFrame) -> DataFrame:
    """file, binding, status, terminal_file, terminal_binding, terminal_kind, depth and covered of each of starts (file, binding).

    ``index`` is what ``export_index`` gives, ``targets`` (path, specifier, target) has the files that its specifiers stand for.
    A walk whose branches have more than ``MOST_STEPS`` steps is given up. Unlike a walk that goes depth first, this one counts
    all branches of a round before it looks for one that spoils the rest. A round's steps are counted before they are
    made, so that those of a walk that is given up never are; stars of one file that lead to the same file are one step, which
    counts as many."""
    aim = targets.where("target is not null").select("path", "specifier", "target").distinct()
    local = index.where("entry = 'local'").select(F.col("path").alias("file"), F.col("name").alias("binding"), "kind")
    exports = index.where("entry <> 'local'").join(aim, ["path", "specifier"], "left").select(F.col("path").alias("file"), F.col("name").alias("binding"), "entry", "source", "of_type", "target", "place")
    named = exports.where("entry = 'named'").groupBy("file", "binding").agg(F.count("*").alias("named"), F.first(F.struct("target", "source", "of_type")).alias("to"))
    star = exports.where("entry = 'star'").withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1)
    ends = star.groupBy("file").agg(F.count("*").alias("n_stars"), F.min(F.when(F.col("target").isNull(), F.col("i"))).alias("blind_at"))
    sure = star.join(ends, "file").where("blind_at is null or i < blind_at").groupBy("file", "target", "of_type").agg(F.min("i").alias("i"), F.count("*").alias("times"))
    stars = ends.join(sure.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("i", "target", "of_type", "times"))).alias("stars")), "file", "left")  # one for each file behind
    local, named, stars = cut(local), cut(named), cut(stars)
    key = F.concat_ws("::", "file", "binding")
    open_ = starts.select("file", "binding").distinct().select(F.col("file").alias("start"), F.col("binding").alias("wanted"), F.lit("").alias("step"), "file", "binding", F.lit(False).alias("of_type"), F.array().cast("array<string>").alias("seen"), F.lit(1).cast("long").alias("times"))
    rounds, counts = [], None
    for depth in range(MOST_HOPS + 2):
        met = open_.join(local, ["file", "binding"], "left").join(named, ["file", "binding"], "left").join(stars, "file", "left")
        by_name = F.col("named").isNotNull()
        kid = lambda i, target, binding, of_type, times: F.struct(i.cast("int").alias("i"), target.alias("target"), binding.alias("binding"), of_type.alias("of_type"), times.cast("long").alias("times"))
        none = F.array().cast("array<struct<i:int,target:string,binding:string,of_type:boolean,times:bigint>>")
        n = F.when(by_name, 1).otherwise(F.coalesce("n_stars", F.lit(0)))
        blind = F.when(by_name, F.col("to.target").isNull()).otherwise(F.col("blind_at").isNotNull())
        to = F.when(by_name, F.when(~blind, F.array(kid(F.lit(0), F.col("to.target"), F.col("to.source"), F.col("to.of_type"), F.lit(1))))).otherwise(F.transform("stars", lambda s: kid(s["i"], s["target"], F.col("binding"), s["of_type"], s["times"])))
        status = (
            F.when(F.lit(depth > MOST_HOPS), "depth-exceeded").when(F.array_contains("seen", key), "cycle").when(F.col("kind").isNotNull(), "terminal").when(F.col("named") >= 2, "ambiguous")
            .when(F.col("named").isNull() & (F.col("binding") == "default"), "unresolved").when(n == 0, "unresolved").when((n == 1) & blind, "unresolved")
        )
        rows = met.withColumn("status", status).withColumn("kids", F.when(F.col("status").isNull(), F.coalesce(to, none)))
        covered = ~F.col("of_type") & ~F.col("file").rlike(DECLARATION_FILE) & F.col("kind").isin(RUNTIME_KINDS)
        rows = cut(rows.select("start", "wanted", "step", "file", "binding", "of_type", F.array_append("seen", key).alias("seen"), "status", "kind", (F.col("status").eqNullSafe("terminal") & covered).alias("covered"), "kids", "times", (n > 1).alias("branches"), blind.alias("blind")))
        rounds.append(rows)
        ahead = F.col("times") * F.aggregate("kids", F.lit(0).cast("long"), lambda a, x: a + x["times"])
        now = rows.groupBy("start", "wanted").agg(F.sum("times").alias("steps"), F.coalesce(F.sum(ahead), F.lit(0)).alias("ahead"), F.lit(0).cast("long").alias("known"))
        if counts is not None:
            now = counts.select("start", "wanted", "steps", F.lit(0).cast("long").alias("ahead"), F.col("total").alias("known")).unionByName(now).groupBy("start", "wanted").agg(F.sum("steps").alias("steps"), F.sum("ahead").alias("ahead"), F.max("known").alias("known"))
        counts = cut(now.select("start", "wanted", "steps", F.greatest("known", F.col("steps") + F.col("ahead")).alias("total")))
        live = rows.where("status is null").join(counts.where(F.col("total") <= MOST_STEPS), ["start", "wanted"], "left_semi")
        if depth > MOST_HOPS or live.isEmpty():
            break
        open_ = live.select("start", "wanted", "step", "of_type", "seen", "times", F.explode("kids").alias("t")).select("start", "wanted", F.concat("step", F.lit("."), F.lpad(F.col("t.i").cast("string"), 6, "0")).alias("step"), F.col("t.target").alias("file"), F.col("t.binding").alias("binding"), (F.col("of_type") | F.col("t.of_type")).alias("of_type"), "seen", (F.col("times") * F.col("t.times")).alias("times"))
        open_ = cut(open_)
    outcome = F.struct("status", F.when(F.col("status") == "terminal", F.col("file")).alias("file"), F.when(F.col("status") == "terminal", F.col("binding")).alias("binding"), F.when(F.col("status") == "terminal", F.col("kind")).alias("kind"), "depth", "covered")
    below = None
    for depth in range(len(rounds) - 1, -1, -1):
        rows = rounds[depth].withColumn("depth", F.lit(depth).cast("long"))
        ended = rows.where("status is not null").select("start", "wanted", "step", outcome.alias("found"))
        inner = rows.where("status is null").select("start", "wanted", "step", "branches", "blind", "depth")
        if below is not None:
            up = below.select("start", "wanted", F.regexp_replace("step", r"\.\d+$", "").alias("step"), F.col("step").alias("child"), "found")
            hit = F.col("found.status") == "terminal"
            spoilt = F.col("found.status").isin(CUT_SHORT)
            groups = up.groupBy("start", "wanted", "step").agg(
                F.min_by("found", "child").alias("only"), F.min_by(F.when(spoilt, F.col("found.status")), F.when(spoilt, F.col("child"))).alias("spoilt"),
                F.count_distinct(F.when(hit, F.struct("found.file", "found.binding"))).alias("terminals"), F.min_by(F.when(hit, F.col("found")), F.when(hit, F.struct(~F.col("found.covered"), "child"))).alias("best"),
            )
            inner = inner.join(groups, ["start", "wanted", "step"], "left")
            text = F.lit(None).cast("string")
            failed = lambda status: F.struct(status.alias("status"), text.alias("file"), text.alias("binding"), text.alias("kind"), F.col("depth").alias("depth"), F.lit(False).alias("covered"))
            several = F.when(F.col("spoilt").isNotNull(), failed(F.col("spoilt"))).when(F.col("blind"), failed(F.lit("unresolved"))).when(F.col("terminals") == 1, F.col("best")).when(F.col("terminals") > 1, failed(F.lit("ambiguous"))).otherwise(failed(F.lit("unresolved")))
            inner = inner.select("start", "wanted", "step", F.when(F.col("branches"), several).otherwise(F.col("only")).alias("found"))
            ended = ended.unionByName(inner)
        below = cut(ended)
    given_up = counts.where(F.col("total") > MOST_STEPS)
    first_fork = rounds[0].where("branches and status is null").select("start", "wanted", F.lit(0).cast("long").alias("fork"))
    for depth in range(1, len(rounds)):
        first_fork = first_fork.unionByName(rounds[depth].where("branches and status is null").select("start", "wanted", F.lit(depth).cast("long").alias("fork")))
    given_up = given_up.join(first_fork, ["start", "wanted"]).groupBy("start", "wanted").agg(F.min("fork").alias("fork"))
    rows = below.join(given_up, ["start", "wanted"], "left")
    said = lambda c: F.when(F.col("fork").isNull(), F.col(f"found.{c}"))
    return rows.select(
        F.col("start").alias("file"), F.col("wanted").alias("binding"), F.coalesce(said("status"), F.lit("budget-exhausted")).alias("status"), said("file").alias("terminal_file"), said("binding").alias("terminal_binding"), said("kind").alias("terminal_kind"), F.coalesce("fork", "found.depth").alias("depth"), (F.col("fork").isNull() & F.col("found.covered")).alias("covered"),
    )


class Scripts:
    """The scripts of the tables: contents, statements, export index, imported names and the targets of all specifiers."""

    def __init__(self, g: Graph):
        self.spark = g.spark
        self.sources = cut(spread(contents(g.script_lines)))
        self.files = self.sources.select("path")

    @cached_property
    def statements(self) -> DataFrame:
        return cut(statements(self.sources))

    @cached_property
    def index(self) -> DataFrame:
        return cut(export_index(self.sources))

    @cached_property
    def imports(self) -> DataFrame:
        return cut(imported_names(self.statements))

    @cached_property
    def targets(self) -> DataFrame:
        values = lambda rows, names: self.spark.createDataFrame(rows, names)
        folders = {d: base for d, base, _, _ in SCRIPT_CONFIGS}
        configs = values([(d, base, [(p, t) for e, _, p, t in SCRIPT_CONFIGS if e == d]) for d, base in folders.items()], "dir string, base string, patterns array<struct<pattern:string,targets:array<string>>>")
        packages = values(SCRIPT_PACKAGES, "name string, dir string")
        wanted = self.index.where("specifier is not null").select("path", "specifier").unionByName(self.imports.select("path", "specifier")).distinct()
        return cut(resolved_by_configuration(wanted, self.files, configs, packages))

    def walks(self) -> DataFrame:
        """Walks of all imported names whose specifier stands for a file."""
        met = self.imports.where("source <> '*'").join(self.targets.where("target is not null"), ["path", "specifier"])
        return walk_barrels(met.select(F.col("target").alias("file"), F.col("source").alias("binding")), self.index, self.targets)


#: What DuckDB adds for the targets of all specifiers: candidates in order, each with all endings.
TARGETS_SQL = SURFACE_SQL + r""", files as (select distinct path from script_lines),
    wanted as (select path, specifier from surface where specifier is not null union select path, m.specifier from imported),
    placed as (select *, regexp_replace(path, '/?[^/]*$', '') as folder, case when starts_with(path, 'src/t/') then 2 when starts_with(path, 'src/a/') then 3 else 1 end as config from wanted),
    roots as (select path, specifier, case when starts_with(specifier, '.') then [folder || '/' || specifier] when starts_with(specifier, '@/') and config = 1 then ['src/' || specifier[3:], 'src/' || specifier] when starts_with(specifier, '@/') and config = 2 then ['src/e/' || specifier[3:], 'src/' || specifier[3:], 'src/' || specifier]
        when starts_with(specifier, '@/t/') and config = 3 then ['src/a/../t/' || specifier[5:]] when starts_with(specifier, '#kit/') and config <> 3 then ['src/' || specifier, 'src/t/' || specifier[6:]] when starts_with(specifier, '#kit/') then ['src/t/' || specifier[6:]] when config <> 3 then ['src/' || specifier] else [] end as spot from placed),
    plain as (select path, specifier, generate_subscripts(spot, 1) as place, regexp_replace(regexp_replace(unnest(spot), '/\./', '/', 'g'), '[^/]+/\.\./', '') as spot from roots),
    guesses as (select path, specifier, place, unnest(range(0, 13)) as n, unnest([case when ends_with(spot, '.js') then regexp_replace(spot, 'js$', 'ts') else spot end, spot || '.ts', spot || '.tsx', spot || '.mts', spot || '.cts', spot || '.js', spot || '.jsx', spot || '.mjs', spot || '.cjs', spot || '/index.ts', spot || '/index.tsx', spot || '/index.js', spot || '/index.jsx']) as target from plain),
    targets as (select w.path, w.specifier, t.target from wanted w left join (select g.path, specifier, arg_min(target, (place, n)) as target from guesses g join files f on f.path = target group by g.path, specifier) t on t.path = w.path and t.specifier = w.specifier)"""

_FAILED = "{{'status': {0}, 'file': null::varchar, 'binding': null::varchar, 'kind': null::varchar, 'depth': {1}, 'covered': false}}"


def _collapse_sql() -> str:
    """The outcomes of steps at each depth from those below, one table for each depth."""
    end = "select start, wanted, step, {'status': status, 'file': case when status = 'terminal' then file end, 'binding': case when status = 'terminal' then binding end, 'kind': case when status = 'terminal' then kind end, 'depth': depth, 'covered': covered} as found from walk where depth = %d and status is not null"
    out = [f"r{MOST_HOPS + 1} as ({end % (MOST_HOPS + 1)})"]
    for d in range(MOST_HOPS, -1, -1):
        fail = lambda status: _FAILED.format(status, d)  # noqa: B023, E731
        out.append(
            f"r{d} as ({end % d} union all select w.start, w.wanted, w.step, case when not many then g.only_one when g.spoilt is not null then {fail('g.spoilt')} when blind > 0 then {fail(repr('unresolved'))} when g.n = 1 then g.best when g.n > 1 then {fail(repr('ambiguous'))} else {fail(repr('unresolved'))} end from walk w left join "
            f"(select start, wanted, regexp_replace(step, '\\.\\d+$', '') as up, arg_min(found, step) as only_one, arg_min(found.status, step) filter (found.status in ('depth-exceeded', 'budget-exhausted')) as spoilt, count(distinct found.file || found.binding) filter (found.status = 'terminal') as n, arg_min(found, (not found.covered, step)) filter (found.status = 'terminal') as best from r{d + 1} group by 1, 2, 3) g "
            f"on g.start = w.start and g.wanted = w.wanted and g.up = w.step where w.depth = {d} and w.status is null)"
        )
    return ", ".join(out)


WALKS_SQL = TARGETS_SQL + r""", named_to as (select s.path as file, s.name as binding, count(*) as n, first({'target': t.target, 'binding': s.source, 'of_type': s.of_type}) as k from surface s left join targets t on t.path = s.path and t.specifier = s.specifier where entry = 'named' group by 1, 2),
    star_to as (select s.path as file, list({'target': t.target, 'of_type': s.of_type} order by s.ord, s.i) as ks from stars s left join targets t on t.path = s.path and t.specifier = s.specifier group by 1),
    begun as (select distinct t.target as start, p.m.source as wanted from imported p join targets t on t.path = p.path and t.specifier = p.m.specifier where t.target is not null and p.m.source <> '*'),
    walk(start, wanted, step, depth, file, binding, of_type, seen, status, kind, covered, kids, blind, many) as (
        select start, wanted, '', -1, null::varchar, null::varchar, false, []::varchar[], null::varchar, null::varchar, false, [{'target': start, 'binding': wanted, 'of_type': false}], 0, false from begun
        union all select start, wanted, step, depth, file, binding, of_type, list_append(seen, file || '::' || binding), status, kind, coalesce(status = 'terminal' and not of_type and not regexp_matches(file, '\.d\.[mc]?ts$') and kind in ('function', 'class', 'const', 'default', 'namespace'), false), case when status is null then case when cut > 0 then to_list[1:cut - 1] else to_list end end, case when cut > 0 then 1 else 0 end, coalesce(len(to_list) > 1, false)
        from (select *, case when depth > 5 then 'depth-exceeded' when list_contains(seen, file || '::' || binding) then 'cycle' when kind is not null then 'terminal' when named > 1 then 'ambiguous' when named is null and binding = 'default' then 'unresolved' when coalesce(len(to_list), 0) = 0 then 'unresolved' when len(to_list) = 1 and cut > 0 then 'unresolved' end as status
            from (select *, coalesce(list_position(list_transform(to_list, lambda x: x.target is null), true), 0) as cut
                from (select x.start, x.wanted, case when x.depth < 0 then '' else x.step || '.' || lpad(x.i::varchar, 6, '0') end as step, x.depth + 1 as depth, x.k.target as file, x.k.binding as binding, x.of_type or x.k.of_type as of_type, x.seen, l.kind, n.n as named, case when n.n is not null then [n.k] else list_transform(s.ks, lambda q: {'target': q.target, 'binding': x.k.binding, 'of_type': q.of_type}) end as to_list
                    from (select *, generate_subscripts(kids, 1) - 1 as i, unnest(kids) as k from walk where status is null and depth <= 5) x left join locals l on l.path = x.k.target and l.name = x.k.binding left join named_to n on n.file = x.k.target and n.binding = x.k.binding left join star_to s on s.file = x.k.target) y) z) u),
    """ + _collapse_sql()


@query("script_targets", "script_lines", TARGETS_SQL + " select path, specifier, target from targets")
def _targets(g: Graph) -> DataFrame:
    """The file that each specifier of a script stands for, by paths, patterns, base folders and packages."""
    return Scripts(g).targets.select("path", "specifier", "target")


@query("barrel_walk", "script_lines", WALKS_SQL + " select start as file, wanted as binding, found.status as status, found.file as terminal_file, found.binding as terminal_binding, found.kind as terminal_kind, found.depth::bigint as depth, found.covered as covered from r0")
def _barrel_walk(g: Graph) -> DataFrame:
    return Scripts(g).walks()


@query(
    "barrel_axis",
    "script_lines",
    WALKS_SQL
    + r""", by_statement as (select path, ord, i, specifier, bool_and(of_type) as all_types, list(source) filter (source <> '*' and not of_type) as bs from import_parts group by path, ord, i, specifier),
    counted as (select b.*, t.target from by_statement b join targets t on t.path = b.path and t.specifier = b.specifier where contains(b.path, '.test.') and not all_types and t.target is not null and not contains(t.target, '.test.') and len(bs) > 0 and t.target in (select path from surface where entry <> 'local')),
    judged as (select path, ord, i, bool_and(r.found.covered) as good from (select *, unnest(bs) as b from counted) c join r0 r on r.start = c.target and r.wanted = c.b group by path, ord, i)
    select count(*) as n, count(*) filter (good) as resolved, case when count(*) > 0 then floor(1000.0 * count(*) filter (good) / count(*) + 0.5) / 10 end as pct from judged""",
)
def _barrel_axis(g: Graph) -> DataFrame:
    """Of the tests' runtime imports from files with re-exports, how many reach a runtime definition with all their names."""
    s = Scripts(g)
    barrels = s.index.where("entry <> 'local'").select(F.col("path").alias("target")).distinct()
    found = extracted(s.sources).where("kind = 'runtime'").where(F.col("path").contains(".test.")).withColumn("n", F.monotonically_increasing_id())
    names = cut(found.select("path", "n", "specifier", F.explode(F.transform("bindings", lambda b: F.substring_index(b, " ", 1))).alias("binding")).where("binding <> '*'"))
    met = names.join(s.targets, ["path", "specifier"]).where(~F.col("target").contains(".test.")).join(barrels, "target", "left_semi")
    walks = s.walks().select(F.col("file").alias("target"), "binding", "covered")
    judged = met.join(walks, ["target", "binding"]).groupBy("path", "n").agg(F.bool_and("covered").alias("good"))
    n, good = F.count("*"), F.count_if("good")
    return judged.agg(n.alias("n"), good.alias("resolved"), percent_or_null(good, n).alias("pct"))
