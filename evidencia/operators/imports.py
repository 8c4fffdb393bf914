"""Imports of scripts, by patterns: specifiers, kinds, bound names; and their targets among known files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.driver_tables import Graph

#: An import or re-export statement: keyword, ``type``, clause and specifier. Statements begin a line; a clause is a
#: name, a list in braces or a star, so that it never runs into the next statement.
STATIC = r"""(?m)^[ \t]*(import|export)[ \t]+(type[ \t]+)?((?:[A-Za-z_$][\w$]*[ \t]*(?:,\s*)?)?(?:\{[^}]*\}|\*(?:[ \t]*as[ \t]+[\w$]+)?)?)(?:\s*from[ \t]*)?["']([^"'\n]+)["']"""
#: ``import("x")`` and ``require("x")``.
CALLED = r"""\b(?:import|require)[ \t]*\([ \t]*["']([^"'\n]+)["']"""
#: Line and block comments go first, so that what they quote is no import.
COMMENTS = r"(?s)/\*.*?\*/|(?m)(?:^|[ \t])//[^\n]*"


def _bindings(clause: Column) -> Column:
    """Imported names of a clause: ``default``, ``*`` and named ones without types, each as ``imported local``."""
    named = F.filter(F.transform(F.split(F.regexp_extract(clause, r"(?s)\{(.*?)\}", 1), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~x.rlike("^type "))
    pairs = F.transform(named, lambda x: F.concat(F.regexp_extract(x, r"^([\w$]+)", 1), F.lit(" "), F.regexp_extract(x, r"([\w$]+)$", 1)))
    default, space = F.regexp_extract(clause, r"^\s*([A-Za-z_$][\w$]*)\s*(?:,|$)", 1), F.regexp_extract(clause, r"\*\s*as\s+([\w$]+)", 1)
    return F.concat(F.when(default != "", F.array(F.concat(F.lit("default "), default))).otherwise(F.array().cast("array<string>")), F.when(space != "", F.array(F.concat(F.lit("* "), space))).otherwise(F.array().cast("array<string>")), pairs)


def extracted(sources: DataFrame) -> DataFrame:
    """specifier, kind (runtime or type) and bindings of the imports of sources (path, content), in order by kind of
    statement. A statement is of types if it says so or all its names do."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), COMMENTS, " ")
    groups = [F.regexp_extract_all(text, F.lit(STATIC), F.lit(i)) for i in (1, 2, 3, 4)]
    rows = sources.select("path", F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("word", "type", "clause", "specifier"))])).alias("s")).select("path", "s.*")
    rows = rows.where((F.col("word") == "import") | (F.trim("clause") != ""))
    inner = F.regexp_extract("clause", r"(?s)^\s*\{(.*)\}\s*$", 1)  # names alone
    all_types = inner.rlike(r"\S") & F.forall(F.filter(F.split(inner, ","), lambda x: x.rlike(r"\S")), lambda x: F.regexp_replace(x, r"^\s+", "").rlike(r"^type\s"))
    is_type = (F.col("type") != "") | (F.col("word") == "import") & all_types
    none = F.array().cast("array<string>")
    static = rows.select("path", "specifier", F.when(is_type, "type").otherwise("runtime").alias("kind"), F.when(F.col("word") == "import", _bindings(F.col("clause"))).otherwise(none).alias("bindings"))
    called = sources.select("path", F.explode(F.regexp_extract_all(text, F.lit(CALLED), F.lit(1))).alias("specifier"), F.lit("runtime").alias("kind"), none.alias("bindings"))
    return static.unionByName(called)


#: Endings that a specifier without one may stand for, in order (fixed values).
ENDINGS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Endings of scripts as written and as their sources have them (fixed values).
WRITTEN = {".js": [".ts", ".tsx", ".js"], ".jsx": [".tsx", ".jsx"], ".mjs": [".mts", ".mjs"], ".cjs": [".cts", ".cjs"]}


def normalised(folder: Column, specifier: Column) -> Column:
    """A relative specifier's path from the root, its dots resolved; null if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(True).alias("inside"))
    step = lambda acc, x: F.struct(
        F.when(x == "..", F.slice(acc["held"], 1, F.greatest(F.size(acc["held"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["held"], x)).alias("held"),
        (acc["inside"] & ((x != "..") | (F.size(acc["held"]) > 0))).alias("inside"),
    )
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["inside"], F.array_join(acc["held"], "/")))


def tries(at: Column) -> Column:
    """The files that a path without a certain ending may stand for, in order."""
    bare = F.regexp_replace(at, r"\.[cm]?jsx?$", "")
    ending = F.regexp_extract(at, r"(\.[cm]?jsx?)$", 1)
    by_ending = F.array(at, *[F.concat(at, F.lit(e)) for e in ENDINGS])
    written = F.array().cast("array<string>")
    for end, sources in WRITTEN.items():
        written = F.when(ending == end, F.array(*[F.concat(bare, F.lit(x)) for x in sources])).otherwise(written)
    return F.concat(written, by_ending)


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The imports with their target among files (path), for relative specifiers; null where none is there."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = imports.withColumn("at", F.when(F.col("specifier").startswith("."), normalised(folder, F.col("specifier"))))
    keyed = rows.select("path", "specifier", "at").where("at is not null").distinct()
    return rows.drop("at").join(_first_known(keyed.select("path", "specifier", F.posexplode(tries(F.col("at"))).alias("rank", "target")), files), ["path", "specifier"], "left")


def _first_known(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Of each path and specifier the first candidate (rank, target) that is a file."""
    known = files.select(F.col("path").alias("target")).distinct()
    return candidates.join(known, "target").groupBy("path", "specifier").agg(F.min_by("target", "rank").alias("target"))


def _configured(configs: DataFrame, paths: DataFrame) -> DataFrame:
    """path with the base folder and the patterns (pattern and targets) of its nearest configuration (dir, base, patterns)."""
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    met = paths.select("path", F.explode(F.array_distinct(above)).alias("a")).select("path", "a.*").join(configs, "dir")
    return met.groupBy("path").agg(F.max_by(F.struct("dir", "base", "patterns"), "depth").alias("c")).select("path", "c.dir", "c.base", "c.patterns")


def resolved_by_configuration(imports: DataFrame, files: DataFrame, configs: DataFrame, packages: DataFrame) -> DataFrame:
    """The imports with their target among files (path), for all specifiers, or null.

    A relative specifier stands for its path. Any other is held against the patterns of the file's nearest
    configuration (dir, base, patterns: array of pattern, with one star at most, and targets in order): an equal pattern, else
    the one with the longest part before its star. Its targets come first, then the specifier below the base folder, then the
    workspace package (name, dir) whose name it begins with; targets lie below the base folder, or below ``dir`` without one."""
    keyed = imports.select("path", "specifier").distinct()
    rows = keyed.join(_configured(configs, keyed.select("path").distinct()), "path", "left")
    spec, folder = F.col("specifier"), F.regexp_replace("path", "/?[^/]*$", "")
    relative = spec.startswith(".")
    prefix, suffix = (lambda p: F.substring_index(p["pattern"], "*", 1)), (lambda p: F.when(p["pattern"].contains("*"), F.substring_index(p["pattern"], "*", -1)).otherwise(F.lit("")))
    starred = lambda p: p["pattern"].contains("*")
    fits = lambda p: F.when(starred(p), spec.startswith(prefix(p)) & spec.endswith(suffix(p)) & (F.length(spec) >= F.length(prefix(p)) + F.length(suffix(p)))).otherwise(spec == p["pattern"])
    ranked = F.array_sort(F.transform(F.filter(F.coalesce("patterns", F.array().cast("array<struct<pattern:string,targets:array<string>>>")), fits), lambda p: F.struct(F.when(starred(p), -F.length(prefix(p))).otherwise(-(1 << 20)).alias("rank"), p["pattern"].alias("pattern"), p["targets"].alias("targets"))))
    rows = rows.withColumn("best", F.when(~relative, F.get(ranked, F.lit(0))))
    middle = F.when(F.col("best.pattern").contains("*"), F.substring(spec, F.length(F.substring_index("best.pattern", "*", 1)) + 1, F.length(spec) - F.length("best.pattern") + 1)).otherwise(F.lit(""))
    root = F.coalesce("base", "dir")
    by_pattern = F.coalesce(F.transform("best.targets", lambda t: normalised(root, F.replace(t, F.lit("*"), middle))), F.array().cast("array<string>"))
    by_base = F.when(~relative & F.col("base").isNotNull(), F.array(normalised(F.col("base"), spec))).otherwise(F.array().cast("array<string>"))
    name = F.when(spec.startswith("@"), F.regexp_extract(spec, "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(spec, "^([^/]+)", 1))
    rows = rows.withColumn("package", F.when(~relative, name)).join(packages.select(F.col("name").alias("package"), F.col("dir").alias("package_dir")), "package", "left")
    by_package = F.when(F.col("package_dir").isNotNull(), F.array(normalised(F.col("package_dir"), F.substring(spec, F.length("package") + 2, F.length(spec))))).otherwise(F.array().cast("array<string>"))
    at = F.filter(F.when(relative, F.array(normalised(folder, spec))).otherwise(F.concat(by_pattern, by_base, by_package)), lambda x: x.isNotNull())
    each = rows.select("path", "specifier", F.posexplode(at).alias("place", "at")).select("path", "specifier", "place", F.posexplode(tries(F.col("at"))).alias("n", "target"))
    found = _first_known(each.select("path", "specifier", F.struct("place", "n").alias("rank"), "target"), files)
    return imports.join(found, ["path", "specifier"], "left")


def import_edges(found: DataFrame, tests: DataFrame) -> DataFrame:
    """IMPORTS edges, one for each pair of files, and MAY_RELATE_TO candidates from tests (path) to what they import
    at run time and is no test: from_id, to_id, type, confidence."""
    pairs = found.where("target is not null and target <> path")
    edges = pairs.select(F.col("path").alias("from_id"), F.col("target").alias("to_id")).distinct().select("*", F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("confidence"))
    test = tests.select("path").distinct()
    from_tests = pairs.where("kind = 'runtime'").join(test, "path", "left_semi").join(test.select(F.col("path").alias("target")), "target", "left_anti")
    related = from_tests.select(F.col("path").alias("from_id"), F.col("target").alias("to_id")).distinct().select("*", F.lit("MAY_RELATE_TO").alias("type"), F.lit(0.75).alias("confidence"))
    return edges.unionByName(related)


@query("import_edges", "modules", "select distinct path as from_id, target as to_id, 'IMPORTS' as type, 1.0::double as confidence from (select path, target, specifier from modules) x where target <> path union all select distinct path, target, 'MAY_RELATE_TO', 0.75::double from modules where is_test and not target_is_test and kind = 'runtime' and target <> path")
def _import_edges(g: Graph) -> DataFrame:
    """Module sources are written from the relation's pairs, read by pattern and resolved."""
    rows = g.modules
    files = rows.select(F.col("path")).unionByName(rows.select(F.col("target").alias("path"))).distinct()
    tests = rows.where("is_test").select("path").unionByName(rows.where("target_is_test").select(F.col("target").alias("path"))).distinct()
    line = F.when(F.col("kind") == "type", F.concat(F.lit("import type {T} from '"), "specifier", F.lit("';"))).otherwise(F.concat(F.lit("import {a, b as c} from '"), "specifier", F.lit("';")))
    sources = rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))  # few lines of a file
    return import_edges(resolved(extracted(sources), files), tests)
