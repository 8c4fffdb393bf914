"""The surface of scripts, read by statement: declarations, exports, re-exports and imported names.

A statement of the module's own scope begins a line without indentation; what is indented belongs to the
statement above. Statements are taken from the text by one pattern and parted by column expressions, so
that a file is one row until its statements are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_of
from ..registry import query
from ..sources.driver_tables import Graph
from .imports import COMMENTS

#: A statement: a clause in braces with what follows it on its line, or a line that a word of declarations begins.
STATEMENT = r"""(?m)^((?:import|export|const|let|var)\b[^;"'`=(\n]*\{[^}]*\}[^;\n]*|(?:import|export|declare|abstract|async|function|class|const|let|var|enum|interface|type|namespace|module)\b[^\n]*)"""
NAME = r"[A-Za-z_$][\w$]*"
DECLARED = rf"^(?:export\s+)?(?:declare\s+)?(?:abstract\s+|async\s+)*(const\s+enum|function|class|const|let|var|enum|interface|type|namespace|module)\b\s*\*?\s*({NAME})?"
LISTED = r"""(?s)^export\s+(type\s+)?\{([^}]*)\}(?:\s*from\s*["']([^"']+)["'])?"""
STARRED = rf"""(?s)^export\s+(type\s+)?\*\s*(?:as\s+({NAME})\s+)?from\s*["']([^"']+)["']"""
IMPORTED = r"""(?s)^import\s+(type\s+(?!from\b))?([^"']*?)\s*from\s*["']([^"']+)["']"""
#: Kinds of declarations as exports name them (fixed values).
KINDS = {"function": "function", "class": "class", "enum": "const", "const enum": "const", "const": "const", "let": "const", "var": "const", "interface": "type", "type": "type"}
#: Kinds that exist at run time (fixed values).
RUNTIME_KINDS = ["function", "class", "const", "default", "namespace"]


def contents(lines: DataFrame) -> DataFrame:
    """path and content of files from their statements (path, ord, code)."""
    rows = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "code"))).alias("s"))  # one file's statements
    return rows.select("path", F.array_join(F.transform("s", lambda x: x["code"]), "\n").alias("content"))


def spread(sources: DataFrame) -> DataFrame:
    """The files over all tasks: their patterns take far longer than their size tells."""
    return sources.repartition(max(8, sources.sparkSession.sparkContext.defaultParallelism * 2))


def statements(sources: DataFrame) -> DataFrame:
    """path, place and text of the statements of sources (path, content); ``body`` is what follows up to the closing brace of a namespace."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), COMMENTS, " ")
    found = sources.select("path", text.alias("text")).select("path", "text", F.posexplode(F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(1))).alias("place", "statement"))
    return found.select("path", "place", F.trim("statement").alias("statement"), F.when(F.col("statement").rlike(r"^(export\s+)?(namespace|module)\b"), F.col("text")).alias("text"))


def _elements(clause: Column) -> Column:
    """(of_type, source, name) of a list in braces."""
    parts = F.filter(F.transform(F.split(clause, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, r"^type (?!as\b|$)", "")
    return F.transform(parts, lambda x: F.struct((bare(x) != x).alias("of_type"), F.regexp_extract(bare(x), r"^([\w$]+)", 1).alias("source"), F.regexp_extract(bare(x), r"([\w$]+)$", 1).alias("name")))


def _variables(statement: Column) -> Column:
    """Names that a const, let or var statement binds: of a pattern in brackets its targets, else of each declarator."""
    rest = F.regexp_replace(statement, r"^(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+", "")
    pattern = F.regexp_extract(rest, r"(?s)^[\{\[]([^\}\]]*)", 1)
    targets = F.transform(F.split(pattern, ","), lambda x: F.regexp_extract(F.regexp_replace(F.trim(F.regexp_replace(x, r"=.*$", "")), r"^.*:\s*|^\.\.\.", ""), rf"^({NAME})$", 1))
    plain = F.regexp_replace(rest, r""""[^"\n]*"|'[^'\n]*'|`[^`]*`""", "0")
    for _ in range(4):  # brackets within brackets, from the inside
        plain = F.regexp_replace(plain, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>=;]*>", "")
    declarators = F.transform(F.split(plain, ","), lambda x: F.regexp_extract(F.trim(x), rf"^({NAME})", 1))
    return F.filter(F.when(rest.rlike(r"^[\{\[]"), targets).otherwise(declarators), lambda x: x != "")


def declarations(stmts: DataFrame) -> DataFrame:
    """path, place, name, kind and whether it is exported, of declarations; of a file's equal names the last counts elsewhere."""
    s = F.col("statement")
    word, name = F.regexp_replace(F.regexp_extract(s, DECLARED, 1), r"\s+", " "), F.regexp_extract(s, DECLARED, 2)
    # a namespace of types alone is none at run time
    body = F.substring_index(F.call_function("substring_index", F.col("text"), s, F.lit(-1)), "\n}", 1)
    lives = F.concat(s, F.lit("\n"), body).rlike(r"(?m)(?:[\s{;]|^)(?:function|class|const|let|var|enum)\s|^\s+[\w$.]+\(")
    kind = first_of([(word == w, k) for w, k in KINDS.items()], F.when(F.coalesce(lives, F.lit(False)), "namespace").otherwise("type"))
    rows = stmts.where(word != "").where(~s.rlike(r"^export\s+default\b")).where(~s.rlike(LISTED) & ~s.rlike(STARRED))
    names = F.when(word.isin("const", "let", "var"), _variables(s)).when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("path", "place", s.rlike(r"^export\b").alias("exported"), F.when(s.rlike(r"^(export\s+)?declare\b"), "type").otherwise(kind).alias("kind"), F.posexplode(names).alias("i", "name"))
    return rows.select("path", "place", "i", "name", "kind", "exported")


def imported_names(stmts: DataFrame) -> DataFrame:
    """path, name, specifier, source (``default`` and ``*`` stand for the whole) and of_type of imported names; the last of equal ones."""
    s = F.col("statement")
    clause = F.regexp_extract(s, IMPORTED, 2)
    none = F.array().cast("array<struct<of_type:boolean,source:string,name:string>>")
    whole = lambda pattern, source: F.when(F.regexp_extract(clause, pattern, 1) != "", F.array(F.struct(F.lit(False).alias("of_type"), F.lit(source).alias("source"), F.regexp_extract(clause, pattern, 1).alias("name")))).otherwise(none)
    found = F.concat(whole(rf"^({NAME})\s*(?:,|$)", "default"), whole(rf"\*\s*as\s+({NAME})", "*"), _elements(F.regexp_extract(clause, r"(?s)\{(.*)\}", 1)))
    rows = stmts.where(s.rlike(IMPORTED)).select("path", "place", (F.regexp_extract(s, IMPORTED, 1) != "").alias("all_types"), F.regexp_extract(s, IMPORTED, 3).alias("specifier"), F.posexplode(found).alias("i", "e"))
    last = rows.groupBy("path", F.col("e.name").alias("name")).agg(F.max_by(F.struct("specifier", F.col("e.source").alias("source"), (F.col("all_types") | F.col("e.of_type")).alias("of_type")), F.struct("place", "i")).alias("m"))
    return last.select("path", "name", "m.*")


def export_index(sources: DataFrame) -> DataFrame:
    """What each of sources (path, content) exposes, by entry:

    * ``local``: name and kind of a binding defined here (of equal names the last);
    * ``named``: name exposed here, specifier and the name there (source) of a re-export, also of an imported name;
    * ``star``: specifier of ``export *``.

    Re-exports carry of_type and their place among the file's statements."""
    stmts = statements(sources)
    s = F.col("statement")
    declared = declarations(stmts)
    kinds = declared.groupBy("path", "name").agg(F.max_by("kind", F.struct("place", "i")).alias("declared"))
    direct = declared.where("exported").select("path", "place", "i", "name", "kind")
    zero = F.lit(0).alias("i")
    default = stmts.where(s.rlike(r"^export\s+default\b")).select("path", "place", zero, F.lit("default").alias("name"), F.lit("default").alias("kind"))
    star = stmts.where(s.rlike(STARRED)).select("path", "place", (F.regexp_extract(s, STARRED, 1) != "").alias("of_type"), F.regexp_extract(s, STARRED, 2).alias("name"), F.regexp_extract(s, STARRED, 3).alias("specifier"))
    space = star.where("name <> ''").select("path", "place", zero, "name", F.when(F.col("of_type"), "type").otherwise("namespace").alias("kind"))
    lists = stmts.where(s.rlike(LISTED)).select("path", "place", (F.regexp_extract(s, LISTED, 1) != "").alias("all_types"), F.regexp_extract(s, LISTED, 3).alias("specifier"), F.posexplode(_elements(F.regexp_extract(s, LISTED, 2))).alias("i", "e"))
    lists = lists.select("path", "place", "i", "specifier", F.col("e.source").alias("source"), F.col("e.name").alias("name"), (F.col("all_types") | F.col("e.of_type")).alias("of_type"))
    there = lists.where("specifier <> ''").select("path", "place", "i", "name", "specifier", "source", "of_type")
    here = lists.where("specifier = ''").drop("specifier").withColumnRenamed("source", "local")
    names = imported_names(stmts).select("path", F.col("name").alias("local"), "specifier", "source", F.col("of_type").alias("import_of_type"))
    here = here.join(names, ["path", "local"], "left").join(kinds.withColumnRenamed("name", "local"), ["path", "local"], "left")
    passed = here.where("specifier is not null").select("path", "place", "i", "name", "specifier", "source", (F.col("of_type") | F.col("import_of_type")).alias("of_type"))
    own = here.where("specifier is null").select("path", "place", "i", "name", F.when(F.col("of_type"), "type").otherwise(F.coalesce("declared", F.lit("unknown"))).alias("kind"))
    local = direct.unionByName(default).unionByName(space).unionByName(own).groupBy("path", "name").agg(F.max_by(F.struct("kind", "place"), F.struct("place", "i")).alias("m")).select("path", "name", "m.*")
    text, no = F.lit(None).cast("string"), F.lit(False)
    out = ["path", "entry", "name", "kind", "specifier", "source", "of_type", "place"]
    rows = local.select("*", F.lit("local").alias("entry"), text.alias("specifier"), text.alias("source"), no.alias("of_type")).select(out)
    rows = rows.unionByName(there.unionByName(passed).select("*", F.lit("named").alias("entry"), text.alias("kind")).select(out))
    return rows.unionByName(star.where("name = ''").select("path", F.lit("star").alias("entry"), text.alias("name"), text.alias("kind"), "specifier", text.alias("source"), "of_type", "place"))


#: The same for DuckDB, over the lines of ``script_lines``: each statement's head is a line.
SURFACE_SQL = r""", heads as (select path, ord, i, line from (select path, ord, generate_subscripts(string_split(code, chr(10)), 1) as i, unnest(string_split(code, chr(10))) as line from script_lines) x where regexp_matches(line, '^(import|export|async|class|const|function) ')),
    import_parts as (select path, ord, i, 0 as j, regexp_extract(line, '^import (\w+) from', 1) as name, 'default' as source, false as of_type, regexp_extract(line, 'from "([^"]+)"', 1) as specifier from heads where regexp_matches(line, '^import \w+ from')
        union all select path, ord, i, 0, regexp_extract(line, '^import \* as (\w+) from', 1), '*', false, regexp_extract(line, 'from "([^"]+)"', 1) from heads where regexp_matches(line, '^import \* as')
        union all select path, ord, i, j, case when contains(e, ' as ') then split_part(e, ' as ', 2) else replace(e, 'type ', '') end, replace(split_part(e, ' as ', 1), 'type ', ''), whole or starts_with(e, 'type '), specifier
            from (select path, ord, i, starts_with(line, 'import type') as whole, regexp_extract(line, 'from "([^"]+)"', 1) as specifier, generate_subscripts(string_split(regexp_extract(line, '\{ (.*) \}', 1), ', '), 1) as j, unnest(string_split(regexp_extract(line, '\{ (.*) \}', 1), ', ')) as e from heads where regexp_matches(line, '^import (type )?\{')) y),
    imported as (select path, name, arg_max({'specifier': specifier, 'source': source, 'of_type': of_type}, (ord, i, j)) as m from import_parts group by path, name),
    named_heads as (select *, regexp_extract(line, '^(?:export )?(?:declare |abstract |async )*(function|class|const|interface|enum) (\w+)', 1) as word, regexp_extract(line, '^(?:export )?(?:declare |abstract |async )*(?:function|class|const|interface|enum) (\w+)', 1) as name, regexp_extract(line, '\), (\w+) =', 1) as more from heads where not starts_with(line, 'export default') and not starts_with(line, 'import')),
    declared as (select path, ord, i, 0 as j, name, case when contains(line, 'declare') or word = 'interface' then 'type' when word = 'enum' then 'const' else word end as kind, starts_with(line, 'export') as exported from named_heads where word <> '' union all select path, ord, i, 1, more, 'const', true from named_heads where word = 'const' and more <> ''),
    kinds as (select path, name, arg_max(kind, (ord, i, j)) as kind from declared group by path, name),
    list_parts as (select path, ord, i, generate_subscripts(es, 1) as j, unnest(es) as e, whole, specifier from (select path, ord, i, string_split(regexp_extract(line, '\{ (.*) \}', 1), ', ') as es, starts_with(line, 'export type') as whole, regexp_extract(line, 'from "([^"]+)"', 1) as specifier from heads where regexp_matches(line, '^export (type )?\{')) x),
    lists as (select path, ord, i, j, split_part(e, ' as ', 1) as source, case when contains(e, ' as ') then split_part(e, ' as ', 2) else e end as name, whole as of_type, specifier from list_parts),
    passed as (select l.path, l.ord, l.i, l.name, m.specifier, m.source, l.of_type or m.of_type as of_type from lists l join imported p on p.path = l.path and p.name = l.source where l.specifier = '' union all select path, ord, i, name, specifier, source, of_type from lists where specifier <> ''),
    local_parts as (select path, ord, i, j, name, kind from declared where exported union all select path, ord, i, 0, 'default', 'default' from heads where starts_with(line, 'export default')
        union all select path, ord, i, 0, regexp_extract(line, '^export \* as (\w+)', 1), 'namespace' from heads where starts_with(line, 'export * as')
        union all select l.path, ord, i, j, l.name, case when of_type then 'type' else coalesce(k.kind, 'unknown') end from lists l left join kinds k on k.path = l.path and k.name = l.source where specifier = '' and not exists (select 1 from imported p where p.path = l.path and p.name = l.source)),
    locals as (select path, name, arg_max(kind, (ord, i, j)) as kind from local_parts group by path, name),
    stars as (select path, ord, i, regexp_extract(line, 'from "([^"]+)"', 1) as specifier, starts_with(line, 'export type') as of_type from heads where regexp_matches(line, '^export (type )?\* from')),
    surface as (select path, 'local' as entry, name, kind, cast(null as varchar) as specifier, cast(null as varchar) as source, false as of_type from locals union all select path, 'named', name, null, specifier, source, of_type from passed union all select path, 'star', null, null, specifier, null, of_type from stars)"""


@query("export_index", "script_lines", SURFACE_SQL + " select path, entry, name, kind, specifier, source, of_type from surface")
def _export_index(g: Graph) -> DataFrame:
    return export_index(contents(g.script_lines)).drop("place")
