"""Column expressions: rounding, names, paths, tokens, priorities, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half up on the binary double, unlike round(), which works on its decimal rendering."""
    k = 10**digits
    return F.floor(x * F.lit(float(k)) + F.lit(0.5)).cast("double") / F.lit(float(k))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(round_half_up(100.0 * part / whole, digits))


def percent_or_null(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole != 0, round_half_up(100.0 * part / whole, digits))


def saturate(count: Column, target: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), count / F.lit(float(target))))


def slug(text: Column) -> Column:
    """Lower case, other characters as single hyphens, 64 characters, ``item`` if nothing is left."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 64), F.lit("")), F.lit("item"))


def short_hash(*parts: Column) -> Column:
    """12 hexadecimal digits of the parts' digest; null when a part is."""
    return F.substring(F.sha2(F.array_join(F.array(*parts), "|"), 256), 1, 12)


def node_id(kind: Column, external_id: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat(kind, F.lit("|"), external_id), 256), 1, 12))


def edge_id(prefix: str, from_id: Column, type_: Column, to_id: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat(from_id, F.lit("|"), type_, F.lit("|"), to_id), 256), 1, 12))


#: Words that never count as tokens when flows and tests are matched (fixed values).
STOP_WORDS = ["test", "tests", "spec", "should", "works", "found", "from", "names", "behavior", "behaviors", "service", "controller", "handler", "route", "api", "src", "app"]
#: Words that never count when behaviours and symbols are matched (fixed values).
LINK_STOP_WORDS = ["and", "are", "behavior", "code", "criteria", "expected", "file", "for", "from", "has", "have", "into", "not", "the", "this", "that", "test", "tests", "with"]


def tokens(text: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Distinct lower-case words, camel case split, of ``least`` characters, without stop words."""
    split = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    kept = F.filter(split, lambda w: F.length(w) >= least)
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, STOP_WORDS if stop is None else stop)))


def shared_depth(a: Column, b: Column) -> Column:
    """How many path segments two paths have in common from the start."""
    parts = lambda c: F.filter(F.split(c, r"[\\/]+"), lambda x: x != "")
    same = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    return F.coalesce(F.when(first_other > 0, first_other - 1).otherwise(F.size(same)), F.lit(0))


def priority_rank(priority: Column) -> Column:
    """4 to 1 by the first word that occurs (the short forms must be all of it), else 0."""
    p = F.lower(F.coalesce(priority, F.lit("")))
    out = F.when(p.contains("crit") | (p == "p0"), 4)
    for rank, word, short in ((3, "high", "p1"), (2, "med", "p2"), (1, "low", "p3")):
        out = out.when(p.contains(word) | (p == short), rank)
    return out.otherwise(0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    """File name without test marks and extension."""
    return F.regexp_replace(basename(path), r"(\.(test|spec))?\.[^.]+$", "")


def path_parts(path: Column) -> Column:
    """Segments of a path without leading dots and slashes and without what follows ``#`` or ``?``."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^[./]+", ""), r"(?s)[#?].*$", "")
    return F.filter(F.split(cleaned, r"[\\/]"), lambda x: x != "")


def area(path: Column) -> Column:
    """The part of the code that a file belongs to: its first two directories, or the only one;
    below ``server/channels`` (Go) and ``webapp/channels/src`` (scripts) the next one instead."""
    parts, ext = path_parts(path), F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]*)$", 1))
    at = lambda i: F.get(parts, F.lit(i))
    two = F.when(F.size(parts) > 2, F.concat_ws("/", at(0), at(1))).when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(F.coalesce(at(0), F.lit("core")))
    go = (ext == "go") & (at(0) == "server") & (at(1) == "channels") & at(2).isNotNull()
    web = ext.isin("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs") & (at(0) == "webapp") & (at(1) == "channels") & (at(2) == "src") & at(3).isNotNull()
    return F.when(go, F.concat(F.lit("server/"), at(2))).when(web, F.concat(F.lit("webapp/"), at(3))).otherwise(two)


AREA_SQL = """(select case when lower(regexp_extract({0}, '\\.([^./]*)$', 1)) = 'go' and p[1] = 'server' and p[2] = 'channels' and p[3] is not null then 'server/' || p[3]
    when lower(regexp_extract({0}, '\\.([^./]*)$', 1)) in ('ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs') and p[1] = 'webapp' and p[2] = 'channels' and p[3] = 'src' and p[4] is not null then 'webapp/' || p[4]
    when len(p) > 2 then p[1] || '/' || p[2] when len(p) > 1 then p[-2] else coalesce(p[1], 'core') end
    from (select list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce({0}, ''), '^[./]+', ''), '[#?].*$', ''), '[\\\\/]'), lambda x: x <> '') as p) _p)"""


def top_area(path: Column) -> Column:
    """The first directory of a path, or ``core``."""
    return F.coalesce(F.get(path_parts(path), F.lit(0)), F.lit("core"))


def _last_dir(parts: Column) -> Column:
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("core")))


def code_area(path: Column) -> Column:
    """The area by language: below a Java or Kotlin source root the last directory, in Python what follows
    ``src`` or ``app``, else the first two directories."""
    parts, ext = path_parts(path), F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]*)$", 1))
    at = lambda i: F.get(parts, F.lit(i))
    roots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: (F.get(parts, i) == "src") & F.get(parts, i + 1).isin("main", "test"))
    root = F.get(roots, F.lit(0))
    jvm = F.when(F.get(parts, root + 2).isin("java", "kotlin"), _last_dir(F.slice(parts, root + 4, F.size(parts) + 1))).otherwise(_last_dir(parts))
    two = F.when(F.size(parts) > 2, F.concat_ws("/", at(0), at(1))).otherwise(_last_dir(parts))
    python = F.when(at(0).isin("src", "app") & (F.size(parts) > 2), F.concat_ws("/", at(1), at(2))).otherwise(two)
    return F.when(ext.isin("java", "kt"), jvm).when(ext == "py", python).otherwise(two)


CODE_AREA_SQL = """(select case when e in ('java', 'kt') then case when p[r + 2] in ('java', 'kotlin') then case when len(p) - r - 2 > 1 then p[-2] else coalesce(p[r + 3], 'core') end when len(p) > 1 then p[-2] else coalesce(p[1], 'core') end
    when e = 'py' and p[1] in ('src', 'app') and len(p) > 2 then p[2] || '/' || p[3] when len(p) > 2 then p[1] || '/' || p[2] when len(p) > 1 then p[-2] else coalesce(p[1], 'core') end
    from (select *, list_filter(range(1, len(p) + 1), lambda i: p[i] = 'src' and p[i + 1] in ('main', 'test'))[1] as r from (select lower(regexp_extract({0}, '\\.([^./]*)$', 1)) as e, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce({0}, ''), '^[./]+', ''), '[#?].*$', ''), '[\\\\/]'), lambda x: x <> '') as p) _p) _r)"""


def module_key(path: Column) -> Column:
    """The directory up to two levels below the last ``src``, ``java`` or ``python``, else four levels; ``(root)`` for none."""
    parts = F.filter(F.split(dirname(path), "/"), lambda x: x != "")
    out = F.array_join(F.slice(parts, 1, 4), "/")
    for name in ("python", "java", "src"):
        place = F.array_position(F.reverse(parts), name)  # from the end
        out = F.when(place > 0, F.array_join(F.slice(parts, 1, (F.size(parts) - place + 3).cast("int")), "/")).otherwise(out)
    return F.when(F.size(parts) == 0, "(root)").otherwise(out)


MODULE_SQL = """(select case when len(p) = 0 then '(root)' else array_to_string(list_slice(p, 1, coalesce(len(p) - s + 3, len(p) - j + 3, len(p) - y + 3, 4)), '/') end
    from (select p, nullif(list_position(list_reverse(p), 'src'), 0) as s, nullif(list_position(list_reverse(p), 'java'), 0) as j, nullif(list_position(list_reverse(p), 'python'), 0) as y from (select list_filter(string_split(regexp_replace({0}, '/?[^/]*$', ''), '/'), lambda x: x <> '') as p) _p) _q)"""


def local_pair(a: Column, b: Column) -> Column:
    """Whether one file's directory is the other's or lies above it."""
    x, y = F.concat(dirname(a), F.lit("/")), F.concat(dirname(b), F.lit("/"))
    return x.startswith(y) | y.startswith(x)


def route(path: Column) -> Column:
    """A leading slash, none at the end, ``[id]`` as ``:id`` and ``[...x]`` as ``:x*``."""
    trimmed = F.regexp_replace(path, "^/+|/+$", "")
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(trimmed, r"\[\.\.\.([^\]]+)\]", ":$1*"), r"\[([^\]]+)\]", ":$1"))


def reasons(*pairs: tuple[Column, str | Column], separator: str = "; ") -> Column:
    """Texts of the conditions that hold, joined in order."""
    texts = [F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]
    return F.concat_ws(separator, *texts)


def bucket(count: Column, thresholds: list[int]) -> Column:
    """``lo-hi`` of the interval that holds the count, both ends included, from 1 on; ``hi+`` from the last threshold on."""
    out, low = None, 1
    for high in thresholds:
        text = F.lit(f"{low}-{high - 1}")
        out = F.when(count < high, text) if out is None else out.when(count < high, text)
        low = high
    return out.otherwise(F.lit(f"{low}+"))


def clamp_confidence(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def csv_cell(text: Column) -> Column:
    """Quoted where needed; a leading formula sign is disarmed, carriage returns become blanks."""
    plain = F.replace(text, F.lit("\r"), F.lit(" "))
    safe = F.when(plain.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), plain)).otherwise(plain)
    return F.when(safe.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"[\r\n\t]", " ")
