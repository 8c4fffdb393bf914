"""JSON in the answers of models: fences off, the first balanced part out, and the links in it row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp_confidence
from ..functions.rules import let
from ..registry import query
from ..sources.driver_tables import Graph

#: A fenced block (fixed value).
FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def balanced(text: Column, open_: str, close: str) -> Column:
    """The part from the first ``open_`` to the bracket that closes it; brackets in strings don't count. Null if it stays open.

    Characters that tell nothing go first, in runs, so that the fold has one step for each mark."""
    first = F.instr(text, F.lit(open_))
    rest = F.substring(text, first, F.length(text))
    # each piece ends with a mark or is an escaped character
    pieces = F.regexp_extract_all(rest, F.lit(rf'(?s)(\\.|[^\\"{{}}\[\]]+|.)'), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        # outside of strings a backslash is a character like others, so what follows it counts
        mark = F.when(x.startswith("\\") & ~s["quoted"], F.substring(x, 2, 1)).otherwise(x)
        quote = mark == '"'
        depth = s["depth"] + F.when(s["quoted"] | (s["end"] > 0), 0).when(mark == open_, 1).when(mark == close, -1).otherwise(0)
        at = s["at"] + F.length(x)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), F.when((s["end"] == 0) & (depth == 0) & (mark == close) & ~s["quoted"], at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda s: s["end"])
    return F.when(first > 0, let(end, lambda n: F.when(n > 0, F.substring(rest, F.lit(1), n))))


def recovered(text: Column) -> Column:
    """The JSON of an answer: what stands in the first fence, or all of it; of that, unless it begins with a bracket, the first
    balanced object or array, whichever begins first and closes; else all of it."""
    fenced = F.regexp_extract(text, FENCE, 1)
    body = F.regexp_replace(F.when(text.rlike(FENCE), fenced).otherwise(text), r"^\s+|\s+$", "")

    def slice_of(b: Column) -> Column:
        brace, bracket = F.instr(b, F.lit("{")), F.instr(b, F.lit("["))
        array_first = (bracket > 0) & ((brace == 0) | (bracket < brace))
        object_, array = balanced(b, "{", "}"), balanced(b, "[", "]")
        return F.when(b.rlike(r"^[\{\[]"), b).otherwise(F.coalesce(F.when(array_first, array), object_, array, b))

    return let(body, slice_of)


LINK = "behavior_id string, symbol_id string, confidence double, reasons array<string>"


def recovered_links(answers: DataFrame) -> DataFrame:
    """k, place, behavior_id, symbol_id and confidence (0 to 1, 0.5 for none) of the links in answers (k, text): an array, or the
    ``links`` of an object. Links without both ids are left out, answers that are no JSON have none."""
    found = answers.select("k", recovered(F.col("text")).alias("json"))
    as_array, as_object = F.from_json("json", f"array<struct<{_ddl(LINK)}>>"), F.from_json("json", f"struct<links: array<struct<{_ddl(LINK)}>>>")
    whole = F.try_parse_json("json").isNotNull()
    links = F.when(whole & F.col("json").startswith("["), as_array).when(whole & F.col("json").startswith("{"), as_object["links"])
    rows = found.select("k", F.posexplode(links).alias("place", "l")).where("l.behavior_id <> '' and l.symbol_id <> ''")
    return rows.select("k", F.col("place").cast("long").alias("place"), "l.behavior_id", "l.symbol_id", clamp_confidence(F.col("l.confidence")).alias("confidence"))


def _ddl(columns: str) -> str:
    return ", ".join(c.strip().replace(" ", ": ", 1) for c in columns.split(","))


@query("recovered_answers", "answers", "select k, case when form in (0, 1, 6) then regexp_extract(text, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) when form = 2 then regexp_extract(text, '(?s)(\\{.*\\})', 1) when form in (3, 7) then regexp_extract(text, '(?s)(\\[.*\\])', 1) when form = 8 then regexp_extract(text, '(\\{\"links\": \\[\\]\\})', 1) when form = 5 then regexp_extract(text, '(\\[1, 2\\])', 1) else trim(text) end as json from answers")
def _recovered(g: Graph) -> DataFrame:
    return g.answers.select("k", recovered(F.col("text")).alias("json"))


@query(
    "recovered_links",
    "answers",
    """, parts as (select k, form, regexp_extract_all(text, '"behavior_id": "([^"]*)"', 1) as bs, regexp_extract_all(text, '"symbol_id": "([^"]*)"', 1) as ss, regexp_extract_all(text, '"confidence": ([0-9.]+)', 1) as cs from answers where form in (0, 1, 2, 3, 6))
    select k, i - 1 as place, bs[i] as behavior_id, ss[i] as symbol_id, least(1.0, case when cs[i] is null then 0.5 else cs[i]::double end)::double as confidence from (select *, unnest(range(1, len(bs) + 1)) as i from parts) x where bs[i] <> '' and ss[i] <> ''""",
)
def _recovered_links(g: Graph) -> DataFrame:
    return recovered_links(g.answers.select("k", "text"))
