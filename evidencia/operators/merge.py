"""Union, de-duplication, pruning and incremental merge of graph fragments; manifest differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.driver_tables import Graph


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """By external_id the row of highest confidence (of equal ones the first), at the first one's place."""
    rest = [c for c in nodes.columns if c != "external_id"]
    best = nodes.groupBy("external_id").agg(F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("c"), "ord")).alias("best"), F.min("ord").alias("first"))
    return best.select("external_id", *[F.col("first").alias(c) if c == "ord" else F.col(f"best.{c}").alias(c) for c in rest])


def dedup_edges(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first edge of each key."""
    keys = keys or ["from_id", "to_id", "type"]
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ord", *rest)).alias("first")).select(*[F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in edges.columns])


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("external_id").distinct()
    return edges.join(ids.withColumnRenamed("external_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("external_id", "to_id"), "to_id", "left_semi")


FRAGMENT_SQL = """, fragments as (select ord, external_id, kind, title, confidence from nodes union all select 90000000 + ord, external_id, kind, 'again ' || title, case when ord % 2 = 0 then 0.95::double else 0.5::double end from nodes where kind = 'CodeSymbol' and ord % 3 = 0)"""


def fragments(g: Graph) -> DataFrame:
    """Nodes of two sources, a third of the symbols found by both."""
    columns = ["ord", "external_id", "kind", "title", "confidence"]
    again = g.nodes.where("kind = 'CodeSymbol' and ord % 3 = 0").select((F.col("ord") + 90000000).alias("ord"), "external_id", "kind", F.concat(F.lit("again "), "title").alias("title"), F.when(F.col("ord") % 2 == 0, 0.95).otherwise(0.5).alias("confidence"))
    return g.nodes.select(*columns).unionByName(again)


@query("node_dedup", "nodes", FRAGMENT_SQL + " select external_id, kind, title, confidence, min(ord) over (partition by external_id) as ord from fragments qualify row_number() over (partition by external_id order by confidence desc, ord) = 1")
def _node_dedup(g: Graph) -> DataFrame:
    return dedup_nodes(fragments(g))


@query("edge_dedup", "edges", "select from_id, to_id, type, strength, ord from (select from_id, to_id, 'TESTED_BY' as type, strength, ord from edges where type in ('TESTED_BY', 'CALLS') union all select to_id, from_id, 'TESTED_BY', 'reviewed', ord + 5 from edges where type = 'COVERS') x qualify row_number() over (partition by from_id, to_id, type order by ord, strength) = 1")
def _edge_dedup(g: Graph) -> DataFrame:
    one = g.edges.where("type in ('TESTED_BY', 'CALLS')").select("ord", "from_id", "to_id", F.lit("TESTED_BY").alias("type"), "strength")
    two = g.edges.where("type = 'COVERS'").select((F.col("ord") + 5).alias("ord"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("TESTED_BY").alias("type"), F.lit("reviewed").alias("strength"))
    return dedup_edges(one.unionByName(two))


@query("dangling_prune", ("nodes", "edges"), ", left_over as (select external_id from nodes where not (kind = 'CodeSymbol' and ord % 7 = 0)) select ord, from_id, to_id, type, strength from edges where from_id in (select external_id from left_over) and to_id in (select external_id from left_over)")
def _prune(g: Graph) -> DataFrame:
    return prune_dangling(g.edges, g.nodes.where("not (kind = 'CodeSymbol' and ord % 7 = 0)")).select("ord", "from_id", "to_id", "type", "strength")


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files added, removed or changed; equal ones don't show."""
    b, n = before.select(F.col("rel_path").alias("b_path"), F.col("hash").alias("b_hash")), now.select(F.col("rel_path").alias("n_path"), F.col("hash").alias("n_hash"))
    both = b.join(n, F.col("b_path") == F.col("n_path"), "full_outer")
    change = F.when(F.col("b_path").isNull(), "added").when(F.col("n_path").isNull(), "removed").when(~F.col("b_hash").eqNullSafe(F.col("n_hash")), "changed")
    return both.select(F.coalesce("b_path", "n_path").alias("rel_path"), change.alias("change")).where("change is not null")


DIFF_SQL = """, diff as (select coalesce(b.rel_path, n.rel_path) as rel_path, case when b.rel_path is null then 'added' when n.rel_path is null then 'removed' else 'changed' end as change from manifest_before b full outer join manifest_now n on n.rel_path = b.rel_path where b.hash is distinct from n.hash)"""


@query("manifest_diff", ("manifest_before", "manifest_now"), DIFF_SQL + " select rel_path, change from diff")
def _diff(g: Graph) -> DataFrame:
    return manifest_diff(g.manifest_before, g.manifest_now)


@query("freshness", ("manifest_before", "manifest_now"), DIFF_SQL + " select case when (select count(*) from manifest_before) = 0 then 'missing' when count(*) = 0 then 'fresh' else 'stale' end as state, count(*) as changes from diff")
def _freshness(g: Graph) -> DataFrame:
    n = manifest_diff(g.manifest_before, g.manifest_now).agg(F.count("*").alias("changes"))
    m = g.manifest_before.agg(F.count("*").alias("known"))
    return n.crossJoin(m).select(F.when(F.col("known") == 0, "missing").when(F.col("changes") == 0, "fresh").otherwise("stale").alias("state"), "changes")  # two single rows


def merge(old: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """Old nodes of files that stay, those of removed files marked stale, and fresh nodes of added and changed files."""
    touched = diff.where("change <> 'removed'").select(F.col("rel_path").alias("file"))
    gone = diff.where("change = 'removed'").select(F.col("rel_path").alias("file"))
    kept = old.join(touched, "file", "left_anti").join(gone, "file", "left_anti")
    ghosts = old.join(gone, "file", "left_semi").withColumn("stale", F.lit(True))
    return dedup_nodes(kept.unionByName(ghosts).unionByName(fresh.join(touched, "file", "left_semi")))


@query(
    "incremental_merge",
    ("nodes", "manifest_before", "manifest_now"),
    DIFF_SQL
    + """ select external_id, file, case when d.change = 'changed' then title || ' v2' else title end as title, n.stale or coalesce(d.change = 'removed', false) as stale from nodes n left join diff d on d.rel_path = n.file where n.kind = 'CodeSymbol'""",
)
def _merge(g: Graph) -> DataFrame:
    old = g.nodes.where("kind = 'CodeSymbol'").select("ord", "external_id", "file", "title", "stale", "confidence")
    fresh = old.withColumn("title", F.concat("title", F.lit(" v2")))
    return merge(old, fresh, manifest_diff(g.manifest_before, g.manifest_now)).select("external_id", "file", "title", "stale")


def reproved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hard coverage edges that a run has added."""
    return after.join(before, ["from_id", "to_id"], "left_anti")


@query("reprove_difference", "edges", ", hard as (select from_id, to_id, ord from edges where type = 'COVERS' and strength = 'hard') select from_id, to_id from hard except select from_id, to_id from hard where ord % 3 <> 0")
def _reproved(g: Graph) -> DataFrame:
    hard = g.edges.where("type = 'COVERS' and strength = 'hard'")
    return reproved(hard.where("ord % 3 <> 0").select("from_id", "to_id"), hard.select("from_id", "to_id")).distinct()


@query("slug_suffixes", "nodes", "select external_id, slug || case when n > 1 then '-' || n else '' end as slug from (select *, row_number() over (partition by slug order by ord) as n from (select external_id, ord, coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), ''), 'item') as slug from nodes where kind in ('Requirement', 'UserFlow')) x) y")
def _slugs(g: Graph) -> DataFrame:
    """Slugs of titles; a second one of the same name gets a number."""
    from ..functions.expressions import slug

    rows = g.nodes.where("kind in ('Requirement', 'UserFlow')").select("external_id", "ord", slug(F.col("title")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("ord"))
    return rows.withColumn("n", n).select("external_id", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")).alias("slug"))
