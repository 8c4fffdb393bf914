"""Proof ledger: selection of the record that counts, statistics, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import round_half_up
from ..lineage import cut as shared
from ..registry import query
from ..sources.driver_tables import Graph


def certified(record: str = "") -> Column:
    """Whether a record's certificate (its struct ``proof``) and outcome are those of a dynamic proof: reproven and
    closed, of the targeted kind, green before, failing on the mutant's assertion, with the target not mocked."""
    c = lambda n: F.col(record + n)
    proof = lambda n: c(f"proof.{n}")
    return F.coalesce((c("status") == "reproven") & c("closed") & (proof("kind") == "dynamic_targeted") & proof("baseline_green") & proof("mutant_failed_assertion") & proof("target_not_mocked"), F.lit(False))


@query("proof_certificates", "ledger", "select idx, coalesce(status = 'reproven' and closed and case when idx % 11 = 0 then 'other' when idx % 13 <> 0 then 'dynamic_targeted' end = 'dynamic_targeted' and idx % 5 <> 1 and idx % 7 <> 1 and case when idx % 17 <> 0 then idx % 3 <> 1 end, false) as certified from ledger")
def _certificates(g: Graph) -> DataFrame:
    """Records whose certificates lack one part or another."""
    n = F.col("idx")
    proof = F.struct(F.when(n % 11 == 0, "other").when(n % 13 != 0, "dynamic_targeted").alias("kind"), (n % 5 != 1).alias("baseline_green"), (n % 7 != 1).alias("mutant_failed_assertion"), F.when(n % 17 != 0, n % 3 != 1).alias("target_not_mocked"))
    return g.ledger.withColumn("proof", proof).select("idx", certified().alias("certified"))


def dynamic_proof(row: str = "") -> Column:
    """The same for records whose certificate has been judged before (``dynamic_proof``)."""
    c = lambda n: F.col(row + n)
    return F.coalesce((c("status") == "reproven") & c("closed") & c("dynamic_proof"), F.lit(False))


def best_records(ledger: DataFrame) -> DataFrame:
    """Of each target the newest valid proof of its present code, else the newest record; ``proven`` says which."""
    proven = dynamic_proof() & F.coalesce("fingerprint_matches", F.lit(False))
    when = F.coalesce("ts", F.lit("1970-01-01").cast("timestamp"))
    # max_by() needs no sort and combines before the shuffle, so a hot target is no burden
    best = ledger.groupBy("target_id").agg(F.max_by(F.struct("idx", "status", "closed", proven.alias("proven"), "ts"), F.struct(proven, when, "idx")).alias("best"))
    return best.select("target_id", "best.*")


@query(
    "ledger_best_proof",
    "ledger",
    """select target_id, idx, status, closed, proven, ts from (select *, status = 'reproven' and closed and dynamic_proof and fingerprint_matches as proven from ledger) x
    qualify row_number() over (partition by target_id order by proven desc, ts desc, idx desc) = 1""",
)
def _best(g: Graph) -> DataFrame:
    return best_records(g.ledger)


@query(
    "ledger_stats",
    "ledger",
    """select count(*) as total, count(*) filter (status = 'reproven') as reproven, count(*) filter (status = 'unproven') as unproven, count(*) filter (status = 'already_proven') as already_proven, count(*) filter (status = 'generated_unverifiable') as generated_unverifiable,
    floor(100.0 * count(*) filter (status = 'reproven' and closed) / count(*) filter (status in ('reproven', 'unproven')) * 100 + 0.5) / 100 as kept_rate from ledger""",
)
def _stats(g: Graph) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    kept = F.count_if((F.col("status") == "reproven") & F.col("closed"))
    tried = F.count_if(F.col("status").isin("reproven", "unproven"))
    return g.ledger.agg(F.count("*").alias("total"), n("reproven"), n("unproven"), n("already_proven"), n("generated_unverifiable"), F.when(tried == 0, 0.0).otherwise(round_half_up(100.0 * kept / tried, 2)).alias("kept_rate"))


def fingerprint(file_hash: Column, symbol: Column, member: Column) -> Column:
    """Null when any part is missing."""
    whole = F.concat(file_hash, F.lit("|"), symbol, F.lit("|"), member)
    return F.concat(F.lit("sha256:"), F.sha2(whole, 256))


@query(
    "target_fingerprint",
    ("nodes", "manifest_now"),
    """select n.external_id, 'sha256:' || sha256(m.hash || '|' || n.external_id || '|' || n.member_of) as fingerprint from nodes n left join manifest_now m on m.rel_path = n.file where n.kind = 'CodeSymbol'""",
)
def _fingerprint(g: Graph) -> DataFrame:
    symbols = g.nodes.where("kind = 'CodeSymbol'").select("external_id", "file", "member_of")
    files = g.manifest_now.select(F.col("rel_path").alias("file"), "hash")
    return symbols.join(files, "file", "left").select("external_id", fingerprint(F.col("hash"), F.col("external_id"), F.col("member_of")).alias("fingerprint"))


def numbered(records: DataFrame, order: str = "idx", held: int = 0) -> DataFrame:
    """Records with run_id: their own, or their place in the whole ledger, ``held`` records being there before.

    Places come from counts of sorted partitions, so no task sees the whole ledger."""
    ordered = shared(records.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each partition
    place = F.col("before") + F.col("row") - F.col("first") + 1 + held
    own = F.nullif(F.col("run_id"), F.lit("")) if "run_id" in records.columns else F.lit(None).cast("string")
    joined = ordered.join(F.broadcast(before), "part")
    return joined.withColumn("run_id", F.coalesce(own, F.concat(F.lit("run:"), F.lpad(place.cast("string"), F.greatest(F.lit(6), F.length(place.cast("string"))), F.lit("0"))))).drop("part", "row", "first", "before")


@query("run_ids", "ledger", "select target_id, case when idx % 50 = 0 then 'own:' || idx else printf('run:%06d', row_number() over (order by idx)) end as run_id, idx from ledger")
def _run_ids(g: Graph) -> DataFrame:
    """Runs numbered within the ledger; some bring their own id."""
    return numbered(g.ledger.withColumn("run_id", F.when(F.col("idx") % 50 == 0, F.concat(F.lit("own:"), F.col("idx").cast("string"))))).select("target_id", "run_id", "idx")
