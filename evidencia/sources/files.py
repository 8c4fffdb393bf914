"""File and pack sources and sinks."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classification import language, role
from ..operators.ledger import numbered
from ..operators.text import redact

#: Names that are never scanned (fixed values).
IGNORED = ["node_modules", ".git", "dist", "build", "coverage", "__pycache__", ".venv"]
MOST_BYTES = 1_000_000


def ignore_pattern(rules: list[str]) -> str:
    """One pattern for bare names (any segment) and globs (``*`` within a segment, ``**`` across)."""
    parts = []
    for rule in [*IGNORED, *rules]:
        rule = rule.strip().strip("/")
        if not rule or rule.startswith(("#", "!")):
            continue
        body = re.escape(rule).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        parts.append(f"(^|/){body}(/|$)")
    return "|".join(parts)


def read_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> list[str]:
    """Lines of the rule files right below a folder, where there are any; negations and comments are passed over later."""
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    lines: list[str] = []
    for name in names:  # through the file system itself, as readers pass over names that begin with a dot
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        system = path.getFileSystem(configuration)
        if system.exists(path):
            stream = system.open(path)
            try:
                lines += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return lines


#: Files of a scan, at most (fixed value).
MOST_FILES = 100_000


def scan_files(spark: SparkSession, root: str, rules: list[str] = (), most: int = MOST_FILES) -> DataFrame:
    """rel_path, size, hash, role and language of the files below a folder, the first ``most`` by name;
    contents never reach the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = re.escape(root.rstrip("/"))
    rel = F.regexp_replace("path", f"^[a-z]+:/*(?=/){prefix}/|^.*?{prefix}/", "")
    rows = files.where(F.col("length") <= MOST_BYTES).withColumn("rel_path", rel)
    kept = rows.where(~F.col("rel_path").rlike(ignore_pattern(list(rules)))).select("rel_path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))
    return kept.orderBy("rel_path").limit(most).withColumn("role", role(F.col("rel_path"))).withColumn("language", language(F.col("rel_path")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields may hold quotes, separators and line ends."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


#: What a file of a kind is read as (fixed values); plain texts only if their first line is a template's header.
TEMPLATE_HEADER = r"(?i)(^|[,;\t])\s*\"?(behaviou?r(_| )name|acceptance(_| )criteria|requirement)\"?\s*([,;\t]|$)"


def source_kind(path: Column, first_line: Column) -> Column:
    """``template``, ``markdown`` or null, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(ext == "csv", "template").when(ext.isin("md", "mdx", "markdown"), "markdown").when((ext == "txt") & first_line.rlike(TEMPLATE_HEADER), "template")


#: Coverage reports by place: path, language, format and whether they can be read (fixed values).
ARTIFACTS = [
    ("coverage.out", "go", "go-coverprofile", True),
    ("cover.out", "go", "go-coverprofile", True),
    ("coverprofile.out", "go", "go-coverprofile", True),
    ("go.coverprofile", "go", "go-coverprofile", True),
    ("coverage/go.coverprofile", "go", "go-coverprofile", True),
    ("coverage/coverage.out", "go", "go-coverprofile", True),
    ("coverage/lcov.info", "tsjs", "lcov", True),
    ("lcov.info", "tsjs", "lcov", True),
    ("coverage/cobertura-coverage.xml", "tsjs", "cobertura", False),
    ("coverage/coverage-final.json", "tsjs", "unknown", False),
    ("coverage.xml", "python", "coverage-py", True),
    (".coverage", "python", "coverage-py", False),
    ("target/site/jacoco/jacoco.xml", "java", "jacoco", True),
    ("build/reports/jacoco/test/jacocoTestReport.xml", "java", "jacoco", True),
]


def coverage_artifacts(files: DataFrame) -> DataFrame:
    """path, language, format and ingestible of the coverage reports among files (rel_path): known places first,
    then the same base names anywhere below; each path once, in order."""
    values = ", ".join(f"('{p}', '{lang}', '{fmt}', {str(ok).lower()})" for p, lang, fmt, ok in ARTIFACTS)
    known = files.sparkSession.sql(f"select *, regexp_extract(place, '([^/]*)$', 1) as base from values {values} as a(place, language, format, ingestible)")
    base = F.regexp_extract("rel_path", "([^/]*)$", 1)
    met = files.select("rel_path", base.alias("base")).join(F.broadcast(known), "base")  # as long as the list above
    rank = F.when(F.col("rel_path") == F.col("place"), 0).when(F.col("rel_path").endswith(F.concat(F.lit("/"), F.col("place"))), 1).otherwise(2)
    best = met.groupBy("rel_path").agg(F.min_by(F.struct("language", "format", "ingestible"), F.struct(rank, "place")).alias("a"))
    return best.select(F.col("rel_path").alias("path"), "a.*").orderBy("path")


def normalised_coverage(ranges: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Ranges (artifact, file, ...) whose file is one of ``files`` (rel_path): as written, without ``file://`` and the
    root, below the artifact's folder, or as the end of just one path. Others are left out."""
    raw = F.col("file")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(code), F.lit(sign))
    raw = F.regexp_replace(F.replace(F.trim(raw), F.lit("\\"), F.lit("/")), "^file://", "")
    below = F.regexp_replace(raw, "^" + re.escape(root.rstrip("/") + "/"), "") if root else raw
    plain = F.regexp_replace(below, r"^(\./)+", "")
    folder = F.regexp_replace("artifact", "/?[^/]*$", "")
    rows = ranges.withColumn("raw", plain).where((F.col("raw") != "") & ~F.col("raw").contains("://"))
    known = files.select(F.col("rel_path")).distinct()
    names = rows.select("artifact", "raw", folder.alias("folder")).distinct()
    places = names.select("artifact", "raw", F.posexplode(F.array_distinct(F.array("raw", F.when(F.col("folder") != "", F.concat_ws("/", "folder", "raw")).otherwise(F.col("raw"))))).alias("rank", "rel_path"))
    direct = places.join(known, "rel_path").groupBy("artifact", "raw").agg(F.min_by("rel_path", "rank").alias("found"))
    parts = F.split("rel_path", "/")
    tails = known.select("rel_path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))).alias("raw")).where("raw like '%/%'")
    left = names.select("artifact", "raw").join(direct, ["artifact", "raw"], "left_anti").where("raw not like '/%' and raw not like '../%'")
    by_end = left.join(tails, "raw").groupBy("artifact", "raw").agg(F.count("*").alias("n"), F.min("rel_path").alias("found")).where("n = 1").drop("n")
    return rows.drop("file").join(direct.unionByName(by_end), ["artifact", "raw"]).withColumnRenamed("found", "file").drop("raw")


#: Version of the stored graph.
SCHEMA_VERSION = "1"


def save_graph(relations: dict[str, DataFrame], path: str) -> None:
    """Each relation as a table, and the version that ``load_graph`` asks for."""
    for name, rows in relations.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(relations.values())).sparkSession.sql(f"select '{SCHEMA_VERSION}' as schema_version").write.mode("overwrite").parquet(f"{path}/_version")


def load_graph(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The stored relations; another version is an error."""
    version = spark.read.parquet(f"{path}/_version").first().schema_version
    if version != SCHEMA_VERSION:
        raise ValueError(f"stored graph has version {version}, wanted {SCHEMA_VERSION}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_ledger(records: DataFrame, path: str) -> None:
    """Evidence ids distinct and sorted; runs without an id are numbered after those that the ledger has."""
    if "evidence_ids" in records.columns:
        records = records.withColumn("evidence_ids", F.array_sort(F.array_distinct("evidence_ids")))
    spark = records.sparkSession
    try:
        held = spark.read.parquet(path).count()
    except AnalysisException:  # the first records
        held = 0
    numbered(records, held=held).write.mode("append").parquet(path)


def cached(files: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """What a cache (hash, version, payload) holds of files (rel_path, hash), and the files to work out anew.

    Written back, hits and new rows are the next cache, so that hashes which no file has go."""
    fitting = cache.where(F.col("version") == version).dropDuplicates(["hash"])
    return files.join(fitting, "hash"), files.join(fitting.select("hash"), "hash", "left_anti")


def gate_hash(files: DataFrame, configs: DataFrame) -> str:
    """A digest of all paths and of the configuration files' hashes: when it changes, resolved imports are void."""
    each = files.select(F.xxhash64("rel_path").alias("h")).unionByName(configs.select(F.xxhash64("rel_path", "hash").alias("h")))
    row = each.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{row.n}:{row.s}:{row.x}"


def export_pack(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Metadata alone as JSON lines: redacted titles, no import or framework-derived edges."""
    nodes.select("external_id", "kind", redact(F.col("title")).alias("title"), "file", "eligible").write.mode("overwrite").json(f"{path}/entities")
    edges.where("type <> 'IMPORTS' and strength <> 'framework-derived'").select("from_id", "to_id", "type", "strength").write.mode("overwrite").json(f"{path}/relationships")
