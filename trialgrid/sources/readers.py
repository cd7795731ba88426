"""Scans: result trees, definitions, manifests, records, frozen tables, goldens, logs, files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import scalars as S
from ..functions import schemas as M
from ..operators.extract import LOG_PATTERNS, log_events, with_path_info


def _uri(path):
    """A file's path with one spelling of its scheme."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def empty_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path of the files of no bytes under root, of which Spark's scans give no row: those that its listing has and a scan of names lacks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    listed, seen = found.inputFiles(), found.select(_uri(F.col("path")).alias("path"))  # the listing that the driver holds in any case
    none = spark.createDataFrame([], "path string")
    if len(listed) == seen.count():
        return none
    return spark.createDataFrame([(p,) for p in listed], "path string").select(_uri(S.plain_path(F.col("path"))).alias("path")).join(seen, "path", "left_anti")


def _result_glob(seeds: tuple[int, ...] | None) -> str:
    return "route_*_seed*.json" if not seeds else "route_*_seed{" + ",".join(map(str, seeds)) + "}.json"


def _result_texts(spark: SparkSession, root: str, seeds: tuple[int, ...] | None, packed: bool) -> DataFrame:
    """path, value of the result files under root, or of the members of the archives there."""
    if packed:
        members = spark.read.schema(M.ARCHIVE).option("recursiveFileLookup", True).parquet(root).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), "value")
        seed = "|".join(map(str, seeds)) if seeds else ".*"
        return members.where(F.col("path").rlike(rf"/results/route_[^/]*_seed({seed})\.json$"))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", _result_glob(seeds)).text(root)
    return files.select(S.plain_path(F.col("_metadata.file_path")).alias("path"), "value").where(F.col("path").rlike(r"/results/[^/]+$"))


def _parsed_results(spark: SparkSession, root: str, seeds: tuple[int, ...] | None, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    schema = StructType([*StructType.fromDDL(M.CHECKPOINT).fields, StructField("_corrupt", StringType())])
    files = _result_texts(spark, root, seeds, packed)
    # parsed from a column: a scan of JSON files refuses queries that need the broken text alone
    raw = files.select("path", "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d")).select("path", "value", "d.*")
    bad = F.col("_corrupt").isNotNull() | ~F.col("value").rlike(r"\S")
    good = with_path_info(raw.where(~bad).drop("_corrupt", "value"), "path")
    return good, raw.where(bad).select("path", F.col("value").alias("text"), F.col("_checkpoint").isNull().alias("nothing_read"))


def scan_results(spark: SparkSession, root: str, seeds: tuple[int, ...] | None = None, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with path, scenario, level, route_id, variant, seed; unreadable files as path, text, nothing_read).

    Files named route_*_seed{n}.json in folders named results, at any depth; NaN and infinities are read as numbers. A blank file and one of no bytes, as a
    run that crashed leaves it, are unreadable. packed: the files are members of archives (writers.pack_tree)."""
    good, bad = _parsed_results(spark, root, seeds, packed)
    if packed:
        return good, bad
    empty = empty_files(spark, root, _result_glob(seeds)).where(F.col("path").rlike(r"/results/[^/]+$"))
    return good, bad.unionByName(empty.select("path", F.lit("").alias("text"), F.lit(True).alias("nothing_read")))


@dataclass(frozen=True)
class Source:
    root: str
    seeds: tuple[int, ...]
    models: tuple[str, ...] = ()
    packed: bool = False


def source_plan(paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """paths (category, dir) with model: the override's, else the folder's name. overrides: category, dir, model."""
    known = F.broadcast(overrides.select("category", "dir", F.col("model").alias("_m")))
    return paths.join(known, ["category", "dir"], "left").withColumn("model", F.coalesce("_m", "dir")).drop("_m")


def scan_sources(spark: SparkSession, sources: list[Source], ceiling: tuple[str, ...] = (), ceiling_seed: int | None = None) -> DataFrame:
    """All documents of several trees laid out as {category}/{model}/...; ceiling models count from one seed only."""
    out = None
    for s in sources:
        part = _parsed_results(spark, s.root, s.seeds, s.packed)[0]
        tail = F.split(F.substring_index("path", s.root.rstrip("/").rpartition("/")[2] + "/", -1), "/")
        part = part.withColumns({"category": F.get(tail, F.lit(0)), "model": F.get(tail, F.lit(1))})
        part = part.where(F.col("model").isin(*s.models)) if s.models else part
        out = part if out is None else out.unionByName(part)
    if ceiling:
        out = out.where(~F.col("model").isin(*ceiling) | (F.col("seed") == ceiling_seed))
    return out


def scan_routes(spark: SparkSession, root: str, tag: str = "blueprint", glob: str = "*.xml") -> DataFrame:
    """path, route id, town, waypoints, trigger, weather of each definition, and how often the object's tag occurs in its text."""
    routes = spark.read.schema(M.ROUTE).format("xml").option("rowTag", "route").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).withColumn("path", F.col("_metadata.file_path"))
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    tags = text.select("path", F.regexp_count("value", F.lit(rf"<{tag}\b")).alias("n_tags"), F.regexp_extract("value", rf"<{tag}[^>]*value=\"([^\"]*)\"", 1).alias("blueprint"))
    return routes.select(
        "path", F.col("_id").alias("route_id"), F.col("_town").alias("town"), F.col("waypoints.position").alias("waypoints"),
        F.get(F.col("scenarios.scenario"), F.lit(0)).alias("scenario"), F.size("scenarios.scenario").alias("n_scenarios"), F.get(F.col("weathers.weather"), F.lit(0)).alias("weather"),
    ).join(tags, "path", "left")


def scan_tsv(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows of a TSV whose header and field counts must fit; its comment lines)."""
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    notes = spark.read.text(path).where(F.col("value").startswith("#")).select(F.trim(F.regexp_replace("value", "^#", "")).alias("note"))
    return rows, notes


def file_headers(spark: SparkSession, path: str, glob: str | None = None, comment: str | None = None) -> DataFrame:
    """path, header: the first line of each file under path (a comment is none), from the first block of each; a row a file."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    lines = lines.select(S.plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_no"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    named = F.col("value") != ""
    named = named & ~F.col("value").startswith(comment) if comment else named
    return lines.where((F.col("_at") == 0) & named).groupBy("path").agg(F.min_by("value", "_no").alias("header"))


def read_by_name(spark: SparkSession, path: str, glob: str | None = None, path_as: str | None = None, **options) -> DataFrame:
    """Rows of delimited text files whose columns are found by the names in each file's own header; all are text.

    A column that a file lacks is null in its rows; columns are those of all headers, in order of the first file that has them. Files are read together
    with those of the same header, so as many scans are made as there are different headers. A header is one line."""
    heads = file_headers(spark, path, glob, options.get("comment"))
    kinds = heads.groupBy("header").agg(F.min("path").alias("first")).orderBy("first").collect()  # a row for each different header
    out = None
    for kind in kinds:
        reader = spark.read.options(header=True, inferSchema=False, **options)
        if len(kinds) == 1:
            reader = reader.option("recursiveFileLookup", True)
            rows = (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)
        else:
            rows = reader.csv([r["path"] for r in heads.where(F.col("header") == kind["header"]).select("path").collect()])
        if path_as:
            rows = rows.withColumn(path_as, S.plain_path(F.col("_metadata.file_path")))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], f"{path_as} string" if path_as else StructType([]))
    return out


def scan_manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A manifest whose columns stand in any order, in each file; others are ignored, rows too short to hold a path skipped."""
    rows = read_by_name(spark, path, sep="\t", comment="#", mode="PERMISSIVE")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).where(F.col("path").isNotNull() & (F.col("path") != ""))


def load_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A records table read as text, then typed by its schema; a missing column is an error."""
    raw = read_text_table(spark, path)
    lost = [c for c in columns if c not in raw.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return typed_records(raw.select(*columns))


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    return read_by_name(spark, path, emptyValue="", nullValue="\u0000", escape='"')


def typed_records(raw: DataFrame) -> DataFrame:
    def one(c: str):
        if c in M.IDENTITY or c in M.MIXED:
            return F.col(c)
        return (S.tri_state(F.col(c)) if c in M.TRI_STATE else S.try_double(F.col(c))).alias(c)

    return raw.select(*map(one, raw.columns))


def scan_frozen(spark: SparkSession, root: str, cells: DataFrame, overrides: dict[tuple[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """(rows of root/{model}/{category}.csv, a file or a folder of parts, with model, category; expected cells without a file that has a header).

    Columns are found by name in each file: headers may differ in order and in columns, and a table may have a header only.
    overrides: file name of a cell."""
    top = re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
    names = {(m, f.removesuffix(".csv")): c for (m, c), f in overrides.items()}

    def celled(df: DataFrame) -> DataFrame:
        tail = F.split(F.substring_index("_p", top, -1), "/")
        model, file = F.get(tail, F.lit(0)), F.regexp_replace(F.get(tail, F.lit(1)), r"\.csv$", "")
        category = F.coalesce(*[F.when((model == m) & (file == f), c) for (m, f), c in names.items()], file)
        return df.withColumns({"model": model, "category": category}).drop("_p")

    rows = celled(read_by_name(spark, root, "*.csv", path_as="_p"))
    there = celled(file_headers(spark, root, "*.csv").select(F.col("path").alias("_p"))).distinct()
    return rows, cells.join(there, ["model", "category"], "left_anti")


GOLDEN = "schema string, bundle_version string, split struct<sha256: string, n_routes: bigint>, tolerance struct<driving_score_abs: double, max_observed_spread: double>, routes map<string, struct<expected_blueprint_id: string, status: string, driving_score: double, ds_spread: double>>"


def load_golden(spark: SparkSession, path: str, split: DataFrame, schema_id: str, split_sha: str) -> tuple[DataFrame, DataFrame]:
    """(a row per route with the tolerance; problems: wrong schema, no version, other split, no tolerance, routes of the split not covered)."""
    bundle = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    rows = bundle.select(F.explode("routes").alias("path", "e"), F.col("tolerance.driving_score_abs").alias("tolerance")).select("path", "e.*", "tolerance")
    tests = F.array(
        F.when(~F.col("schema").eqNullSafe(schema_id), "schema"), F.when(F.coalesce("bundle_version", F.lit("")) == "", "version"),
        F.when(~F.col("split.sha256").eqNullSafe(split_sha), "split"), F.when(F.col("tolerance.driving_score_abs").isNull(), "tolerance"),
    )
    bad = bundle.select(F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("problem"), F.lit("").alias("path"))
    gaps = split.select("path").join(rows.select("path"), "path", "left_anti").select(F.lit("uncovered").alias("problem"), "path")
    return rows, bad.unionByName(gaps)


def scan_logs(spark: SparkSession, glob: str) -> DataFrame:
    """path, value, kind, a, b of log lines of known forms, in one pass."""
    lines = spark.read.text(glob).select(S.plain_path(F.col("_metadata.file_path")).alias("path"), "value")
    return log_events(lines, LOG_PATTERNS)


def digest_files(spark: SparkSession, root: str, glob: str = "*", whole: int = 1 << 27, chunk: int = 1 << 23) -> DataFrame:
    """path, size, sha256 of all files under root, of any size. One of more than `whole` bytes isn't read as one value but by its task, `chunk` bytes at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
                state = hashlib.sha256()
                with store.open_input_stream(at) as data:
                    while part := data.read(chunk):
                        state.update(part)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([state.hexdigest()])], ["path", "size", "sha256"])

    fits = files.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("size")).mapInArrow(read, "path string, size long, sha256 string")
    empty = empty_files(spark, root, glob).select("path", F.lit(0).cast("long").alias("size"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha256"))
    return fits.unionByName(large).unionByName(empty)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """rel, the paths of all definitions under root in order; an empty tree is an error."""
    name = root.rstrip("/").rpartition("/")[2] + "/"
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root).select(F.substring_index("path", name, -1).alias("rel"))
    if out.isEmpty():
        raise ValueError(f"no definitions under {root}")
    return out.orderBy("rel")
