"""Scans and sinks: tables, question trees, JSON lines, result files, settings, hashes of files, manifests."""

from __future__ import annotations

import hashlib
import json
import logging
import tempfile
import uuid
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def question_tree(spark: SparkSession, root: str, dataset: str, depth: int = 2) -> DataFrame:
    """(id, question, source_subset, source_competency): arrays of questions in <subset>/<competency>.json or, with depth 1,
    <subject>.json.  Blank questions are skipped, ids keep their place in the array, from 1."""
    files = spark.read.schema("question string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    path = F.split(F.regexp_replace(F.input_file_name(), r"\.json$", ""), "/")
    rows = files.select("question", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("m"), (F.element_at(path, -2) if depth == 2 else F.element_at(path, -1)).alias("source_subset"), (F.element_at(path, -1) if depth == 2 else F.lit(None).cast("string")).alias("source_competency"))
    first = rows.groupBy("file").agg(F.min("m").alias("m0"))  # a multi-line file is one task's, its rows in order
    rows = rows.join(first, "file").withColumn("i", F.col("m") - F.col("m0") + 1)
    slug = F.replace(F.replace(F.lower(F.coalesce("source_competency", F.lit(""))), F.lit("_"), F.lit("-")), F.lit("--"), F.lit("-"))
    parts = F.concat_ws("-", F.lit(dataset), "source_subset", F.when(slug != "", slug), F.col("i").cast("string"))
    return rows.where(F.col("question").rlike(r"\S")).select(parts.alias("id"), "question", "source_subset", "source_competency")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


log = logging.getLogger(__name__)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, by whatever file system they name, in order."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in sorted(paths) if (at := path(p)).getFileSystem(conf).exists(at)]


def corpus_source(spark: SparkSession, prepared: str | None, cached: str, root: str, dataset: str, schema: str, depth: int = 2) -> DataFrame:
    """A prepared file of JSON lines if it is there, else the cached one, else the tree, which is then cached."""
    for p in (prepared, cached):
        if p and existing(spark, [p]):
            return json_lines(spark, p, schema)
    write_json_lines(question_tree(spark, root, dataset, depth), cached)
    return json_lines(spark, cached, schema)


def result_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every file's rows as texts, one below the other; columns that a file lacks are empty, missing files are left out.

    No file that is there is an error.
    """
    found = existing(spark, paths)
    for p in sorted(set(paths) - set(found)):
        log.warning("no result file %s", p)
    if not found:
        raise FileNotFoundError("none of the result files is there")
    frames = [spark.read.option("header", True).option("inferSchema", False).csv(p) for p in found]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.na.fill("")


def append_rows(df: DataFrame, path: str) -> None:
    """Rows of a log, added below those that are there."""
    df.write.mode("append").option("header", True).csv(path)


def published(spark: SparkSession, path: str, key: str, numbers: tuple[str, ...]) -> DataFrame:
    """A CSV's key and number columns; texts that aren't numbers are NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(key, *[F.col(c).try_cast("double").alias(c) for c in numbers])


def metric_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(model, corpus, <schema>): documents <root>/<model>/<corpus>.metrics.json, the keys from their paths."""
    raw = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/*.metrics.json")
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)\.metrics\.json$", i)
    return raw.select(part(1).alias("model"), part(2).alias("corpus"), *raw.columns)


def cached_metrics(spark: SparkSession, root: str, schema: str, key: str) -> DataFrame:
    """The documents whose cache_key is the one asked for; those that can't be read, or lack it, count as misses."""
    return metric_files(spark, root, schema).where(F.col("cache_key") == key)


def keys_of_all(found: DataFrame) -> DataFrame:
    """(key) of (corpus, key): the keys that every corpus has."""
    n = found.agg(F.countDistinct("corpus").alias("n"))
    return found.groupBy("key").agg(F.countDistinct("corpus").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("key")


def merged(base: dict, over: dict) -> dict:
    """Settings of ``over`` on top of ``base``; maps merge, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings, on top of the one that its "base" names, from the same folder."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one file
    own = json.loads(text)
    base = own.pop("base", None)
    return merged(settings(spark, f"{path.rsplit('/', 1)[0]}/{base}"), own) if base else own


def fingerprint(options: dict, without: tuple[str, ...] = ("n_workers", "batch_size", "device")) -> str:
    """A digest of settings that decide a result, leaving out those that only decide its speed."""
    return hashlib.sha256(json.dumps({k: v for k, v in options.items() if k not in without}, sort_keys=True).encode()).hexdigest()


def versions(names: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict[str, str]:
    """Versions of packages; those that aren't there are left out."""
    out = {}
    for n in names:
        try:
            out[n] = version(n)
        except PackageNotFoundError:
            log.info("%s isn't installed", n)
    return out


def write_manifest(spark: SparkSession, path: str, commit: str = "", **facts) -> None:
    """Facts about how something was made, with the versions of Spark and of packages, the commit, and the time in UTC, as
    one JSON document."""
    facts = facts | {"packages": versions()} | ({"commit": commit} if commit else {})
    row = spark.range(1).select(*[F.lit(json.dumps(v) if isinstance(v, (dict, list)) else v).alias(k) for k, v in facts.items()], F.lit(spark.version).alias("spark"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    row.coalesce(1).write.mode("overwrite").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A session without one gets a folder of its own if it runs on one
    machine, as tests do; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def roster(spark: SparkSession, path: str, keys: tuple[str, ...] = ("id", "pooling", "dim")) -> DataFrame:
    """(model, <keys>): a JSON map of models to their entries, in the order of their names; a key that an entry lacks is NULL."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one file of settings
    rows = [(m, *[None if (e or {}).get(k) is None else str(e[k]) for k in keys]) for m, e in sorted(json.loads(text or "{}").items())]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ("model", *keys)))


def reference_rows(spark: SparkSession, path: str, metrics: tuple[str, ...]) -> DataFrame:
    """(model, corpus, <metrics>): a JSON map of models to corpora to published metrics; what isn't a number is NULL."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    rows = [(m, c, *[number(e.get(k)) for k in metrics]) for m, by in sorted(json.loads(text or "{}").items()) for c, e in sorted(by.items()) if isinstance(e, dict)]
    return spark.createDataFrame(rows, ", ".join(["model string", "corpus string", *(f"`{c}` double" for c in metrics)]))


#: Whether the shuffle files of a query go when it ends (Spark 4.1), else when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a file, where it is known how many rows a stored table has at most.
FILE_ROWS = 10_000


def stored(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cut the lineage: ``df`` written to the shared folder and read back, which outlives lost executors.  The shuffle
    files of its making go at once.  With ``most``, a bound on its rows, few rows aren't written as many files: short
    rows only, as the last stage then has as many tasks as files, two a core at least."""
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, 1 + most // FILE_ROWS))
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.stored_path)


def drop_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
