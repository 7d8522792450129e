"""Tables as versions: Parquet has no MERGE, so every change is a function from the old state and the changes to the new state."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graph import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """old with new rows (seq) over it by the keys, of new ones the highest seq; columns in `keep` stay as in old where it has the key."""
    n = latest(new, keys, "seq").drop("seq")
    if keep:
        before = old.select(*keys, F.lit(True).alias("_was"), *(F.col(c).alias(f"_old_{c}") for c in keep))
        n = n.join(before, keys, "left")
        for c in keep:
            n = n.withColumn(c, F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    n = n.select(old.columns)
    return old.join(n, keys, "left_anti").select(old.columns).unionByName(n)


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """By uri; created_at stays, last_seen_at is the new row's."""
    return upsert(old, new, ["uri"], ["created_at"])


def upsert_links(old: DataFrame, new: DataFrame) -> DataFrame:
    new = new if "seq" in new.columns else new.withColumn("seq", F.lit(0))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in old.schema if f.name not in new.columns}
    return upsert(old, new.withColumns(missing) if missing else new, ["id"])


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without all rows of the keys in new, and new: chunks of a document, vectors of a uri."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def register_source_active(documents: DataFrame, batches: DataFrame) -> DataFrame:
    """Documents of a batch become active again; last_seen_at stays if set, and unknown ones are added."""
    seen = batches.groupBy(F.col("source_uri").alias("uri")).agg(F.max("created_at").alias("_seen"))
    known = documents.join(seen, "uri", "left")
    hit = F.col("_seen").isNotNull()
    known = known.withColumns({"status": F.when(hit, "active").otherwise(F.col("status")), "last_seen_at": F.coalesce("last_seen_at", "_seen")}).select(documents.columns)
    fresh = seen.join(documents, "uri", "left_anti")
    value = {"uri": F.col("uri"), "status": F.lit("active"), "created_at": F.col("_seen"), "last_seen_at": F.col("_seen")}
    return known.unionByName(fresh.select(*(value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in documents.schema)))


#: Hash buckets of a table's key, and the keys: a change of a few keys rewrites their buckets only.
BUCKETS = 64
BUCKET_KEYS = {"documents": "uri", "evidence": "source_uri", "chunks": "document_uri", "vectors": "uri", "nodes": "uri", "degrees": "uri", "grams": "gram"}
MANIFEST = "name string, bucket int, version string, schema string"


def bucket_of(key: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, root: str, name: str, version: str) -> list[int]:
    """The rows in folders of their buckets; a large bucket is split among tasks. Which buckets have rows."""
    key = BUCKET_KEYS.get(name)
    path = f"{root}/{name}/version={version}"
    rows = df.withColumn("_bucket", bucket_of(key) if key else F.lit(0)).hint("rebalance", "_bucket")
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(path)
    try:
        return sorted(r[0] for r in df.sparkSession.read.parquet(path).select("_bucket").distinct().collect())  # names of folders, at most BUCKETS
    except AnalysisException:  # no rows, no folders
        return []


def _write_manifest(spark: SparkSession, root: str, version: str, rows: list[tuple]) -> None:
    """The last step of a version: a row for each bucket of each table, with the version that has its rows."""
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/_done/{version}")


def manifest(spark: SparkSession, root: str, version: str | None = None) -> tuple[str, list]:
    """The version, or the last one, and its manifest: tables times buckets rows at most."""
    if version is None:
        named = spark.read.schema(MANIFEST).parquet(f"{root}/_done/*").select(F.regexp_extract(F.input_file_name(), "/_done/([^/]+)/", 1).alias("v"))
        version = named.agg(F.max("v")).first()[0]
    return version, spark.read.schema(MANIFEST).parquet(f"{root}/_done/{version}").collect()


def write_version(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """All tables of a state, whole, below new folders; a reader takes the last version that has a manifest."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        rows += [(name, -1, version, df.schema.json()), *((name, b, version, None) for b in _write_buckets(df, root, name, version))]
    _write_manifest(spark, root, version, rows)


def _read(spark: SparkSession, root: str, name: str, rows: list, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(next(r.schema for r in rows if r.name == name and r.bucket < 0)))
    paths = [f"{root}/{name}/version={r.version}/_bucket={r.bucket}" for r in rows if r.name == name and r.bucket >= 0 and (buckets is None or r.bucket in buckets)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_touched(keys: DataFrame, root: str, name: str, version: str | None = None) -> DataFrame:
    """The rows of the keys (one column), out of their buckets only."""
    rows = manifest(keys.sparkSession, root, version)[1]
    touched = {r[0] for r in keys.select(bucket_of(keys.columns[0])).distinct().collect()}  # at most BUCKETS
    found, key = _read(keys.sparkSession, root, name, rows, touched), BUCKET_KEYS[name]
    return found.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")


def read_version(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    return _read(spark, root, name, manifest(spark, root, version)[1])


def update_version(root: str, keys: DataFrame, old: str, new: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
    """Version `new` from `old`: change gets the tables' rows in the buckets of the keys (one column) and returns them changed; all other buckets stay where they are.

    What is read and written grows with the touched buckets, not with the state. Done again for the same versions, it writes the same.
    """
    spark = keys.sparkSession
    rows = manifest(spark, root, old)[1]
    touched = {r[0] for r in keys.select(bucket_of(keys.columns[0])).distinct().collect()}  # at most BUCKETS
    names = sorted({r.name for r in rows})
    kept = [tuple(r) for r in rows if r.bucket < 0 or r.bucket not in touched]
    if touched:
        for name, df in change({n: _read(spark, root, n, rows, touched) for n in names}).items():
            kept += [(name, b, new, None) for b in _write_buckets(df, root, name, new)]
    _write_manifest(spark, root, new, kept)
