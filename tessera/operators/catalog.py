"""Catalogue operations as functions from tables to tables (inventory A8-A12, A18-A22, C3-C6,
C10, D1-D5, D13, D17, F1-F15), and the store that keeps versions of tables.

There is no in-place update: a function returns the new table, ``Store.write`` writes it as a
new version, and moving one pointer makes versions visible together.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.filters import ascii_fold
from tessera.plans.scratch import kept
from tessera.schemas import Busy, Invalid, NotFound, SampleStatus, schema

KEPT = ("content_hash", "duration_ms", "sample_rate", "channels")


# -- store -----------------------------------------------------------------------------------


class Store:
    """Versions of tables below a folder; ``_CURRENT`` names the version of each table.

    The pointer is written to a temporary name and renamed, so a reader sees all of a change or
    nothing of it.  Paths go through Hadoop's file system and may be on any store.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def pointers(self) -> dict[str, int]:
        where = self._path(f"{self.folder}/_CURRENT")
        if not self._fs.exists(where):
            return {}
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(where)
        try:
            return json.loads(lines.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.pointers().get(table) if version is None else version
        if version is None:
            return self.spark.createDataFrame([], schema(table))
        return self.spark.read.schema(schema(table)).parquet(f"{self.folder}/{table}/v{version}")

    def write(self, tables: Mapping[str, DataFrame]) -> dict[str, int]:
        """Write new versions of some tables in the given order, then move the pointer."""
        now = self.pointers()
        for table, df in tables.items():
            want = schema(table)
            version = now.get(table, 0) + 1
            df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields)).write.mode("overwrite").parquet(f"{self.folder}/{table}/v{version}")
            now[table] = version
        self._point(now)
        return now

    def _point(self, now: dict[str, int]) -> None:
        temporary, final = self._path(f"{self.folder}/_NEXT"), self._path(f"{self.folder}/_CURRENT")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(rename, 1)
        array[0] = rename.OVERWRITE
        options.rename(temporary, final, array)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def prune(self) -> None:
        """Remove versions that the pointer does not name, and search indexes."""
        now = self.pointers()
        self._fs.delete(self._path(f"{self.folder}/_index"), True)
        for table, version in now.items():
            for status in self._fs.listStatus(self._path(f"{self.folder}/{table}")):
                if status.getPath().getName() != f"v{version}":
                    self._fs.delete(status.getPath(), True)


# -- helpers ------------------------------------------------------------------------------------


def next_id(df: DataFrame, column: str = "id") -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it does not replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def require(df: DataFrame, where: Column, what: str) -> None:
    if df.where(where).limit(1).isEmpty():
        raise NotFound(what)


def named(name: str, what: str) -> str:
    if not (name := name.strip()):
        raise Invalid(f"a {what} needs a name")
    return name


# -- samples ------------------------------------------------------------------------------------


def upsert_samples(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Merge scanned rows by (root_id, rel_path) (F1).

    An id and its first sighting stay; what the scan did not find out keeps its old value; the
    vector and the error are always cleared.  New rows get the next ids.
    """
    keys = ["root_id", "rel_path"]
    old_, new_ = old.alias("o"), new.alias("n")
    both = old_.join(new_, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    fresh = F.col("o.id").isNull()
    gone = F.col("n.rel_path").isNull()
    out = []
    for c in old.columns:
        o = F.col(f"o.{c}")
        n = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == "id":
            v = o
        elif c in ("vector_id", "error"):
            v = F.when(gone, o)
        elif c == "first_seen_at":
            v = F.coalesce(o, F.lit(now))
        elif c == "updated_at":
            v = F.when(gone, o).otherwise(F.lit(now))
        elif c in KEPT:
            v = F.coalesce(n, o)
        else:
            v = F.when(gone, o).otherwise(n)
        out.append(v.cast(dict(old.dtypes)[c]).alias(c))
    merged = both.select(*out, fresh.alias("_new"))
    base = next_id(old)
    added = merged.where("_new").drop("_new")
    numbered = number(added, [F.col("root_id"), F.col("rel_path")], base, "id")
    return merged.where(~F.col("_new")).drop("_new").unionByName(numbered.select(*old.columns))


def number(df: DataFrame, order: list[Column], start: int, column: str) -> DataFrame:
    """Consecutive numbers in an order: counts of range partitions plus places within."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(offset, "_part").withColumn(column, (F.col("_before") + F.col("_place") - 1 + start).cast("long")).drop("_part", "_place", "_before")


def set_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whole feature blocks, replaced (F2)."""
    return replace(old, new, ["sample_id"])


def set_embeddings(samples: DataFrame, found: DataFrame) -> DataFrame:
    """``sample_id, vector_id`` -> samples with status embedded."""
    new = found.select(F.col("sample_id").alias("id"), F.col("vector_id").alias("_v"))
    out = samples.join(new, "id", "left")
    hit = F.col("_v").isNotNull()
    return out.withColumn("status", F.when(hit, SampleStatus.EMBEDDED.value).otherwise(F.col("status"))).withColumn("vector_id", F.coalesce("_v", "vector_id")).select(*samples.columns)


def mark_failed(samples: DataFrame, failures: DataFrame) -> DataFrame:
    """``sample_id, error`` -> status decode_failed."""
    new = failures.select(F.col("sample_id").alias("id"), F.col("error").alias("_e"))
    out = samples.join(new, "id", "left")
    hit = F.col("_e").isNotNull()
    return out.withColumn("status", F.when(hit, SampleStatus.DECODE_FAILED.value).otherwise(F.col("status"))).withColumn("error", F.coalesce("_e", "error")).select(*samples.columns)


def representatives(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``representative``, the least ``order`` of each value of ``by``.

    A least value is a partial sum in every task, so a value that most rows have goes to no task
    as a whole; the way back is a join that can be split.
    """
    least = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(order).alias("representative"))
    return rows.join(least, by, "left").withColumn("representative", F.coalesce("representative", order))


def twins(new: DataFrame, samples: DataFrame, embedding: bool) -> DataFrame:
    """Adds ``plan`` and ``twin_id`` to rows with ``rel_path, content_hash``.

    ``existing``: a finished sample has the content; ``compute``: the first of the rows with
    this content; ``copy``: another row of this scan; ``none``: no content hash.
    """
    done = ["embedded"] if embedding else ["decoded", "embedded"]
    known = samples.where(F.col("status").isin(done) & F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("id").alias("twin_id"))
    first = new.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("rel_path").alias("first_path"))
    out = new.join(known, "content_hash", "left").join(first, "content_hash", "left")
    plan = (
        F.when(F.col("content_hash").isNull(), "none")
        .when(F.col("twin_id").isNotNull(), "existing")
        .when(F.col("rel_path") == F.col("first_path"), "compute")
        .otherwise("copy")
    )
    return out.withColumn("plan", plan)


def counts(samples: DataFrame) -> DataFrame:
    """Samples by status."""
    return samples.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def embedded(samples: DataFrame) -> DataFrame:
    """Samples with a vector, in the order of the vectors."""
    return samples.where((F.col("status") == "embedded") & F.col("vector_id").isNotNull()).select(F.col("id").alias("sample_id"), "vector_id").orderBy("vector_id", "sample_id")


def with_paths(samples: DataFrame, roots: DataFrame) -> DataFrame:
    """Samples with their absolute path and whether they have a vector."""
    joined = samples.join(roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path")), "root_id")
    return joined.withColumn("absolute_path", F.concat_ws("/", "root_path", "rel_path")).withColumn("embedded", F.col("vector_id").isNotNull())


def detail(samples: DataFrame, features: DataFrame, roots: DataFrame, tags: DataFrame, sample_tags: DataFrame, sample_id: int) -> DataFrame:
    """One sample with its features and the names of its tags (K)."""
    require(samples, F.col("id") == sample_id, f"sample {sample_id}")
    names = sample_tags.where(F.col("sample_id") == sample_id).join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    listed = names.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))), lambda s: s["name"]).alias("tags"))
    one = with_paths(samples.where(F.col("id") == sample_id), roots).join(features.withColumnRenamed("sample_id", "id"), "id", "left")
    return one.crossJoin(F.broadcast(listed))


# -- vectors --------------------------------------------------------------------------------------


def checked_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors of the right width; others are an error."""
    wrong = F.size("v") != width
    return vectors.withColumn("v", F.when(wrong, F.raise_error(F.concat(F.lit(f"a vector is not {width} wide: "), F.size("v").cast("string")))).otherwise(F.col("v")))


def compact(vectors: DataFrame, samples: DataFrame) -> DataFrame:
    """Vectors that a sample still refers to."""
    return vectors.join(samples.where("vector_id is not null").select("vector_id"), "vector_id", "left_semi")


def dead_ratio(vectors: DataFrame, samples: DataFrame) -> DataFrame:
    live = samples.select(F.count_distinct("vector_id").alias("live"))
    total = vectors.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(live).select(F.coalesce(F.try_divide(F.col("total") - F.col("live"), F.col("total")), F.lit(0.0)).alias("dead_ratio"))


# -- layouts ----------------------------------------------------------------------------------------


def begin_run(runs: DataFrame, algorithm: str, params: dict, sample_count: int, now: int) -> tuple[DataFrame, int]:
    """A new run that is not active."""
    run_id = next_id(runs)
    row = runs.sparkSession.createDataFrame([(run_id, algorithm, json.dumps(params), sample_count, now, None, False)], schema("projection_runs"))
    return runs.unionByName(row), run_id


def set_points(points: DataFrame, run_id: int, new: DataFrame) -> DataFrame:
    """Coordinates (and colours, where given) of a run."""
    rows = new.withColumn("run_id", F.lit(run_id).cast("long"))
    for c in ("r", "g", "b"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("float"))
    return replace(points, rows.select(*points.columns), ["run_id", "sample_id"])


def activate(runs: DataFrame, points: DataFrame, run_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """Make a run the active one and drop finished others; runs in flight stay."""
    require(runs, F.col("id") == run_id, f"run {run_id}")
    mine = F.col("id") == run_id
    stay = runs.where(mine | F.col("completed_at").isNull())
    stay = stay.withColumn("is_active", mine).withColumn("completed_at", F.when(mine, F.coalesce("completed_at", F.lit(now))).otherwise(F.col("completed_at")))
    return stay, points.join(stay.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(*points.columns)


def discard(runs: DataFrame, points: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """Drop a run that is not active; an active one stays (F8)."""
    stay = runs.where((F.col("id") != run_id) | F.col("is_active"))
    return stay, points.join(stay.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(*points.columns)


def newest_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id"))


# -- tags ---------------------------------------------------------------------------------------------


def set_tag(tags: DataFrame, sample_tags: DataFrame, sample_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Tag a sample; the first spelling of a name stays, a blank name does nothing."""
    name = name.strip()
    if not name:
        return tags, sample_tags
    spark = tags.sparkSession
    known = tags.where(ascii_fold(F.col("name")) == ascii_fold(F.lit(name))).select("id").first()
    if known is None:
        tag_id = next_id(tags)
        tags = tags.unionByName(spark.createDataFrame([(tag_id, name, None)], schema("tags")))
    else:
        tag_id = known["id"]
    row = spark.createDataFrame([(sample_id, tag_id)], schema("sample_tags"))
    return tags, sample_tags.unionByName(row).distinct()


def unset_tag(tags: DataFrame, sample_tags: DataFrame, sample_id: int, name: str) -> DataFrame:
    """Take a tag off a sample; the tag itself stays."""
    ids = tags.where(ascii_fold(F.col("name")) == ascii_fold(F.lit(name.strip()))).select(F.col("id").alias("tag_id"), F.lit(sample_id).cast("long").alias("sample_id"))
    return sample_tags.join(ids, ["sample_id", "tag_id"], "left_anti").select(*sample_tags.columns)


def edit_tag(tags: DataFrame, tag_id: int, name: str | None = None, **color: str | None) -> DataFrame:
    """Rename a tag, or set its colour with ``color=``."""
    require(tags, F.col("id") == tag_id, f"tag {tag_id}")
    mine = F.col("id") == tag_id
    if name is not None:
        wanted = named(name, "tag")
        if not tags.where(~mine & (ascii_fold(F.col("name")) == ascii_fold(F.lit(wanted)))).limit(1).isEmpty():
            raise Invalid(f"there is a tag {wanted}")
        tags = tags.withColumn("name", F.when(mine, F.lit(wanted)).otherwise(F.col("name")))
    if "color" in color:
        tags = tags.withColumn("color", F.when(mine, F.lit(color["color"]).cast("string")).otherwise(F.col("color")))
    return tags


def delete_tag(tags: DataFrame, sample_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tags.where(F.col("id") != tag_id), sample_tags.where(F.col("tag_id") != tag_id)


def tag_counts(tags: DataFrame, sample_tags: DataFrame) -> DataFrame:
    """All tags with the number of samples, unused ones too."""
    return with_counts(tags, sample_tags.withColumnRenamed("tag_id", "id"), "sample_id").orderBy(F.lower("name"), "id")


def with_counts(rows: DataFrame, members: DataFrame, column: str) -> DataFrame:
    n = members.groupBy("id").agg(F.count(column).alias("n"))
    return rows.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


# -- collections ------------------------------------------------------------------------------------------


def create_collection(collections: DataFrame, members: DataFrame, name: str, sample_ids: list[int], now: int) -> tuple[DataFrame, DataFrame, int]:
    new = next_id(collections)
    row = collections.sparkSession.createDataFrame([(new, named(name, "collection"), now)], schema("collections"))
    return collections.unionByName(row), append_members(members, new, sample_ids), new


def append_members(members: DataFrame, collection_id: int, sample_ids: list[int]) -> DataFrame:
    """Members at the end, in the given order, those already there left out."""
    mine = members.where(F.col("collection_id") == collection_id)
    spark = members.sparkSession
    given = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(sample_ids))], "sample_id long, ord long")
    fresh = given.join(mine.select("sample_id"), "sample_id", "left_anti")
    start = mine.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("start"))
    place = F.row_number().over(Window.orderBy("ord")) - 1  # a request, not a table
    rows = fresh.withColumn("place", place).crossJoin(F.broadcast(start)).select(F.lit(collection_id).cast("long").alias("collection_id"), "sample_id", (F.col("start") + F.col("place")).cast("long").alias("position"))
    return members.unionByName(rows)


def remove_member(members: DataFrame, collection_id: int, sample_id: int) -> DataFrame:
    """Take a member out and close the gap."""
    return resequenced(members.where((F.col("collection_id") != collection_id) | (F.col("sample_id") != sample_id)))


def resequenced(members: DataFrame) -> DataFrame:
    """Positions 0, 1, 2, ... in the order they have."""
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy("position", "sample_id")) - 1
    return members.withColumn("position", place.cast("long"))


def reorder(members: DataFrame, collection_id: int, sample_ids: list[int]) -> DataFrame:
    """A new order of just the members that are there."""
    mine = members.where(F.col("collection_id") == collection_id)
    given = members.sparkSession.createDataFrame([(collection_id, s, i) for i, s in enumerate(sample_ids)], schema("collection_members"))
    a, b = mine.select("sample_id"), given.select("sample_id")
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise Invalid("an order has to name each member once")
    return members.where(F.col("collection_id") != collection_id).unionByName(given)


def rename_collection(collections: DataFrame, collection_id: int, name: str) -> DataFrame:
    require(collections, F.col("id") == collection_id, f"collection {collection_id}")
    return collections.withColumn("name", F.when(F.col("id") == collection_id, F.lit(named(name, "collection"))).otherwise(F.col("name")))


def delete_collection(collections: DataFrame, members: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame]:
    return collections.where(F.col("id") != collection_id), members.where(F.col("collection_id") != collection_id)


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    return with_counts(collections, members.withColumnRenamed("collection_id", "id"), "sample_id").orderBy(F.desc("created_at"), F.desc("id"))


def collection_members(members: DataFrame, samples: DataFrame, collection_id: int) -> DataFrame:
    """Members with their file names, in order."""
    mine = members.where(F.col("collection_id") == collection_id)
    return mine.join(samples.select(F.col("id").alias("sample_id"), "filename"), "sample_id").orderBy("position")


# -- roots, scans, settings ---------------------------------------------------------------------------------


def add_root(roots: DataFrame, path: str, label: str | None, now: int) -> tuple[DataFrame, int]:
    """A root by path; a known one keeps its id and, without a new one, its label."""
    known = roots.where(F.col("path") == path).first()
    if known is not None:
        mine = F.col("id") == known["id"]
        return roots.withColumn("label", F.when(mine, F.coalesce(F.lit(label), "label")).otherwise(F.col("label"))), known["id"]
    new = next_id(roots)
    return roots.unionByName(roots.sparkSession.createDataFrame([(new, path, label, True, now, None)], schema("library_roots"))), new


def enable_root(roots: DataFrame, root_id: int, enabled: bool) -> DataFrame:
    require(roots, F.col("id") == root_id, f"root {root_id}")
    return roots.withColumn("enabled", F.when(F.col("id") == root_id, F.lit(enabled)).otherwise(F.col("enabled")))


def remove_root(tables: Mapping[str, DataFrame], root_id: int) -> dict[str, DataFrame]:
    """A root goes with its samples and all that refers to them."""
    out = dict(tables)
    out["library_roots"] = tables["library_roots"].where(F.col("id") != root_id)
    out["samples"] = tables["samples"].where(F.col("root_id") != root_id)
    gone = tables["samples"].where(F.col("root_id") == root_id).select(F.col("id").alias("sample_id"))
    for name in ("sample_features", "sample_tags", "collection_members", "projections"):
        if name in tables:
            out[name] = tables[name].join(gone, "sample_id", "left_anti").select(*tables[name].columns)
    return out


def start_scan(runs: DataFrame, root_id: int | None, now: int) -> tuple[DataFrame, int]:
    new = next_id(runs)
    return runs.unionByName(runs.sparkSession.createDataFrame([(new, root_id, now, None, 0, 0, 0, 0, "running", None)], schema("scan_runs"))), new


def finish_scan(runs: DataFrame, scan_id: int, status: str, tally: Mapping[str, int], error: str | None, now: int) -> DataFrame:
    mine = F.col("id") == scan_id
    new = {"finished_at": F.lit(now), "status": F.lit(str(status)), "error": F.lit(error).cast("string")} | {f"files_{k}": F.lit(v).cast("long") for k, v in tally.items()}
    for c, v in new.items():
        runs = runs.withColumn(c, F.when(mine, v).otherwise(F.col(c)))
    return runs


def set_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    return replace(settings, settings.sparkSession.createDataFrame([(key, value)], schema("app_settings")), ["key"])


# -- keyed lookups ------------------------------------------------------------------------------------------


def tag_id(tags: DataFrame, name: str) -> DataFrame:
    """The id of a tag by name, however it is written."""
    return tags.where(ascii_fold(F.col("name")) == ascii_fold(F.lit(name.strip()))).select("id")


def member_ids(members: DataFrame, collection_id: int) -> DataFrame:
    """The samples of a collection in its order."""
    return members.where(F.col("collection_id") == collection_id).orderBy("position").select("sample_id", "position")


def tags_of(tags: DataFrame, sample_tags: DataFrame) -> DataFrame:
    """``sample_id, tags``: the names of each sample's tags, by name whatever the case (C4)."""
    named_ = sample_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    listed = F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name")))
    return named_.groupBy("sample_id").agg(F.transform(listed, lambda s: s["name"]).alias("tags"))


def gain(settings: DataFrame) -> float:
    """The stored gain; 1 where it is missing or no finite number from 0."""
    row = settings.where(F.col("key") == "gain").select("value").first()
    try:
        value = float(row["value"])
    except (TypeError, ValueError):
        return 1.0
    return value if 0 <= value < float("inf") else 1.0
