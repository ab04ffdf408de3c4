"""The typed filter (inventory 2.B, C1-C9): a dataclass compiled to a DataFrame plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import fulltext
from tessera.schemas import FEATURES, FilterTooLarge, Invalid

MAX_LIST = 512


@dataclass(frozen=True)
class Range:
    """Both ends belong to the range; either may be open."""

    feature: str
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class QueryFilter:
    """All fields have to hold; an empty field asks for nothing."""

    root_ids: tuple[int, ...] = ()
    exts: tuple[str, ...] = ()
    ranges: tuple[Range, ...] = ()
    tags: tuple[str, ...] = ()
    collections: tuple[int, ...] = ()
    text: str | None = None
    projected_only: bool = False
    limit: int | None = None


@dataclass
class Tables:
    """The tables a filter may touch; those it does not name are never read."""

    samples: DataFrame
    features: DataFrame | None = None
    sample_tags: DataFrame | None = None
    tags: DataFrame | None = None
    members: DataFrame | None = None
    runs: DataFrame | None = None
    points: DataFrame | None = None
    postings: DataFrame | None = None
    extra: Mapping[str, DataFrame] = field(default_factory=dict)


def ascii_fold(c: Column) -> Column:
    """Case folding of A to Z only, so that other letters stay apart."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def checked(what: str, values: Iterable) -> list:
    values = list(values)
    if len(values) > MAX_LIST:
        raise FilterTooLarge(f"{what}: {len(values)} values, {MAX_LIST} at most")
    return values


def normal_ext(ext: str) -> str:
    return ext.strip().lstrip(".").lower()


def in_range(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose value lies in the range; null never does."""
    df = df.where(F.col(column).isNotNull())
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def all_of(ids: DataFrame, members: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Rows of ``ids`` that have every wanted value in ``members``: one semi join however many."""
    wanted = sorted(set(wanted))
    if not wanted:
        return ids
    have = members.where(F.col(value).isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(wanted))
    return ids.join(have, key, "left_semi")


def active_points(runs: DataFrame, points: DataFrame) -> DataFrame:
    """Coordinates of the active run, in one statement."""
    active = runs.where("is_active").select(F.col("id").alias("run_id"))
    return points.join(F.broadcast(active), "run_id")


def sample_ids(t: Tables, f: QueryFilter) -> DataFrame:
    """Ascending ``sample_id`` of the samples that a filter lets through."""
    for what, values in (("roots", f.root_ids), ("extensions", f.exts), ("tags", f.tags), ("collections", f.collections)):
        checked(what, values)
    for r in f.ranges:
        if r.feature not in FEATURES:
            raise Invalid(f"no feature {r.feature}")
    df = t.samples.withColumnRenamed("id", "sample_id")
    if f.root_ids:
        df = df.where(F.col("root_id").isin(list(f.root_ids)))
    if f.exts:
        df = df.where(F.col("ext").isin([normal_ext(e) for e in f.exts]))
    of_samples = [r for r in f.ranges if FEATURES[r.feature][0] == "samples"]
    for r in of_samples:
        df = in_range(df, FEATURES[r.feature][1], r.min, r.max)
    df = df.select("sample_id")
    if len(of_samples) < len(f.ranges):
        # A range excludes null, so the left join of the features may as well be an inner one.
        features = t.features
        for r in f.ranges:
            if FEATURES[r.feature][0] == "features":
                features = in_range(features, FEATURES[r.feature][1], r.min, r.max)
        df = df.join(features.select("sample_id"), "sample_id", "left_semi")
    if f.projected_only:
        df = df.join(active_points(t.runs, t.points).select("sample_id"), "sample_id", "left_semi")
    if f.tags:
        names = t.tags.select(F.col("id").alias("tag_id"), ascii_fold(F.col("name")).alias("name"))
        folded = [n.translate(fulltext.ASCII_LOWER) for n in f.tags]
        df = all_of(df, t.sample_tags.join(F.broadcast(names.where(F.col("name").isin(folded))), "tag_id"), "sample_id", "name", folded)
    if f.collections:
        df = all_of(df, t.members, "sample_id", "collection_id", list(f.collections))
    if f.text is not None and (query := fulltext.parse(f.text)) is not None:
        df = df.join(fulltext.matching(t.postings, query).withColumnRenamed("doc_id", "sample_id"), "sample_id", "left_semi")
    df = df.orderBy("sample_id")
    return df if f.limit is None else df.limit(f.limit)


def feature_column(t: Tables, feature: str) -> DataFrame:
    """``sample_id, value`` of every point of the active run, null where there is none."""
    if feature not in FEATURES:
        raise Invalid(f"no feature {feature}")
    table, column = FEATURES[feature]
    points = active_points(t.runs, t.points).select("sample_id")
    source = t.samples.withColumnRenamed("id", "sample_id") if table == "samples" else t.features
    return points.join(source.select("sample_id", F.col(column).cast("double").alias("value")), "sample_id", "left")
