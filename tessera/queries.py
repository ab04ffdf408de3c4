"""Queries over the driver's tables that exercise the operators, and their SQL.

Documents stand in for samples, labels for their nullable features, embeddings for vectors,
conversations for ordered collections, events for series and progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import catalog, columns, embedding, filters, fulltext, projection, vectors
from tessera.operators.components import connected_components
from tessera.operators.filters import QueryFilter, Range, Tables
from tessera.schemas import TABLES, complete, parse_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as samples: a root for each source, the language as extension."""
    d = load(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("root_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path"),
        F.col("lang").alias("ext"), F.col("n_chars").alias("duration_ms"),
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as features; half of the documents have none."""
    return load(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("double").alias("bpm"), F.col("toxic").cast("double").alias("key_mode"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Two components of each embedding as a layout; two runs, of which 1 is active."""
    e = load(spark, sf, "embeddings")
    one = e.select(F.lit(1).cast("long").alias("run_id"), F.col("vec_id").alias("sample_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    two = e.select(F.lit(2).cast("long").alias("run_id"), F.col("vec_id").alias("sample_id"), F.col("embedding")[2].cast("double").alias("x"), F.col("embedding")[3].cast("double").alias("y"))
    return one.unionByName(two)


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, True), (2, False)], "id long, is_active boolean")


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def r6(c, name: str):
    return (F.round(c, 6) + 0.0).alias(name)


# -- filters and joins ------------------------------------------------------------------------------


@query("""
select d.doc_id as sample_id from documents d left join labels l using (doc_id)
where d.source in ('src1', 'src2', 'src3') and d.n_chars between 200 and 9000 and l.quality >= 1
""")
def filter_in_range_left(spark, sf):
    f = QueryFilter(root_ids=(1, 2, 3), ranges=(Range("durationMs", 200, 9000), Range("bpm", 1)))
    return filters.sample_ids(Tables(samples(spark, sf), features(spark, sf)), f)


@query("""
with t as (select doc_id, source as name from documents union all select doc_id, lang from documents)
select distinct doc_id as sample_id from documents d
where exists (select 1 from t where t.doc_id = d.doc_id and lower(name) = 'src3') and exists (select 1 from t where t.doc_id = d.doc_id and lower(name) = 'en')
""")
def filter_all_of_tags(spark, sf):
    d = load(spark, sf, "documents")
    names = d.select("source").unionByName(d.select(F.col("lang").alias("source"))).distinct().select(F.xxhash64("source").alias("id"), F.col("source").alias("name"))
    tagged = d.select(F.col("doc_id").alias("sample_id"), F.explode(F.array(F.xxhash64("source"), F.xxhash64("lang"))).alias("tag_id"))
    return filters.sample_ids(Tables(samples(spark, sf), tags=names, sample_tags=tagged), QueryFilter(tags=("SRC3", "en")))


@query("""
select doc_id as sample_id from documents d
where exists (select 1 from conversations c where c.conv_id = 3 and c.turn = d.doc_id) and exists (select 1 from conversations c where c.conv_id = 5 and c.turn = d.doc_id)
""")
def filter_semi_membership(spark, sf):
    members = load(spark, sf, "conversations").select(F.col("conv_id").alias("collection_id"), F.col("turn").alias("sample_id"))
    return filters.sample_ids(Tables(samples(spark, sf), members=members), QueryFilter(collections=(3, 5)))


@query("select doc_id as sample_id from documents join embeddings on doc_id = vec_id where n_chars <= 2000")
def filter_active_only(spark, sf):
    t = Tables(samples(spark, sf), runs=runs(spark), points=points(spark, sf))
    return filters.sample_ids(t, QueryFilter(projected_only=True, ranges=(Range("durationMs", None, 2000),)))


@query("select doc_id as sample_id from documents where lang in ('fr', 'de')")
def filter_normalized_ext(spark, sf):
    return filters.sample_ids(Tables(samples(spark, sf)), QueryFilter(exts=(" .FR", "..de ")))


@query("select vec_id as sample_id from embeddings e where not exists (select 1 from labels l where l.doc_id = e.vec_id)")
def newcomers_anti(spark, sf):
    have = load(spark, sf, "labels").select(F.lit(1).cast("long").alias("run_id"), F.col("doc_id").alias("sample_id"))
    rows = load(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    return vectors.newcomers(rows, have, 1)


@query("select vec_id as sample_id, coalesce(quality::double, 'NaN'::double) as value from embeddings left join labels on doc_id = vec_id")
def feature_column_nullkeep(spark, sf):
    t = Tables(samples(spark, sf), features(spark, sf), runs=runs(spark), points=points(spark, sf))
    return filters.feature_column(t, "bpm").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


@query("select count(*) as missing from embeddings left join labels on doc_id = vec_id where quality is null")
def missing_count(spark, sf):
    t = Tables(samples(spark, sf), features(spark, sf), runs=runs(spark), points=points(spark, sf))
    return columns.missing(filters.feature_column(t, "bpm"), "value")


@query("select n_nationkey::bigint as id, n_name as name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by all")
def count_zero_kept(spark, sf):
    tags = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    tagged = load(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("tag_id"), F.col("c_custkey").alias("sample_id"))
    return catalog.tag_counts(tags, tagged)


@query("select conv_id, string_agg(distinct role, ' ' order by role) as roles from conversations group by conv_id")
def ordered_string_agg(spark, sf):
    c = load(spark, sf, "conversations")
    tagged = c.select(F.col("conv_id").alias("sample_id"), F.col("role").alias("name")).distinct()
    rows = c.select(F.col("conv_id").alias("sample_id"), F.lit("f").alias("filename"), F.lit("p").alias("rel_path")).distinct()
    return fulltext.searched_text(rows, tagged).select(F.col("doc_id").alias("conv_id"), F.col("tags").alias("roles"))


@query("select lang as status, count(*) as n from documents group by all")
def counts_by_status(spark, sf):
    return catalog.counts(load(spark, sf, "documents").select(F.col("lang").alias("status")))


@query("""
select conv_id as collection_id, turn + 10000 as sample_id, (coalesce((select max(turn) from conversations m where m.conv_id = c.conv_id), -1) + row_number() over (partition by conv_id order by turn)) as position
from conversations c where conv_id = 3
""")
def append_position(spark, sf):
    members = load(spark, sf, "conversations").select(F.col("conv_id").alias("collection_id"), F.col("turn").alias("sample_id"), F.col("turn").alias("position"))
    turns = [r[0] + 10_000 for r in members.where("collection_id = 3").select("sample_id").orderBy("sample_id").collect()]
    return catalog.append_members(members, 3, turns).where("sample_id >= 10000")


@query("select conv_id as collection_id, turn as sample_id, row_number() over (partition by conv_id order by turn) - 1 as position from conversations where role <> 'user'")
def resequence_after_remove(spark, sf):
    members = load(spark, sf, "conversations").where("role <> 'user'").select(F.col("conv_id").alias("collection_id"), F.col("turn").alias("sample_id"), F.col("turn").alias("position"))
    return catalog.resequenced(members)


@query("""
with o as (select doc_id, source, n_chars, lang from documents where doc_id % 3 <> 0), n as (select doc_id, source, case when doc_id % 2 = 0 then n_chars + 1 end as n_chars from documents where doc_id % 3 <> 1)
select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(n.n_chars, o.n_chars) as duration_ms, case when n.doc_id is null then o.lang end as error
from o full join n on o.doc_id = n.doc_id
""")
def upsert_coalesce(spark, sf):
    d = load(spark, sf, "documents")
    old = d.where("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("root_id"), F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("duration_ms"),
        F.col("lang").alias("error"), F.lit(0).cast("long").alias("first_seen_at"),
    )
    new = d.where("doc_id % 3 <> 1").select(F.lit(1).cast("long").alias("root_id"), F.col("doc_id").cast("string").alias("rel_path"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") + 1).alias("duration_ms"))
    return catalog.upsert_samples(old, new, 5).select(F.col("rel_path").cast("long").alias("doc_id"), "duration_ms", "error")


@query("select doc_id, min(doc_id) over (partition by sha256(text)) as representative from documents")
def dedup_representative(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return catalog.representatives(d, "hash", "doc_id").select("doc_id", "representative")


@query("""
with k as (select min(doc_id) as twin_id, text from documents where doc_id % 4 = 0 group by text),
f as (select min(lpad(doc_id::varchar, 12, '0')) as first_path, text from documents where doc_id % 4 <> 0 group by text)
select d.doc_id, twin_id, case when twin_id is not null then 'existing' when lpad(d.doc_id::varchar, 12, '0') = first_path then 'compute' else 'copy' end as plan
from documents d left join k on k.text = d.text left join f on f.text = d.text where d.doc_id % 4 <> 0
""")
def duplicate_plan(spark, sf):
    d = load(spark, sf, "documents").withColumn("content_hash", F.unhex(F.sha2("text", 256)))
    known = d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), "content_hash", F.lit("embedded").alias("status"))
    new = d.where("doc_id % 4 <> 0").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("rel_path"), "content_hash")
    return catalog.twins(new, known, True).select("doc_id", "twin_id", "plan")


@query("select doc_id from documents d where not exists (select 1 from documents k where k.doc_id = d.doc_id and k.doc_id % 3 = 0 and k.n_chars > 500)")
def incremental_skip(spark, sf):
    from tessera.sources.audio import changed

    d = load(spark, sf, "documents").select("doc_id", F.lit(1).alias("root_id"), F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size_bytes"))
    known = d.where("doc_id % 3 = 0").withColumn("status", F.when(F.col("mtime") > 500, "embedded").otherwise("decode_failed"))
    return changed(d, known, F.col("status") == "embedded").select("doc_id")


# -- vectors --------------------------------------------------------------------------------------------


@query("""
with s as (select q.vec_id as query_id, x.vec_id as id, list_cosine_similarity(q.embedding::double[], x.embedding::double[]) as c from embeddings q join embeddings x on q.vec_id <> x.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by c desc, id)::int as rank from s)
select query_id, id, rank, round(c, 6) + 0.0 as score from r where rank <= 5
""")
def cosine_topk(spark, sf):
    v = vecs(spark, sf)
    return vectors.nearest(v.where("id % 20 = 0"), v, 5, "cosine").select("query_id", "id", "rank", r6(F.col("score"), "score"))


@query("""
select vec_id as id, greatest(round(list_cosine_similarity(x.embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)), 6), 0.0) as similarity
from embeddings x where vec_id <> 3 order by list_cosine_similarity(x.embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)) desc, vec_id limit 10
""")
def similar_one(spark, sf):
    return vectors.similar(vecs(spark, sf), 3, 10).select("id", r6(F.col("similarity"), "similarity"))


@query("""
with s as (select q.vec_id as query_id, x.vec_id as id, list_distance(q.embedding::double[], x.embedding::double[]) as d from embeddings q join embeddings x on q.vec_id <> x.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by d, id)::int as rank from s)
select query_id, id, rank from r where rank <= 15
""")
def euclid_topk_partitioned(spark, sf):
    v = vecs(spark, sf)
    return vectors.nearest(v.where("id % 20 = 0"), v, 15, "euclid").select("query_id", "id", "rank")


PLACED = """
with s as (select q.vec_id as query_id, x.vec_id as id, list_distance(q.embedding::double[], x.embedding::double[]) as d, x.embedding[1]::double as x, x.embedding[2]::double as y
  from embeddings q join embeddings x on x.vec_id % 20 <> 0 where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by d, id) as rank from s),
"""


@query(
    PLACED
    + "b as (select query_id, sum(x / (d + 0.001)) / sum(1 / (d + 0.001)) as x, sum(y / (d + 0.001)) / sum(1 / (d + 0.001)) as y from r where rank <= 15 group by query_id) "
    "select query_id as id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y from b"
)
def barycentre_placement(spark, sf):
    v = vecs(spark, sf)
    anchors = v.where("id % 20 <> 0").withColumns({"x": F.col("v")[0].cast("double"), "y": F.col("v")[1].cast("double")})
    near = vectors.nearest(v.where("id % 20 = 0"), anchors, 15, "euclid")
    both = near.withColumnRenamed("score", "distance").join(anchors.select("id", "x", "y"), "id")
    return vectors.barycentre(both).select(F.col("query_id").alias("id"), r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query("""
with p as (select vec_id as id, (vec_id | 1)::hugeint as s from embeddings),
a1 as (select id, xor(s, (s * 8192) % 18446744073709551616::hugeint) as s from p), a2 as (select id, xor(s, s >> 7) as s from a1), a3 as (select id, xor(s, (s * 131072) % 18446744073709551616::hugeint) as s from a2),
b1 as (select id, s as one, xor(s, (s * 8192) % 18446744073709551616::hugeint) as s from a3), b2 as (select id, one, xor(s, s >> 7) as s from b1), b3 as (select id, one, xor(s, (s * 131072) % 18446744073709551616::hugeint) as s from b2)
select id, round(((one >> 40)::double / 8388608 - 1) * 10 * 0.002, 9) + 0.0 as dx, round(((s >> 40)::double / 8388608 - 1) * 10 * 0.002, 9) + 0.0 as dy from b3
""")
def jitter_xorshift(spark, sf):
    dx, dy = scalar.jitter(F.col("id"), F.lit(10.0))
    return vecs(spark, sf).select("id", (F.round(dx, 9) + 0.0).alias("dx"), (F.round(dy, 9) + 0.0).alias("dy"))


@query("""
with u as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
m as (select dim, avg(x) as mean, stddev_pop(x) as std from u group by dim)
select vec_id as id, dim::int as dim, round(greatest(-5, least(5, (x - mean) / case when std <= 1e-6 then 1.0 else std end)), 6) + 0.0 as z from u join m using (dim)
""")
def standardize_clip(spark, sf):
    v = vecs(spark, sf)
    cells = v.select("id", F.posexplode(scalar.doubles(F.col("v"))).alias("dim", "x")).join(F.broadcast(columns.moments(v)), "dim")
    return cells.select("id", "dim", r6(scalar.standardize(F.col("x"), F.col("mean"), F.col("std")), "z"))


@query("""
with u as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as d from embeddings), m as (select d, avg(x) as m from u group by d),
c as (select vec_id, d, x - m as x from u join m using (d))
select a.d::int as i, b.d::int as j, round(sum(a.x * b.x) / (count(*) - 1), 6) + 0.0 as cov from c a join c b on a.vec_id = b.vec_id and a.d <= b.d group by all
""")
def covariance_upper(spark, sf):
    return projection.covariance(vecs(spark, sf)).select("i", "j", r6(F.col("cov"), "cov"))


@query()
def pca_project(spark, sf):
    return projection.Pca().fit_transform(vecs(spark, sf))


@query("""
with t as (select count(*) as total from embeddings), p as (select unnest([null, total, total - 1, 0, total // 2]) as placed, total from t)
select case when placed is null then -1 else placed end as placed, case when placed is null then 'full' when placed >= total then 'up_to_date' when (total - placed) / total < 0.05 then 'incremental' else 'full' end as kind,
case when placed is null then total else total - placed end as new from p
""")
def refit_plan(spark, sf):
    total = load(spark, sf, "embeddings").count()
    cases = (None, total, total - 1, 0, total // 2)
    return spark.createDataFrame([(-1 if p is None else p, *projection.plan(total, p)) for p in cases], "placed long, kind string, new long")


@query("""
with recursive n as (select l_orderkey as a, l_partkey + 10000000 as b from lineitem where l_quantity >= 49),
u as (select a, b from n union select b, a from n),
c(node, label) as (select a, a from u union select u.b, c.label from c join u on u.a = c.node)
select node, min(label) as component from c group by node
""")
def components(spark, sf):
    """Orders and parts that large lines join up."""
    edges = load(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))
    return connected_components(edges)


@query("""
with s as (select q.vec_id as query_id, x.vec_id as id, list_cosine_similarity(q.embedding::double[], x.embedding::double[]) as c,
  (q.embedding[1]::double - x.embedding[1]::double) ** 2 + (q.embedding[2]::double - x.embedding[2]::double) ** 2 as d from embeddings q join embeddings x on q.vec_id <> x.vec_id),
r as (select *, row_number() over (partition by query_id order by c desc, id) as rc, row_number() over (partition by query_id order by d, id) as rd from s)
select round(avg(case when rc <= 15 then 1.0 else 0.0 end), 6) + 0.0 as hit_rate from r where rd <= 5
""")
def hit_rate_at_k(spark, sf):
    v = vecs(spark, sf)
    flat = v.select("id", F.slice("v", 1, 2).alias("v"))
    truth = vectors.nearest(v, v, 15, "cosine")
    spatial = vectors.nearest(flat, flat, 5, "euclid")
    return vectors.hit_rate(spatial, truth).select(r6(F.col("hit_rate"), "hit_rate"))


# -- columns -----------------------------------------------------------------------------------------------


@query("""
select min(embedding[1]::double) as min_x, max(embedding[1]::double) as max_x, min(embedding[2]::double) as min_y, max(embedding[2]::double) as max_y,
round(sqrt((max(embedding[1]::double) - min(embedding[1]::double)) ** 2 + (max(embedding[2]::double) - min(embedding[2]::double)) ** 2), 6) + 0.0 as diagonal from embeddings
""")
def bounding_box(spark, sf):
    return columns.bounding_box(points(spark, sf).where("run_id = 1")).select("min_x", "max_x", "min_y", "max_y", r6(F.col("diagonal"), "diagonal"))


@query("""
with d as (select sqrt((embedding[1]::double - embedding[3]::double) ** 2 + (embedding[2]::double - embedding[4]::double) ** 2) as d from embeddings),
r as (select d, row_number() over (order by d) as rn, count(*) over () as n from d)
select round(d, 6) + 0.0 as median from r where rn = n // 2 + 1
""")
def upper_median_displacement(spark, sf):
    p = points(spark, sf)
    return columns.displacement(p.where("run_id = 1"), p.where("run_id = 2")).select(r6(F.col("median"), "median"))


@query("""
with r as (select value, row_number() over (order by value) as rn, count(*) over () as n from events where value is not null and isfinite(value))
select max(case when rn = floor(0.02 * (n - 1) + 0.5) + 1 then value end) as low, max(case when rn = floor(0.98 * (n - 1) + 0.5) + 1 then value end) as high from r
""")
def percentile_domain(spark, sf):
    return columns.domain(load(spark, sf, "events"), "value")


@query("""
with t as (select p_partkey, greatest(0.0, least(1.0, (p_retailprice - 900.0) / 1100.0)) * 5 as s from part), i as (select p_partkey, s, least(4, floor(s))::int as k from t),
c as (select [[0.18, 0.24, 0.48], [0.29, 0.35, 0.68], [0.55, 0.33, 0.62], [0.85, 0.36, 0.42], [0.98, 0.6, 0.27], [0.99, 0.9, 0.61]]::double[][] as st)
select p_partkey, round(st[k + 1][1] + (st[k + 2][1] - st[k + 1][1]) * (s - k), 6) + 0.0 as r, round(st[k + 1][2] + (st[k + 2][2] - st[k + 1][2]) * (s - k), 6) + 0.0 as g,
round(st[k + 1][3] + (st[k + 2][3] - st[k + 1][3]) * (s - k), 6) + 0.0 as b from i, c
""")
def color_ramp(spark, sf):
    bounds = spark.createDataFrame([(900.0, 2000.0)], "low double, high double")
    out = columns.coloured(load(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bounds, "ember")
    return out.select("p_partkey", *(r6(F.col(c), c) for c in "rgb"))


@query("select vec_id as sample_id, (case when l.doc_id is not null then 1 else 0 end)::tinyint as mask from embeddings left join labels l on l.doc_id = vec_id")
def mask_merge(spark, sf):
    return columns.mask(points(spark, sf).where("run_id = 1"), load(spark, sf, "labels").select(F.col("doc_id").alias("sample_id")))


@query("select vec_id as sample_id from embeddings where embedding[1]::double between -0.1 and 0.2 and embedding[2]::double between -0.2 and 0.1 order by (embedding[1]::double - 0.05) ** 2 + (embedding[2]::double + 0.05) ** 2, vec_id limit 25")
def viewport_nearest(spark, sf):
    return columns.viewport(points(spark, sf).where("run_id = 1"), -0.1, -0.2, 0.2, 0.1, 25).select("sample_id")


@query("""
with m as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts, event_id) as seq from events),
k as (select *, row_number() over (partition by user_id order by seq desc)::int as place from m where before is null or before <> event_type)
select user_id, seq, event_type as item, place from k where place <= 100
""")
def recency_trail(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    visits = load(spark, sf, "events").select("user_id", F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("item"))
    return columns.trail(visits)


@query("""
with s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events)
select user_id, floor(((pos + 1) * 8 - 1) / n)::int as bucket, min(value) as lo, max(value) as hi from s group by all
""")
def bucket_minmax(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    series = load(spark, sf, "events").select("user_id", "value", (F.row_number().over(order) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("size"))
    return columns.bucket_extremes(series, "user_id", 8)


@query("""
select vec_id as sample_id, case when max(x) over () > min(x) over () then round((x - min(x) over ()) / (max(x) over () - min(x) over ()), 6) + 0.0 else 0.5 end as x from (select vec_id, embedding[1]::double as x from embeddings)
""")
def min_max_axis(spark, sf):
    return columns.min_max(points(spark, sf).where("run_id = 1").select("sample_id", "x"), ["x"]).select("sample_id", r6(F.col("x"), "x"))


# -- series --------------------------------------------------------------------------------------------------


def series(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf, "events").select(F.col("user_id").alias("key"), F.row_number().over(order).cast("long").alias("pos"), "value")


SERIES = "with s as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) as pos, value from events)"


@query(
    SERIES
    + """, w as (select *, lag(value) over o as before, lead(value) over o as after, avg(value) over (partition by key order by pos rows between 10 preceding and 10 following) as local, avg(value) over (partition by key) as whole
from s window o as (partition by key order by pos)) select key, pos, value from w where value > before and value >= after and value > 1.5 * local and value > 0.5 * whole"""
)
def onset_pick(spark, sf):
    return columns.onset_candidates(series(spark, sf))


@query(
    SERIES.replace("with s", "with recursive s")
    + """, w as (select *, lag(value) over o as before, lead(value) over o as after, avg(value) over (partition by key order by pos rows between 10 preceding and 10 following) as local, avg(value) over (partition by key) as whole
from s window o as (partition by key order by pos)), c as (select key, pos, value from w where value > before and value >= after and value > 1.5 * local and value > 0.5 * whole),
k(key, pos) as (select key, min(pos) from c group by key union all select k.key, (select min(c.pos) from c where c.key = k.key and c.pos >= k.pos + 5) from k where exists (select 1 from c where c.key = k.key and c.pos >= k.pos + 5))
select c.* from c join k using (key, pos)"""
)
def onset_gap(spark, sf):
    return columns.onsets(series(spark, sf))


@query(SERIES + " select key, pos, round(coalesce(greatest(value - lag(value) over (partition by key order by pos), 0.0), 0.0), 6) + 0.0 as flux from s")
def flux_rectified(spark, sf):
    return columns.flux(series(spark, sf)).select("key", "pos", r6(F.col("flux"), "flux"))


@query("""
with u as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), l as (select vec_id, (x >= 0) <> (lag(x) over (partition by vec_id order by i) >= 0) as c from u)
select vec_id as id, round(sum(case when c then 1 else 0 end) / (count(*) - 1), 6) + 0.0 as zcr from l group by vec_id
""")
def zero_crossing(spark, sf):
    return vecs(spark, sf).select("id", r6(scalar.zero_crossing(F.col("v")), "zcr"))


@query("""
select vec_id as id, round(20 * log10(greatest(list_max(list_transform(embedding, lambda x: abs(x::double))), 1e-10)), 6) + 0.0 as peak_db,
round(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)), 1e-10)), 6) + 0.0 as rms_db from embeddings
""")
def db_levels(spark, sf):
    return vecs(spark, sf).select("id", r6(scalar.peak_db(F.col("v")), "peak_db"), r6(scalar.rms_db(F.col("v")), "rms_db"))


@query("""
with d as (select user_id, time_bucket(interval '1 day', ts) as "at", arg_max(event_type, (ts, event_id)) as newest from events group by all),
b as (select *, lag(newest) over (partition by user_id order by "at") as previous from d)
select user_id, "at", newest as last from b where previous is null or previous <> newest
""")
def progress_tumbling(spark, sf):
    from tessera.streaming.ingest import progress

    return progress(load(spark, sf, "events"), "ts", "event_type", "user_id", "1 day", ("event_id",))


@query("""
with g as (select user_id, ts, event_id, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '6 hours' then 1 else 0 end as brk from events),
s as (select *, sum(brk) over (partition by user_id order by ts, event_id rows unbounded preceding) as sess from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, sess
""")
def debounce_session(spark, sf):
    from tessera.streaming.ingest import debounced

    return debounced(load(spark, sf, "events"), "ts", "user_id", "6 hours", "value").select("user_id", "start", "n")


@query("select user_id, min(value) as least, max(value) as most, round(avg(value), 6) + 0.0 as mean from events group by all")
def repeats_summary(spark, sf):
    return columns.repeats_summary(load(spark, sf, "events"), "value", ("user_id",)).select("user_id", "least", "most", r6(F.col("mean"), "mean"))


# -- full text --------------------------------------------------------------------------------------------------

TOKENS = "with t as (select doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) as token from documents), k as (select doc_id, token from t where token <> '') "
POSITIONS = """with l as (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ts from documents),
k as (select doc_id, unnest(ts) as token, generate_subscripts(ts, 1) as pos from l) """


def postings(spark, sf):
    return fulltext.postings(load(spark, sf, "documents").select("doc_id", "text"), ["text"], accents=False)


def found(spark, sf, text: str) -> DataFrame:
    return fulltext.matching(postings(spark, sf), fulltext.parse(text))


@query(TOKENS + "select doc_id from k where token = 'that' intersect select doc_id from k where token like 'tion%'")
def fts_and(spark, sf):
    return found(spark, sf, "that tion")


@query(TOKENS + "select distinct doc_id from k where token in ('avec', 'nicht')")
def fts_or(spark, sf):
    return found(spark, sf, '"avec" OR "nicht"')


@query(TOKENS + "select doc_id from k where token = 'the' except select doc_id from k where token = 'from'")
def fts_not(spark, sf):
    return found(spark, sf, '"the" NOT "from"')


@query(TOKENS + "select distinct doc_id from k where token like 'entre%'")
def fts_prefix(spark, sf):
    return found(spark, sf, "entre")


@query(POSITIONS + "select distinct a.doc_id from k a join k b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.token = 'of' and b.token = 'the'")
def fts_phrase(spark, sf):
    return found(spark, sf, '"of the"')


@query(
    TOKENS
    + """, ln as (select doc_id, count(*) as len from k group by doc_id), n as (select count(*)::double as n, sum(len)::double as toks from ln),
tf as (select token, doc_id, count(*) as tf from k where token in ('avec', 'pour') group by all), df as (select token, count(*) as df from tf group by token),
s as (select doc_id, -(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (toks / n))) as s from tf join df using (token) join ln using (doc_id), n),
r as (select doc_id, sum(s) as rank from s group by doc_id having count(*) = 2)
select doc_id, round(rank, 6) + 0.0 as rank from r order by r.rank, doc_id limit 20"""
)
def bm25_topk(spark, sf):
    return fulltext.ranked(postings(spark, sf), fulltext.parse('"avec" "pour"'), limit=20).select("doc_id", r6(F.col("rank"), "rank"))


# -- catalogue -----------------------------------------------------------------------------------------------------


@query("with u as (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) select dim::int as dim, round(avg(x), 6) + 0.0 as mean from u group by dim")
def vector_mean(spark, sf):
    return columns.moments(vecs(spark, sf)).select("dim", r6(F.col("mean"), "mean"))


@query("""
with d as (select sqrt((embedding[1]::double - embedding[3]::double) ** 2 + (embedding[2]::double - embedding[4]::double) ** 2) as d from embeddings),
r as (select d, row_number() over (order by d) as rn, count(*) over () as n from d),
e as (select sqrt((max(embedding[3]::double) - min(embedding[3]::double)) ** 2 + (max(embedding[4]::double) - min(embedding[4]::double)) ** 2) as extent from embeddings)
select round(d / extent, 6) + 0.0 as relative from r, e where rn = n // 2 + 1
""")
def relative_displacement(spark, sf):
    p = points(spark, sf)
    return columns.displacement(p.where("run_id = 1"), p.where("run_id = 2")).select(r6(F.col("relative"), "relative"))


@query("select vec_id as sample_id, round((embedding[1]::double - 0.1) ** 2 + (embedding[2]::double - 0.1) ** 2, 6) + 0.0 as d2 from embeddings")
def all_by_distance(spark, sf):
    return columns.by_distance(points(spark, sf).where("run_id = 1"), 0.1, 0.1).select("sample_id", r6(F.col("d2"), "d2"))


@query("select o_orderkey as id, o_orderdate as created_at from orders order by o_orderdate desc, o_orderkey desc limit 50")
def newest_first(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return catalog.newest_runs(rows).limit(50)


@query("select vec_id as vector_id from embeddings e where exists (select 1 from labels l where l.doc_id = e.vec_id)")
def compaction(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("v"))
    return catalog.compact(v, load(spark, sf, "labels").select(F.col("doc_id").alias("vector_id"))).select("vector_id")


@query("select round((count(*) - (select count(*) from labels where doc_id in (select vec_id from embeddings))) / count(*), 6) + 0.0 as dead_ratio from embeddings")
def dead_ratio(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"))
    live = load(spark, sf, "labels").join(v.withColumnRenamed("vector_id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("vector_id"))
    return catalog.dead_ratio(v, live).select(r6(F.col("dead_ratio"), "dead_ratio"))


@query("select c_custkey as id, r_name || '/' || n_name || '/' || c_name as absolute_path, c_acctbal > 0 as embedded from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def path_projection(spark, sf):
    places = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    roots = places.select(F.col("n_nationkey").alias("id"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("root_id"), F.col("c_name").alias("rel_path"), F.when(F.col("c_acctbal") > 0, 1).alias("vector_id"))
    return catalog.with_paths(rows, roots).select("id", "absolute_path", "embedded")


@query("select s_suppkey as id, row_number() over (order by s_name, s_suppkey) + 99 as number from supplier")
def numbered(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return catalog.number(rows, [F.col("s_name"), F.col("id")], 100, "number").select("id", "number")


@query("select user_id, case when count(*) > 40 then ceil((count(*) - 40) * 3.5 / 40)::bigint end as eta from events group by user_id")
def eta_seconds(spark, sf):
    n = load(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", scalar.eta_seconds(F.col("n"), F.lit(40), F.lit(3.5)).alias("eta"))


@query("select turn as sample_id, conv_id as collection_id, turn as position, 'doc' || d.doc_id as filename from conversations join documents d on d.doc_id = turn where conv_id = 4")
def members_in_order(spark, sf):
    members = load(spark, sf, "conversations").select(F.col("conv_id").alias("collection_id"), F.col("turn").alias("sample_id"), F.col("turn").alias("position"))
    names = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"))
    return catalog.collection_members(members, names, 4)


@query("select vec_id as sample_id, case when quality is null then 0.3 else 0.5 end::double as r from embeddings left join labels on doc_id = vec_id")
def fit_colour_fallback(spark, sf):
    p = points(spark, sf).where("run_id = 1").join(load(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality"), "sample_id", "left")
    half = F.when(F.col("quality").isNotNull(), 0.5)
    return columns.fitted_colours(p.select("sample_id", *(half.alias(c) for c in "rgb"))).select("sample_id", "r")


# -- changes of the catalogue ----------------------------------------------------------------------------------------


def customers(spark, sf) -> DataFrame:
    """Customers as samples: a status by segment, a vector where the balance is positive."""
    status = F.when(F.col("c_mktsegment") == "BUILDING", "pending").when(F.col("c_acctbal") > 0, "embedded").otherwise("decoded")
    return load(spark, sf, "customer").select(
        F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("root_id"), F.col("c_name").alias("rel_path"), status.alias("status"),
        F.lit(None).cast("string").alias("error"), F.when((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "BUILDING"), F.col("c_custkey").cast("long")).alias("vector_id"),
    )


CUSTOMERS = """with c as (select c_custkey::bigint as id, c_nationkey::bigint as root_id, c_name as rel_path,
case when c_mktsegment = 'BUILDING' then 'pending' when c_acctbal > 0 then 'embedded' else 'decoded' end as status, case when c_acctbal > 0 and c_mktsegment <> 'BUILDING' then c_custkey::bigint end as vector_id from customer) """


@query("select o_custkey::bigint as sample_id, max(o_totalprice) as bpm from orders group by all union all select c_custkey, -1.0 from customer where c_custkey not in (select o_custkey from orders)")
def set_features(spark, sf):
    old = load(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("sample_id"), F.lit(-1.0).alias("bpm"))
    new = load(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("sample_id")).agg(F.max("o_totalprice").alias("bpm"))
    return catalog.set_features(old, new)


@query(CUSTOMERS + "select c.id, case when o.v is not null then 'embedded' else c.status end as status, coalesce(o.v, c.vector_id) as vector_id from c left join (select o_custkey as k, min(o_orderkey)::bigint as v from orders group by all) o on o.k = c.id")
def set_embeddings(spark, sf):
    found = load(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("sample_id")).agg(F.min("o_orderkey").cast("long").alias("vector_id"))
    return catalog.set_embeddings(customers(spark, sf), found).select("id", "status", "vector_id")


@query(CUSTOMERS + "select c.id, case when o.k is not null then 'decode_failed' else c.status end as status, coalesce(o.e, '') as error from c left join (select distinct o_custkey as k, 'open order' as e from orders where o_orderstatus = 'O') o on o.k = c.id")
def mark_failed(spark, sf):
    failures = load(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").cast("long").alias("sample_id"), F.lit("open order").alias("error")).distinct()
    return catalog.mark_failed(customers(spark, sf), failures).select("id", "status", F.coalesce("error", F.lit("")).alias("error"))


def layouts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Three runs - active, finished, in flight - over the embeddings' components."""
    runs_ = spark.createDataFrame([(1, "pca", "{}", 9, 10, 11, True), (2, "umap", "{}", 9, 20, 21, False), (3, "tsne", "{}", 9, 30, None, False)], "id long, algorithm string, params_json string, sample_count long, created_at long, completed_at long, is_active boolean")
    e = load(spark, sf, "embeddings")
    each = e.select(F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("run_id"), F.col("vec_id").alias("sample_id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"), F.lit(0.0).cast("float").alias("z"))
    return runs_, each.select("*", *(F.lit(None).cast("float").alias(c) for c in "rgb"))


@query("select run_id, count(*) as n, (run_id = 3) as active from embeddings, (values (1), (3)) r(run_id) where run_id = 3 group by all")
def activate_run(spark, sf):
    runs_, points_ = catalog.activate(*layouts(spark, sf), 3, 50)
    return points_.join(runs_.select(F.col("id").alias("run_id"), "is_active"), "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_active").alias("active")).withColumn("run_id", F.col("run_id").cast("int"))


@query("select run_id, count(*) as n from embeddings, (values (1), (3)) r(run_id) group by all")
def discard_run(spark, sf):
    runs_, points_ = catalog.discard(*layouts(spark, sf), 2)
    runs_, points_ = catalog.discard(runs_, points_, 1)  # the active one stays
    return points_.groupBy(F.col("run_id").cast("int")).agg(F.count(F.lit(1)).alias("n"))


@query("select 4 as id, 'umap' as algorithm, false as active, count(*) as sample_count from embeddings")
def begin_run(spark, sf):
    runs_, run_id = catalog.begin_run(layouts(spark, sf)[0], "umap", {"neighbours": 15}, load(spark, sf, "embeddings").count(), 60)
    return runs_.where(F.col("id") == run_id).select(F.col("id").cast("int").alias("id"), "algorithm", F.col("is_active").alias("active"), "sample_count")


@query("select vec_id as sample_id, round(case when l.doc_id is not null then 9.5 else embedding[1]::double end, 6) + 0.0 as x from embeddings left join labels l on l.doc_id = vec_id")
def set_points(spark, sf):
    _, points_ = layouts(spark, sf)
    fresh = load(spark, sf, "embeddings").join(load(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi")
    fresh = fresh.select(F.col("vec_id").alias("sample_id"), F.lit(9.5).cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"))
    return catalog.set_points(points_, 2, fresh).where("run_id = 2").select("sample_id", r6(F.col("x").cast("double"), "x"))


def tag_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nations as tags of the customers, with a second tag for those in a debt."""
    tags = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("color"))
    c = load(spark, sf, "customer")
    own = c.select(F.col("c_custkey").cast("long").alias("sample_id"), F.col("c_nationkey").cast("long").alias("tag_id"))
    return tags, own.unionByName(c.where("c_acctbal < 0 and c_nationkey <> 0").select(F.col("c_custkey").cast("long").alias("sample_id"), F.lit(0).cast("long").alias("tag_id")))


TAGS = """with own as (select c_custkey::bigint as sample_id, c_nationkey::bigint as tag_id from customer union all select c_custkey, 0 from customer where c_acctbal < 0 and c_nationkey <> 0) """


@query(TAGS + "select tag_id, count(*) as n from (select * from own union select 5, 3 union select 5, 25) t group by all")
def set_tag(spark, sf):
    """A known tag however it is written, and a new one."""
    tags, tagged = catalog.set_tag(*tag_tables(spark, sf), 5, " nation_3 ")
    tags, tagged = catalog.set_tag(tags, tagged, 5, "Atlantis")
    return tagged.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))


@query(TAGS + "select * from own where not (sample_id = (select min(c_custkey) from customer where c_nationkey = 3) and tag_id = 3)")
def unset_tag(spark, sf):
    first = load(spark, sf, "customer").where("c_nationkey = 3").agg(F.min("c_custkey")).first()[0]
    return catalog.unset_tag(*tag_tables(spark, sf), first, "NATION_3")


@query(TAGS + "select tag_id, count(*) as n from own where tag_id <> 7 group by all")
def delete_tag(spark, sf):
    return catalog.delete_tag(*tag_tables(spark, sf), 7)[1].groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))


@query("select n_nationkey::bigint as id, case when n_nationkey = 3 then 'Maple' else n_name end as name, case when n_nationkey = 4 then '#123456' else '' end as color from nation")
def edit_tag(spark, sf):
    tags = tag_tables(spark, sf)[0]
    changed = catalog.edit_tag(catalog.edit_tag(tags, 3, "Maple"), 4, color="#123456")
    return changed.select("id", "name", F.coalesce("color", F.lit("")).alias("color"))


@query(TAGS + "select sample_id, string_agg(upper(n_name), ',' order by lower(n_name)) as tags from own join nation on n_nationkey = tag_id group by all")
def tags_by_sample(spark, sf):
    return catalog.tags_of(*tag_tables(spark, sf)).select("sample_id", F.upper(F.array_join("tags", ",")).alias("tags"))


@query("select n_nationkey::bigint as id from nation where lower(n_name) = 'nation_6'")
def tag_lookup(spark, sf):
    return catalog.tag_id(tag_tables(spark, sf)[0], " nATION_6 ")


def line_members(spark, sf) -> DataFrame:
    """Parts as members of the orders, each once, in order of their numbers."""
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("collection_id"), F.col("l_partkey").cast("long").alias("sample_id")).distinct()
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy("collection_id").orderBy("sample_id")) - 1).cast("long"))


MEMBERS = "with m as (select *, row_number() over (partition by collection_id order by sample_id) - 1 as position from (select distinct l_orderkey::bigint as collection_id, l_partkey::bigint as sample_id from lineitem)) "


@query(MEMBERS + "select sample_id, position from m where collection_id = 3")
def member_lookup(spark, sf):
    return catalog.member_ids(line_members(spark, sf), 3)


@query(MEMBERS + "select collection_id, sample_id, case when collection_id = 3 then (select max(position) from m where collection_id = 3) - position else position end as position from m")
def reorder_members(spark, sf):
    members = line_members(spark, sf)
    mine = [r[0] for r in members.where("collection_id = 3").select("sample_id").orderBy(F.desc("position")).collect()]
    return catalog.reorder(members, 3, mine)


@query(MEMBERS + "select collection_id, sample_id from m where collection_id <> 3")
def delete_collection(spark, sf):
    collections = load(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("name"), F.lit(0).cast("long").alias("created_at"))
    return catalog.delete_collection(collections, line_members(spark, sf), 3)[1].select("collection_id", "sample_id")


@query("select s_suppkey::bigint as id, 'new ' || s_name as name from supplier where s_suppkey = 2 union all select s_suppkey, s_name from supplier where s_suppkey <> 2")
def rename_collection(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.lit(0).cast("long").alias("created_at"))
    name = rows.where("id = 2").first()["name"]
    return catalog.rename_collection(rows, 2, f"  new {name} ").select("id", "name")


@query("select r_regionkey::bigint as id, r_name as path, coalesce(case when r_regionkey = 2 then 'far' end, '') as label, r_regionkey <> 1 as enabled from region union all select max(r_regionkey) + 1, 'ATLANTIS', '', true from region")
def roots_changed(spark, sf):
    roots = load(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("path"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("enabled"), F.lit(0).cast("long").alias("added_at"), F.lit(None).cast("long").alias("last_scan_id"))
    known = roots.where("id = 2").first()["path"]
    roots, same = catalog.add_root(roots, known, "far", 5)
    assert same == 2
    roots, _ = catalog.add_root(roots, "ATLANTIS", None, 6)
    return catalog.enable_root(roots, 1, False).select("id", "path", F.coalesce("label", F.lit("")).alias("label"), "enabled")


@query(CUSTOMERS + ", own as (select c_custkey::bigint as sample_id, c_nationkey as tag_id from customer) select (select count(*) from c where root_id <> 3) as samples, (select count(*) from own where tag_id <> 3) as tagged")
def root_removed(spark, sf):
    c = customers(spark, sf)
    own = c.select(F.col("id").alias("sample_id"), F.col("root_id").alias("tag_id"))
    roots = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    left = catalog.remove_root({"library_roots": roots, "samples": c, "sample_tags": own}, 3)
    return left["samples"].agg(F.count(F.lit(1)).alias("samples")).crossJoin(left["sample_tags"].agg(F.count(F.lit(1)).alias("tagged")))


@query("select 1 as id, 'completed' as status, count(*) as seen, count_if(l.doc_id is null)::bigint as added, count_if(l.doc_id is not null)::bigint as skipped from documents d left join labels l using (doc_id)")
def scan_tally(spark, sf):
    from tessera.sources.audio import changed

    found = load(spark, sf, "documents").select(F.lit(1).cast("long").alias("root_id"), F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size_bytes"))
    finished = load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("rel_path")).join(found, "rel_path").withColumn("status", F.lit("embedded"))
    seen, todo = found.count(), changed(found, finished, F.col("status") == "embedded").count()
    runs_, scan_id = catalog.start_scan(spark.createDataFrame([], TABLES["scan_runs"]), 1, 10)
    done = catalog.finish_scan(runs_, scan_id, "completed", {"seen": seen, "added": todo, "skipped": seen - todo, "failed": 0}, None, 20)
    return done.select(F.col("id").cast("int").alias("id"), "status", F.col("files_seen").alias("seen"), F.col("files_added").alias("added"), F.col("files_skipped").alias("skipped"))


@query("""
with h as (select doc_id, sha256(text) as h, lpad(doc_id::varchar, 12, '0') as rel_path from documents), t as (select h, min(doc_id) as twin from h where doc_id % 2 = 0 group by h),
f as (select h, min(rel_path) as first from h where doc_id % 2 = 1 group by h)
select case when twin is not null then 'existing' when rel_path = first then 'compute' else 'copy' end as plan, count(*) as n from h join f using (h) left join t using (h) where doc_id % 2 = 1 group by all
""")
def scan_twins(spark, sf):
    d = load(spark, sf, "documents").withColumn("content_hash", F.unhex(F.sha2("text", 256)))
    known = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "content_hash", F.lit("decoded").alias("status"))
    new = d.where("doc_id % 2 = 1").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("rel_path"), "content_hash")
    return catalog.twins(new, known, False).groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


@query("select n_nationkey::varchar as key, case when n_nationkey = 4 then '0.5' else n_name end as value from nation")
def settings_changed(spark, sf):
    settings = load(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    return catalog.set_setting(settings, "4", "0.5")


@query("select value, gain::double as gain from (values ('0.25', 0.25), ('-1', 1.0), ('loud', 1.0), ('inf', 1.0), ('', 1.0)) t(value, gain)")
def gain_setting(spark, sf):
    one = lambda v: catalog.gain(spark.createDataFrame([("gain", v)], "key string, value string"))
    return spark.createDataFrame([(v, one(v)) for v in ("0.25", "-1", "loud", "inf", "")], "value string, gain double")


@query(CUSTOMERS + "select id as sample_id, vector_id from c where status = 'embedded' and vector_id is not null")
def embedded_samples(spark, sf):
    return catalog.embedded(customers(spark, sf))


@query(CUSTOMERS + "select id, status = 'embedded' as full_done, status in ('embedded', 'decoded') as light_done from c")
def status_complete(spark, sf):
    c = customers(spark, sf)
    return c.select("id", complete(F.col("status"), True).alias("full_done"), complete(F.col("status"), False).alias("light_done"))


@query("select c_custkey::bigint as id, case when c_mktsegment in ('pending') then c_mktsegment else 'pending' end as status from customer")
def status_unknown(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), parse_status(F.col("c_mktsegment")).alias("status"))


@query("""
with a as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[1]::double * 0.6 - embedding[2]::double * 0.8 + 3 as u, embedding[1]::double * 0.8 + embedding[2]::double * 0.6 - 2 as w from embeddings)
select id, round(u, 5) + 0.0 as x, round(w, 5) + 0.0 as y from a
""")
def procrustes_alignment(spark, sf):
    """A layout and the same one turned and moved: the fit finds the turn again."""
    one = points(spark, sf).where("run_id = 1").select(F.col("sample_id").alias("id"), "x", "y")
    two = one.select("id", (F.col("x") * 0.6 - F.col("y") * 0.8 + 3).alias("x"), (F.col("x") * 0.8 + F.col("y") * 0.6 - 2).alias("y"))
    moved = projection.procrustes(one, two).apply(one)
    return moved.select("id", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query("""
with f as (select vec_id as vector_id, embedding[1]::double as x from embeddings), r as (select o_orderkey::bigint as sample_id, o_custkey::bigint as vector_id from orders),
m as (select vector_id, min(sample_id) as first from r group by all)
select sample_id, sample_id = first as exact, case when sample_id = first then round(x, 6) + 0.0 else 99 end as x from r join m using (vector_id) join f using (vector_id)
""")
def vector_fan_out(spark, sf):
    fitted = points(spark, sf).where("run_id = 1").select(F.col("sample_id").alias("id"), "x", "y", F.lit(0.0).alias("z"))
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("sample_id"), F.col("o_custkey").cast("long").alias("vector_id"))
    spread = projection.fan_out(rows, fitted, 10.0).join(rows, "sample_id").join(fitted.select(F.col("id").alias("vector_id"), F.col("x").alias("at")), "vector_id")
    exact = F.col("x") == F.col("at")
    return spread.select("sample_id", exact.alias("exact"), F.when(exact, F.round("at", 6) + 0.0).otherwise(99).alias("x"))


# -- queries as they are typed ----------------------------------------------------------------------------------------


@query(TOKENS + "select doc_id as sample_id from (select doc_id from k where token = 'der' union select doc_id from k where token = 'les') join documents using (doc_id) where n_chars >= 300 order by doc_id limit 40")
def filter_text_and_limit(spark, sf):
    t = Tables(samples(spark, sf), postings=postings(spark, sf))
    return filters.sample_ids(t, QueryFilter(text='"der" OR "les"', ranges=(Range("durationMs", 300),), limit=40))


@query("select doc_id from documents where regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])uber([^\\p{L}\\p{N}]|$)')")
def fts_accents(spark, sf):
    """Diacritics are folded in the index as in the query."""
    index = fulltext.postings(load(spark, sf, "documents").select("doc_id", "text"), ["text"])
    return fulltext.matching(index, fulltext.parse('"Über"'))


@query("select doc_id from documents where lang = 'de' or source = 'src2' or regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])src2([^\\p{L}\\p{N}]|$)')")
def fts_fields(spark, sf):
    """Three fields: a word counts wherever it stands."""
    d = load(spark, sf, "documents")
    index = fulltext.postings(d.select("doc_id", "text", "lang", "source"), ["text", "lang", "source"], accents=False)
    found_ = fulltext.matching(index, fulltext.parse('"src2"'))
    return found_.unionByName(fulltext.matching(index.where("field = 1"), fulltext.parse('"de"'))).distinct()


def written(query: fulltext.Node | fulltext.Term | None) -> str:
    """A parsed query in one line: tokens joined by +, a prefix with a star, operators in brackets."""
    if query is None:
        return "-"
    if isinstance(query, fulltext.Term):
        return "+".join(query.tokens) + "*" * query.prefix
    return f"({written(query.left)} {query.op} {written(query.right)})"


#: Queries as typed, and what they mean.
TYPED = {
    "kick": "kick*",
    "kick drum": "(kick AND drum*)",
    '"kick drum"': "kick+drum",
    '"kick" drum': "(kick AND drum*)",
    "kick* drum": "(kick* AND drum*)",
    "kick AND OR snare": "(kick AND snare*)",
    "kick NOT snare a": "(kick NOT (snare AND a*))",
    "kick OR snare": "(kick OR snare*)",
    "kick NOT snare": "(kick NOT snare*)",
    "AND kick": "kick*",
    "kick OR": "kick*",
    "NOT": "-",
    "": "-",
    '"open phrase': "open+phrase",
    "a-b": "(a AND b*)",
    "!!!": "-",
}


@query("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in TYPED.items()) + ") t(typed, meant)")
def fts_rewriter(spark, sf):
    return spark.createDataFrame([(t, written(fulltext.parse(t))) for t in TYPED], "typed string, meant string")


class Doubled:
    """A model that doubles the first two components."""

    width = 2

    def embed(self, inputs):
        return [x[:2] * 2 for x in inputs]


@query("select vec_id as id, round(2 * embedding[1]::double, 5) + 0.0 as x, round(2 * embedding[2]::double, 5) + 0.0 as y from embeddings")
def embedding_stage(spark, sf):
    found_ = embedding.embedded(vecs(spark, sf).withColumnRenamed("v", "input"), Doubled())
    return found_.select("id", *((F.round(F.col("v")[i].cast("double"), 5) + 0.0).alias(n) for i, n in enumerate("xy")))
