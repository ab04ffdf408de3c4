"""URL filter over a sorted digest array.

The list of rules is one file: 64-bit xxHash keys in ascending order, the place of each
rule's text, its verdict, then the texts.  Workers memory-map it, probe whole batches by
binary search and compare the stored text of every hit, so that a collision of digests can
not decide.  The file is written to the shared folder and fetched by each executor once.

A rule is ``host/path``; it fits its host and all subdomains if the path of the url starts
with the rule's path.  The longest fitting rule wins; without one the default verdict holds.
Defined results: a url that is null or has no ``://`` has an empty host and path, and gets
the default verdict; repeated rows are judged one by one; null ids are carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frame import LOWER, UPPER, Frame, map_batches
from tessera.plans.scratch import new_path

HEAD = struct.Struct("<8sQQQ")
MAGIC = b"DIGESTS1"
VERDICTS = ("allow", "block")

#: Fixed values of the contract.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def parts(rule: str) -> tuple[str, str]:
    """Host and path of a rule."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def pack(rules: Iterable[tuple[str, str]]) -> bytes:
    """The digest array of the rules; of a rule given twice the last verdict holds."""
    known = {rule: VERDICTS.index(verdict) for rule, verdict in rules}
    rows = sorted((xxhash.xxh64_intdigest(rule.encode()), rule.encode(), v) for rule, v in known.items())
    texts = [text for _, text, _ in rows]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.uint64))).astype("<u8")
    labels = max((parts(r)[0].count(".") + 1 for r in known), default=0)
    return b"".join(
        [
            HEAD.pack(MAGIC, len(rows), labels, 0),
            np.array([k for k, _, _ in rows], "<u8").tobytes(),
            ends.tobytes(),
            np.array([v for _, _, v in rows], "u1").tobytes(),
            *texts,
        ]
    )


class DigestArray:
    """Read side of ``pack``: memory-mapped, so all workers of a machine share its pages."""

    def __init__(self, path: str) -> None:
        self.data = np.memmap(path, np.uint8, "r")
        magic, n, self.labels, _ = HEAD.unpack(self.data[: HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path} is no digest array")
        at = HEAD.size
        self.keys = self.data[at : at + 8 * n].view("<u8")
        self.ends = self.data[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.verdicts = self.data[at + 16 * n + 8 : at + 17 * n + 8]
        self.texts = self.data[at + 17 * n + 8 :]
        self.lengths = sorted({len(parts(self.text(i))[1]) for i in range(n)})

    def text(self, i: int) -> str:
        return self.texts[int(self.ends[i]) : int(self.ends[i + 1])].tobytes().decode()

    def probe(self, wanted: list[str]) -> np.ndarray:
        """For each text the index of its rule, or -1."""
        digests = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in wanted), np.uint64, len(wanted))
        low = np.searchsorted(self.keys, digests, "left")
        high = np.searchsorted(self.keys, digests, "right")
        out = np.full(len(wanted), -1, np.int64)
        for i in np.flatnonzero(high > low):
            out[i] = next((k for k in range(low[i], high[i]) if self.text(k) == wanted[i]), -1)
        return out


def fitting(array: DigestArray, hosts: list[str], paths: list[str]) -> list[int]:
    """For each url the index of its longest fitting rule, or -1."""
    wanted: dict[str, int] = {}
    mine: list[list[str]] = []
    for host, path in zip(hosts, paths, strict=True):
        tried = []
        if host:
            labels = host.split(".")
            for k in range(1, min(array.labels, len(labels)) + 1):
                suffix = ".".join(labels[-k:])
                tried += [suffix + path[:n] for n in array.lengths if n <= len(path)]
        for key in tried:
            wanted.setdefault(key, len(wanted))
        mine.append(tried)
    found = array.probe(list(wanted))
    best = []
    for tried in mine:
        hits = [key for key in tried if found[wanted[key]] >= 0]
        best.append(int(found[wanted[max(hits, key=lambda x: (len(x), x))]]) if hits else -1)
    return best


def publish(spark: SparkSession, data: bytes) -> str:
    """Write the array to the shared folder; each executor fetches its copy once."""
    path = f"{new_path(spark, 'digests')}/{xxhash.xxh3_128_hexdigest(data)}.digests"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    name = path.rsplit("/", 1)[1]
    if name not in {f.rsplit("/", 1)[1] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule (null without one) and verdict of every row."""
    name = publish(pages.sparkSession, pack(rules))
    frame = Frame(pages)
    host, path = host_and_path(frame.col(url))
    parsed = frame.df.select(frame.col(key).alias(key), host.alias("host"), path.alias("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            best = fitting(array, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([array.text(i) if i >= 0 else None for i in best], pa.string()),
                    pa.array([VERDICTS[array.verdicts[i]] if i >= 0 else default for i in best], pa.string()),
                ],
                [key, "host", "path", "rule", "verdict"],
            )

    kind = dict(parsed.dtypes)[key]
    return map_batches(parsed, work, f"`{key}` {kind}, host string, path string, rule string, verdict string", 10_000)


#: The same for DuckDB.
ORACLE = r"""
with u as (select page_id, coalesce(url, '') as url from pages),
p as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from u),
q as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) as path from p),
rules(rule, rule_host, rule_path, verdict) as (values
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from q join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select q.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from q left join m on q.page_id = m.page_id
"""
