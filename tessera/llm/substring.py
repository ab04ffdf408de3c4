"""Substring dedup with automata of repeated phrases.

A window is ``WINDOW`` words in a row.  Windows with equal words share an anchor: of the
phrases of ``PHRASE`` words in a window, the first with the least hash.  So two texts can share
a window only if one of its anchors is found in both.

1.  Every text gives its anchors.  Those found in two different texts are counted in one
    aggregation with partial sums, over hashes only.  Texts without one repeat nothing.
2.  The other texts give the words of these phrases.  A phrase whose words stand in two different
    texts is a confirmed passage.  Passages are dealt out to shards by the text they stand in
    first, so that a text's passages are in few shards; there is a shard for each ``SHARD`` of them.
3.  Each shard is compiled into an Aho-Corasick automaton, and every text with passages of the
    shard is streamed through it, which locates all occurrences.  Windows around an occurrence
    that is their anchor are the ones that may repeat.  A shard that many texts need is compiled
    once for each ``UNIT`` of them, so no task gets all of them.
4.  These windows, by 128-bit rolling hash, get the smallest id they start in.  A window is
    removed with all its words where that id is smaller than its own text's.

Rows with the same words are judged through the one with the smallest id; no step lists pairs.

Defined results: a null or short text (fewer words than a window) keeps all it has; a null id
neither removes nor is removed from; rows with the same id never remove each other's words;
repeated rows get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frame import Frame, map_batches
from tessera.plans.prune import maybe_in
from tessera.plans.scratch import few, kept, staged

WINDOW = 50
PHRASE = 10
#: Passages of a shard (and of the text that fills it), and texts streamed through one automaton.
SHARD, UNIT = 4096, 2000

#: Odd multipliers of the two rolling hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of all runs of ``n`` words of a text, from prefix sums of ``hash * base^i``."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, dtype=np.uint64, out=powers)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64, out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, n: int) -> np.ndarray:
        count = len(prefix) - n
        return (prefix[n:] - prefix[:count]) * self.down[:count]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that the least hash is no matter of the words' order."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Reader:
    """Hashes of one text's words, phrases and windows."""

    def __init__(self, window: int, phrase: int) -> None:
        self.window, self.phrase = window, phrase
        self.rolls = [Rolling(b) for b in BASES]

    def words(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))

    def phrases(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the phrase at each word, and the place of each window's anchor."""
        grams = mixed(self.rolls[0].runs(self.rolls[0].prefix(hashes), self.phrase))
        width = self.window - self.phrase + 1
        at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
        return grams, at

    def windows(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [r.runs(r.prefix(hashes), self.window) for r in self.rolls]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _scan(window: int, phrase: int):
    """Each text: its number of words, digests of its words, and its anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(window, phrase)
        for batch in batches:
            n, sha, one, two, anchors = [], [], [], [], []
            for value in batch.column(2):
                found = value.as_py().split()
                joined = b" ".join(found)
                n.append(len(found))
                sha.append(hashlib.sha256(joined).hexdigest())
                digest = xxhash.xxh3_128_intdigest(joined)
                one.append(_signed(digest >> 64))
                two.append(_signed(digest & (1 << 64) - 1))
                if len(found) >= window:
                    grams, at = reader.phrases(reader.words(found))
                    anchors.append(np.unique(grams[at]).view(np.int64))
                else:
                    anchors.append(np.zeros(0, np.int64))
            ends = np.concatenate(([0], np.cumsum([len(a) for a in anchors]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(anchors) if anchors else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists],
                ["doc_id", "row", "n_words", "sha", "d1", "d2", "anchors"],
            )

    return work


def _passages(window: int, phrase: int):
    """``row, text, anchors`` -> the words of each anchor's phrase: ``anchor, words, d1``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(window, phrase)
        for batch in batches:
            anchors, phrases, texts = [], [], []
            for d1, value, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = value.as_py().split()
                grams, at = reader.phrases(reader.words(found))
                places = np.unique(at)
                places = places[np.isin(grams[places], wanted.values.to_numpy().view(np.uint64))]
                anchors.append(grams[places].view(np.int64))
                phrases += [b" ".join(found[i : i + phrase]) for i in places.tolist()]
                texts.append(np.full(len(places), d1.as_py(), np.int64))
            if anchors:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(phrases, pa.binary()), pa.array(np.concatenate(texts))], ["anchor", "words", "d1"])

    return work


class Automaton:
    """The passages of a shard; finds the words at which any of them begins."""

    def __init__(self, phrase: int) -> None:
        self.phrase, self.machine = phrase, ahocorasick.Automaton()

    def add(self, words: bytes) -> None:
        self.machine.add_word((b" " + words + b" ").decode("latin-1"), 1)

    def compile(self) -> None:
        self.machine.make_automaton()

    def begins(self, found: list[bytes]) -> np.ndarray:
        at = np.zeros(len(found), bool)
        if self.machine.kind == ahocorasick.AHOCORASICK:
            text = " " + b" ".join(found).decode("latin-1") + " "
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            hits = np.fromiter((end for end, _ in self.machine.iter(text)), np.int64)
            at[np.searchsorted(ends, hits) - self.phrase + 1] = True
        return at


def _locate(window: int, phrase: int):
    """``shard, part, doc_id, row, text`` in order of shard and part, passages (without a row)
    before texts -> the windows of each text that may repeat, by the shard's passages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(window, phrase)
        unit, automaton, compiled = None, Automaton(phrase), False
        for batch in batches:
            ids, rows, starts, one, two = [], [], [], [], []
            for shard, part, doc_id, row, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, part) != unit:
                    unit, automaton, compiled = (shard, part), Automaton(phrase), False
                if row is None:
                    automaton.add(value)
                    continue
                if not compiled:
                    automaton.compile()
                    compiled = True
                found = value.split()
                hits = automaton.begins(found)
                if not hits.any():
                    continue
                hashes = reader.words(found)
                _, at = reader.phrases(hashes)
                may = np.flatnonzero(hits[at])
                a, b = reader.windows(hashes)
                ids.append(doc_id)
                rows.append(row)
                starts.append(may.astype(np.int32))
                one.append(a[may].view(np.int64))
                two.append(b[may].view(np.int64))
            if not ids:
                continue
            ends = np.concatenate(([0], np.cumsum([len(s) for s in starts]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (starts, one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), *lists], ["doc_id", "row", "starts", "h1", "h2"])

    return work


def _remove(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for value, starts in zip(batch.column(2), batch.column(3), strict=True):
                found = value.as_py().split()
                at = starts.values.to_numpy()
                edge = np.bincount(at, minlength=len(found) + 1) - np.bincount(at + window, minlength=len(found) + 1)[: len(found) + 1]
                covered = np.cumsum(edge)[: len(found)] > 0
                removed.append(int(covered.sum()))
                kept.append(b" ".join([found[i] for i in np.flatnonzero(~covered).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "row", "n_removed", "kept_sha", "kept"],
            )

    return work


def deduplicated(documents: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, unit: int = UNIT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row; ``kept`` holds the words
    that are left, null where the text keeps all or nothing."""
    frame = Frame(documents)
    text = F.coalesce(frame.col("text"), F.lit("")).cast("binary")
    docs = frame.df.select(frame.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    scanned = kept(
        map_batches(docs, _scan(window, phrase), "doc_id long, row long, n_words long, sha string, d1 long, d2 long, anchors array<long>", 500)
    )
    named = scanned.where("doc_id is not null")
    ends = named.where(F.col("n_words") >= window).groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # Written, so that both sides of the join are dealt out anew and a large group can be split.
    low = staged(few(ends.where("low < high").drop("high")), "copied")
    copies = named.select("doc_id", "row", "d1", "d2").join(low, ["d1", "d2"]).where("doc_id > low").select("doc_id", "row").distinct().withColumn("copy", F.lit(True))

    pairs = named.select("doc_id", "row", "d1", F.explode("anchors").alias("anchor"))
    recurring = pairs.groupBy("anchor").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("doc_id").alias("first")).where("a <> b").select("anchor", "first")
    recurring = staged(few(recurring), "recurring")
    shards = max(1, -(-recurring.count() // shard))
    recurring = recurring.select("anchor", F.pmod(F.xxhash64("first"), F.lit(shards)).alias("shard"))
    wanted = (
        pairs.join(recurring, "anchor")
        .groupBy("doc_id", "row", "d1")
        .agg(F.collect_set("anchor").alias("anchors"), F.collect_set("shard").alias("shards"))
        .join(copies, ["doc_id", "row"], "left_anti")
    )
    wanted = kept(wanted)
    texts = kept(maybe_in(docs, wanted, ["doc_id", "row"]).join(wanted, ["doc_id", "row"]).select("doc_id", "row", "d1", "text", "anchors", "shards"))

    phrases = map_batches(texts.select("d1", "text", "anchors"), _passages(window, phrase), "anchor long, words binary, d1 long", 500)
    confirmed = phrases.groupBy("anchor", "words").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("anchor", "words")
    passages = confirmed.join(recurring, "anchor").select("shard", "words")
    each = texts.select("doc_id", "row", "text", F.explode("shards").alias("shard"))
    parts = staged(few(wanted.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / unit).cast("int").alias("parts"))), "units")
    streamed = each.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int").alias("part"), "doc_id", "row", "text")
    compiled = passages.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.col("words").alias("text")
    )
    dealt = compiled.unionByName(streamed).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("row").isNotNull())
    located = kept(map_batches(dealt, _locate(window, phrase), "doc_id long, row long, starts array<int>, h1 array<long>, h2 array<long>"))
    windows = located.select("doc_id", "row", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("doc_id", "row", "w.starts", "w.h1", "w.h2")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeated = (
        windows.join(staged(few(first.drop("last")), "first"), ["h1", "h2"])
        .where("doc_id > first")
        .groupBy("doc_id", "row")
        .agg(F.collect_list("starts").alias("starts"))
    )
    cut = map_batches(
        texts.select("doc_id", "row", "text").join(repeated, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]),
        _remove(window),
        "doc_id long, row long, n_removed long, kept_sha string, kept binary",
        500,
    )
    return (
        scanned.select("doc_id", "row", "n_words", "sha")
        .join(copies, ["doc_id", "row"], "left")
        .join(cut, ["doc_id", "row"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept"),
        )
    )


#: The same for DuckDB at 50 words.
ORACLE = r"""
with l as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from l),
s as (select doc_id, unnest(range(1, len(ws) - 48)) as pos, ws from l where len(ws) >= 50),
g as (select doc_id, pos, min(doc_id) over (partition by array_to_string(list_slice(ws, pos, pos + 49), ' ')) < doc_id as again from s),
c as (select w.doc_id, w.pos, word, coalesce(max(case when again then 1 else 0 end) over (partition by w.doc_id order by w.pos rows between 49 preceding and current row), 0) as gone
  from w left join g on g.doc_id = w.doc_id and g.pos = w.pos),
k as (select doc_id, sum(gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (where gone = 0), '') as kept from c group by doc_id)
select l.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from l left join k on k.doc_id = l.doc_id
"""
