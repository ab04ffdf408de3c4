"""SimHash near-duplicate detection over a Gray-order hierarchical index.

Fingerprints that differ in at most ``radius`` bits agree in one of ``radius`` + 1 blocks of
bits, so each distinct fingerprint is sent once for each block to the node of that block's
pattern: the upper level of the index.  A node with many fingerprints is factored again by
blocks of the bits that are left, as often as needed, so no task gets an unbounded node.
Inside a node the fingerprints are sorted by Gray rank, which puts those with few differing
bits side by side; groups of neighbours are factored into the bits they share, groups of
groups likewise, and a search goes down from the top, adding up differences and leaving out
every group that already has too many.

Equal fingerprints are one entry of the index.  From a node goes a spanning forest of its
links, not all pairs; connected components over all forests give the groups.

``one_of_each`` also takes texts as near duplicates whose word shingles are similar, however many
bits their fingerprints are apart.  Candidates for that agree in one of ``BANDS`` groups of
``ROWS`` least shingle hashes, a fixed number of rows for each text; every candidate is
confirmed on the texts.

Defined results: a null or empty text has fingerprint zero, linked like any other; null ids
get a fingerprint and take part in no minimum (a group of null ids only has none); repeated
rows are repeated in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frame import Frame, local, map_batches
from tessera.operators.components import connected_components
from tessera.plans.prune import maybe_in, not_in
from tessera.plans.scratch import few, kept, staged

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints a node may hold before it is factored again.
NODE = 4096
#: Entries of a group of the index at each level.
FAN = 16


# -- fingerprints ----------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; bit i is set if over half of the hashes have it."""
    found = text.lower().split()
    n = len(found) - shingle + 1
    if not found:
        return 0
    if n < 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of every row."""
    frame = Frame(documents)
    df = frame.df.select(frame.col("doc_id").cast("long").alias("doc_id"), F.coalesce(frame.col("text"), F.lit("")).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(df, work, "doc_id long, fp long")


# -- the index of one node --------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of groups over codes in Gray order; each group knows the bits all its codes share."""

    def __init__(self, codes: np.ndarray, fan: int = FAN) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.fan = fan
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        every, some = self.codes, self.codes
        while len(every) > 1:
            at = np.arange(0, len(every), fan)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((every, some))

    def links(self, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` of a minimum spanning forest over all pairs within ``radius``:
        codes that are linked at any smaller radius are connected by edges of that radius."""
        left, right, apart = (np.zeros(0, np.int64) for _ in range(3))
        for at in range(0, len(self.codes), block):
            a, b = self.search(np.arange(at, min(at + block, len(self.codes))), radius)
            if len(a):
                d = np.bitwise_count(self.codes[a] ^ self.codes[b]).astype(np.int64)
                left, right, apart = _forest(np.concatenate((left, a)), np.concatenate((right, b)), np.concatenate((apart, d)), len(self.codes))
        return left, right

    def search(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(asked, found)`` with found < asked, all codes within ``radius``."""
        query = asked
        group = np.zeros(len(asked), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            every, some = self.levels[depth]
            if depth < len(self.levels) - 1:
                query, group = self._children(query, group, len(every))
            reach = self.fan ** (depth + 1)
            code = self.codes[query]
            apart = np.bitwise_count((every[group] & ~code) | (code & ~some[group]))
            keep = (apart <= radius) & (group * reach < query)
            query, group = query[keep], group[keep]
        if not self.levels:
            return query[:0], group[:0]
        query, place = self._children(query, group, len(self.codes))
        keep = (place < query) & (np.bitwise_count(self.codes[query] ^ self.codes[place]) <= radius)
        return query[keep], place[keep]

    def _children(self, query: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        place = (group[:, None] * self.fan + np.arange(self.fan)).ravel()
        query = np.repeat(query, self.fan)
        keep = place < n
        return query[keep], place[keep]


def _forest(left: np.ndarray, right: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges that Kruskal's algorithm keeps."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.argsort(apart, kind="stable")
    kept = []
    for at, i, j in zip(order.tolist(), left[order].tolist(), right[order].tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(at)
    keep = np.array(kept, np.int64)
    return left[keep], right[keep], apart[keep]


# -- the distributed index ----------------------------------------------------------------


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in ``n`` runs of nearly the same length."""
    return [list(map(int, part)) for part in np.array_split(np.array(bits, int), n)]


def mask(bits: list[int]) -> int:
    """As a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _first_node(codes: DataFrame, radius: int) -> tuple[DataFrame, dict[int, list[int]]]:
    parts = blocks(list(range(BITS)), radius + 1)
    node = F.explode(F.array(*(F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(mask(p))).alias("bits")) for i, p in enumerate(parts))))
    df = codes.withColumn("node", node).select("fp", "node.path", "node.bits")
    return df, {i: [b for b in range(BITS) if b not in p] for i, p in enumerate(parts)}


def _factor(df: DataFrame, left: dict[int, list[int]], radius: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """Large nodes one level down: their path is extended by a block of the bits not yet used."""
    options, rest = [], {}
    for path, bits in left.items():
        for i, part in enumerate(blocks(bits, radius + 1)):
            to = path * (radius + 1) + i + 1000
            rest[to] = [b for b in bits if b not in part]
            options.append((path, to, mask([b for b in range(BITS) if b not in rest[to]])))
    table = local(df.sparkSession, options, "path int, to int, mask long")
    return df.join(F.broadcast(table), "path").select(
        "fp", F.col("to").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits")
    ), rest


def nodes(codes: DataFrame, radius: int, limit: int = NODE) -> DataFrame:
    """``fp, path, bits``: every distinct fingerprint in each node that it has to be searched in."""
    df, left = _first_node(codes, radius)
    done: DataFrame | None = None
    while True:
        size = df.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n"))
        shared = size.where("n > 1")
        large = staged(few(shared.where(F.col("n") > limit)), "large-nodes")
        small = shared.where(F.col("n") <= limit).drop("n")
        part = df.join(small, ["path", "bits"], "left_semi").select("fp", "path", "bits")
        done = part if done is None else done.unionByName(part)
        if min(map(len, left.values())) <= radius or large.isEmpty():
            if not large.isEmpty():  # all bits but a few agree: at most 2^radius codes in a node
                done = done.unionByName(df.join(large, ["path", "bits"], "left_semi").select("fp", "path", "bits"))
            return done
        df = staged(df.join(large, ["path", "bits"], "left_semi"), "nodes")
        df, left = _factor(df, left, radius)


def _node_links(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(codes: np.ndarray) -> pa.RecordBatch:
            index = GrayIndex(codes.view(np.uint64))
            a, b = index.links(radius)
            found = index.codes.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[a]), pa.array(found[b])], ["src", "dst"])

        held_key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).to_numpy(zero_copy_only=False)
            path = batch.column(1).to_numpy(zero_copy_only=False)
            bits = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((path[1:] != path[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(code)]))
            pairs = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                key = (path[s], bits[s])
                if key == held_key:
                    held.append(code[s:e])
                    continue
                if held_key is not None:
                    pairs.append(np.concatenate(held) if len(held) > 1 else held[0])
                held_key, held = key, [code[s:e]]
            two = [p for p in pairs if len(p) == 2]
            if two:  # by far the most nodes; their index is a single comparison
                both = np.stack(two)
                near = np.bitwise_count((both[:, 0] ^ both[:, 1]).view(np.uint64)) <= radius
                yield pa.RecordBatch.from_arrays([pa.array(both[near, 0]), pa.array(both[near, 1])], ["src", "dst"])
            for p in pairs:
                if len(p) > 2:
                    yield solve(p)
        if held_key is not None:
            yield solve(np.concatenate(held))

    return work


def links(codes: DataFrame, radius: int = RADIUS, limit: int = NODE) -> DataFrame:
    """A forest of links between distinct fingerprints ``fp`` within ``radius`` bits."""
    held = nodes(codes, radius, limit).repartition("path", "bits").sortWithinPartitions("path", "bits", "fp")
    return map_batches(held, _node_links(radius), "src long, dst long", 10_000)


def grouped(found: DataFrame, radius: int = RADIUS, limit: int = NODE) -> DataFrame:
    """``fp`` and ``doc_id`` -> the same with ``component_id`` of the group."""
    low = staged(few(found.groupBy("fp").agg(F.min("doc_id").alias("low"))), "codes")
    joined = connected_components(links(low.select("fp"), radius, limit))
    members = joined.select(F.col("node").alias("fp"), "component").join(low, "fp")
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    group = members.join(lowest, "component").select("fp", "component_id", "component")
    every = low.join(group, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    return found.join(staged(few(every), "groups"), "fp")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` in hexadecimal and ``component_id`` of every row."""
    found = kept(fingerprints(documents, shingle))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(found, radius).select("doc_id", text.alias("fingerprint"), "component_id")


# -- similar texts, however many bits apart -------------------------------------------------

#: Near duplicates in general: texts whose five-word shingles agree.
WORDS, SIMILAR = 5, 0.8
#: Rows of the index for each text, and the least hashes of which each is made.  Of two texts with
#: a similarity of 0.8 all rows differ with a probability of (1 - 0.8^4)^24 = 3 in a million.
BANDS, ROWS = 24, 4
#: Of the least hashes behind the rows, so many agree in two texts of a similarity of 0.8 but in
#: two of a million cases (77 of 96 do on average, at a similarity of 0.5 it is 48).
AGREE = 58


def similarity(a: bytes, b: bytes, width: int) -> float:
    """Jaccard similarity of the word shingles of two texts."""
    one, two = (set(zip(*(w[i:] for i in range(width)), strict=False)) or {tuple(w)} for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / len(one | two)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles; a text of fewer words is one."""
    found = text.lower().split()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(words) - width + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), SEED)], np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = _mixed(total + words[i : i + n])
    return np.unique(total)


class Bands:
    """For each text ``bands`` hashes of ``rows`` least shingle hashes each."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(SEED)
        self.shape = bands, rows
        self.times = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """The text's rows, and a byte of each least hash."""
        least = np.full(len(self.times), (1 << 64) - 1, np.uint64)
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096, None] * self.times + self.plus
            np.minimum(least, part.min(axis=0), out=least)
        total = np.arange(self.shape[0], dtype=np.uint64)
        for column in least.reshape(self.shape).T:
            total = _mixed(total + column)
        return total, least.astype(np.uint8).tobytes()


def sketches(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    """``doc_id, t, text`` -> ``doc_id, t, fp, n, bands, least``: fingerprint, number of distinct
    shingles of ``width`` words, rows of the index and a byte of each least hash, all from one
    reading of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Bands(BANDS, ROWS)
        for batch in batches:
            fp, n, bands, least = [], [], [], []
            for value in batch.column(2):
                text = value.as_py()
                hashes = shingle_hashes(text, width)
                fp.append(fingerprint(text, shingle))
                n.append(len(hashes))
                rows, small = maker.of(hashes)
                bands.append(rows)
                least.append(small)
            ends = np.arange(len(bands) + 1, dtype=np.int32) * BANDS
            flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            columns = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(least, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "t", "fp", "n", "bands", "least"])

    return map_batches(docs.select("doc_id", "t", F.col("text").cast("binary").alias("text")), work, "doc_id long, t long, fp long, n int, bands array<long>, least binary")


def _crossing(width: int, least: float, agree: int, held: int = 1 << 16, size: int = 1 << 23, made: int = 1 << 17):
    """``h, label, fp, n, least, text`` in order of ``h, label`` -> links between texts of one ``h``
    and different labels.  Two texts whose sizes leave room for the similarity and whose least hashes
    agree well enough are compared by their shingles here, unless the links of this ``h`` join their
    labels already; so a run of one ``h`` gives fewer links than it has labels, never its pairs."""

    def links(h: np.ndarray, label: np.ndarray, fp: np.ndarray, n: np.ndarray, small: np.ndarray, text: pa.Array) -> pa.RecordBatch:
        new = np.flatnonzero((h[1:] != h[:-1]) | (label[1:] != label[:-1])) + 1
        run = np.flatnonzero(h[1:] != h[:-1]) + 1
        every = np.arange(len(h))
        group = np.searchsorted(new, every, "right")
        first = np.append(new, len(h))[group]
        last = np.append(run, len(h))[np.searchsorted(run, every, "right")]
        more = np.cumsum(last - first)
        parent, src, dst = list(range(len(new) + 1)), [], []
        known: dict[int, np.ndarray] = {}
        room = 0

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def hashes(i: int) -> np.ndarray:
            nonlocal room
            if i not in known:
                if room > 1 << 20:
                    known.clear()
                    room = 0
                known[i] = shingle_hashes(text[i].as_py(), width)
                room += len(known[i])
            return known[i]

        def similar(i: int, j: int) -> bool:
            x, y = hashes(i), hashes(j)
            both = np.sort(np.concatenate((x, y)))
            shared = int((both[1:] == both[:-1]).sum())
            return shared >= least * (len(x) + len(y) - shared) - 1e-9 and similarity(text[i].as_py(), text[j].as_py(), width) >= least

        start = 0
        while start < len(h):
            done = more[start - 1] if start else 0
            end = max(int(np.searchsorted(more, done + made, "right")), start + 1)
            count = (last - first)[start:end]
            a = np.repeat(every[start:end], count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[start:end], count)
            keep = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
            a, b = a[keep], b[keep]
            keep = (small[a] == small[b]).sum(axis=1) >= agree
            a, b = a[keep], b[keep]
            for i, j, of, to in zip(a.tolist(), b.tolist(), group[a].tolist(), group[b].tolist(), strict=True):
                x, y = root(of), root(to)
                if x != y and similar(i, j):
                    parent[max(x, y)] = min(x, y)
                    src.append(i)
                    dst.append(j)
            start = end
        return pa.RecordBatch.from_arrays([pa.array(fp[np.array(x, np.int64)]) for x in (src, dst)], ["src", "dst"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = []
        rows = held_size = 0

        def joined() -> list:
            *columns, texts = zip(*parts, strict=True)
            return [*(np.concatenate(c) for c in columns), pa.concat_arrays(texts)]

        for batch in batches:
            if not batch.num_rows:
                continue
            small = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            parts.append([*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]), small, batch.column(5).cast(pa.large_binary())])
            rows += batch.num_rows
            held_size += batch.column(5).nbytes
            if rows < held and held_size < size:
                continue
            columns = joined()
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last run may go on
            if cut:
                yield links(*(c[:cut] for c in columns))
            parts, rows = [[c[cut:] for c in columns]], 0
            held_size = 0
        if parts:
            columns = joined()
            if len(columns[0]):
                yield links(*columns)

    return work


def _confirm(width: int, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [similarity(a.as_py(), b.as_py(), width) >= least for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["src", "dst"])

    return work


def similar_links(docs: DataFrame, found: DataFrame, radius: int, width: int, least: float) -> DataFrame:
    """Links between fingerprints: all within ``radius`` bits (as a forest), and those that the
    similarity of two texts with shingles of ``width`` words, ``least`` or more, asks for.

    ``docs`` are ``t, text``, ``found`` their sketches.  In each row of the index the texts are
    held against the smallest of them first, which makes one group of most copies; then every
    two texts of one row that are still in different groups.
    """
    near = staged(few(links(found.select("fp").distinct(), radius).distinct()), "near")
    # Copies of a text are one entry; texts of one fingerprint are linked anyway.
    single = kept(found.groupBy("t", "fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("least").alias("least")))
    index = single.select("t", "fp", "n", F.explode("bands").alias("h"))
    entry = F.struct("n", "t", "fp")
    heads = index.groupBy("h").agg(F.min(entry).alias("head"), (F.min("fp") != F.max("fp")).alias("several"), F.count(F.lit(1)).alias("m")).where("several")
    shared = staged(_spread(index.join(heads.select("h", "head", "m"), "h")), "shared-rows")
    texts = docs.select("t", F.col("text").cast("binary").alias("text"))

    def wanted(ends: DataFrame) -> DataFrame:
        found = maybe_in(texts, ends, ["t"]).join(ends, "t").groupBy("t").agg(F.first("text").alias("text"))
        return staged(_spread(found), "wanted")

    def confirmed(pairs: DataFrame) -> DataFrame:
        have = wanted(pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct())
        both = pairs.join(have.select(F.col("t").alias("a"), F.col("text").alias("x")), "a").join(have.select(F.col("t").alias("b"), F.col("text").alias("y")), "b")
        return staged(_spread(map_batches(both.select("fa", "fb", "x", "y"), _confirm(width, least), "src long, dst long", 500).distinct()), "confirmed")

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9

    head = F.col("head")
    to_head = shared.where((F.col("fp") != head["fp"]) & fits(F.col("n"), head["n"])).select(
        F.least("t", head["t"]).alias("a"), F.when(F.col("t") < head["t"], F.col("fp")).otherwise(head["fp"]).alias("fa"),
        F.greatest("t", head["t"]).alias("b"), F.when(F.col("t") < head["t"], head["fp"]).otherwise(F.col("fp")).alias("fb"),
    )
    tested = staged(_spread(to_head.distinct()), "first-pairs")
    first = near.unionByName(confirmed(tested))
    label = connected_components(first).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    marked = shared.where("m > 2").join(label, "fp", "left").select("h", F.coalesce("label", "fp").alias("label"), "t", "fp", "n")
    marked = staged(_spread(marked), "marked")
    mixed = marked.groupBy("h").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("h")
    open_ = marked.join(mixed, "h", "left_semi").join(single.select("t", "fp", "least"), ["t", "fp"])
    open_ = open_.join(wanted(open_.select("t").distinct()), "t")
    runs = open_.select("h", "label", "fp", "n", "least", "text").repartition("h").sortWithinPartitions("h", "label")
    rest = map_batches(runs, _crossing(width, least, AGREE), "src long, dst long", 10_000).distinct()
    return first.unionByName(staged(_spread(rest), "crossing"))


def _spread(df: DataFrame) -> DataFrame:
    """A table that is small against what it was made from, dealt out anew."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, width: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """One row of each group of near duplicates with all its columns: the one with the smallest
    id (null comes last), of rows with that id one of them.

    Two texts are near duplicates within ``radius`` bits, or if their shingles of ``width``
    words have a similarity of ``least`` or more.  Rows are named by id and a hash of the text,
    so nothing depends on the order of the input.
    """
    frame = Frame(documents)
    text = F.coalesce(frame.col("text"), F.lit(""))
    table = frame.df.withColumn("doc_id", frame.col("doc_id").cast("long")).withColumn("t", F.xxhash64(text))
    docs = table.select("doc_id", "t", text.alias("text"))
    found = kept(sketches(docs, shingle, width))
    joined = connected_components(similar_links(docs.select("t", "text"), found, radius, width, least))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    per_code = found.groupBy("fp").agg(F.min(place).alias("place"), F.max(place).alias("most"), F.count(F.lit(1)).alias("m"))
    label = per_code.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    label = staged(_spread(label.select("fp", "label", "place", "m")), "codes")
    stay = label.groupBy("label").agg(F.min("place").alias("stay"), F.sum("m").alias("m")).where("m > 1")
    chosen = label.join(stay.select("label", "stay"), "label").select("fp", "stay")
    key = ["doc_id", "t"]
    several = found.select("fp", *key).join(staged(_spread(chosen), "chosen"), "fp")
    # Each id and text in a group of several rows: does it go, and are there more rows like it?
    same = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("t") == F.col("stay.t"))
    marks = staged(_spread(several.groupBy(*key).agg(F.min(~same).alias("goes"), F.count(F.lit(1)).alias("m")).where("goes or m > 1")), "marks")
    other = not_in(table, marks, key)
    held = maybe_in(table, marks, key).alias("x").join(marks.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.t") == F.col("y.t")), "left")
    held = held.where("goes is null or not goes").select("x.*", "m")
    names = frame.df.columns
    one = held.where("m > 1").groupBy(*key).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
    return frame.restore(other.select(*names).unionByName(held.where("m is null or m = 1").select(*names)).unionByName(one))
