"""Class-based n-gram language model (Brown et al. 1992) with distributed exchange clustering.

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(token | class)

Counts come from all training texts, and every training word gets its class by exchange:

1.  Units - each of the ``HEAD`` most frequent words, and the others by their last letters
    (``TAILS`` units) - give a first clustering: bigrams of units are counted over the whole
    corpus and the exchange algorithm moves units between ``CLASSES`` classes while that raises
    the likelihood of all bigrams.
2.  Every other word leaves its unit (Uszkoreit and Brants 2008): one reading of the corpus gives
    each word the counts of the classes before and after it, summed by word; where they are
    summed, the word moves to the class that raises the likelihood most, by the matrix of class
    bigrams that all tasks share.

Transitions are smoothed by ``LAMBDA``, emissions by one count for each word and one for all
unseen words of a class, so both are proper distributions; an unseen word has the class of its
unit.

What is broadcast or sent to the driver has a fixed bound: unit bigrams (at most units^2), class
bigrams, and the ``KNOWN`` most frequent words with their counts and classes.  Counts and classes
of all other words are joined to the texts that use them, by a 64-bit hash of the word.

Defined results: a null text is empty and has one token, its end; a null id counts as the
empty text for the split; repeated rows are scored, and counted in training, one by one; with
no training text every token is unseen.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frame import Frame, local, map_batches
from tessera.plans.scratch import kept, staged

HEAD, TAILS, CLASSES = 1000, 128, 48
KNOWN = 200_000
#: Bytes from which on a word is looked up by its hash only.
LONGEST = 64
LAMBDA = 0.5
ROUNDS = 6
#: The token at the end of each text; no word is empty.
END = b""
#: Words a worker counts before it hands its counts on, and events it sums up at once.
COUNTED, EVENTS = 1 << 20, 1 << 21
#: Words that a worker numbers before it begins anew.
NUMBERED = 1 << 18
#: Seed of Spark's own 64-bit hash, so both sides name a word alike.
SEED = 42


def wid(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word, SEED)
    return value - (1 << 64) if value >> 63 else value


def tail_of(word: bytes, tails: int = TAILS) -> int:
    return zlib.crc32(word[-2:]) % tails


def tail_column(word: Column, tails: int = TAILS) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % tails).cast("int")


class Units(dict):
    """Word -> unit; remembers the units of other words up to a bound."""

    def __init__(self, head: list[bytes], tails: int) -> None:
        super().__init__({w: i for i, w in enumerate(head)})
        self.head, self.tails, self.size = len(head), tails, len(head) + tails

    def __missing__(self, word: bytes) -> int:
        unit = self.head + tail_of(word, self.tails)
        if len(self) < 1 << 19 and len(word) <= LONGEST:
            self[word] = unit
        return unit


class Numbers(dict):
    """Word -> a number of its own, in order of first use; ``words`` has them by number."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


# -- counts -------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            counts.update(value.as_py().lower().split())
        counts[END] += batch.num_rows
        if len(counts) > COUNTED:
            yield out(counts)
            counts = Counter()
    if counts:
        yield out(counts)


def _count_bigrams(head: list[bytes], tails: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(head, tails)
        size = units.size
        end = units[END]
        total: np.ndarray | None = None
        for batch in batches:
            seen = array("i", [end])
            for value in batch.column(0):
                seen.extend(map(units.__getitem__, value.as_py().lower().split()))
                seen.append(end)
            ids = np.frombuffer(seen, np.int32).astype(np.int64)
            codes = ids[:-1] * size + ids[1:]
            if total is None:
                total = np.zeros(size * size, np.int64)
            found, n = np.unique(codes, return_counts=True)
            total[found] += n
        if total is not None:
            at = np.flatnonzero(total)
            for s in range(0, len(at), 1 << 18):
                part = at[s : s + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["pair", "n"])

    return work


# -- classes -------------------------------------------------------------------------------


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1.0))


def exchange(bigrams: np.ndarray, classes: int, fixed: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of units from a matrix of their bigrams, by the exchange algorithm.

    Units start in turn by frequency.  A unit moves to the class that raises
    sum N(g,h) log N(g,h) - sum N(g) log N(g) (left) - the same (right) most, until a round
    moves none or ``rounds`` are over.  Unit ``fixed`` keeps class 0 to itself.
    """
    size = len(bigrams)
    counts = bigrams.astype(float)
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = [int(u) for u in np.argsort(-weight, kind="stable") if u != fixed]
    first = 0 if fixed is None else 1
    free = max(classes - first, 1)
    cls = np.zeros(size, np.int64)
    for i, u in enumerate(order):
        cls[u] = first + i % free
    member = np.zeros((size, classes))
    member[np.arange(size), cls] = 1
    n = member.T @ counts @ member
    to = counts @ member  # unit -> class
    fro = counts.T @ member  # class -> unit
    for _ in range(rounds):
        moved = 0
        for u in order:
            a, self_ = cls[u], counts[u, u]
            if weight[u] == 0:
                continue
            out, into = to[u].copy(), fro[u].copy()
            out[a] -= self_
            into[a] -= self_
            # The matrix without u.
            n[a, :] -= out
            n[:, a] -= into
            n[a, a] -= self_
            left, right = n.sum(axis=1), n.sum(axis=0)
            gain = np.zeros(classes)
            rows = _xlogx(n + out[None, :]) - _xlogx(n)
            columns = _xlogx(n + into[None, :].T @ np.ones((1, classes))) - _xlogx(n)
            gain += rows.sum(axis=1) + columns.sum(axis=0)
            at = np.arange(classes)
            d = n[at, at]
            gain += _xlogx(d + out + into + self_) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
            gain -= _xlogx(left + out.sum() + self_) - _xlogx(left)
            gain -= _xlogx(right + into.sum() + self_) - _xlogx(right)
            if fixed is not None:
                gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b, :] += out
            n[:, b] += into
            n[b, b] += self_
            if b != a:
                moved += 1
                cls[u] = b
                to[:, a] -= counts[:, u]
                to[:, b] += counts[:, u]
                fro[:, a] -= counts[u, :]
                fro[:, b] += counts[u, :]
        if not moved:
            break
    return cls


# -- every word in the exchange ------------------------------------------------------------


class Seeds:
    """The classes of units, as each worker uses them."""

    def __init__(self, units: list[bytes], tails: int, cls: np.ndarray) -> None:
        self.head = {w: int(cls[i]) for i, w in enumerate(units)}
        self.of_tail, self.tails = [int(c) for c in cls[len(units) :]], tails

    def __call__(self, word: bytes) -> int:
        found = self.head.get(word)
        return self.of_tail[tail_of(word, self.tails)] if found is None else found


def _neighbours(shared, classes: int):
    """Training texts -> ``wid, cls, events``: for each word that is no unit of its own its class so
    far and, as ``code << 24 | n``, how often a class is before (code) or after it (classes + code)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        codes = 2 * classes
        numbers, cls, free, made, size = Numbers(), [], [], [], 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(made), return_counts=True)
            word, code = found // codes, found % codes
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
            mine = [numbers.words[i] for i in word[starts].tolist()]
            ends = np.concatenate((starts, [len(word)])).astype(np.int32)
            events = pa.ListArray.from_arrays(ends, pa.array((code << 24 | np.minimum(n, (1 << 24) - 1)).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array([wid(w) for w in mine], pa.int64()), pa.array([cls[i] for i in word[starts].tolist()], pa.int32()), events], ["wid", "cls", "events"])

        for batch in batches:
            seen = [numbers[END]]
            for value in batch.column(0):
                seen.extend(map(numbers.__getitem__, value.as_py().lower().split()))
                seen.append(numbers[END])
            for w in numbers.words[len(cls) :]:
                cls.append(seeds(w))
                free.append(w not in seeds.head)
            # Half the memory where that holds the numbers.
            kind = np.int32 if len(cls) * codes < 1 << 31 else np.int64
            ids = np.array(seen, kind)
            of, moves = np.array(cls, kind)[ids], np.array(free)[ids]
            before, after = ids[1:] * codes + of[:-1], ids[:-1] * codes + classes + of[1:]
            made += [before[moves[1:]], after[moves[:-1]]]
            size += len(made[-1]) + len(made[-2])
            if size > EVENTS or len(cls) > NUMBERED:
                yield out()
                numbers, cls, free, made, size = Numbers(), [], [], [], 0
        if made:
            yield out()

    return work


class Gains:
    """What a word's move to each class adds to the likelihood, by the class bigrams ``n``."""

    def __init__(self, n: np.ndarray, small: int = 32) -> None:
        self.c = len(n)
        # By code: what is before the word (columns of n are its class), then what is after it.
        self.cells = np.concatenate((n, n.T)).astype(float)
        self.total = np.stack((n.sum(axis=0), n.sum(axis=1))).astype(float)
        counts = np.arange(small + 1, dtype=float)[:, None, None]
        self.plus = _xlogx(self.cells + counts) - _xlogx(self.cells)
        self.small = small

    def best(self, word: np.ndarray, code: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Words' best classes, from their events in order of ``word`` (numbers from 0)."""
        gain = np.zeros((len(cls), self.c))
        for at in range(0, len(word), 1 << 15):
            w, k, m = word[at : at + (1 << 15)], code[at : at + (1 << 15)], n[at : at + (1 << 15)]
            part = self.plus[np.minimum(m, self.small), k]
            many = np.flatnonzero(m > self.small)
            if len(many):
                cell = self.cells[k[many]]
                part[many] = _xlogx(cell + m[many, None]) - _xlogx(cell)
            # In its own class the word is counted already.
            own = self.cells[k, cls[w]]
            part[np.arange(len(w)), cls[w]] = _xlogx(own) - _xlogx(np.maximum(own - m, 0))
            starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            gain[w[starts]] += np.add.reduceat(part, starts, axis=0)
        every = np.arange(len(cls))
        for side in (0, 1):
            mine = np.bincount(word, weights=n * (code // self.c == side), minlength=len(cls))
            total = self.total[side]
            gain -= _xlogx(total + mine[:, None]) - _xlogx(total)
            own = total[cls]
            gain[every, cls] += _xlogx(own + mine) - 2 * _xlogx(own) + _xlogx(np.maximum(own - mine, 0))
        gain[:, 0] = -np.inf  # the end's own
        best = gain.argmax(axis=1)
        return np.where(gain[every, best] > gain[every, cls] + 1e-9, best, cls)


def _move(shared):
    """``wid, cls, events`` in order of ``wid`` -> ``wid, cls`` after the move."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains: Gains = shared.value

        def moved(ids: np.ndarray, cls: np.ndarray, lengths: np.ndarray, events: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            number = np.repeat(np.cumsum(np.concatenate(([True], ids[1:] != ids[:-1]))) - 1, lengths)
            codes = 2 * gains.c
            key, which = np.unique(number * codes + (events >> 24), return_inverse=True)
            n = np.bincount(which, weights=events & ((1 << 24) - 1)).astype(np.int64)
            best = gains.best(key // codes, key % codes, n, cls[starts].astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(best.astype(np.int32))], ["wid", "cls"])

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            lists = batch.column(2)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()))
            rows += batch.num_rows
            if rows < 1 << 15:
                continue
            ids, cls, lengths, events = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(ids, ids[-1]))  # the last word may go on
            if cut:
                done = int(lengths[:cut].sum())
                yield moved(ids[:cut], cls[:cut], lengths[:cut], events[:done])
                ids, cls, lengths, events = ids[cut:], cls[cut:], lengths[cut:], events[done:]
            held, rows = [(ids, cls, lengths, events)], 0
        if held and len(held[0][0]) + rows:
            yield moved(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


def likelihood(n: np.ndarray) -> float:
    """What exchange raises: the log likelihood of the class bigrams but for a constant."""
    n = n.astype(float)
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=0)).sum() - _xlogx(n.sum(axis=1)).sum())


# -- training -------------------------------------------------------------------------------


@dataclass
class Model:
    """All a worker needs to read texts but the counts and classes of rare words."""

    seeds: Seeds
    classes: int
    #: The most frequent words (long ones by hash) with their counts and classes.
    known: dict[bytes | int, tuple[int, int]]
    train_tokens: int
    vocabulary: int


@dataclass
class Trained:
    model: Model
    #: ``wid, c, cls`` of every training word.
    words: DataFrame
    #: Words and tokens of each class.
    types: np.ndarray
    tokens: np.ndarray
    #: The likelihood of class bigrams with the units' classes.
    before: float = field(default=0.0)


def most_frequent(words: DataFrame, known: int, columns: list[str]) -> list:
    """The most frequent words, most frequent first, at most ``known`` rows.

    Words are counted by steps of their logarithm (some thousand); the lowest step that still
    fits gives the bound, so no more rows than asked for reach the driver.
    """
    stepped = words.withColumn("step", F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int"))
    bound, total = None, 0
    for row in stepped.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        total += row["n"]
        if total > known:
            break
        bound = row["step"]
    if bound is None:
        return []
    return sorted(stepped.where(F.col("step") >= bound).select(*columns).collect(), key=lambda r: (-r["c"], r["wid"]))


def train(texts: DataFrame, head: int = HEAD, tails: int = TAILS, classes: int = CLASSES, known: int = KNOWN, rounds: int = ROUNDS) -> Trained:
    """A model of a table with one binary column ``text``."""
    context = texts.sparkSession.sparkContext
    counted = map_batches(texts, _count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    short = F.when(F.length("word") <= LONGEST, F.col("word")).alias("word")
    counts = kept(counted.select(F.xxhash64("word").alias("wid"), short, tail_column(F.col("word"), tails).alias("tail"), (F.length("word") == 0).alias("end"), "c"))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent = most_frequent(counts.where(~F.col("end") & F.col("word").isNotNull()), head, ["wid", "word", "c"])
    units = [END, *(bytes(r["word"]) for r in frequent)]
    u = len(units) + tails
    pairs = map_batches(texts, _count_bigrams(units, tails), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(u * u, np.int64)
    bigrams[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    bigrams = bigrams.reshape(u, u)
    cls = exchange(bigrams, classes, fixed=0, rounds=rounds)
    member = np.zeros((u, classes))
    member[np.arange(u), cls] = 1
    n = member.T @ bigrams @ member
    seeds = Seeds(units, tails, cls)
    near = map_batches(texts, _neighbours(context.broadcast(seeds), classes), "wid long, cls int, events array<int>")
    dealt = near.repartition("wid").sortWithinPartitions("wid")
    moved = map_batches(dealt, _move(context.broadcast(Gains(n))), "wid long, cls int", 1 << 15)
    of_units = local(texts.sparkSession, [(wid(w), int(c)) for w, c in seeds.head.items()], "wid long, cls int")
    words = kept(counts.select("wid", "word", "c", "end").join(moved.unionByName(of_units), "wid"))
    per_class = words.groupBy("cls").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("tokens")).collect()
    types, tokens = np.zeros(classes), np.zeros(classes)
    for r in per_class:
        types[r["cls"]], tokens[r["cls"]] = r["types"], r["tokens"]
    top = most_frequent(words.where(~F.col("end")), known, ["wid", "word", "c", "cls"])
    lookup = {(r["wid"] if r["word"] is None else bytes(r["word"])): (r["c"], r["cls"]) for r in top}
    ends = counts.where("end").select("c").first()
    if ends:
        lookup[END] = (ends["c"], 0)
    return Trained(Model(seeds, classes, lookup, size["n"], size["v"]), words.select("wid", "c", "cls"), types, tokens, likelihood(n))


# -- scores -------------------------------------------------------------------------------


def _read(shared):
    """Texts as class bigrams (``pair, n``) as far as the worker knows the words, and the places of
    the others: ``rare`` are their hashes, ``often`` their counts, ``unseen`` the class each has if it
    is no training word; ``left, right`` are the bigrams with a rare word, as class or classes + number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        c = m.classes
        numbers, logs, cls, ids_of, other = Numbers(), [], [], [], []

        def learn() -> None:
            for w in numbers.words[len(cls) :]:
                key = w if len(w) <= LONGEST else wid(w)
                found = m.known.get(key)
                cls.append(-1 if found is None else found[1])
                logs.append(0.0 if found is None else float(np.log10(found[0] + 1.0)))
                ids_of.append(wid(w) if found is None else 0)
                other.append(m.seeds(w))

        end = 0
        for batch in batches:
            if len(numbers) > NUMBERED:
                numbers, logs, cls, ids_of, other = Numbers(), [], [], [], []
            texts = [np.fromiter(map(numbers.__getitem__, [*value.as_py().lower().split(), END]), np.int64) for value in batch.column(3)]
            learn()
            of, log = np.array(cls, np.int64), np.array(logs)
            out: list[list] = [[] for _ in range(10)]
            for ids in texts:
                mine = of[ids]
                rare = np.flatnonzero(mine < 0)
                which, often = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(rare):
                    which, place, often = np.unique(ids[rare], return_inverse=True, return_counts=True)
                    mine[rare] = c + place
                before = np.concatenate(([end], mine[:-1]))
                far = (before >= c) | (mine >= c)
                pair, n = np.unique((before * c + mine)[~far], return_counts=True)
                found = (len(ids), len(ids) - len(rare), float(log[ids].sum()), pair, n, before[far], mine[far], [ids_of[i] for i in which.tolist()], often, [other[i] for i in which.tolist()])
                for column, value in zip(out, found, strict=True):
                    column.append(value)

            def lists(values: list, kind: type) -> pa.Array:
                ends = np.concatenate(([0], np.cumsum(list(map(len, values))))).astype(np.int32)
                return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(v, kind) for v in values]) if values else np.zeros(0, kind)))

            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), *(lists(x, np.int64 if i == 4 else np.int32) for i, x in enumerate(out[3:]))],
                ["rid", "doc_id", "train", "n_tokens", "seen", "logs", "pair", "n", "left", "right", "rare", "often", "unseen"],
            )

    return work


def _resolve(classes: int):
    """Adds the bigrams of rare words to ``pair, n``, with the classes of those that are training
    words (``place, cls``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, counts = [], []
            for pair, n, left, right, unseen, place, cls in zip(*(batch.column(i) for i in range(6, 13)), strict=True):
                pair, n = pair.values.to_numpy().astype(np.int64), n.values.to_numpy()
                of = np.concatenate((np.arange(classes), unseen.values.to_numpy())).astype(np.int64)
                if place.is_valid:
                    of[classes + place.values.to_numpy()] = cls.values.to_numpy()
                more = of[left.values.to_numpy()] * classes + of[right.values.to_numpy()]
                pairs.append(np.concatenate((pair, more)).astype(np.int32))
                counts.append(np.concatenate((n, np.ones(len(more), np.int64))).astype(np.int32))
            ends = np.concatenate(([0], np.cumsum(list(map(len, pairs))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (pairs, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *lists], ["doc_id", "train", "n_tokens", "known", "logs", "rid", "pair", "n"])

    return work


def _transitions(classes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), weights=batch.column(1).flatten().to_numpy(), minlength=classes * classes).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    return work


def _steps(step: np.ndarray):
    flat = step.ravel()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float((flat[p.values.to_numpy()] * n.values.to_numpy()).sum()) for p, n in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.float64())], ["doc_id", "n_tokens", "known", "logs", "steps"])

    return work


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def steps_of(n: np.ndarray, types: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) - log10(denominator of the class's emissions): what a token
    adds besides log10(count + 1)."""
    transition = np.log10((n + LAMBDA) / (n.sum(axis=1, keepdims=True) + LAMBDA * len(n)))
    return transition - np.log10(tokens + types + 1)[None, :]


def read_texts(docs: DataFrame, trained: Trained) -> DataFrame:
    """``doc_id, train, text`` -> ``doc_id, train, n_tokens, known, logs, rid, pair, n``: each text's
    class bigrams and, of its known tokens, the number and the sum of log10(count + 1)."""
    m = trained.model
    shared = docs.sparkSession.sparkContext.broadcast(m)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "train", "text")
    lists = "pair array<int>, n array<int>, left array<int>, right array<int>, rare array<long>, often array<int>, unseen array<int>"
    schema = f"rid long, doc_id long, train boolean, n_tokens long, seen long, logs double, {lists}"
    # Written with its row numbers, so that nothing numbers the rows again.
    read = staged(map_batches(rows, _read(shared), schema), "read")
    rare = read.select("rid", F.posexplode(F.arrays_zip("rare", "often")).alias("place", "r")).select("rid", "place", F.col("r.rare").alias("wid"), F.col("r.often").alias("often"))
    more = (
        rare.join(trained.words, "wid")
        .groupBy("rid")
        .agg(F.collect_list(F.struct("place", "cls")).alias("found"), F.sum("often").alias("more"), F.sum(F.col("often") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs"))
    )
    whole = read.join(more, "rid", "left").select(
        "doc_id", "train", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).cast("long").alias("known"), (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("logs"),
        "rid", "pair", "n", "left", "right", "unseen", F.col("found.place").alias("place"), F.col("found.cls").alias("cls"),
    )
    return staged(map_batches(whole, _resolve(m.classes), "doc_id long, train boolean, n_tokens long, known long, logs double, rid long, pair array<int>, n array<int>"), "class-bigrams")


def class_bigrams(read: DataFrame, classes: int) -> np.ndarray:
    """The matrix of class bigrams of the training texts."""
    sums = map_batches(read.where("train").select("pair", "n"), _transitions(classes), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(classes * classes)
    n[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return n.reshape(classes, classes)


def scored(documents: DataFrame, head: int = HEAD, tails: int = TAILS, classes: int = CLASSES, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """Trains on all rows that are not held out and scores every row."""
    frame = Frame(documents)
    docs = frame.df.select(
        frame.col("doc_id").cast("long").alias("doc_id"), F.coalesce(frame.col("text"), F.lit("")).cast("binary").alias("text")
    ).withColumn("train", ~held_out(F.col("doc_id")))
    trained = train(docs.where("train").select("text"), head, tails, classes, known, rounds)
    m = trained.model
    read = read_texts(docs, trained)
    step = steps_of(class_bigrams(read, classes), trained.types, trained.tokens)
    each = float(np.log10(float(m.train_tokens + m.vocabulary + 1)))
    found = map_batches(read.select("doc_id", "n_tokens", "known", "logs", "pair", "n"), _steps(step), "doc_id long, n_tokens long, known long, logs double, steps double")
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(m.train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("logs") + F.col("steps")).alias("score"),
    )
