"""Line dedup by a segment-partition edit join (Pass-Join, Li et al. 2011).

A line stays where it occurs first.  Lines are the same if they are equal or linked by edit
distance: two lines of at least 2 (``threshold`` + 1) characters, the least that can be split,
are linked at ``threshold`` edits or fewer, and links join up to classes.

Equal lines become one row first.  Each distinct line is split into ``threshold`` + 1
segments, which are indexed by (length of the line, number of the segment, segment); each line
probes the indexes of all lengths it can be linked to with the few substrings that can match
by position.  One segment of a pair is untouched by ``threshold`` edits, so no link is lost.
Candidates lose their common ends and are verified by bit-parallel edit distance in the band
of ``threshold`` diagonals.

Where more than ``hot`` lines share a segment no pairs are listed.  The segment is cut out of
them and the rest is split and probed again within the group: the same two bounds hold for what
is left, so large groups fall apart by their own differences.  At one edit this goes on until
at most ``REST`` characters are left; lines that then agree in all but one place are one row
each of a group whose members are all linked, and a line and the line with one character more
meet under what is left without that character.  Every substitution is found in one group or
one pair only, so links are counted by group sizes.  At more than one edit groups are split
``depth`` times and what is still crowded then is listed as pairs.

Everything is DataFrame functions.  Shuffles carry digests and places, texts only where lines
are made distinct, where candidates are verified and where texts lose lines.

Defined results: a null text has no lines; a line without a word is neither removed nor a
duplicate; a null id comes after all others; rows equal in id and text are one document, and
get the same result; texts of the same id count as one place, in which a line stays once in
each text; an empty table gives an empty result.  Lines are told apart by 128-bit digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frame import WHITE, Frame, let
from tessera.operators.components import connected_components
from tessera.plans.prune import maybe_in, not_in
from tessera.plans.scratch import few, kept, new_path, staged

THRESHOLD = 1
#: Lines of one segment from which on its group is split again.
HOT = 32
#: Times a group is split at most if there is more than one edit.
DEPTH = 4
#: At one edit, characters of a line, and of what is left of one in a crowded group, whose
#: variants are listed instead of its segments.
SHORT, REST = 16, 64
LAST = (1 << 63) - 1


# -- edit distance ----------------------------------------------------------------------------


def _common(a: Column, b: Column, limit: int = 1 << 30) -> Column:
    """Length of the common prefix, by binary steps."""
    steps = [1 << k for k in range(limit.bit_length() - 1, -1, -1)]

    def search(most: Column) -> Column:
        def step(at: Column, n: Column) -> Column:
            same = (at + n <= most) & (F.substring(a, at + 1, n) == F.substring(b, at + 1, n))
            return F.when(same, at + n).otherwise(at)

        return F.aggregate(F.filter(F.array(*map(F.lit, steps)), lambda n: n <= most), F.lit(0), step)

    return let(F.least(F.length(a), F.length(b)), search)


def banded(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two arrays of characters if at most ``threshold``, else more than it.

    Hyyro's bit-parallel recurrence over the band: bit w-1 of a word of w bits stands for row
    i + threshold of column i, and the word moves down one row with each column.
    """
    w = 2 * threshold + 2
    every, top = (1 << w) - 1, 1 << (w - 1)

    def match(i: Column, c: Column) -> Column:
        bits = F.lit(0).cast("long")
        for d in range(-threshold, threshold + 1):
            hit = F.coalesce(F.get(a, i + d) == c, F.lit(False)) & (i + d >= 0)
            bits = bits + F.when(hit, F.lit(1 << (w - 1 - threshold + d)).cast("long")).otherwise(F.lit(0).cast("long"))
        return bits

    def inverse(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(every).cast("long"))

    def both(x: Column, y: Column) -> Column:
        return x.bitwiseAND(y)

    def column(s: Column, x: Column) -> Column:
        i, vp, vn = x["i"], s["vp"], s["vn"]
        hit = match(i, x["c"])

        def of_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(inverse(d0.bitwiseOR(vp)))
            hn = both(d0, vp)
            down = F.shiftright(d0, 1)
            row = F.size(a) - 1 - i - threshold  # < 0: the band has passed the last row
            flag = F.lit(1 << (w - 1)).cast("long")
            side = F.when(row >= 0, flag).otherwise(F.element_at(F.array(*(F.lit(top >> k).cast("long") for k in range(w))), F.least(-row, F.lit(w - 1)) + 1))
            change = F.when(row >= 0, F.when(both(d0, flag) == 0, 1).otherwise(0)).otherwise(
                F.when(both(hp, side) != 0, 1).otherwise(0) - F.when(both(hn, side) != 0, 1).otherwise(0)
            )
            return F.struct(
                both(hn.bitwiseOR(inverse(down.bitwiseOR(hp))), F.lit(every).cast("long")).alias("vp"),
                both(down, hp).alias("vn"),
                (s["d"] + change).alias("d"),
            )

        d0 = both(both(hit, vp) + vp, F.lit(every).cast("long")).bitwiseXOR(vp).bitwiseOR(hit).bitwiseOR(vn)
        return let(d0, of_d0)

    # At the start rows below the first are one apart; rows above it are outside.
    start = F.struct(
        F.lit(every & ~((1 << (w - threshold - 1)) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(threshold), F.size(a)).alias("d")
    )
    columns = F.transform(b, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    run = F.aggregate(columns, start, column, lambda s: s["d"])
    far = F.abs(F.size(a) - F.size(b)) > threshold
    return F.when(far, F.lit(threshold + 1)).when(F.size(b) == 0, F.size(a)).when(F.size(a) == 0, F.size(b)).otherwise(run)


def distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two texts if at most ``threshold``, else more than it: common ends are
    cut off, what is between them is compared in the band."""

    def chars(x: Column) -> Column:
        return F.filter(F.split(x, ""), lambda c: c != "")

    def cut(x: Column, y: Column) -> Column:
        def tails(p: Column) -> Column:
            return F.struct(F.substring(x, p + 1, F.length(x)).alias("x"), F.substring(y, p + 1, F.length(y)).alias("y"))

        def heads(t: Column) -> Column:
            def core(n: Column) -> Column:
                return F.struct(F.substring(t["x"], F.lit(1), F.length(t["x"]) - n).alias("x"), F.substring(t["y"], F.lit(1), F.length(t["y"]) - n).alias("y"))

            return let(_common(F.reverse(t["x"]), F.reverse(t["y"])), core)

        return let(let(_common(x, y), tails), heads)

    def verify(t: Column) -> Column:
        longest = F.greatest(F.length(t["x"]), F.length(t["y"]))
        run = let(chars(t["x"]), lambda x: let(chars(t["y"]), lambda y: banded(x, y, threshold)))
        # Both cores begin and end with a difference: at one edit they are a character long.
        return F.when(longest > 8, F.lit(2)).otherwise(run) if threshold == 1 else run

    return let(cut(a, b), verify)


# -- candidates -------------------------------------------------------------------------------


def _measured(rows: DataFrame, threshold: int) -> DataFrame:
    """Adds the length of each line and, for each length it is held against, what the even
    partition of that length needs; as columns, so that they are computed once."""
    n = threshold + 1
    rows = rows.select("id", "s", "group", F.length("s").alias("len"))
    short = [F.expr(f"cast((len - {d}) div {n} as int)").alias(f"q{d}") for d in range(n)]
    return rows.select("*", *short)


def _segment(shorter: int, i: int, threshold: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` of a line that is ``shorter`` than this one:
    all are equally long but the last ones, which are longer by one."""
    n = threshold + 1
    short = F.col(f"q{shorter}")
    longer = F.col("len") - shorter - short * n
    start = F.lit(i) * short + F.greatest(F.lit(0), F.lit(i - n) + longer) + 1
    return start.cast("int"), (short + F.when(F.lit(i) >= n - longer, 1).otherwise(0)).cast("int")


def _entries(rows: DataFrame, threshold: int, places: list[tuple[int, int, int]]) -> DataFrame:
    """``key, id, group, len, start, n`` of the substrings at ``places``: how much shorter the
    other line is, the segment, and how far from its place in the other line."""
    values: list[Column] = []
    for shorter, i, off in places:
        start, n = _segment(shorter, i, threshold)
        at = start + off
        key = F.xxhash64("group", F.col("len") - shorter, F.lit(i), F.substring(F.col("s"), at, n))
        fits = (at >= 1) & (at + n <= F.col("len") + 1)
        values += [F.when(fits, key) if off else key, at.cast("int"), n]
    found = _measured(rows, threshold).select("id", "group", "len", F.stack(F.lit(len(places)), *values).alias("key", "start", "n"))
    return found.where("key is not null").select("key", "id", "group", "len", "start", "n")


def indexed(rows: DataFrame, threshold: int) -> DataFrame:
    """All segments of ``id, s, group``."""
    return _entries(rows, threshold, [(0, i, 0) for i in range(threshold + 1)])


def probing(rows: DataFrame, threshold: int) -> DataFrame:
    """The substrings that have to be looked up, by the multi-match-aware rule, but for the
    segments themselves, which are in the index."""
    places = [
        (shorter, i, off)
        for shorter in range(threshold + 1)
        for i in range(threshold + 1)
        for off in range(max(-i, shorter - (threshold - i)), min(i, shorter + threshold - i) + 1)
        if shorter or off
    ]
    return _entries(rows, threshold, places)


def _met(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Pairs of lines that meet under a key; of two lines of one length only one order."""
    a = index.select("key", F.col("id").alias("a"), F.col("len").alias("la"))
    same = a.join(index.select("key", F.col("id").alias("b")), "key").where("b > a").select("a", "b")
    b = probe.select("key", F.col("id").alias("b"), F.col("len").alias("lb"))
    other = a.join(b, "key").where((F.col("lb") > F.col("la")) | (F.col("b") > F.col("a"))).select("a", "b")
    return same.unionByName(other)


def _without(s: Column, at: Column) -> Column:
    """A text without its character at ``at`` (from 1)."""
    return F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s)))


def _variants(lines: DataFrame, longer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One edit between short rests ``id, s, group``: groups ``g, id`` of two or more lines that
    agree in all but one place, and pairs ``a, b`` of ``lines`` and ``longer``."""
    at = F.explode(F.sequence(F.lit(1), F.length("s"))).alias("at")
    masked = lines.select("id", "group", "s", at).select(F.xxhash64("group", "at", _without(F.col("s"), F.col("at")), F.length("s")).alias("g"), "id")
    shared = masked.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g")
    groups = masked.join(shared, "g", "left_semi")
    less = longer.select("id", "group", "s", at).select(F.xxhash64("group", _without(F.col("s"), F.col("at"))).alias("key"), F.col("id").alias("b")).distinct()
    pairs = lines.select(F.xxhash64("group", "s").alias("key"), F.col("id").alias("a")).join(less, "key").select("a", "b")
    return groups, pairs


def _spread(df: DataFrame) -> DataFrame:
    """A table that is small against what it was made from, dealt out anew: what made it keeps
    all its tasks."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def _plus(one: DataFrame | None, other: DataFrame) -> DataFrame:
    return other if one is None else one.unionByName(other)


def candidates(lines: DataFrame, threshold: int, hot: int = HOT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a, b`` of ids of ``id, s`` that may be linked; pairs may repeat.  Of one edit also
    ``g, id``: groups in which every two lines differ in one place, none of them in the pairs."""
    level = lines.select("id", "s", F.lit(0).cast("long").alias("group"))
    as_index, as_probe = level, level
    pairs, lines_left, longer_left = None, None, None
    step = 0
    while True:
        if threshold == 1:
            # A longer line belongs to the lengths of its partners, one less.
            short = REST if step else SHORT
            lines_left = _plus(lines_left, as_index.where(F.length("s") <= short))
            longer_left = _plus(longer_left, as_probe.where(F.length("s") <= short + 1))
            as_index, as_probe = as_index.where(F.length("s") > short), as_probe.where(F.length("s") > short + 1)
        index, probe = indexed(as_index, threshold), probing(as_probe, threshold)
        crowded = None
        if threshold == 1 or step < depth:
            crowded = staged(few(index.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("key")), "crowded")
            if crowded.isEmpty():
                crowded = None
        if crowded is None:
            pairs = _plus(pairs, _met(index, probe))
            break
        # All of a level is written, so that no plan holds those of the levels before it.
        calm = _met(index.join(crowded, "key", "left_anti"), probe.join(crowded, "key", "left_anti"))
        pairs = _plus(pairs, staged(_spread(calm.distinct()), "pairs"))

        def rest(entries: DataFrame, source: DataFrame, crowded: DataFrame = crowded, step: int = step) -> DataFrame:
            """The lines of crowded keys without the segment they share."""
            hit = staged(few(entries.join(crowded, "key", "left_semi")), "crowded-entries")
            joined = (source if step else maybe_in(source, hit, ["id", "group"])).join(hit, ["id", "group"])
            cut = F.concat(F.substring(F.col("s"), F.lit(1), F.col("start") - 1), F.substring(F.col("s"), F.col("start") + F.col("n"), F.length("s")))
            return staged(few(joined.select("id", cut.alias("s"), F.col("key").alias("group")).distinct()), "crowded-rests")

        as_index, as_probe = rest(index, as_index), rest(probe if threshold == 1 else probe.unionByName(index), as_probe)
        step += 1
    if threshold > 1:
        return pairs, None
    groups, more = _variants(lines_left, longer_left)
    return pairs.unionByName(more), staged(_spread(groups), "line-groups")


# -- lines and classes --------------------------------------------------------------------------


def _digests(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def _worded(line: Column) -> Column:
    # Trimming on the left is enough to tell, and stops at the first character of a word.
    return F.ltrim(line, F.lit(WHITE)) != ""


def links(lines: DataFrame, threshold: int = THRESHOLD, hot: int = HOT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """Distinct linked pairs ``a1, a2, b1, b2`` of distinct lines ``k1, k2, s`` and, of one edit,
    the members ``g, k1, k2`` of groups in which every two lines are linked, with ``r1, r2``, the
    member that stands for the group.  A link is in one pair or in one group."""
    pairs, groups = candidates(lines.select(F.col("k1").alias("id"), "s"), threshold, hot, depth)
    pairs = staged(_spread(pairs.distinct()), "candidates")
    ids = pairs.select(F.col("a").alias("k1")).unionByName(pairs.select(F.col("b").alias("k1")))
    if groups is not None:
        ids = ids.unionByName(groups.select(F.col("id").alias("k1")))
    ids = ids.distinct()
    texts = kept(maybe_in(lines.select("k1", "k2", "s"), ids, ["k1"]).join(ids, "k1"))

    def named(k1: str, k2: str, s: str) -> DataFrame:
        return texts.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("s").alias(s))

    both = pairs.join(named("a", "a2", "sa"), "a").join(named("b", "b2", "sb"), "b")
    near = both.where(distance(F.col("sa"), F.col("sb"), threshold) <= threshold).select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2")
    if groups is None:
        return staged(_spread(near), "links"), None
    # One member stands for a group; who is not linked to it (by a collision of keys) is no member.
    first = groups.groupBy("g").agg(F.min("id").alias("r1")).join(named("r1", "r2", "sr"), "r1")
    members = groups.withColumnRenamed("id", "k1").join(texts, "k1").join(first, "g").where(distance(F.col("s"), F.col("sr"), 1) <= 1)
    return staged(_spread(near), "links"), staged(_spread(members.select("g", "k1", "k2", "r1", "r2")), "line-members")


def _node(k1: str, k2: str) -> Column:
    return F.concat_ws(":", k1, k2)


def joined_up(near: DataFrame, members: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """From pairs and groups: ``k1, k2, class`` of every linked line and its links ``k1, k2, links``."""
    ends = near.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.lit(1).alias("n")).unionByName(near.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), F.lit(1).alias("n")))
    edges = near.select(_node("a1", "a2").alias("src"), _node("b1", "b2").alias("dst"))
    if members is not None:
        size = members.groupBy("g").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
        ends = ends.unionByName(members.join(size, "g").select("k1", "k2", F.col("n").cast("int").alias("n")))
        edges = edges.unionByName(members.select(_node("k1", "k2").alias("src"), _node("r1", "r2").alias("dst")))
    counts = ends.groupBy("k1", "k2").agg(F.sum("n").alias("links"))
    node = F.split("node", ":")
    found = connected_components(edges).select(node[0].cast("long").alias("k1"), node[1].cast("long").alias("k2"), F.col("component").alias("class"))
    return found, counts


def classes(docs: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``k1, k2, class, first`` of the lines that occur in several places or have links, and
    the number of links ``k1, k2, links`` of the lines that have any."""
    each = docs.select("place", F.explode(F.split("text", "\n")).alias("s")).where(_worded(F.col("s")))
    distinct = each.groupBy("s").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "lines")
    distinct.select(*_digests(F.col("s")), "s", "first", "n").coalesce(max(6, parts // 3)).write.parquet(path)
    lines = spark.read.schema("k1 long, k2 long, s string, first long, n long").parquet(path)
    near, members = links(lines.where(F.length("s") >= 2 * (threshold + 1)), threshold, hot)
    joined, counts = joined_up(near, members)
    key = ["k1", "k2"]
    linked = lines.select(*key, "first").join(joined, key)
    low = linked.groupBy("class").agg(F.min("first").alias("low"))
    of_links = linked.join(low, "class").select(*key, "class", F.col("low").alias("first"))
    of_copies = lines.where("n > 1").select(*key, _node("k1", "k2").alias("class"), "first").join(joined.select(*key), key, "left_anti")
    return kept(of_links.unionByName(of_copies)), counts


def _documents(frame: Frame) -> DataFrame:
    text = F.coalesce(frame.col("text"), F.lit(""))
    doc_id = frame.col("doc_id").cast("long")
    return frame.df.select("*", F.coalesce(doc_id, F.lit(LAST)).alias("place"), F.xxhash64(text).alias("row"), text.alias("text"))


def _seen(docs: DataFrame) -> DataFrame:
    """``place, row, pos, k1, k2`` of every line with a word."""
    each = docs.select("place", "row", F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    return each.where(_worded(F.col("s"))).select("place", "row", "pos", *_digests(F.col("s")))


def _drops(seen: DataFrame, known: DataFrame) -> DataFrame:
    """``place, row, drops, source``: the lines (from 0, ascending) that a text loses, and the
    smallest place that has one of them first."""
    held = seen.join(known, ["k1", "k2"])
    leader = F.min("pos").over(Window.partitionBy("place", "row", "class"))
    return (
        held.withColumn("leader", leader)
        .where((F.col("pos") > F.col("leader")) | (F.col("first") < F.col("place")))
        .groupBy("place", "row")
        .agg(F.array_sort(F.collect_set("pos")).alias("drops"), F.min("first").alias("source"))
    )


def without(text: Column, drops: Column) -> Column:
    """A text without the lines at ``drops``."""
    return F.array_join(
        let(
            F.split(text, "\n"),
            lambda l: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.size(drops)),
                    lambda i: let(
                        F.when(i == 0, F.lit(0)).otherwise(F.get(drops, i - 1) + 1),
                        lambda s: F.slice(l, s + 1, F.greatest(F.coalesce(F.get(drops, i), F.size(l)) - s, F.lit(0))),
                    ),
                )
            ),
        ),
        "\n",
    )


def _split_by_drops(documents: DataFrame, threshold: int, hot: int, count_links: bool) -> tuple[Frame, DataFrame, DataFrame, DataFrame | None]:
    """The frame, its rows that may lose lines (with ``drops``), the other rows, and if asked
    for the links ``place, row, links`` of each text's lines."""
    frame = Frame(documents)
    docs = _documents(frame)
    narrow = docs.select("place", "row", "text")
    known, counts = classes(narrow, threshold, hot)
    seen = kept(_seen(narrow)) if count_links else _seen(narrow)
    drops = kept(_drops(seen, known))
    key = ["place", "row"]
    of_text = maybe_in(seen.select(*key, "k1", "k2"), counts, ["k1"]).distinct().join(counts, ["k1", "k2"]).groupBy(*key).agg(F.sum("links").alias("links")) if count_links else None
    return frame, maybe_in(docs, drops, key).join(drops, key, "left"), not_in(docs, drops, key), of_text


def deduplicated(documents: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """All columns of ``documents`` with the lines that are left; ``n_chars``, where there is
    such a column, follows the text.  Rows that lose all their lines go."""
    frame, touched, others, _ = _split_by_drops(documents, threshold, hot, count_links=False)
    name = frame.name("text")
    left = without(F.col("text"), F.col("drops"))
    cut = touched.withColumn(name, F.when(F.col("drops").isNull(), F.col(name)).otherwise(left))
    if "n_chars" in frame.names:
        chars = frame.name("n_chars")
        cut = cut.withColumn(chars, F.when(F.col("drops").isNull(), F.col(chars)).otherwise(F.length(F.col(name)).cast("long")))
    cut = cut.where(F.col("drops").isNull() | _worded(F.col(name)))
    return frame.restore(cut.select(*others.columns).unionByName(others))


def report(documents: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """For each row: ``doc_id``, its lines, the lines it loses, the links of its lines to other
    lines, ``class_id`` (the smallest id that has one of the lost lines first, or its own), and
    a digest of the text that is left."""
    frame, touched, others, links_of = _split_by_drops(documents, threshold, hot, count_links=True)
    lines = F.size(F.split("text", "\n")).cast("long")
    left = F.when(F.col("drops").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("drops")))
    one = touched.select(
        frame.col("doc_id").cast("long").alias("doc_id"), "place", "row", lines.alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_removed"), F.least("source", "place").alias("class_id"), F.sha2(left, 256).alias("kept_sha256"),
    )
    two = others.select(
        frame.col("doc_id").cast("long").alias("doc_id"), "place", "row", lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"),
        F.col("place").alias("class_id"), F.sha2("text", 256).alias("kept_sha256"),
    )
    return (
        one.unionByName(two)
        .join(links_of, ["place", "row"], "left")
        .select(
            "doc_id", "n_lines", "n_removed", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("class_id") < LAST, F.col("class_id")).alias("class_id"), "kept_sha256",
        )
    )


#: The same for DuckDB at one edit: it leaves the first or the last half of a pair's shorter line alone.
ORACLE = r"""
with recursive t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
o as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from t),
b as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as worded from o),
d as (select line, min(doc_id) as first from b where worded group by line),
n as (select line, length(line) as len from d where length(line) >= 4),
h as (select line, len, unnest([len, len - 1]) as l from n),
s as (select *, left(line, (l // 2)::int) as head, right(line, (l - l // 2)::int) as tail from h where l >= 4),
p as (select a.line as a, b.line as b, a.len as l, b.len - a.len as more from s a join s b on a.l = a.len and b.l = a.l and a.head = b.head and a.line <> b.line
  union select a.line, b.line, a.len, b.len - a.len from s a join s b on a.l = a.len and b.l = a.l and a.tail = b.tail and a.line <> b.line),
q as (select a, b from p where len(list_filter(range(l + more), lambda i: left(a, i::int) = left(b, i::int) and substr(a, (i + 2 - more)::int) = substr(b, (i + 2)::int))) > 0),
e as (select a, b from q union select b, a from q),
r(line, other) as (select a, b from e union select r.line, e.b from r join e on r.other = e.a),
cl as (select d.line, least(d.line, coalesce(min(other), d.line)) as class from d left join r on r.line = d.line group by d.line),
cf as (select cl.class, min(d.first) as first from cl join d using (line) group by cl.class),
m as (select b.doc_id, b.pos, b.line, b.worded, cl.class, cf.first, min(b.pos) over (partition by b.doc_id, coalesce(cl.class, b.line)) as leader
  from b left join cl on cl.line = b.line and b.worded left join cf on cf.class = cl.class),
k as (select *, worded and (first < doc_id or leader < pos) as gone from m),
lk as (select a as line, count(*) as links from e group by a),
dl as (select doc_id, sum(links) as links from (select distinct doc_id, line from b where worded) x join lk using (line) group by doc_id)
select k.doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_removed, coalesce(max(dl.links), 0)::bigint as n_links,
  least(k.doc_id, coalesce(min(first) filter (where gone), k.doc_id)) as class_id, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from k left join dl on dl.doc_id = k.doc_id group by k.doc_id
"""
