"""The corpus operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, license_scan, line_dedup, lm, mixing, quality, simhash, substring, topk, url_filter

WHITE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgé"), rng.integers(1, 8))) for _ in range(400)]

    def prose(n):
        return "\n".join(" ".join(rng.choice(vocabulary, 12)).capitalize() + "." for _ in range(max(n // 12, 1)))

    texts = [prose(int(n)) for n in rng.integers(12, 240, 60)]
    texts += texts[:5] + [t.replace("a", "b", 1) for t in texts[5:15]]
    texts += [texts[20] + "\n" + texts[21], "x " + texts[22], None, "", "   \n\t", "word", "a b", "Ünïcödé\u2003space \x85 nel 😀", "the " * 120, "LOUD WORDS! " * 30, "#%$ | " * 20 + "and so on"]
    texts += [" ".join(words(texts[30])[:60]), " ".join(words(texts[30])[5:]), prose(6000), texts[0]]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[70]]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names differ from ours in case only, or are ones we use inside.
    df = spark.createDataFrame(corpus(), DOCS)
    more = {"TEXT": "no", "rid": -1, "size": -2, "fp": 0, "row": 9, "s": "s", "key": "k", "c1": "c"}
    return df.select("*", *(F.lit(v).alias(k) for k, v in more.items())).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def unique(docs):
    return {r[0]: r[1] for r in corpus()}


# -- quality ----------------------------------------------------------------------------------


def measured(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(WHITE):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality(docs, empty):
    got = quality.judged(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        n, chars, symbols, dup, rep = measured(unique(docs)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["kept"] and r["base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    counts = {r["rule"]: (r["failed"], r["failed_only_this"]) for r in quality.ablation(quality.ledger(docs)).collect()}
    bits = [r["fail_bits"] for r in got]
    for rule, bit in quality.BIT.items():
        want = (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
        assert counts.get(rule, (0, 0)) == want
    assert quality.judged(empty).count() == 0


# -- lines ---------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_distance(spark, threshold):
    rng = np.random.default_rng(threshold)
    pairs = []
    for _ in range(150):
        a = list(rng.choice(list("abcé😀"), rng.integers(0, 25)))
        b = list(a)
        for _ in range(rng.integers(0, 6)):
            at = int(rng.integers(0, len(b) + 1))
            if rng.random() < 0.5 or at == len(b):
                b.insert(at, "z")
            else:
                del b[at]
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.distance(F.col("a"), F.col("b"), threshold).alias("d")).collect():
        want = edits(r["a"], r["b"])
        assert r["d"] == want if want <= threshold else r["d"] > threshold


def linked(spark, lines, threshold, hot, depth):
    """All links that ``links`` gives as pairs or groups, how often it gives each, and its rows."""
    df = spark.createDataFrame([(i, -i, x) for i, x in enumerate(lines)], "k1 long, k2 long, s string")
    near, members = line_dedup.links(df, threshold, hot, depth)
    rows = near.collect()
    found = collections.Counter((min(r["a1"], r["b1"]), max(r["a1"], r["b1"])) for r in rows)
    assert all(r["a2"] == -r["a1"] and r["b2"] == -r["b1"] for r in rows)
    groups = collections.defaultdict(list)
    for r in members.collect() if members is not None else ():
        groups[r["g"]].append(r["k1"])
    for g in groups.values():
        found.update((i, j) for i in g for j in g if i < j)
    counts = {r["k1"]: r["links"] for r in line_dedup.joined_up(near, members)[1].collect()}
    return found, counts, len(rows) + sum(map(len, groups.values()))


def check_links(spark, lines, threshold, hot, depth=2):
    found, counts, rows = linked(spark, lines, threshold, hot, depth)
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if abs(len(lines[i]) - len(lines[j])) <= threshold and edits(lines[i], lines[j]) <= threshold}
    assert set(found) == want and set(found.values()) <= {1}
    assert counts == collections.Counter(i for p in want for i in p)
    return rows


@pytest.mark.parametrize(("threshold", "hot"), [(1, 1000), (1, 6), (1, 1), (2, 1000), (2, 30)])
def test_links(spark, threshold, hot):
    rng = np.random.default_rng(5)
    lines = set()
    for k in range(25):
        base = "".join(rng.choice(list("abcdefg "), 60 if k == 0 else rng.integers(6, 45)))
        for _ in range(40 if k == 0 else 4):
            b = list(base)
            for _ in range(rng.integers(0, 3)):
                b[int(rng.integers(0, len(b)))] = "z"
            if rng.random() < 0.4:
                b.insert(int(rng.integers(0, len(b))), "y")
            lines.add("".join(b))
    check_links(spark, sorted(lines), threshold, hot)


def test_links_of_what_is_left_of_crowded_lines(spark):
    # Segments shared by all lines are cut out until next to nothing is left.
    lines = ["a" * 20, "a" * 21, "a" * 22, *("a" * k + "b" + "a" * (19 - k) for k in range(20)), "abab", "abaab", "ababa", "baba", "aaaa", "aaaaa"]
    for hot in (1, 2, 100):
        check_links(spark, lines, 1, hot)


def test_links_of_a_large_group_are_no_pairs(spark):
    """Lines that all differ in one place are all linked, but are one row each of the result."""
    head, tail = "The same line again, but for ", "."
    lines = [head + chr(0x4E00 + i) + tail for i in range(300)] + [head + tail]
    rows = check_links(spark, lines, 1, line_dedup.HOT)
    assert rows <= 4 * len(lines)


def test_line_dedup(docs, empty):
    texts = unique(docs)
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    every = sorted({x for v in lines.values() for x in v if x.strip(WHITE)})
    parent = {x: x for x in every}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [x for x in every if len(x) >= 4]
    links = collections.Counter()
    for i, a in enumerate(near):
        for b in near[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and edits(a, b) <= 1:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    first = {}
    for i in sorted(lines):
        for x in lines[i]:
            if x.strip(WHITE):
                first.setdefault(root(x), i)
    want, own = {}, {}
    for i, v in lines.items():
        seen, kept = set(), []
        for x in v:
            if x.strip(WHITE):
                if first[root(x)] != i or root(x) in seen:
                    continue
                seen.add(root(x))
            kept.append(x)
        lost = [first[root(x)] for x in v if x.strip(WHITE) and x not in kept]
        own[i] = min([i, *lost])
        want[i] = (len(v), len(v) - len(kept), sum(links[x] for x in set(v)), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept))
    got = line_dedup.report(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r["n_lines"], r["n_removed"], r["n_links"], r["kept_sha256"]) == want[r["doc_id"]][:4]
        assert r["class_id"] == own[r["doc_id"]]
    kept = line_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    stay = {i for i, w in want.items() if w[1] == 0 or w[4].strip(WHITE)}
    rows = [(r[0], r[1], r[4]) for r in kept.collect()]
    assert {r[0] for r in rows} == stay
    assert all((t or "") == want[i][4] and n == len(t or "") for i, t, n in rows)
    assert line_dedup.report(empty).count() == 0


# -- urls -----------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "https://a.net/de/1", "https://www.example.net/de/8#f",
            "http://example.net/de/7", "ftp://x.org/es/", "http://x.org/es", "http://com", "http://a.com?x=/en/", "a://b://c.com/en/", "http:///en/", "://.com/en/y"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(r, v) for r, v in url_filter.RULES if (host == url_filter.parts(r)[0] or host.endswith("." + url_filter.parts(r)[0])) and path.startswith(url_filter.parts(r)[1])]
        best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    got = url_filter.judged(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert tuple(r)[1:5] == judge(urls[r["page_id"]])
    assert url_filter.judged(df.limit(0)).count() == 0


def test_collisions_are_confirmed(tmp_path):
    data = url_filter.pack([("a.com/x", "block"), ("b.com/y", "allow")])
    path = tmp_path / "d"
    # All keys the same: only the stored text can tell the rules apart.
    same = bytearray(data)
    key = xxhash.xxh64_intdigest(b"a.com/x").to_bytes(8, "little")
    same[url_filter.HEAD.size : url_filter.HEAD.size + 16] = key * 2
    path.write_bytes(bytes(same))
    array = url_filter.DigestArray(str(path))
    at = array.probe(["a.com/x", "c.com"])
    assert array.text(int(at[0])) == "a.com/x" and at[1] == -1
    path2 = tmp_path / "e"
    path2.write_bytes(url_filter.pack([]))
    assert url_filter.DigestArray(str(path2)).probe(["x"]).tolist() == [-1]


# -- mixing ----------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    t = mixing.targets({"a": 1000, "b": 1, "c": 2})
    assert t["b"] == 3 and t["c"] == 6 and t["a"] == pytest.approx(994)
    assert list(mixing.targets({None: 1, "é": 1, "z": 1})) == ["z", "é", None]
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    assert sum(mixing.whole({"a": 1.5, "b": 1.5, "c": 2.0}).values()) == 5


def test_mixing(docs, empty):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(corpus())
    sizes = collections.Counter()
    for r in corpus():
        sizes[r[3]] += len(words(r[1]))
    goal = mixing.targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(words(unique(docs)[r["doc_id"]]))
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal) and sum(taken.values()) == sum(sizes.values())
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).select("doc_id", "taken").collect())) == sorted(str(r) for r in mixing.mixed(docs).select("doc_id", "taken").collect())
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    mixed = collections.Counter()
    for r in out.collect():
        whole = words(unique(docs)[r[0]])
        mine = words(r[1])
        assert mine == whole[: len(mine)] and r[4] == len(r[1])
        mixed[r[3]] += len(mine)
    assert mixed == taken
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_by_a_heap(spark):
    """The mix row by row: the packet with the least virtual finish time is always the next."""
    rows = [(r[0], r[3], len(words(r[1])), i) for i, r in enumerate(corpus())]
    hashes = {r[0]: r[1] for r in spark.createDataFrame(corpus(), DOCS).select("doc_id", F.xxhash64(F.lit(0), "doc_id")).collect()}
    sizes = collections.Counter()
    for _, source, n, _ in rows:
        sizes[source] += n
    goal = mixing.whole(mixing.targets(sizes))
    queues = {}
    for source, target in goal.items():
        own = sorted((r for r in rows if r[1] == source and r[2]), key=lambda r: (hashes[r[0]], r[0], r[2], r[3]))
        packets, at = [], 0
        for epoch in range(3):
            for doc_id, _, n, i in own:
                first = min(max(target - at, 0), n)
                for part, done in ((first, at + first), (n - first, at + n)):
                    if part:
                        packets.append((done / target if target else math.inf, hashes[doc_id], i, epoch, part))
                at += n
        queues[source] = packets[::-1]
    heap = [(q[-1], str(source), source) for source, q in queues.items() if q]
    heapq.heapify(heap)
    left, taken = sum(goal.values()), collections.Counter()
    while left and heap:
        packet, name, source = heapq.heappop(heap)
        queues[source].pop()
        took = min(packet[4], left)
        taken[packet[2]] += took
        left -= took
        if queues[source]:
            heapq.heappush(heap, (queues[source][-1], name, source))
    want = collections.Counter((r[0], taken[r[3]]) for r in rows)
    got = collections.Counter((r["doc_id"], r["taken"]) for r in mixing.mixed(spark.createDataFrame(corpus(), DOCS)).collect())
    assert got == want


# -- BPE ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_bpe(docs, empty, tokenizer):
    path, library = tokenizer
    got = bpe.encoded(docs, path, ids=True).collect()
    assert len(got) == len(corpus())
    for r in got:
        ids = library.encode(unique(docs)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(empty, path).count() == 0


def test_bpe_transducer(tokenizer):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    path, library = tokenizer
    encoder, names, _ = bpe.coders(path)
    merges = bpe.model(path)
    pieces = st.sampled_from(["the", "ing", "tion", "a", "e", "x", "é", "漢", "0", "'s", " ", "\n", "Σ", "<|endoftext|>", "!!", "İ", "\x1c", "\x85", "ß", "\u0301"])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(pieces | st.characters(exclude_categories=["Cs"]), max_size=40), st.integers(1, 9))
    def same(parts, block):
        text = "".join(parts)
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert ids == np.frombuffer(b"".join(encoder.stream(parts, block)), "<u4").tolist()
        assert "".join(names.feed([i]) for i in ids) + names.feed([], final=True) == library.decode(ids, skip_special_tokens=False)

    same()
    # Every code point whose class or case newer Unicode versions changed, and its neighbours.
    codes = {c for a, b in bpe._ranges(bpe.LATER) for c in (a - 1, a, (a + b) // 2, b, b + 1)} | set(bpe.later_lower()) | {0xE0FFF, 0x10FFFF}
    for code in sorted(codes):
        same.hypothesis.inner_test(["the", chr(code), "Ab", chr(code), " 1", chr(code), "!", chr(code)], 5)


def test_bpe_memory_is_bounded(tokenizer):
    """50 MB in pieces: neither blocks nor what the transducer holds grow."""
    path, library = tokenizer
    merges = bpe.model(path)
    rng = np.random.default_rng(0)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "the", "ain"):
        word = "".join(rng.choice(list(alphabet), 20_000))
        run = bpe.WordTransducer(merges, chunk=64)
        ids, most = [], 0
        for at in range(0, len(word), 50):
            ids += run.feed(word[at : at + 50].encode())
            most = max(most, len(run.held))
        ids += run.finish()
        assert ids == library.encode(word, add_special_tokens=False).ids
        assert most <= merges.lookahead + 64 + 50
    encoder, names, _ = bpe.coders(path)
    part = " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(20_000)) + " "
    times = 50_000_000 // len(part) + 1
    n, longest, digest = 0, 0, hashlib.sha256()
    for packed in encoder.stream(part for _ in range(times)):
        n += len(packed) // 4
        longest = max(longest, len(packed), len(encoder.run.held))
        digest.update(packed)
    ids = library.encode(part, add_special_tokens=False).ids
    assert n == times * len(ids) and longest <= 64 * 4096
    assert digest.hexdigest() == hashlib.sha256(np.array(ids * times, "<u4").tobytes()).hexdigest()
    # A run of letters that is longer than a block goes through the transducer in pieces.
    run = "".join(rng.choice(list("abcdefghij"), 200_000))
    assert np.frombuffer(encoder.encode(run), "<u4").tolist() == library.encode(run, add_special_tokens=False).ids


def test_bpe_decoder_state(tokenizer):
    path, library = tokenizer
    encoder, _, decoder = bpe.coders(path)
    ids = np.frombuffer(encoder.encode("héllo wörld 漢字 😀"), "<u4").tolist()
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], final=True) == "héllo wörld 漢字 😀 "


# -- language model ---------------------------------------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    options = {"head": 40, "tails": 16, "classes": 8, "known": 100}
    got = lm.scored(docs, **options).collect()
    rows = [(r[0], (r[1] or "").encode().lower().split() + [b""]) for r in corpus()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    train = [t for i, t in rows if not held[i]]
    counts = collections.Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    # The model by brute force, from the classes that training gives.
    table = spark.createDataFrame(corpus(), DOCS).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    trained = lm.train(table.where(~lm.held_out(F.col("doc_id"))).select("text"), **options)
    classes = {r["wid"]: r["cls"] for r in trained.words.collect()}
    assert classes.keys() == {lm.wid(w) for w in counts} and classes[lm.wid(b"")] == 0 and sum(c == 0 for c in classes.values()) == 1
    assert len(set(classes.values())) == 8

    def cls(w):
        return classes.get(lm.wid(w), trained.model.seeds(w))

    bigrams = collections.Counter((cls(a), cls(b)) for t in train for a, b in zip([b"", *t], t, strict=False))
    left = collections.Counter()
    for (a, _), k in bigrams.items():
        left[a] += k
    tokens, types = collections.Counter(), collections.Counter()
    for w, c in counts.items():
        tokens[cls(w)] += c
        types[cls(w)] += 1

    def brute(t):
        return sum(
            math.log10((bigrams[cls(a), cls(b)] + lm.LAMBDA) / (left[cls(a)] + lm.LAMBDA * 8)) + math.log10((counts[b] + 1) / (tokens[cls(b)] + types[cls(b)] + 1))
            for a, b in zip([b"", *t], t, strict=False)
        )

    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["score"] == pytest.approx(brute(t), rel=1e-9)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm.scored(empty).count() == 0


def test_emissions_and_transitions_sum_to_one(docs):
    texts = docs.select(F.concat_ws(" ", "lang", "source", F.lit("a b a")).cast("binary").alias("text"))
    trained = lm.train(texts, head=5, tails=4, classes=3, known=5)
    read = lm.read_texts(texts.select(F.lit(1).cast("long").alias("doc_id"), F.lit(True).alias("train"), "text"), trained)
    step = lm.steps_of(lm.class_bigrams(read, 3), trained.types, trained.tokens)
    words_ = trained.words.collect()
    for before in range(3):
        total = sum(10 ** step[before, r["cls"]] * (r["c"] + 1) for r in words_) + sum(10 ** step[before, k] for k in range(3))
        assert total == pytest.approx(1.0)


def test_words_move_to_the_class_that_raises_likelihood_most():
    rng = np.random.default_rng(1)
    n = rng.poisson(30, (5, 5)).astype(float)
    gains = lm.Gains(n, small=2)
    for _ in range(20):
        # A word of class a that is counted in n already.
        a = int(rng.integers(1, 5))
        before, after = rng.integers(0, 4, 5), rng.integers(0, 4, 5)
        before, after = np.minimum(before, n[:, a]), np.minimum(after, n[a, :])

        def moved(c, a=a, before=before, after=after):
            m = n.copy()
            m[:, a] -= before
            m[a, :] -= after
            m[:, c] += before
            m[c, :] += after
            return lm.likelihood(m)

        events = [(k, x) for k, x in enumerate([*before, *after]) if x]
        code, count = (np.array(x, np.int64) for x in zip(*events, strict=True))
        got = int(gains.best(np.zeros(len(code), np.int64), code, count, np.array([a]))[0])
        # The change of a cell both sides touch is of second order.
        assert moved(got) >= moved(a) - 1.5 and moved(got) >= max(map(moved, range(1, 5))) - 3


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    # Two kinds of units that follow each other.
    n = np.zeros((21, 21))
    for a in range(1, 21):
        for b in range(1, 21):
            n[a, b] = rng.poisson(20 if (a % 2) != (b % 2) else 0.5)
    cls = lm.exchange(n, 3, fixed=0)
    assert cls[0] == 0 and len({cls[i] for i in range(1, 21, 2)}) == 1 and len({cls[i] for i in range(2, 21, 2)}) == 1 and cls[1] != cls[2]


# -- substrings -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("window", "phrase", "shard", "unit"), [(50, 10, substring.SHARD, substring.UNIT), (12, 4, 5, 3)])
def test_substrings(docs, empty, window, phrase, shard, unit):
    texts = {i: (t or "").encode().split() for i, t in unique(docs).items()}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][p : p + window]), i)
    got = substring.deduplicated(docs, window, phrase, shard, unit).collect()
    assert len(got) == len(corpus())
    for r in got:
        w = texts[r["doc_id"]]
        gone = {k for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < r["doc_id"] for k in range(p, p + window)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(left).hexdigest())
    assert sum(r["n_removed"] for r in got) > 0
    assert substring.deduplicated(empty).count() == 0


def test_passages_are_found_by_their_automaton():
    machine = substring.Automaton(2)
    found = b"a b ab a bb a b".split()
    assert not machine.begins(found).any()
    machine.add(b"a b")
    machine.add(b"ab a")
    machine.compile()
    assert machine.begins(found).tolist() == [True, False, True, False, False, True, False]


def test_substrings_of_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (2, text), (1, text), (1, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.deduplicated(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60)]


def test_very_long_texts(spark):
    """Texts of megabytes, beside others, for the operators that read texts in Python."""
    rng = np.random.default_rng(6)
    long = " ".join(f"w{x}" for x in rng.integers(0, 3000, 300_000))
    rows = [(1, long), (2, long + " tail"), (3, "short text"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.deduplicated(df).collect()} == {1: 0, 2: 300_000, 3: 0, 4: 0}
    codes = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert codes[1] == codes[2] == 1
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == {1, 3, 4}
    measured_ = {r["doc_id"]: r["n_words"] for r in quality.judged(df).collect()}
    assert measured_ == {1: 300_000, 2: 300_001, 3: 2, 4: 0}
    scores = {r["doc_id"]: r["n_tokens"] for r in lm.scored(df, head=50, tails=8, classes=4).collect()}
    assert scores == {1: 300_001, 2: 300_002, 3: 3, 4: 1}


# -- near duplicates -----------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = [x for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(codes):
    ids = sorted(codes)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (codes[a] ^ codes[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(docs, empty):
    codes = {i: brute_fingerprint(t) for i, t in unique(docs).items()}
    label = groups(codes)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (f"{codes[r['doc_id']]:016x}", label[r["doc_id"]])
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    # Each group keeps its smallest id; more goes only if it is similar to another text.
    left = {r[0] for r in one.collect()}
    assert left <= set(label.values())
    texts = unique(docs)
    for i in set(label.values()) - left:
        assert any(simhash.similarity((texts[i] or "").encode(), (t or "").encode(), 5) >= 0.8 for j, t in texts.items() if j != i)
    close = [(i, j) for i in left for j in left if i < j and (codes[i] ^ codes[j]).bit_count() <= 2]
    assert not close
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("limit", [4096, 40])
def test_simhash_nodes(spark, limit):
    rng = np.random.default_rng(2)
    codes = list(map(int, rng.integers(0, 1 << 63, 80, dtype=np.uint64)))
    for c in codes[:40]:
        for _ in range(3):
            codes.append(c ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 4)).tolist())))
    codes += map(int, rng.integers(0, 1 << 18, 150, dtype=np.uint64))
    codes = dict(enumerate(sorted(set(codes))))
    df = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in codes.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(df, 2, limit).collect()}
    assert got == groups(codes)


def test_simhash_null_ids(spark):
    df = spark.createDataFrame([(None, ""), (None, "   "), (None, "other text here"), (5, "x y z")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["5", "None", "None", "None"]
    assert simhash.one_of_each(df).count() == 3


def test_similar_texts_are_one_group(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 150)] for _ in range(20)]
    rows = []
    for k, w in enumerate(base):
        rows.append((10 * k, " ".join(w)))
        for copy in range(1, 4):
            v = list(w)
            for at in rng.integers(0, 150, copy):
                v[at] = "changed"
            rows.append((10 * k + copy, " ".join(v)))
    texts = dict(rows)
    left = {r[0] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {10 * k for k in range(20)} <= left
    near = [i for i in texts if i % 10 and simhash.similarity(texts[i].encode(), texts[i - i % 10].encode(), 5) >= 0.8]
    assert len(near) > 40 and not left & set(near)


def test_similar_texts_many_bits_apart_are_one_group(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(120):
        w = [f"w{x}" for x in rng.integers(0, 5000, 40)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-3], "changed", "at", "end"]))]
    apart = [(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    assert max(apart) > 12
    rows += [(1000, "four words of text"), (1001, "four words  of text"), (1002, "four words of it"), (1003, None), (1004, rows[0][1])]
    left = {r[0] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {*range(0, 240, 2), 1000, 1002, 1003}


def test_similar_texts_around_a_third_are_one_group(spark, monkeypatch):
    """The third text's fingerprint is nearer to both than they are to each other."""
    base = [f"w{x}" for x in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "changed"])), (3, "something else that is not at all like them")]
    codes = F.when(F.col("doc_id") == 1, 0).when(F.col("doc_id") == 2, 63).otherwise(7).cast("long")
    real = simhash.sketches
    monkeypatch.setattr(simhash, "sketches", lambda *a: real(*a).withColumn("fp", codes))
    left = {r[0] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1, 3}


def test_similar_texts_that_only_a_third_joins(spark):
    """A chain: each text is similar to the next, the ends are not; and repeated rows."""
    base = [f"w{x}" for x in range(100)]
    chain = [" ".join([*(f"x{i}" for i in range(k * 4)), *base[k * 4 :]]) for k in range(6)]
    rows = [(i, t, i) for i, t in enumerate(chain)] + [(0, chain[0], 0), (0, chain[0], 7), (50, "quite another text", 1), (50, "quite another text", 1)]
    pairs = [(i, j) for i in range(6) for j in range(i) if simhash.similarity(chain[i].encode(), chain[j].encode(), 5) >= 0.8]
    assert (1, 0) in pairs and (5, 0) not in pairs
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, more long")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 50]


def test_unlike_texts_of_one_template_make_few_pairs(spark, monkeypatch):
    """Texts that share rows of the index but are not similar are no rows of a join."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.choice(60, 4, replace=False):
            w[at] = f"c{i}x{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)]
    made = []
    whole = simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, tag: (out := whole(df, tag), made.append((tag, out.count())))[0])
    left = {r[0] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not left & set(range(1000, 1020))
    assert dict(made)["crossing"] < 150 * 149 / 2 / 10


def test_gray_index():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 12, 900, dtype=np.uint64))
    index = simhash.GrayIndex(codes, fan=4)
    a, b = index.search(np.arange(len(codes)), 2)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    d = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 2), strict=True) if j < i}


# -- licences -------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def classifier():
    lines = [line for r in corpus() if r[1] for line in r[1].split("\n") if line]
    return license_scan.fit(lines)


def test_licence_accuracy_on_held_out_examples(classifier):
    rng = np.random.default_rng(123)
    fresh = ["the quick brown fox jumps over the lazy dog", "you may copy the plate of the car", "see the section below for the details of the software"]
    texts, labels = license_scan.examples(rng, [license_scan.tokens(x) for x in fresh])
    hits = [classifier.classify(t)[0] == y for t, y in zip(texts, labels, strict=True)]
    assert np.mean(hits) > 0.9
    for family, notices in license_scan.TEMPLATES.items():
        for text in notices:
            found, _, likeness = classifier.classify(license_scan.tokens(text))
            assert found == family and likeness == 1.0


def test_licence_scan(spark, classifier, empty):
    rows = [(1, "Prose and more prose.\nReleased under the MIT License.\nThe end."), (2, "nothing here"), (3, None), (4, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (2, "nothing here"), (5, "prose " * 300_000 + "\nReleased under the MIT License."), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = license_scan.scanned(df, classifier).collect()
    got = {r["doc_id"]: (r["families"], r["n_confirmed"], [h["line"] for h in r["hits"]]) for r in rows}
    assert len(rows) == 7 and got.pop(5) == ("mit", 1, [1])
    assert got == {1: ("mit", 1, [1]), 2: ("", 0, []), 3: ("", 0, []), 4: ("apache,cc-by-nc", 2, [0, 1]), None: ("mit", 1, [0])}
    assert license_scan.scanned(empty).count() == 0


def test_licence_lines_are_all_judged(classifier):
    """The shortcut for lines without a word of a feature changes nothing."""
    rng = np.random.default_rng(3)
    pool = [w for notices in license_scan.TEMPLATES.values() for t in notices for w in license_scan.tokens(t)] + ["prose", "more", "word"] * 200
    lines = [" ".join(rng.choice(pool, rng.integers(0, 9))) for _ in range(600)] + ["the mit license", "", "?!", "as is", "nothing like it"]
    got = license_scan.found_in(classifier, "\n".join(lines))
    want = [(i, *classifier.classify(license_scan.tokens(x))) for i, x in enumerate(lines) if license_scan.tokens(x)]
    assert got == [w for w in want if w[1] != license_scan.UNKNOWN]
    assert any(lines[i] == "the mit license" and family == "mit" for i, family, _, _ in got)


def test_licence_calibration(classifier):
    held = classifier.held_out
    assert held["n"] > 200 and held["accuracy"] > 0.9 and held["log_loss"] < 0.4 and held["calibration_error"] < 0.05


# -- exact search --------------------------------------------------------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(int(i), [0.5] * 8) for i in range(300, 420)]  # a large group of equal vectors
    rows += [(1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, [1.0, 2.0]), (1201, [3.0, 4.0]), (1250, []), (1300, []), (1301, []), (None, [1.0] * 8), rows[50], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("V"), F.lit(2).alias("cell"))
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    for i, q in fine:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    for options in ({}, {"block": 20, "part": 3, "pivots": 7}):
        got = topk.searched(df, F.col("vec_id") % 50 == 0, **options)
        assert collections.Counter(map(tuple, got.collect())) == want
    assert topk.searched(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_components(spark):
    rows = [(50, [1e9, 2.0]), (1, [1e9, 3.0]), (2, [-1e9, 5.0]), (3, [1e30, 0.0])]
    got = topk.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    # Both scores are clipped to the largest number, so the smaller id comes first.
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, (1 << 63) - 1), (3, (1 << 63) - 1), (2, -(1 << 63))]


def test_blank_lines_are_told_by_trimming_once(spark):
    """The cheaper test of a line equals trimming both ends."""
    from pyspark.sql import functions as F

    from tessera.llm.frame import WHITE
    from tessera.llm.line_dedup import _worded

    odd = spark.createDataFrame([(x,) for x in ("", None, " ", "\t \r", "a", " a ", "\x0b\x0c", "é\r", "\x1f", " 　 ")], "s string")
    assert odd.where(~_worded(F.col("s")).eqNullSafe(F.btrim(F.col("s"), F.lit(WHITE)) != "")).count() == 0
    assert "btrim" not in str(_worded(F.col("s"))).lower() and "TrimBoth" not in str(_worded(F.col("s")))
