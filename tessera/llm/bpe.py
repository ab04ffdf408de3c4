"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Whether two neighbouring symbols end up in one token depends on what follows only through a
chain of merges of rising rank, each of which reaches over one token.  ``lookahead`` computes
the longest such chain of a merge list, so a token that ends that many symbols before the end
of what has been read can not change any more.  The transducer emits such tokens at once and
keeps the rest, so its memory is bounded by the lookahead, not by the word or the text.

Decoding is a state machine as well: token by token it turns the byte alphabet back into
bytes and the bytes into text, holding back at most an unfinished UTF-8 sequence.

A text is read in blocks that end at white space, every word goes through the transducer, ids
are hashed and decoded block by block as they are settled, and words seen before are looked up
in a bounded table of the transducer's own results.  So besides the text itself memory holds one
block (or the longest run without white space or digits), the lookahead and that table.

The vocabulary file is a parameter (a Hugging Face ``tokenizer.json`` with a BPE model, NFC,
white space and lower-case normalisation, and a splitting pattern); nothing is trained.
Defined results: a null text is empty and has no tokens; repeated rows are encoded one by one;
null ids are carried.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frame import Frame, map_batches

#: Symbols read before stable tokens are looked for.
CHUNK = 1024
#: Words kept with their tokens, per worker; when full, the cache starts anew.
CACHE = 1 << 19
#: Longer words are not worth keeping.
CACHED_LENGTH = 64
#: Characters of a block.
BLOCK = 1 << 16
#: Up to so many symbols the pair to merge is looked for by a scan, beyond by a heap.
SCANNED = 64

# Code points that Unicode versions after 16.0, the library's, made letters or
# numbers.  The library takes them for neither.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# Lower case of characters that are newer than Unicode 15.1, as first-last:lower.
LATER_LOWER = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: bytes that are printable
    in Latin-1 stand for themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _ranges(listed: str) -> Iterator[tuple[int, int]]:
    for item in listed.split():
        first, _, last = item.partition("-")
        yield int(first, 16), int(last or first, 16)


def later_classes() -> str:
    """``LATER`` as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(LATER))


def later_lower() -> dict[int, int]:
    found = {}
    for item in LATER_LOWER.split():
        upper, _, lower = item.partition(":")
        for a, b in _ranges(upper):
            found |= {code: int(lower, 16) + code - a for code in range(a, b + 1)}
    return found


class Merges:
    """A BPE model: ``rank`` has the place of a pair ``left << 32 | right`` and ``made`` its token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokens = {i: t for t, i in self.vocabulary.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        v = self.vocabulary
        self.pairs = [(v[a], v[b]) for a, b in pairs]
        self.rank = {a << 32 | b: i for i, (a, b) in enumerate(self.pairs)}
        self.made = [v[a + b] for a, b in pairs]
        bytes_ = byte_alphabet()
        self.inner = [v[c] for c in bytes_]
        self.last = [v[c + self.end] for c in bytes_]
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern, regex.V0)
        # For texts with newer characters: the same without them among letters and numbers.
        older = {c: f"[{c}--[{later_classes()}]]" for c in (r"\p{L}", r"\p{N}")}
        self.careful = regex.compile(regex.sub(r"\\p\{[LN]\}", lambda m: older[m.group()], pattern), regex.V1)
        self.lookahead = lookahead(self.tokens, self.pairs)


def lookahead(tokens: dict[int, str], pairs: list[tuple[int, int]]) -> int:
    """Characters that bound how far left of the end of its input BPE can still change.

    Let what follows make the last settled token t merge to its right by a merge (t, x) in one
    reading and not in another.  The settled part shrinks by t.  The token s before it can be
    touched only by a later merge (s, y) in which y begins with t.  So the reach of a merge is
    the length of its left side plus the longest reach of such later merges; the list is gone
    through from its end.  ``best[t]`` is the longest reach of a later merge whose right side
    begins with t.
    """
    best: dict[str, int] = {}
    most = 0
    for a, b in reversed(pairs):
        left, right = tokens[a], tokens[b]
        reach = len(left) + best.get(left, 0)
        most = max(most, reach)
        for n in range(1, len(right) + 1):
            if best.get(right[:n], 0) < reach:
                best[right[:n]] = reach
    return most + max(map(len, tokens.values()), default=0)


def merge_short(symbols: list[int], rank: dict[int, int], made: list[int]) -> list[int]:
    """BPE of few symbols: the pair of lowest rank is merged until none is left."""
    get = rank.get
    while (n := len(symbols)) > 1:
        found = [get(a << 32 | b, 1 << 60) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        low = min(found)
        if low == 1 << 60:
            break
        token, out, i = made[low], [], 0
        while i < n:
            if i < n - 1 and found[i] == low:
                out.append(token)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def merge_long(symbols: list[int], rank: dict[int, int], made: list[int]) -> list[tuple[int, int]]:
    """The same for many symbols, in n log n: ``(token, first symbol after it)``."""
    n = len(symbols)
    token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if token[i] != a or j >= n or token[j] != b:
            continue
        token[i], token[j], after[i] = made[r], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := rank.get(token[x] << 32 | token[y])) is not None:
                heapq.heappush(heap, (r, x, token[x], token[y]))
    out, i = [], 0
    while i < n:
        out.append((token[i], after[i]))
        i = after[i]
    return out


class WordTransducer:
    """Encodes one word that comes in pieces; holds ``lookahead`` + ``CHUNK`` symbols at most."""

    def __init__(self, merges: Merges, chunk: int = CHUNK) -> None:
        self.m, self.chunk, self.held = merges, chunk, bytearray()

    def feed(self, piece: bytes) -> Iterator[int]:
        for at in range(0, len(piece), self.chunk):
            self.held += piece[at : at + self.chunk]
            if len(self.held) > self.chunk + self.m.lookahead:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        settled = len(self.held) - self.m.lookahead
        done = 0
        for token, end in merge_long([self.m.inner[b] for b in self.held], self.m.rank, self.m.made):
            if end > settled:
                break
            done = end
            yield token
        del self.held[:done]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        symbols = [self.m.inner[b] for b in self.held]
        symbols[-1] = self.m.last[self.held[-1]]
        self.held.clear()
        if len(symbols) <= SCANNED:
            return merge_short(symbols, self.m.rank, self.m.made)
        return [t for t, _ in merge_long(symbols, self.m.rank, self.m.made)]


class Encoder:
    """Text to ids, as the tokenizers library does it without special tokens around the text."""

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.run = WordTransducer(merges)
        self.known: dict[str, bytes] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.lower = later_lower()
        self.first_later = chr(min(min(self.lower), *(a for a, _ in _ranges(LATER))))
        self.later = regex.compile(f"[{later_classes()}{''.join(map(chr, self.lower))}]", regex.V0)

    def normal(self, text: str) -> str:
        """NFC, any white space as a space, and lower case letter by letter (so without the
        final form of sigma that depends on what follows)."""
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def words(self, piece: str) -> list[str]:
        if not piece.isascii() and max(piece) >= self.first_later and self.later.search(piece):
            return self.m.careful.findall(self.normal(piece).translate(self.lower))
        return self.m.pattern.findall(self.normal(piece))

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit integers."""
        data = word.encode("utf-8", "surrogatepass")
        packed = array("I", [*self.run.feed(data), *self.run.finish()]).tobytes()
        if len(data) <= CACHED_LENGTH:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = packed
        return packed

    def block(self, text: str) -> Iterator[bytes]:
        """The ids of a text that ends at the end of a word."""
        pieces = self.cut.split(text) if self.cut and any(s in text for s in self.m.special) else [text]
        get = self.known.get
        for piece in pieces:
            if piece in self.m.special:
                yield array("I", [self.m.special[piece]]).tobytes()
                continue
            for found in (words[at : at + 4096] for words in [self.words(piece)] for at in range(0, len(words), 4096)):
                if len(piece) > BLOCK and max(map(len, found)) > BLOCK:  # a word that is longer than a block
                    for w in found:
                        data = w.encode("utf-8", "surrogatepass")
                        for at in range(0, len(data), BLOCK):
                            yield array("I", self.run.feed(data[at : at + BLOCK])).tobytes()
                        yield array("I", self.run.finish()).tobytes()
                else:
                    yield b"".join([get(w) or self.word(w) for w in found])

    def stream(self, pieces: Iterable[str], block: int = BLOCK) -> Iterator[bytes]:
        """The ids of a text that comes in pieces, as soon as they are settled.

        A block ends after white space, or else after a digit that has an ASCII character behind
        it: no word, no special token and no composed character goes beyond either.
        """
        held = ""
        for piece in pieces:
            for at in range(0, len(piece), block):
                held = held + piece[at : at + block] if held else piece[at : at + block]
                if len(held) < block:
                    continue
                end = max(held.rfind(" "), held.rfind("\n")) + 1
                if not end and (digit := _AFTER_DIGIT.search(held)):
                    end = digit.start(1)
                if end:
                    yield from self.block(held[:end])
                    held = held[end:]
        if held:
            yield from self.block(held)

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream([text]))


#: The last place after a digit and before another ASCII character.
_AFTER_DIGIT = regex.compile(r"(?r)[0-9]()[\x00-\x7f]")


class Decoder:
    """Ids to text, id by id: the bytes of each token go through an incremental UTF-8 decoder,
    which holds back what is unfinished.

    With ``names`` the tokens' names with a space between, the library's decoding of a vocabulary
    without a decoder.  Otherwise the byte alphabet is undone and an end-of-word mark is a space.
    """

    def __init__(self, merges: Merges, names: bool = False) -> None:
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.names, self.begun = names, False
        self.bytes: list[bytes] = []
        for i in range(max(merges.tokens, default=-1) + 1):
            name = merges.tokens.get(i, "")
            body = name.removesuffix(merges.end) if merges.end else name
            if names:
                self.bytes.append(b" " + name.encode())
            elif merges.special.get(name) == i:
                self.bytes.append(name.encode())
            else:
                self.bytes.append(bytes(byte_of[c] for c in body) + b" " * (body != name))
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.names and data and not self.begun:
            self.begun, data = True, data[1:]
        text = self.state.decode(data, final)
        if final:
            self.state.reset()
            self.begun = False
        return text


_MODELS: dict[str, Merges] = {}


def model(path: str) -> Merges:
    """One model a worker process, read from the machine's installed vocabulary."""
    if path not in _MODELS:
        _MODELS[path] = Merges(path)
    return _MODELS[path]


_CODERS: dict[str, tuple[Encoder, Decoder, Decoder]] = {}


def coders(path: str) -> tuple[Encoder, Decoder, Decoder]:
    """An encoder, the decoder to names and the decoder to text."""
    if path not in _CODERS:
        _CODERS[path] = Encoder(model(path)), Decoder(model(path), names=True), Decoder(model(path))
    return _CODERS[path]


def encoded(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``key``, ``n_tokens`` and digests of the ids and of the decoded text; with ``ids`` the
    ids themselves and the text that the byte-to-text machine gives back."""
    frame = Frame(documents)
    df = frame.df.select(frame.col(key).alias(key), F.coalesce(frame.col(text), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names, back = coders(vocabulary)
        for batch in batches:
            counts, id_digests, text_digests, lists, texts = [], [], [], [], []
            for value in batch.column(1):
                n, of_ids, of_text, all_ids, whole = 0, hashlib.sha256(), hashlib.sha256(), [], []
                for packed in encoder.stream([value.as_py()]):
                    settled = np.frombuffer(packed, "<u4").tolist()
                    n += len(settled)
                    of_ids.update(packed)
                    of_text.update(names.feed(settled).encode())
                    if ids:
                        all_ids += settled
                        whole.append(back.feed(settled))
                of_text.update(names.feed([], final=True).encode())
                counts.append(n)
                id_digests.append(of_ids.hexdigest())
                text_digests.append(of_text.hexdigest())
                if ids:
                    lists.append(all_ids)
                    texts.append("".join(whole) + back.feed([], final=True))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            found = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                found += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, found)

    kind = dict(df.dtypes)[key]
    more = ", ids array<int>, decoded string" if ids else ""
    return map_batches(df, work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}", 500)
