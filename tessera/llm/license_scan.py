"""License scans by a trained paragraph classifier.

A sparse logistic regression over word n-grams (one to three words) gives each paragraph - a
line - a licence family or ``unknown``.  It is trained here: positives are whole texts,
excerpts and framed copies of the published notices in ``license_texts``; negatives are the
lines of a bounded sample of the corpus (``sample`` texts of at most ``SAMPLE_CHARS``
characters, by least hash of their id).  Probabilities are calibrated by a temperature fitted
on held-out examples, and a family is reported only above ``LIKELY``.  A prediction counts as
confirmed when the paragraph shares enough of its n-grams with a text of that family.

The corpus is read once, each text whole, without a shuffle; the model (a few thousand
weights) is all that is sent to the workers.

Defined results: a null or empty text has no licence; a null id is carried and is not used for
training; repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frame import Frame, map_batches, thinned
from tessera.llm.license_texts import TEMPLATES

UNKNOWN = "unknown"
NGRAM = 3
SAMPLE, SAMPLE_CHARS, SAMPLE_LINES = 400, 20_000, 1500
FEATURES = 4000
LIKELY, CONFIRM = 0.6, 0.5
SEED = 7
_WORD = regex.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(found: list[str], least: int = 1, most: int = NGRAM) -> list[str]:
    return [" ".join(found[i : i + n]) for n in range(least, most + 1) for i in range(len(found) - n + 1)]


@dataclass
class Classifier:
    families: list[str]
    feature: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: All words of all features: a paragraph without any of them has no feature.
    words: frozenset[str] = frozenset()
    featureless: tuple[str, float, float] = (UNKNOWN, 1.0, 0.0)
    #: What the model says on the held-out examples: number, accuracy, log loss, calibration error.
    held_out: dict[str, float] = field(default_factory=dict)
    templates: dict[str, list[frozenset[str]]] = field(default_factory=dict)

    def features(self, found: list[str]) -> list[int]:
        get = self.feature.get
        return sorted({i for g in grams(found) if (i := get(g)) is not None})

    def probabilities(self, found: list[str]) -> np.ndarray:
        on = self.features(found)
        score = self.bias + (self.weights[on].sum(axis=0) / np.sqrt(len(on)) if on else 0.0)
        p = np.exp((score - score.max()) / self.temperature)
        return p / p.sum()

    def likeness(self, family: str, found: list[str]) -> float:
        """The larger share of n-grams that the paragraph has in common with one of the
        family's texts: of the paragraph's own or of that text's."""
        mine = _comparable(found)
        best = 0.0
        for text in self.templates[family]:
            common = len(mine & text)
            best = max(best, common / max(len(mine), 1), common / max(len(text), 1) if len(text) > 2 else 0.0)
        return best

    def classify(self, found: list[str]) -> tuple[str, float, float]:
        """Family, its probability and the likeness that confirms it."""
        p = self.probabilities(found)
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < LIKELY:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)]), 0.0
        return family, float(p[best]), self.likeness(family, found)


def _comparable(found: list[str]) -> frozenset[str]:
    return frozenset(grams(found, 2, 2))


def examples(rng: np.random.Generator, negatives: list[list[str]]) -> tuple[list[list[str]], list[str]]:
    """Texts of the families whole, as excerpts and between other words; then the negatives."""
    texts, labels = [], []
    filler = [w for line in negatives for w in line] or ["word"]
    for family, notices in TEMPLATES.items():
        whole = [tokens(t) for t in notices]
        for found in whole:
            texts += [found] * 6
            labels += [family] * 6
            for _ in range(12 + len(found)):
                n = min(len(found), int(rng.integers(5, 31)))
                at = int(rng.integers(0, len(found) - n + 1))
                texts.append(found[at : at + n])
                labels.append(family)
            for _ in range(10):
                before, after = (list(rng.choice(filler, int(rng.integers(0, 9)))) for _ in range(2))
                texts.append([*map(str, before), *found, *map(str, after)])
                labels.append(family)
    known = {g for notices in TEMPLATES.values() for t in notices for g in _comparable(tokens(t))}
    for line in negatives:
        mine = _comparable(line)
        if line and len(mine & known) <= 0.2 * len(mine):
            texts.append(line)
            labels.append(UNKNOWN)
    # Random orders of the notices' own words are no licence either.
    pool = [w for notices in TEMPLATES.values() for t in notices for w in tokens(t)]
    for _ in range(300):
        texts.append([str(w) for w in rng.choice(pool, int(rng.integers(1, 25)))])
        labels.append(UNKNOWN)
    return texts, labels


def fit(negatives: list[str], steps: int = 200, rate: float = 10.0, decay: float = 1e-4) -> Classifier:
    """Train on the notices and on lines that are no licence; deterministic."""
    rng = np.random.default_rng(SEED)
    texts, labels = examples(rng, [tokens(x) for x in negatives[:SAMPLE_LINES]])
    families = [*TEMPLATES, UNKNOWN]
    y = np.array([families.index(x) for x in labels])
    in_prose: Counter = Counter()
    in_notice: Counter = Counter()
    for found, label in zip(texts, labels, strict=True):
        (in_prose if label == UNKNOWN else in_notice).update(set(grams(found)))
    prose = max(sum(label == UNKNOWN for label in labels), 1)
    own = {g for notices in TEMPLATES.values() for t in notices for g in grams(tokens(t))}
    ranked = [g for g, n in sorted(in_notice.items(), key=lambda x: (-x[1], x[0])) if g in own and (" " in g or in_prose[g] < 0.05 * prose)]
    feature = {g: i for i, g in enumerate(ranked[:FEATURES])}
    model = Classifier(families, feature, np.zeros((len(feature), len(families))), np.zeros(len(families)))
    x = np.zeros((len(texts), len(feature)), np.float32)
    for i, found in enumerate(texts):
        on = model.features(found)
        if on:
            x[i, on] = 1 / np.sqrt(len(on))
    held = rng.random(len(texts)) < 0.2
    target = np.eye(len(families), dtype=np.float32)[y]
    share = 1 / np.bincount(y[~held], minlength=len(families)).clip(1)
    cost = (share[y[~held]] / share[y[~held]].sum()).astype(np.float32)[:, None]
    w, b = model.weights.astype(np.float32), model.bias.astype(np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    xt, tt = x[~held], target[~held]
    for _ in range(steps):
        s = xt @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - tt) * cost
        vw = 0.9 * vw - rate * (xt.T @ g + decay * w)
        vb = 0.9 * vb - rate * g.sum(axis=0)
        w += vw
        b += vb
    score = x[held] @ w + b

    def loss(t: float) -> float:
        z = score / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), y[held]] - np.log(np.exp(z).sum(axis=1))).mean()) if len(z) else 0.0

    model.weights, model.bias = w.astype(float), b.astype(float)
    model.temperature = min((0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    model.words = frozenset(w for g in feature for w in g.split(" "))
    model.templates = {f: [_comparable(tokens(t)) for t in notices] for f, notices in TEMPLATES.items()}
    model.featureless = model.classify([])
    model.held_out = calibration(model, [t for t, h in zip(texts, held, strict=True) if h], [t for t, h in zip(labels, held, strict=True) if h])
    return model


def calibration(model: Classifier, texts: list[list[str]], labels: list[str], bins: int = 10) -> dict[str, float]:
    """Accuracy, log loss, and the expected calibration error: the mean distance between what the
    model says of its first choice and how often that is right, by bins of probability."""
    if not texts:
        return {}
    p = np.array([model.probabilities(t) for t in texts])
    y = np.array([model.families.index(x) for x in labels])
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    at = np.minimum((sure * bins).astype(int), bins - 1)
    gap = sum(abs(sure[at == b].mean() - right[at == b].mean()) * (at == b).mean() for b in set(at.tolist()))
    return {"n": len(y), "accuracy": float(right.mean()), "log_loss": float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()), "calibration_error": float(gap)}


def sample_lines(documents: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Lines of the bounded training sample."""
    frame = Frame(documents)
    text = frame.col("text")
    rows = (
        thinned(frame.df, frame.col("doc_id"), sample, documents.count())
        .where(frame.col("doc_id").isNotNull() & (F.length(text) <= SAMPLE_CHARS))
        .select(F.pmod(F.xxhash64(frame.col("doc_id")), F.lit(1 << 40)).alias("h"), text.alias("text"))
        .orderBy("h", "text")
        .limit(sample)
        .collect()
    )
    return [line for r in rows for line in r["text"].split("\n") if line]


def found_in(model: Classifier, text: str) -> list[tuple[int, str, float, float]]:
    """``(line, family, probability, likeness)`` of the lines that are predicted a licence."""
    out = []
    for i, line in enumerate(text.split("\n")):
        found = tokens(line)
        # Without a word of any feature the model sees nothing but its bias.
        family, p, like = model.featureless if model.words.isdisjoint(found) else model.classify(found)
        if found and family != UNKNOWN:
            out.append((i, family, p, like))
    return out


def scanned(documents: DataFrame, model: Classifier | None = None, key: str = "doc_id") -> DataFrame:
    """For each row: its lines, predicted and confirmed licence lines, the confirmed families
    by name, and all predictions as ``hits``."""
    model = model or fit(sample_lines(documents))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    frame = Frame(documents)
    df = frame.df.select(frame.col(key).alias(key), F.coalesce(frame.col("text"), F.lit("")).alias("text"))
    hit = pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lines, predicted, confirmed, families, hits = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                found = found_in(m, text)
                sure = [f for _, f, _, like in found if like >= CONFIRM]
                lines.append(text.count("\n") + 1 if text else 0)
                predicted.append(len(found))
                confirmed.append(len(sure))
                families.append(",".join(sorted(set(sure))))
                hits.append([{"line": i, "family": f, "probability": p, "likeness": like, "confirmed": like >= CONFIRM} for i, f, p, like in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.int64()), pa.array(predicted, pa.int64()), pa.array(confirmed, pa.int64()), pa.array(families, pa.string()), pa.array(hits, pa.list_(hit))],
                [key, "n_lines", "n_predicted", "n_confirmed", "families", "hits"],
            )

    kind = dict(df.dtypes)[key]
    return map_batches(
        df, work, f"`{key}` {kind}, n_lines long, n_predicted long, n_confirmed long, families string, hits array<struct<line:int,family:string,probability:double,likeness:double,confirmed:boolean>>"
    )
