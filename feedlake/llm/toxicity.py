"""Toxicity by a counterfactual-regularised classifier.

A logistic regression on the words present in a text. Besides the labels it
fits, it is penalised for changes of its score under counterfactuals (counterfactual
logit pairing): in every sentence of a training text that holds an identity term, that
term is swapped for each other one of its group (each group holds a neutral word
too; one that the sentence holds already just replaces the term), and the squared
difference of the two logits is added to the loss. Identity terms are always
features, so one that is rare or evenly spread follows the others of its group: naming
a group moves the score no more than naming nobody in particular, unless the labels
insist.

Training rows are a bounded sample of the labelled ones: at most about
``MAX_TRAIN`` (a row is drawn by a hash of its id, with one probability for
all); copies of one text share one unit of weight. Features are the identity terms and
the words whose presence depends on the label (chi-square above ``MIN_CHI2``,
at most ``MAX_FEATURES``), counted by an aggregate over (word, label). The driver gets the
features, the swaps per pair of terms and the features of each training row,
never a text or its other words; the fit runs there in a fixed number of steps, and
scoring is a map over all whole texts with the few weights.

Defined cases: NULL and empty texts get the score of a text without features;
NULL labels are not used; with labels of one class only the score is that
class's smoothed share; a NULL id counts as the empty string for the fold. Texts
of any length are scored whole; repeated rows get equal scores; ties of the chi-square
go to the smaller word hash. Extra columns are ignored, whatever their names; an empty
table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import cut, slices
from feedlake.llm.tokens import Powers, Words

FOLDS = 5
MAX_TRAIN = 20_000
MAX_FEATURES = 4096
MIN_CHI2 = 15.0
MIN_TEXTS = 4
L2 = 1.0
COUNTERFACTUAL = 10.0
STEPS = 300
# identity terms by group, the neutral word of each group first (fixed values)
IDENTITY_GROUPS = (
    ("person", "woman", "man", "girl", "boy", "lesbian", "gay", "bisexual", "transgender", "queer", "straight"),
    ("people", "women", "men", "girls", "boys", "lesbians", "gays", "immigrants", "refugees", "foreigners", "migrants"),
    ("believer", "muslim", "christian", "jew", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("human", "black", "white", "asian", "african", "european", "american", "arab", "latino", "hispanic", "mexican",
     "chinese", "indian", "jewish", "islamic", "native"),
    ("citizen", "immigrant", "refugee", "foreigner", "migrant", "disabled", "blind", "deaf", "elderly", "young", "old"),
    ("persona", "mujer", "hombre", "musulmán", "cristiano", "judío", "inmigrante", "refugiado", "gitano", "negro", "blanco"),
    ("personne", "femme", "homme", "musulman", "chrétien", "juif", "immigré", "réfugié", "noir", "blanc", "arabe"),
    ("mensch", "frau", "mann", "muslim", "christ", "jude", "einwanderer", "flüchtling", "schwarzer", "weißer", "türke"),
)


_SENTENCE = re.compile(r"[.!?\n]+")


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def word_hashes(words: list[str]) -> np.ndarray:
    return Words(pa.array(words), Powers()).hash.view(np.int64)


def _presence(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word hash), ordered."""
    words = Words(texts, powers)
    hashes = words.hash.view(np.int64)
    order = np.lexsort((hashes, words.text))
    text, hashes = words.text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


class Classifier:
    """Weights by word hash, and an intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        order = np.argsort(hashes)
        self.hashes, self.weights, self.intercept = hashes[order], weights[order], intercept

    def scores(self, texts: pa.Array, powers: Powers) -> np.ndarray:
        logit = np.full(len(texts), self.intercept)
        if len(self.hashes):
            text, hashes = _presence(texts, powers)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            logit += np.bincount(text[hit], self.weights[at[hit]], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


class Design:
    """The training rows as indices: feature ``column[i]`` is present in row ``row[i]``;
    swap j takes feature ``left[j]`` out and puts ``right[j]`` in (the number of features: none)."""

    def __init__(self, rows: list[tuple[np.ndarray, int, float]], features: np.ndarray, swaps: list[tuple[int, int, bool, float]]) -> None:
        slot = {int(h): i for i, h in enumerate(features)}
        self.n, self.features = len(rows), len(features)
        self.y = np.array([r[1] for r in rows], float)
        self.weight = np.array([r[2] for r in rows], float)
        found = [[slot[int(h)] for h in r[0] if int(h) in slot] for r in rows]
        self.row = np.repeat(np.arange(self.n), [len(f) for f in found])
        self.column = np.array([c for f in found for c in f], int)
        self.left = np.array([slot[a] for a, _, _, _ in swaps], int)
        self.right = np.array([self.features if both else slot[b] for _, b, both, _ in swaps], int)
        self.pull = np.array([n for *_, n in swaps], float) * COUNTERFACTUAL

    def _sum(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, self.features + 1)[:-1]

    def loss(self, w: np.ndarray, b: float) -> float:
        logit = b + np.bincount(self.row, w[self.column], self.n)
        padded = np.append(w, 0.0)
        swapped = padded[self.left] - padded[self.right]
        return float(self.weight @ (np.logaddexp(0.0, logit) - self.y * logit) + 0.5 * L2 * w @ w + 0.5 * self.pull @ swapped ** 2)

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        logit = b + np.bincount(self.row, w[self.column], self.n)
        error = self.weight * (1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))) - self.y)
        padded = np.append(w, 0.0)
        change = (padded[self.left] - padded[self.right]) * self.pull
        return self._sum(self.column, error[self.row]) + L2 * w + self._sum(self.left, change) - self._sum(self.right, change), float(error.sum())

    def steps(self) -> tuple[np.ndarray, float]:
        """Step sizes that no curvature of the loss exceeds."""
        counts = self.weight * np.maximum(np.bincount(self.row, minlength=self.n), 1)
        bound = L2 + 0.25 * self._sum(self.column, counts[self.row]) + 2 * self._sum(self.left, self.pull) + 2 * self._sum(self.right, self.pull)
        return 1.0 / bound, 1.0 / (0.25 * float(counts.sum()))


def fit(rows: list[tuple[np.ndarray, int, float]], features: np.ndarray, swaps: list[tuple[int, int, bool, float]]) -> Classifier:
    """``rows``: (hashes of the features present, label, weight); ``swaps``: (term, replacement,
    whether the sentence holds both, weight), terms being features."""
    total, positive = sum(r[2] for r in rows), sum(r[2] * r[1] for r in rows)
    prior = float(np.log((positive + 0.5) / (total - positive + 0.5)))
    if not 0 < positive < total or not len(features):
        return Classifier(np.zeros(0, np.int64), np.zeros(0), prior)
    design = Design(rows, features, swaps)
    step_w, step_b = design.steps()
    w, b = np.zeros(len(features)), prior
    for _ in range(STEPS):
        grad, grad_b = design.gradient(w, b)
        w -= step_w * grad
        b -= step_b * grad_b
    return Classifier(np.asarray(features, np.int64), w, b)


def _swaps_of(text: str, partners: dict[int, list[tuple[int, float]]], powers: Powers) -> list[dict]:
    """The swaps that the sentences of a text allow."""
    sentences = [s for s in _SENTENCE.split(text) if s]
    at, hashes = _presence(pa.array(sentences, pa.string()), powers)
    out = []
    for i in range(len(sentences)):
        held = set(hashes[at == i].tolist())
        out += [{"a": a, "b": b, "both": b in held, "n": n} for a in held if a in partners for b, n in partners[a]]
    return out


def _words_of(partners: dict[int, list[tuple[int, float]]]):
    terms = np.array(sorted(partners), np.int64)
    swap = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("both", pa.bool_()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            text, hashes = _presence(batch.column(2), powers)
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32)
            named = set(text[np.isin(hashes, terms)].tolist())
            swaps = [_swaps_of(batch.column(2)[i].as_py(), partners, powers) if i in named else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes)),
                 pa.array(swaps, pa.list_(swap))], names=["kt", "label", "words", "swaps"])
    return run


def swap_partners(groups=IDENTITY_GROUPS) -> dict[int, list[tuple[int, float]]]:
    """Per identity term the others of its groups, each with its share of a sentence's weight."""
    out: dict[int, list[tuple[int, float]]] = {}
    for group in groups:
        terms = [int(h) for h in word_hashes(list(group))]
        for a in terms:
            out.setdefault(a, []).extend((b, 1.0 / (len(terms) - 1)) for b in terms if b != a)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          max_train: int = MAX_TRAIN, groups=IDENTITY_GROUPS) -> Classifier:
    """Fits on labelled rows outside the held-out fold, at most about ``max_train``."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(
        F.col(key).alias("label_key"), F.col(label).cast("int").alias("label"))
    share = min(1.0, max_train / max(usable.count(), 1))
    drawn = usable.filter(F.pmod(F.xxhash64(F.lit(7), "label_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about max_train narrow rows: bounded, whatever the input
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text")).join(
        F.broadcast(drawn), F.col(key) == F.col("label_key"))
    partners = swap_partners(groups)
    rows = cut(rows.select(F.xxhash64("text").alias("kt"), F.when(F.col("label") != 0, 1).otherwise(0).alias("label"), "text").mapInArrow(
        _words_of(partners), "kt bigint, label int, words array<bigint>, swaps array<struct<a:bigint,b:bigint,both:boolean,n:double>>"))
    # sums of decimals: the same whatever the order of rows
    weight = (F.lit(1).cast("decimal(1,0)") / F.col("size").cast("decimal(10,0)")).cast("decimal(24,12)")
    rows = rows.join(rows.groupBy("kt").agg(F.count("*").alias("size")), "kt").withColumn("weight", weight)
    own = F.when(F.col("label") == 1, F.col("weight")).otherwise(F.lit(0).cast("decimal(24,12)"))
    total, positive = (float(x or 0) for x in rows.agg(F.sum("weight"), F.sum(own)).first())
    counts = rows.select(F.explode("words").alias("word"), "weight", own.alias("own")).groupBy("word").agg(
        F.sum("weight").cast("double").alias("n"), F.sum("own").cast("double").alias("n1"))
    n, n1 = F.col("n"), F.col("n1")
    spread = n * (total - n) * (positive * (total - positive))
    chi2 = F.when(spread > 0, total * F.pow(n1 * (total - positive) - (n - n1) * positive, F.lit(2.0)) / spread).otherwise(0.0)
    telling = (counts.withColumn("chi2", chi2).filter((n >= MIN_TEXTS) & (F.col("chi2") >= MIN_CHI2))
               .orderBy(F.desc("chi2"), "word").limit(MAX_FEATURES))
    features = np.array(sorted({r["word"] for r in telling.collect()} | set(partners)), np.int64)
    swaps = rows.select(F.explode("swaps").alias("s"), "weight").groupBy("s.a", "s.b", "s.both").agg(
        F.sum((F.col("weight") * F.col("s.n").cast("decimal(12,10)")).cast("decimal(30,16)")).cast("double").alias("n")).collect()
    kept = rows.select("kt", "label", F.col("weight").cast("double").alias("weight"),
                       F.array_intersect("words", F.lit(features.tolist()).cast("array<bigint>")).alias("words")).toArrow()
    at = np.lexsort((kept["label"].to_numpy(), kept["kt"].to_numpy()))
    y, unit, present = kept["label"].to_numpy(), kept["weight"].to_numpy(), kept["words"]
    return fit([(present[int(i)].values.to_numpy(), int(y[i]), float(unit[i])) for i in at], features,
               sorted((r["a"], r["b"], r["both"], r["n"]) for r in swaps))


def score(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, held_out, score and predicted."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1), powers))],
                                             names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
