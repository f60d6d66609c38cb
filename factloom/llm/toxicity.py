"""Toxicity by a classifier chain.

Categories are predicted in order; each linear (logistic) model sees the document's
features and the probabilities of the earlier categories. In training these come from
models that haven't seen the document (five folds), in use from the final models.

Features are present or not: lower-cased words without ASCII punctuation, and their
first 4 and 6 characters. The models are fitted on a bounded sample of labelled rows
(TRAIN_ROWS, by a hash of the id; rows of one hash count as one), with the FEATURES features of that sample most
associated with a category; all of every document is read for its score.

Defined results: null and empty texts have no features, so the model's prior; rows
with a null label are not learnt from; without rows of both classes a category has
probability 0; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import cut, fresh

TRAIN_ROWS = 20_000
FEATURES = 8192
FOLDS = 5
L2 = 0.5
THRESHOLD = 0.35
PREFIXES = (4, 6)
CHAIN = ("low_quality", "toxic")
#: For bytes of UTF-8, where those under 128 are ASCII.
_CLEAN = bytes(32 if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_set(text: str) -> set[str]:
    return set(text.encode().translate(_CLEAN).decode().lower().split())


def features(text: str) -> set[str]:
    words = word_set(text)
    found = set(words)
    for k in PREFIXES:
        found |= {f"{w[:k]}*{k}" for w in words if len(w) >= k}
    return found


class Entries:
    """Which features each row has: the rows' numbers of entries, and the entries' features one after another."""

    def __init__(self, lengths: np.ndarray, index: np.ndarray, block: int = 1 << 20):
        self.lengths, self.index = lengths, index.astype(np.int32)
        self.ends = np.r_[0, np.cumsum(lengths)]
        # Rows in blocks of so many entries, so that what a pass makes of them stays small.
        self.cuts = np.unique(np.r_[np.searchsorted(self.ends, np.arange(0, self.ends[-1] + 1, block)), len(lengths)])

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            yield slice(lo, hi), self.lengths[lo:hi], self.index[self.ends[lo] : self.ends[hi]]

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Of each row's weights."""
        out = np.zeros(len(self.lengths))
        for rows, n, index in self._blocks():
            out[rows] = np.bincount(np.repeat(np.arange(len(n)), n), w[index], len(n))
        return out

    def gathered(self, r: np.ndarray, size: int) -> np.ndarray:
        """Of each feature, the sum of r over its rows."""
        out = np.zeros(size)
        for rows, n, index in self._blocks():
            out += np.bincount(index, np.repeat(r[rows], n), size)
        return out


class Linear:
    """Logistic regression over sparse present-or-not features and a few dense ones, by limited-memory BFGS."""

    def __init__(self, n: int):
        self.w = np.zeros(n)
        self.known = False

    def fit(self, entries: Entries, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 60) -> "Linear":
        """dense: (rows, k); use: rows to learn from. The weights: features, dense, bias."""
        seen = y[use]
        if not len(seen) or seen.min() == seen.max():
            return self
        self.known = True
        k, size = dense.shape[1], len(self.w)

        def value(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = entries.sums(w) + dense @ w[size - k - 1 : size - 1] + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            loss = np.logaddexp(0, -np.where(y > 0, z, -z))[use].sum() + L2 / 2 * (w[:-1] ** 2).sum()
            r = np.where(use, p - y, 0.0)
            grad = entries.gathered(r, size)
            grad[size - k - 1 : size - 1] += dense.T @ r
            grad[-1] += r.sum()
            grad[:-1] += L2 * w[:-1]
            return loss, grad

        w = self.w
        w[-1] = np.log(seen.mean() / (1 - seen.mean()))
        loss, grad = value(w)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(steps):
            d, alphas = grad.copy(), []
            for s, g in reversed(past):
                alphas.append(s @ d / (s @ g))
                d -= alphas[-1] * g
            if past:
                d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
            else:
                d /= max(1.0, np.abs(grad).max())
            for (s, g), a in zip(past, reversed(alphas), strict=True):
                d += s * (a - (g @ d) / (s @ g))
            t = 1.0
            while t > 1e-6:
                new, new_grad = value(w - t * d)
                if new <= loss - 1e-4 * t * (grad @ d):
                    break
                t /= 2
            else:
                break
            s, g = -t * d, new_grad - grad
            if s @ g > 1e-10:
                past = [*past[-9:], (s, g)]
            w, shrunk = w + s, loss - new
            loss, grad = new, new_grad
            if shrunk < 1e-6 * abs(loss):
                break
        self.w = w
        return self

    def probability(self, sums: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Given the sums of the features' weights; 0 if nothing could be learnt."""
        if not self.known:
            return np.zeros(len(sums))
        k = dense.shape[1]
        return 1 / (1 + np.exp(-np.clip(sums + (dense @ self.w[-k - 1 : -1] if k else 0.0) + self.w[-1], -40, 40)))


class Chain:
    """One model per category; weights: (categories, features)."""

    def __init__(self, vocabulary: list[str], models: list[Linear]):
        # Words, and prefixes by their length: no word has an asterisk.
        self.place: dict[int | None, dict[str, int]] = {k: {} for k in (None, *PREFIXES)}
        for i, v in enumerate(vocabulary):
            name, _, k = v.partition("*")
            self.place[int(k) if k else None][name] = i
        self.models = models
        self.weights = np.stack([m.w[: len(vocabulary)] for m in models], axis=1) if models else np.zeros((0, 0))

    def known(self, text: str) -> list[int]:
        """Places of the text's features that the models know."""
        words, out = word_set(text), []
        for k, place in self.place.items():
            # A shorter word is no prefix of this length, so it isn't there.
            out += map(place.__getitem__, place.keys() & ({w[:k] for w in words} if k else words))
        return out

    def probabilities(self, found: list[list[int]]) -> np.ndarray:
        """(documents, categories)."""
        sums = np.stack([self.weights[f].sum(axis=0) for f in found]) if found else np.zeros((0, len(self.models)))
        out = np.zeros((len(sums), 0))
        for c, model in enumerate(self.models):
            out = np.c_[out, model.probability(sums[:, c], out)]
        return out


def train_chain(entries: Entries, labels: np.ndarray, fold: np.ndarray, vocabulary: list[str]) -> Chain:
    """labels: (rows, categories) of 0 and 1; fold: of each row."""
    n, v = len(labels), len(vocabulary)
    earlier, models = np.zeros((n, 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float64)
        size = v + earlier.shape[1] + 1
        models.append(Linear(size).fit(entries, earlier, y, np.ones(n, bool)))
        out = np.zeros(n)
        if c + 1 < labels.shape[1]:
            for f in range(FOLDS):
                part = Linear(size).fit(entries, earlier, y, fold != f)
                out[fold == f] = part.probability(entries.sums(part.w), earlier)[fold == f]
        earlier = np.c_[earlier, out]
    return Chain(vocabulary, models)


def fit(labelled: DataFrame, text_col: str, label_cols: list[str], key: str, train_rows: int = TRAIN_ROWS, n_features: int = FEATURES) -> Chain:
    """labelled: text and one 0/1 column per category; key: column whose hash draws the sample and the folds."""
    spark = labelled.sparkSession
    known = labelled.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.array(*[F.col(f"`{c}`").cast("int") for c in label_cols]).alias("y"), F.xxhash64(F.lit(7), F.col(f"`{key}`")).alias("h")
    ).where(~F.exists("y", lambda x: x.isNull()))
    drawn = known.select("h", "y", F.xxhash64("text").alias("t")).orderBy("h", "t").limit(train_rows)
    last = drawn.agg(F.max("h")).first()[0]
    if last is None:
        return Chain([], [Linear(1 + c) for c in range(len(label_cols))])
    sample = cut(known.where(F.col("h") <= last).groupBy("h").agg(F.min(F.struct("text", "y")).alias("x")).select("x.text", "x.y", "h"))
    k = len(label_cols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = defaultdict(lambda: [0] * (k + 1))
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                marks = [0, *[i + 1 for i in range(k) if y[i]]]
                for f in features(text):
                    of = found[f]
                    for m in marks:
                        of[m] += 1
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["f", "n"])

    counts = sample.select("text", "y").mapInArrow(count, "f string, n array<long>")
    sums = counts.groupBy("f").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(k + 1)]).where("n0 >= 3")
    rates = sample.agg(F.count(F.lit(1)), *[F.sum(F.col("y")[i]) for i in range(k)]).first()
    apart = []
    for i in range(1, k + 1):
        rate = min(max(rates[i] / rates[0], 1e-9), 1 - 1e-9)
        apart.append(F.abs(F.col(f"n{i}") - F.col("n0") * rate) / F.sqrt(F.col("n0") * rate * (1 - rate)))
    best = F.greatest(*apart) if k > 1 else apart[0]
    vocabulary = [r.f for r in sums.orderBy(best.desc(), "f").limit(n_features).select("f").collect()]
    shared = spark.sparkContext.broadcast(vocabulary)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {v: i for i, v in enumerate(shared.value)}
        for batch in batches:
            found = [[at[f] for f in at.keys() & features(t)] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["i", "y", "h"])

    matrix = sample.mapInArrow(place, "i array<int>, y array<int>, h long").toArrow().sort_by("h")  # rows come in any order
    lists = matrix.column("i").combine_chunks()
    labels = matrix.column("y").combine_chunks().flatten().to_numpy().reshape(-1, k)
    fold = np.abs(matrix.column("h").to_numpy() // 7) % FOLDS
    return train_chain(Entries(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()), labels, fold, vocabulary)


def predict(docs: DataFrame, chain: Chain, names: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and p_<name> of each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.known(t.as_py() or "") for t in batch.column(1)]
            p = own.probabilities(found)
            yield pa.record_batch([batch.column(0), *[pa.array(p[:, c]) for c in range(len(names))]], ["doc_id", *[f"p_{n}" for n in names]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Chain:
    """docs: doc_id, text; labels: doc_id, quality, toxic."""
    own = labels.select(F.col("doc_id").alias("label_id"), (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic_label"))
    # The sample is drawn before the join, so that texts of other labelled rows don't move.
    known = own.where("label_id IS NOT NULL AND low_quality IS NOT NULL AND toxic_label IS NOT NULL")
    h = F.xxhash64(F.lit(7), F.col("label_id"))
    last = known.select(h.alias("h")).orderBy("h").limit(TRAIN_ROWS).agg(F.max("h")).first()[0]
    known = known.where(h <= (last if last is not None else 0)).hint("merge")
    texts = docs.select("doc_id", "text").where(F.xxhash64(F.lit(7), F.col("doc_id")) <= (last if last is not None else 0))
    joined = texts.join(known, texts["doc_id"] == known["label_id"])
    return fit(joined, "text", ["low_quality", "toxic_label"], "doc_id")


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose last category's probability is under the threshold; all columns unchanged."""
    names = docs.columns
    score = fresh(docs, "p_toxic")
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.known(t.as_py() or "") for t in batch.column(at)]
            p = own.probabilities(found)[:, -1]
            yield pa.record_batch([*batch.columns, pa.array(p)], [*names, score])

    return docs.mapInArrow(run, schema).where(F.col(score) < threshold).drop(score)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, chain, CHAIN).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
