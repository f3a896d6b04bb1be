"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training documents. The weights are fitted on a bounded number
of documents of each language by follow-the-regularised-leader with elastic-net penalties, which
leaves most of them zero; a temperature fitted on documents kept aside calibrates the probabilities.
Prediction is one pass over whole texts with the weights, whose size does not depend on the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import documents, packed, slices, unpacked

#: Hashed n-grams of one to three characters.
DIMENSIONS = 1 << 14
ORDERS = (1, 2, 3)
#: Documents of each language that the weights are fitted on, at most.
SAMPLE_PER_LANGUAGE = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
UNDETERMINED = "und"
#: Rows turned into a dense matrix at a time.
_ROWS = 128


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text, in lower case; n-grams never cross texts."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], dtype=np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    counts = np.zeros(len(texts) * DIMENSIONS, dtype=np.float32)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the end of the text
    rolled = np.zeros(len(codes), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        keep = len(codes) - order + 1
        if keep <= 0:
            break
        rolled = rolled[:keep] * np.uint32(0x01000193) + codes[order - 1 :] + np.uint32(order)
        if order in ORDERS:
            spread = rolled * np.uint32(0x9E3779B1)
            bucket = row[:keep] * DIMENSIONS + (spread >> np.uint32(32 - 14)).astype(np.int64)
            counts += np.bincount(bucket[left[:keep] >= order], minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(texts), DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times inverse document frequency, at unit length."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _frequencies(batches):
    """Each task's number of documents, at bucket -1, and of those with each bucket."""
    total, seen = 0, np.zeros(DIMENSIONS, dtype=np.int64)
    for part in slices(batches):
        texts = [t or "" for t in part.column("text").to_pylist()]
        for at in range(0, len(texts), _ROWS):
            seen += (ngram_counts(texts[at : at + _ROWS]) > 0).sum(axis=0)
        total += len(texts)
    bucket = np.concatenate([[-1], np.flatnonzero(seen)])
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array(bucket, pa.int64()), "n": pa.array(np.concatenate([[total], seen[bucket[1:]]]), pa.int64()),
    })


def _features(batches):
    for part in slices(batches):
        texts = [t or "" for t in part.column("text").to_pylist()]
        index, value = [], []
        for at in range(0, len(texts), _ROWS):
            for counts in ngram_counts(texts[at : at + _ROWS]):
                index.append(np.flatnonzero(counts))
                value.append(counts[index[-1]])
        yield pa.RecordBatch.from_pydict({
            "lang": part.column("lang"), "key": part.column("key"),
            "index": pa.array(index, pa.list_(pa.int32())), "value": pa.array(value, pa.list_(pa.float32())),
        })


def softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader with a rate for each weight, for multinomial logistic loss."""

    def __init__(self, dimensions: int, classes: int):
        self.z = np.zeros((dimensions, classes))
        self.n = np.zeros((dimensions, classes))

    def weights(self, index=slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p[None, :]
        squared = self.n[index] + g * g
        rate = (np.sqrt(squared) - np.sqrt(self.n[index])) / ALPHA
        self.z[index] += g - rate * w
        self.n[index] = squared


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest, by golden section on its logarithm.

    The right label counts a little less than 1, so that documents all told apart do not make
    every probability 1.
    """
    if not len(labels):
        return 1.0
    sure = (len(labels) + 1) / (len(labels) + 2)

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        right = np.clip(p[np.arange(len(labels)), labels], 1e-12, 1 - 1e-12)
        return float(-(sure * np.log(right) + (1 - sure) * np.log1p(-right)).mean())

    low, high, golden = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability; ``und`` and 0 for a text that is null or has no letters."""
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for at in range(0, len(known), _ROWS):
            chosen = known[at : at + _ROWS]
            x = weighted(ngram_counts([texts[i] for i in chosen]), self.idf)
            p = softmax(x @ self.weights / self.temperature)
            for i, best, row in zip(chosen, p.argmax(axis=1).tolist(), p):
                names[i], score[i] = self.languages[best], row[best]
        return names, score


def train(docs: DataFrame, *, training: Column, doc_id="doc_id", text="text", lang="lang") -> LanguageModel:
    """Fit on documents where ``training`` holds and the language is not null.

    The sample of a language is the documents with the smallest hash of their doc_id (which chooses, and
    is no input); every fifth is kept aside for the temperature. Without any there is no language to predict.
    """
    chosen = docs.where(training & F.col(lang).isNotNull())
    key = F.xxhash64(F.col(doc_id).cast("string"))
    keys = chosen.select(F.col(lang).cast("string").alias("lang"), key.alias("key"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    limits = (
        keys.withColumn("_place", place).where(F.col("_place") <= SAMPLE_PER_LANGUAGE)
        .groupBy("lang").agg(F.max("key").alias("_most"))
    )
    rows = documents(chosen.withColumn("_lang", F.col(lang).cast("string")).withColumn("_key", key), "_lang", "_key", doc_id=doc_id, text=text)
    rows = rows.select("text", F.col("_lang").alias("lang"), F.col("_key").alias("key"))
    frequency = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in frequency.collect()}  # a row for each dimension at most
    total = found.pop(-1, 0)
    seen = np.zeros(DIMENSIONS)
    seen[list(found)] = list(found.values())
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    # A limit for each language, put into the scan: nothing is shuffled to draw the sample.
    within = F.lit(False)
    for r in limits.collect():
        within = within | ((F.col("lang") == r["lang"]) & (F.col("key") <= r["_most"]))
    sample = rows.where(within).select("text", "lang", "key")
    drawn = sample.mapInArrow(_features, "lang string, key long, index array<int>, value array<float>")
    # Rows that repeat a doc_id share its hash: the limit holds for them too.
    again = F.row_number().over(Window.partitionBy("lang").orderBy("key", "index", "value"))
    bounded = drawn.withColumn("_place", again).where(F.col("_place") <= SAMPLE_PER_LANGUAGE)
    taken = sorted(bounded.collect(), key=lambda r: (r["key"], r["lang"], r["index"]))
    languages = sorted({r["lang"] for r in taken})
    model = Ftrl(DIMENSIONS, max(1, len(languages)))
    examples = []
    for r in taken:
        index = np.array(r["index"], dtype=np.int64)
        value = np.log1p(np.array(r["value"], dtype=np.float64)) * idf[index]
        norm = np.sqrt((value * value).sum())
        examples.append((index, value / norm if norm else value, languages.index(r["lang"])))
    aside = [x for i, x in enumerate(examples) if i % 5 == 4]
    for _ in range(EPOCHS):
        for i, (index, value, label) in enumerate(examples):
            if i % 5 != 4:
                model.learn(index, value, label)
    weights = model.weights()
    scores = np.array([value @ weights[index] for index, value, _ in aside]).reshape(len(aside), weights.shape[1])
    temperature = fit_temperature(scores, np.array([label for _, _, label in aside], dtype=np.int64))
    return LanguageModel(languages, idf, weights.astype(np.float32), temperature)


def _predict(model: LanguageModel):
    def predict(batches):
        for part in slices(batches):
            names, score = model.predict(part.column("text").to_pylist())
            columns = {name: part.column(name) for name in part.rows.schema.names}
            columns["lang_pred"] = pa.array(names, pa.string())
            columns["score"] = pa.array(score, pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return predict


def identify(docs: DataFrame, model: LanguageModel, *, doc_id="doc_id", text="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns in ``keep``, lang_pred and score of every whole text.

    A text that is null, empty or without letters is ``und`` with score 0. Repeated rows each get theirs.
    """
    rows = documents(docs, *keep, doc_id=doc_id, text=text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_predict(model), f"{fields}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept for testing: a third of them, by a checksum of the doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, model: LanguageModel, *, text="text", min_score: float = 0.5) -> DataFrame:
    """Documents with a language of at least this probability, all columns as they were."""
    found = identify(packed(docs, text=text), model, keep=("row",))
    good = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return unpacked(good, docs.columns, text=text)
