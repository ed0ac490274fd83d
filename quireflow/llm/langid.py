"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all labelled rows. The regression is fitted by follow-the-regularised-leader
(per-coordinate, elastic net) on a bounded sample of labelled rows, then calibrated by a temperature found on a held-back
part of that sample. Scoring is one shuffle-free pass over whole texts.

Defined results: a null text, and one without a letter, is ``und`` with score 0; with no labelled row at all every text is
``und``. Ties between languages go to the first by code point. Repeated rows each get their own row. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, map_texts

UNDETERMINED = "und"
#: log2 of the number of hashed n-gram features; n-grams of 1 to MAX_N characters.
FEATURE_BITS, MAX_N = 15, 3
#: At most about this many labelled rows, shared by the languages, fit the regression, and at least FLOOR of each.
SAMPLE_ROWS, SAMPLE_FLOOR = 2_400, 50
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    """Languages, inverse document frequencies, weights (features x languages), intercepts and the temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (tfidf(idx, counts, self.idf) @ self.weights[idx] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features of the lower-cased whole text and how often each occurs."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(1 << FEATURE_BITS, np.int64)
    shift = np.uint32(32 - FEATURE_BITS)
    for at in range(0, len(points), 1 << 20):  # a window at a time; windows overlap by MAX_N - 1
        window = points[at : at + (1 << 20) + MAX_N - 1]
        grams = window
        for n in range(1, MAX_N + 1):
            if n > 1:
                grams = grams[:-1] * np.uint32(0x01000193) + window[n - 1 :]
            own = grams[: min(len(grams), 1 << 20)]
            total += np.bincount(((own + np.uint32(n * 7919)) * np.uint32(2654435761)) >> shift, minlength=1 << FEATURE_BITS)
    idx = np.flatnonzero(total)
    return idx, total[idx]


def tfidf(idx: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[idx]
    return x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(labelled: DataFrame, text_col: str) -> np.ndarray:
    """How many of all the labelled texts have each feature; each task sums its own rows before the shuffle."""

    def partial(batches):
        import pyarrow as pa

        total = np.zeros(1 << FEATURE_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[ngram_counts(text.as_py())[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    rows = labelled.select(text_col).mapInArrow(partial, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << FEATURE_BITS, np.int64)
    for feature, n in rows:  # at most 2 ** FEATURE_BITS rows
        out[feature] = n
    return out


def ftrl(examples, n_features: int, n_classes: int, epochs=4, alpha=0.6, beta=1.0, l1=0.0005, l2=0.0005, seed=7):
    """Follow-the-regularised-leader, proximal, for a softmax; weights come from z and n of the touched rows only."""
    z, n = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))

    def solve(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            idx, x, y = examples[i]
            at, x = np.append(idx, n_features), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = solve(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = np.outer(x, p)
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    w = solve(z, n)
    return w[:-1], w[-1]


def calibrate(model: LanguageModel, examples) -> float:
    """The temperature with the least log loss on examples that the regression has not seen."""
    if not examples:
        return 1.0
    z = np.array([x @ model.weights[idx] + model.bias for idx, x, _ in examples])
    y = np.array([y for *_, y in examples])

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean() + 1e-3 * abs(np.log(t))

    return float(min(np.geomspace(0.1, 10.0, 81), key=loss))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fit on labelled rows (rows with a null text or label are passed over). None if no row is left."""
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs, total = sorted(sizes), sum(sizes.values())
    quota = max(SAMPLE_FLOOR, sample_rows // len(langs))
    part: Column = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, 1.3 * quota / sizes[k]))])[F.col("lang")]
    chosen = map_texts(
        labelled.withColumn("h", hash_fraction(F.col("id").cast("string"), F.col("lang"))).where(F.col("h") < part), "text",
        lambda: lambda texts: [list(x) for x in zip(*[(i.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()) for i, c in map(ngram_counts, texts)], strict=True)],
        [("idx", "binary"), ("counts", "binary")], ["id", "lang", "h"],
    ).collect()  # about the sample, as sparse features
    df = document_frequencies(labelled, "text")
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    seen: dict[str, int] = {}
    examples = []
    for r in sorted(chosen, key=lambda r: (r["h"], str(r["id"]), bytes(r["idx"]), bytes(r["counts"]))):
        if seen.setdefault(r["lang"], 0) < quota:
            seen[r["lang"]] += 1
            idx = np.frombuffer(r["idx"], np.int32)
            examples.append((idx, tfidf(idx, np.frombuffer(r["counts"], np.int32), idf), langs.index(r["lang"])))
    train, held = [e for i, e in enumerate(examples) if i % 5], examples[::5]
    weights, bias = ftrl(train or examples, len(idf), len(langs))
    model = LanguageModel(langs, idf, weights.astype(np.float32), bias)
    model.temperature = calibrate(model, held if train else [])
    return model


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep=("doc_id",), names=("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns with the predicted language and its calibrated probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** FEATURE_BITS rows by the number of languages

    def make_kernel():
        m = shared.value

        def one(text):
            if m is None or text is None or not LETTER.search(text):
                return UNDETERMINED, 0.0
            p = m.probabilities(*ngram_counts(text))
            best = int(p.argmax())
            return m.langs[best], float(min(1.0, p[best]))

        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)]

    return map_texts(docs, text_col, make_kernel, [(names[0], "string"), (names[1], "double")], list(keep), null_text=None)
