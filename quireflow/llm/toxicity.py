"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with word boundaries) and of the word itself, all hashed into
one table; a segment of about SEGMENT words is the mean of its words; a softmax reads that mean. Table and softmax are
trained together, so a misspelling that was never seen shares most of its n-gram vectors with the word it comes from. A
whole text is as toxic as its most toxic segment; averaging over all of a long text would bury a few words. Labels are of
texts, so training lets the highest segments of a toxic text, and all segments of a clean one, carry its label.

Because everything before the softmax is a mean, a word adds a fixed amount to the class margin: scoring adds these up.

Defined results: a null or empty text, or one without a word, is scored from the intercept alone; with no labelled row at
all every score is 0. Repeated rows each get their own row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, map_texts

WORD = re.compile(r"\w+")
#: log2 of the rows of the vector table, its width, the lengths of the n-grams and the words of a segment.
BUCKET_BITS, DIM, MIN_N, MAX_N, SEGMENT = 17, 8, 3, 6, 8
#: The classifier is fitted on at most about this many labelled rows of each class, none longer than SAMPLE_BYTES (longer
#: rows are passed over by the sample, never cut; scoring reads every text whole).
SAMPLE_ROWS, SAMPLE_BYTES = 1_600, 20_000
#: Margins of at most so many words are kept by a worker; words looked up at once; characters of new words hashed at once.
CACHE_WORDS, BATCH_WORDS, BATCH_CHARS = 200_000, 20_000, 200_000
#: Of words this long the n-grams are hashed in pieces.
LONG = 10_000


@dataclass
class ToxicityModel:
    """Vectors of the subwords, and the softmax as the difference between its two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self) -> np.ndarray:
        return self.vectors @ self.weights

    def rescaled(self, scale: float, shift: float) -> ToxicityModel:
        return ToxicityModel(self.vectors, self.weights * scale, self.bias * scale + shift)


class Margins(dict):
    """The class margins of words, kept for words seen before; new ones are taken many at a time."""

    def __init__(self, of_bucket: np.ndarray):
        self.of_bucket = of_bucket

    def learn(self, words: list[str]) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = set(words)
        part, chars = [], 0
        for word in new:
            if len(word) >= LONG:
                self[word] = long_margin(word, self.of_bucket)
                continue
            part.append(word)
            chars += len(word)
            if chars >= BATCH_CHARS:
                self.update(zip(part, word_margins(part, self.of_bucket).tolist(), strict=True))
                part, chars = [], 0
        if part:
            self.update(zip(part, word_margins(part, self.of_bucket).tolist(), strict=True))

    def of_words(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for at in range(0, len(words), BATCH_WORDS):
            part = words[at : at + BATCH_WORDS]
            self.learn(part)
            out[at : at + len(part)] = np.fromiter(map(self.__getitem__, part), np.float64, len(part))
        return out

    def of_texts(self, texts: list[str]) -> list[float]:
        """The margin of the most toxic segment of each text, without the intercept."""
        out, words, sizes = [], [], []
        for text in texts:
            found = WORD.findall(text.lower())
            words += found
            sizes.append(len(found))
            if len(words) >= BATCH_WORDS:
                out += self.highest(words, sizes)
                words, sizes = [], []
        return out + self.highest(words, sizes)

    def highest(self, words: list[str], sizes: list[int]) -> list[float]:
        out, margins, of = [], self.of_words(words), 0
        for n in sizes:
            at = bounds(n)
            out.append(float((np.add.reduceat(margins[of : of + n], at) / np.diff(np.append(at, n))).max()) if n else 0.0)
            of += n
        return out


def calibrate(model: ToxicityModel, texts: list[str], labels: list[int], shares: dict[int, float], steps=25) -> ToxicityModel:
    """Scale and shift of the margin of whole texts, by Newton steps on texts not trained on; ``shares`` weighs the classes."""
    margins = Margins(model.margins())
    z = np.clip(np.array(margins.of_texts(texts)) + model.bias, -30, 30)
    x, y, w = np.stack([z, np.ones_like(z)], 1), np.array(labels, float), np.array([shares[v] for v in labels])
    w = w / w.mean()
    at, prior = np.array([1.0, 0.0]), np.diag([0.5, 0.05])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (w * (p - y)) + prior @ (at - [1.0, 0.0])
        at = at - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + prior, grad)
    return model.rescaled(*at) if np.isfinite(at).all() and at[0] > 0 else model


def subwords(word: str) -> list[int]:
    """Buckets of the whole word and of its character n-grams."""
    s = f"<{word}>"
    mask = (1 << BUCKET_BITS) - 1
    out = [crc32(s.encode("utf-8", "replace")) & mask]
    for n in range(MIN_N, MAX_N + 1):
        out += [crc32(s[i : i + n].encode("utf-8", "replace")) & mask for i in range(len(s) - n + 1)]
    return out


def crc_table() -> np.ndarray:
    """Remainders of the 256 bytes, for CRC-32 a byte at a time."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = crc_table()


def fed(state: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """CRC-32 states after one more character each, in UTF-8."""
    def byte(state, b):
        return CRC[(state ^ b) & 0xFF] ^ (state >> 8)

    wide = np.flatnonzero(codes >= 0x80)
    if not len(wide):
        return byte(state, codes)
    c = codes[wide]
    lead = codes.copy()
    lead[wide] = np.select([c < 0x800, c < 0x10000], [0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18)
    state = byte(state, lead)
    for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
        at = wide[c >= least]
        state[at] = byte(state[at], 0x80 | codes[at] >> shift & 0x3F)
    return state


def word_margins(words: list[str], margins: np.ndarray) -> np.ndarray:
    """For each word the mean of the margins of its ``subwords``; n-grams that begin anywhere are hashed together."""
    tagged, mask = [f"<{w}>" for w in words], (1 << BUCKET_BITS) - 1
    codes = np.frombuffer("".join(tagged).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes >> 11 == 0x1B, np.uint32(ord("?")), codes)  # as "replace" does
    sizes = np.fromiter(map(len, tagged), np.int64, len(tagged))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    at, state, sums = np.arange(len(codes)), np.full(len(codes), 0xFFFFFFFF, np.uint32), np.zeros(len(codes))
    for n in range(1, MAX_N + 1):
        if n > 1:
            within = left[at] >= n
            at, state = at[within], state[within]
        state = fed(state, codes[at + (n - 1)])
        if n >= MIN_N:
            sums[at] += margins[~state & mask]
    whole = margins[np.fromiter((crc32(s.encode("utf-8", "replace")) & mask for s in tagged), np.int64, len(tagged))]
    counts = 1 + sum(np.maximum(sizes - n + 1, 0) for n in range(MIN_N, MAX_N + 1))
    return (np.add.reduceat(sums, ends - sizes) + whole) / counts


def bounds(n_words: int) -> np.ndarray:
    """Starts of the segments of a text: of near equal length, one at least."""
    k = max(1, round(n_words / SEGMENT))
    return np.arange(k) * n_words // k


def train(texts: list[str], labels: list[int], epochs=6, rate=0.4, top=0.12, seed=11) -> ToxicityModel:
    """Joint training by Adagrad over batches of segments."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    words, starts, owner, of = [], [], [], 0
    for d, text in enumerate(texts):
        own = [vocab.setdefault(w, len(vocab)) for w in WORD.findall(text.lower())]
        if own:
            at = bounds(len(own))
            words.append(np.array(own, np.int64))
            starts.append(at + of)
            owner.append(np.full(len(at), d))
            of += len(own)
    vectors, weights, bias = rng.normal(0, 0.05, (1 << BUCKET_BITS, DIM)), rng.normal(0, 1.0, DIM), 0.0
    if not words:
        return ToxicityModel(vectors, weights, bias)
    tokens, starts, owner = np.concatenate(words), np.concatenate(starts), np.concatenate(owner)
    ends = np.append(starts[1:], len(tokens))
    grams = [subwords(w) for w in vocab]
    sizes = np.array([len(g) for g in grams])
    flat, first = np.concatenate([np.array(g) for g in grams]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    y = np.array(labels)[owner]
    seen_v, seen_w, seen_b = np.full(vectors.shape, 1e-10), np.full(DIM, 1e-10), 1e-10

    def ranges(begin, length):
        """The positions begin[i] .. begin[i] + length[i] - 1, one range after the other."""
        at = np.cumsum(length) - length
        return np.arange(length.sum()) + np.repeat(begin - at, length)

    def forward(segments):
        length = ends[segments] - starts[segments]
        used, slot = np.unique(tokens[ranges(starts[segments], length)], return_inverse=True)
        at = flat[ranges(first[used], sizes[used])]
        word = np.add.reduceat(vectors[at], np.cumsum(sizes[used]) - sizes[used], axis=0) / sizes[used][:, None]
        mean = np.add.reduceat(word[slot], np.cumsum(length) - length, axis=0) / length[:, None]
        return length, used, slot, at, mean, mean @ weights + bias

    share = np.where(y == 1, 0.3, 1.0)
    for epoch in range(epochs):
        if epoch:
            z = np.concatenate([forward(part)[-1] for part in np.array_split(np.arange(len(starts)), len(starts) // 4096 + 1)])
            share = np.where(y == 1, 0.0, 1.0)
            for d in np.unique(owner[y == 1]):
                lo, hi = np.searchsorted(owner, [d, d + 1])
                k = max(1, int(np.ceil(top * (hi - lo))))
                best = lo + np.argsort(-z[lo:hi], kind="stable")[:k]
                if epoch < 3 or z[best[0]] > -1.0:  # later on, a label that no segment bears out is taken for noise
                    share[best] = 1.0
        for part in np.array_split(p := rng.permutation(np.flatnonzero(share)), len(p) // 512 + 1):
            length, used, slot, at, mean, z = forward(part)
            slope = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[part]) * share[part]
            of_word = np.repeat(slope / length, length)
            per = np.repeat(np.bincount(slot, of_word, len(used)) / sizes[used], sizes[used])
            g = np.bincount(at, per, 1 << BUCKET_BITS)
            rows = np.flatnonzero(g)
            gv, gw = np.outer(g[rows], weights), slope @ mean
            seen_v[rows] += gv * gv
            vectors[rows] -= rate * gv / np.sqrt(seen_v[rows])
            seen_w += gw * gw
            weights = weights - 0.1 * rate * gw / np.sqrt(seen_w)
            seen_b += slope.sum() ** 2
            bias -= 0.1 * rate * slope.sum() / np.sqrt(seen_b)
    return ToxicityModel(vectors, weights, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel | None:
    """Fit on documents labelled 0 or 1 (other labels and null texts are passed over). None if no row is left.

    The sample is drawn from the labels alone, so it is its few ids that travel to the documents and no text is shuffled.
    An id that is labelled more than once counts by its greatest label.
    """
    seen = labels.select(F.col(id_col).alias("sample_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("sample_id").isNotNull())
    seen = seen.groupBy("sample_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    part = F.create_map(*[F.lit(v) for k in sorted(sizes) for v in (k, min(1.0, sample_rows / sizes[k]))])[F.col("y")]
    ids = seen.where(hash_fraction(F.col("sample_id").cast("string"), F.col("y")) < part)  # about SAMPLE_ROWS of each class
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    chosen = texts.join(F.broadcast(ids), F.col("id") == F.col("sample_id")).select("id", "text", "y").collect()
    if not chosen:
        return None
    chosen = sorted(chosen, key=lambda r: (crc32(str(r["id"]).encode()), r["y"], r["text"]))
    held = chosen[::4] if sum(r["y"] for r in chosen) >= 20 else []
    used = [r for i, r in enumerate(chosen) if i % 4] if held else chosen
    model = train([r["text"] for r in used], [r["y"] for r in used])
    if len({r["y"] for r in held}) < 2:
        return model
    taken = {y: max(1, sum(r["y"] == y for r in chosen)) for y in sizes}
    return calibrate(model, [r["text"] for r in held], [r["y"] for r in held], {y: sizes[y] / taken[y] for y in sizes})


def score(docs: DataFrame, model: ToxicityModel | None, text_col="text", keep=("doc_id",), name="score") -> DataFrame:
    """The ``keep`` columns and the probability that the whole text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.margins().astype(np.float32), float(model.bias)))

    def make_kernel():
        if shared.value is None:
            return lambda texts: [[0.0] * len(texts)]
        margins, bias = shared.value

        known = Margins(margins)

        return lambda texts: [1.0 / (1.0 + np.exp(-np.clip(bias + np.array(known.of_texts(texts)), -30, 30)))]

    return map_texts(docs, text_col, make_kernel, [(name, "double")], list(keep))


def long_margin(word: str, margins: np.ndarray) -> float:
    """The same mean for a very long run, its n-grams in bounded pieces."""
    s, mask = f"<{word}>", (1 << BUCKET_BITS) - 1
    total, n_grams = float(margins[crc32(s.encode("utf-8", "replace")) & mask]), 1
    for n in range(MIN_N, MAX_N + 1):
        for at in range(0, len(s) - n + 1, 10_000):
            ids = [crc32(s[i : i + n].encode("utf-8", "replace")) & mask for i in range(at, min(at + 10_000, len(s) - n + 1))]
            total, n_grams = total + float(margins[ids].sum(dtype=np.float64)), n_grams + len(ids)
    return total / n_grams
