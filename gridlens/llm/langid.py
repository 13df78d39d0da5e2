"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and split into letter runs; a word stands for itself and its
character n-grams (2 to 5, with boundary marks), each hashed to a row of an
embedding table.  The text's vector is the mean of all rows of all its words;
a linear layer and a softmax give language probabilities.

Training is stochastic gradient descent in numpy on a bounded sample of
labelled rows of every label (``max_train`` in all, by the hash of their id), the only bounded
part.  One tenth of the sample is held back to calibrate: a temperature
is fitted there, and the rejection threshold is the largest one up to
``strictest`` that still accepts ``accept`` of its texts.  Prediction covers every whole text: since
the layers are linear, a word's summed embedding times the layer is one small vector, kept
per worker for words seen before; words and texts are summed column-wise, many at a time.

Null texts and texts without letters get ``und`` and score 0.  Repeated rows get
equal predictions.  Null labels are never trained on; with no labelled rows every text is
``und``.  The model's size is fixed by its parameters, not by the data.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

#: rows of each label that are trained on at least, where it has them
LEAST = 20
_WORD = regex.compile(r"\p{L}+")


def subwords(word: str, buckets: int, low: int = 2, high: int = 5) -> list[int]:
    w = f"<{word}>"
    grams = [w] + [w[i:i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


_CRC = np.arange(256, dtype=np.uint32)  # checksum of one byte, for many n-grams at once
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def subwords_of(words: list[str], buckets: int, low: int = 2, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(place of its word, bucket) of all subwords of some words, column-wise; as ``subwords`` a word."""
    marked = [f"<{w}>" for w in words]
    text = "".join(marked)
    code, raw = np.frombuffer(text.encode("utf-32-le"), "<u4"), np.frombuffer(text.encode(), np.uint8)
    width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64)
    start = np.cumsum(width) - width
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # characters up to the word's end
    places = [np.arange(len(marked))]
    found = [np.fromiter((zlib.crc32(w.encode()) % buckets for w in marked), np.int64, len(marked))]
    at, state = np.arange(len(code)), np.full(len(code), 0xFFFFFFFF, np.uint32)
    for n in range(1, high + 1):
        go = left[at] >= n
        at, state = at[go], state[go]
        last = at + n - 1
        for k in range(4):
            more = slice(None) if k == 0 else np.flatnonzero(width[last] > k)
            s = state[more]
            state[more] = _CRC[(s ^ raw[start[last[more]] + k]) & 0xFF] ^ s >> 8
        if n >= low:
            places.append(word[at])
            found.append((~state).astype(np.int64) % buckets)
    return np.concatenate(places), np.concatenate(found)


class WordScores:
    """Summed scores and number of subwords of each word, kept for words seen before."""

    def __init__(self, scores: np.ndarray, held_bytes: int = 16 << 20):
        self.scores, self.columns = scores, scores.shape[1] + 1
        self.limit = max(1000, held_bytes // (8 * self.columns))
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, self.columns))

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.place)
        if len(self.place) + len(new) > self.limit:
            self.place.clear()
            new = words
        rows, part, size = [self.rows[:len(self.place)]], [], 0
        for w in new:
            self.place[w] = len(self.place)
            part.append(w)
            size += len(w)
            if size >= 1 << 16:
                rows.append(self.measure(part))
                part, size = [], 0
        if part:
            rows.append(self.measure(part))
        self.rows = np.concatenate(rows)

    def measure(self, words: list[str]) -> np.ndarray:
        place, bucket = subwords_of(words, len(self.scores))
        return np.stack([*(np.bincount(place, self.scores[bucket, c], len(words)) for c in range(self.columns - 1)),
                         np.bincount(place, minlength=len(words))], 1)

    def totals(self, texts: list[list[str]], step: int = 1 << 19) -> np.ndarray:
        """One row per text: the sum over its words."""
        flat = [w for words in texts for w in words]
        of = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
        out = np.zeros((len(texts), self.columns))
        for k in range(0, len(flat), step):
            part = flat[k:k + step]
            self.learn(set(part))
            rows = self.rows[np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))]
            for c in range(self.columns):
                out[:, c] += np.bincount(of[k:k + step], rows[:, c], len(texts))
        return out


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray        # buckets x dim
    layer: np.ndarray        # dim x labels
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, words: dict[str, int]) -> np.ndarray:
        """words: word -> count, not empty."""
        ids, weight = [], []
        for w, n in words.items():
            got = subwords(w, len(self.table))
            ids += got
            weight += [n] * len(got)
        weight = np.array(weight, np.float64)
        mean = weight @ self.table[ids] / weight.sum()
        return mean @ self.layer + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def train(rows: list[tuple[str, str]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 2, rate: float = 2.0,
          span: int = 25, accept: float = 0.99,
          strictest: float = 0.9, seed: int = 1) -> Model | None:
    """Fit on (text, label) pairs; None if no text has letters.

    Every text is cut into spans of ``span`` words, one gradient step each, so that
    short texts are learnt as well as long ones."""
    labels = sorted({y for _, y in rows})
    number = {y: k for k, y in enumerate(labels)}
    memo: dict[str, np.ndarray] = {}
    data = []
    for text, y in rows:
        words = words_of(text)
        if words:
            for w in words:
                if w not in memo:
                    memo[w] = np.array(subwords(w, buckets), np.int32)
            spans = [words[k:k + span] for k in range(0, len(words), span)]
            data.append(([np.concatenate([memo[w] for w in part]) for part in spans], number[y]))
    if not data:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held = [data[i] for i in order[: len(data) // 10]] if len(data) >= 50 else data
    fit = [data[i] for i in order[len(data) // 10:]] if len(data) >= 50 else data
    table = rng.normal(0, 1 / np.sqrt(dim), (buckets, dim))
    layer, bias = np.zeros((dim, len(labels))), np.zeros(len(labels))
    steps = [(ids, y) for parts, y in fit for ids in parts]
    step, total = 0, epochs * len(steps)
    for _ in range(epochs):
        for i in rng.permutation(len(steps)):
            ids, y = steps[i]
            lr = rate * (1 - step / total)
            step += 1
            mean = table[ids].mean(0)
            g = _softmax(mean @ layer + bias)
            g[y] -= 1
            back = layer @ g
            layer -= lr * np.outer(mean, g)
            bias -= 0.01 * lr * g
            np.subtract.at(table, ids, lr / len(ids) * back)
    model = Model(labels, table, layer, bias)
    z = np.array([table[np.concatenate(parts)].mean(0) @ layer + bias for parts, _ in held])
    y = np.array([k for _, k in held])
    grid = np.geomspace(1, 20, 41)  # logits are divided by it
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    top = np.sort(_softmax(z / model.temperature).max(1))
    model.reject_below = min(strictest, float(top[min(len(top) - 1, int((1 - accept) * len(top)))]))
    return model


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int, per_text: int) -> list[tuple[str, str]]:
    """A bounded number of labelled rows of every label, the same on every run.

    Rows are taken by turns from the labels, in each by id hash, so that all have
    as many as they can: ``max_train`` rows, or more if that is less than
    ``LEAST`` of each label.  Of a text over ``per_text`` characters a span of that length is
    taken (whole ones would not bound the driver's memory), at a place its hash
    gives; prediction takes every length."""
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("t"), F.col(label_col).alias("y"), F.xxhash64(F.col(id_col)).alias("k"), F.xxhash64(text_col).alias("h"))
    n = max(max_train, LEAST * rows.agg(F.count_distinct("y").alias("n")).first()["n"])
    # only hashes are ranked, equal rows once, and in parts of a label before the label as a whole
    first = rows.select("y", "k", "h").distinct().withColumn("part", F.pmod("h", F.lit(8)))
    for keys in (["y", "part"], ["y"]):
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy("k", "h"))
        first = first.withColumn("turn", turn).where(F.col("turn") <= max_train)
    chosen = df.sparkSession.createDataFrame(
        first.orderBy("turn", "k", "h", "y").limit(n).select("y", "k", "h").collect(), "y string, k long, h long")
    spare = F.length("t") - per_text
    start = F.when(spare > 0, F.pmod("h", spare + 1)).otherwise(0).cast("int")
    span = F.substring("t", start + 1, F.lit(per_text))
    whole = F.regexp_replace(span, r"^\p{L}+|\p{L}+$", "")  # without the words that are cut, if others are left
    text = F.when(spare <= 0, F.col("t")).when(whole.rlike(r"\p{L}"), whole).otherwise(span)
    got = rows.join(F.broadcast(chosen), ["y", "k", "h"], "left_semi").dropDuplicates(["y", "k", "h"]).select(
        text.alias("t"), "y", "k", "h").collect()
    return [(r["t"], r["y"]) for r in sorted(got, key=lambda r: (r["k"], r["h"], r["y"]))]


def predict(df: DataFrame, id_col: str, text_col: str, model: Model | None) -> DataFrame:
    """(id, lang_pred, score, rejected): rejected texts score below the calibrated threshold."""
    schema = pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    spark = df.sparkSession
    if model is not None:
        # linear layers: a bucket needs only its row times the layer
        model_small = (model.labels, (model.table @ model.layer).astype(np.float32), model.bias, model.temperature,
                       model.reject_below)
        shared = spark.sparkContext.broadcast(model_small)  # buckets x labels floats, fixed by the parameters
    else:
        shared = None

    def run(rows):
        if shared is None:
            for i, _ in rows:
                yield i, "und", 0.0, True
            return
        labels, scores, bias, temperature, low = shared.value
        known = WordScores(scores)

        def judged(ids, texts):
            total = known.totals(texts)
            p = _softmax((total[:, :-1] / np.maximum(total[:, -1:], 1) + bias) / temperature)
            best = p.argmax(1)
            for i, words, k, x in zip(ids, texts, best.tolist(), p.max(1).tolist()):
                yield (i, labels[k], x, x < low) if words else (i, "und", 0.0, True)

        # texts are judged together up to a size, a longer one alone: equal texts get equal sums
        ids, texts, size = [], [], 0
        for i, text in rows:
            n = len(text or "")
            if ids and size + n > 1 << 20:
                yield from judged(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(words_of(text))
            size += n
        if ids:
            yield from judged(ids, texts)

    return map_rows(df.select(id_col, text_col), run, schema)
