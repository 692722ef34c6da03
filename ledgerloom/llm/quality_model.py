"""Quality classifier: supervised subword embeddings.

A word's features are hashes of the word and of its character n-grams of 3 to 5, between marks of its ends. Words of over
LONGEST bytes (texts without spaces are one) are read in consecutive pieces that count like words; pieces overlap, so that
every n-gram of the word is in one. Word bigrams are features too; in them a word that equals the one before is written as
a mark, so repetition is learned whatever the word. Each hash has a learned vector; a word is the mean of its features'
vectors, a document the mean of its words' and the mean of its bigrams', added. A softmax gives the probabilities of the labels. Vectors and output are trained together by stochastic gradient descent in numpy, on a sample
of SAMPLE labelled documents at most, those of the least hashes of their ids. Training runs in one task over that sample;
what reaches the driver is one number for each hash bucket. Scoring runs over batches without a shuffle: the document's
logit is linear in its words, so each distinct word is looked up once by a worker.

Null, empty and wordless texts score the model's bias. Rows without an id and repeated rows are scored like others; rows
without an id take no part in training, and of rows that share an id the least text does; score() replaces a column of the score's name. Without labels of both kinds every score is the share of label 1, or 0.5 if there
is no label. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordcache import WordSums, in_chunks

#: Labelled documents that training takes at most.
SAMPLE = 3000
BUCKETS = 1 << 17
DIM = 16
EPOCHS = 6
#: Step of each coordinate, divided by the root of its squared gradients so far.
RATE = 0.05
GRAMS = (3, 5)
#: Bytes of the longest word that is read as one, and of a piece of a longer one.
LONGEST = 64
#: Words whose features are looked up together.
AT_ONCE = 4096
#: Either word of a bigram of one word twice.
MARK = zlib.crc32(b"")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def units(ws: list[bytes]) -> list[bytes]:
    """The words, those over LONGEST bytes as pieces, which begin with a space to tell them from words."""
    if max(map(len, ws), default=0) <= LONGEST:
        return ws
    out: list[bytes] = []
    for w in ws:
        if len(w) <= LONGEST:
            out.append(w)
        else:
            b, shared = b"<" + w + b">", GRAMS[1] - 1
            out += [b" " + b[i : i + LONGEST] for i in range(0, len(b) - shared, LONGEST - shared)]
    return out


def features(unit: bytes) -> list[int]:
    """Hash buckets of a word or piece."""
    b = unit[1:] if unit.startswith(b" ") else b"<" + unit + b">"
    grams = {b[i : i + n] for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(b) - n + 1)}
    grams.add(b"=" + unit)
    return [zlib.crc32(g) % BUCKETS for g in grams]


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """Hash buckets of the pairs of neighbouring words, of which hashes are those of all words."""
    a, b = hashes[:-1].astype(np.uint64), hashes[1:].astype(np.uint64)
    same = a == b
    a, b = np.where(same, np.uint64(MARK), a), np.where(same, np.uint64(MARK), b)
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


def crcs(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, ws), np.int64, len(ws))


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights: those of words and those of bigrams sum to 1 each."""
    ws = words(text)
    read = units(ws)
    counts: dict[bytes, int] = {}
    for w in read:
        counts[w] = counts.get(w, 0) + 1
    total: dict[int, float] = {}
    if len(ws) > 1:
        found, times = np.unique(bigrams(crcs(ws)), return_counts=True)
        total = dict(zip(found.tolist(), (times / (len(ws) - 1)).tolist(), strict=True))
    for w, c in counts.items():
        found = features(w)
        share = c / (len(read) * len(found))
        for f in found:
            total[f] = total.get(f, 0.0) + share
    return np.fromiter(total, np.int64, len(total)), np.fromiter(total.values(), np.float32, len(total))


def train(texts: list[str | None], labels: list[int], seed: int = 1) -> tuple[np.ndarray, float]:
    """Differences of the two labels' logits for each bucket, and their bias."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -20, 20))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = [vector(t) for t in texts]
    seen = np.full((BUCKETS, 1), 1e-8, np.float32)
    seen_out, seen_bias = np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            ids, weights = docs[k]
            mean = weights @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            g_out, back = np.outer(mean, p), weights[:, None] * (out @ p)
            seen_out += g_out * g_out
            seen_bias += p * p
            seen[ids] += (back * back).mean(1, keepdims=True)
            out -= RATE * g_out / np.sqrt(seen_out)
            bias -= RATE * p / np.sqrt(seen_bias)
            vectors[ids] -= RATE * back / np.sqrt(seen[ids])
    delta = out[:, 1] - out[:, 0]
    return vectors @ delta, float(bias[1] - bias[0])


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """The model of labels (doc_id, label 0 or 1) with their documents. Which rows may be used is the caller's choice."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    chosen = chosen.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id", F.lit(11)), "__id").limit(SAMPLE)
    sample = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "__id")  # SAMPLE rows at most

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__id", "text"], na_position="last").drop_duplicates("__id")
        delta, bias = train([t if isinstance(t, str) else None for t in rows["text"]], rows["__y"].tolist())
        return pd.DataFrame({"delta": [delta.astype(np.float32).tobytes()], "bias": [bias]})

    got = sample.groupBy(F.lit(0).alias("__one")).applyInPandas(one, "delta binary, bias double").collect()
    return (np.frombuffer(got[0].delta, np.float32), got[0].bias) if got else train([], [])


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    rest = docs.drop(name).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta, bias = sent.value

        def means(new: list[bytes]) -> np.ndarray:
            found = [features(w) for w in new]
            flat = delta[np.fromiter((f for fs in found for f in fs), np.int64)]
            starts = np.cumsum([0, *(len(fs) for fs in found)])[:-1]
            return (np.add.reduceat(flat.astype(np.float64), starts) / [len(fs) for fs in found])[:, None]

        def rows(new: list[bytes]) -> np.ndarray:
            return np.concatenate([means(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)])

        sums = WordSums(rows, 1)
        for batch in batches:
            out: list[float] = []
            for part in in_chunks(x.as_py() for x in batch.column("text")):
                lists = [words(t) for t in part]
                read = [units(ws) for ws in lists]
                n, of = (np.maximum([len(x) for x in some], 1) for some in (read, lists))
                pairs = [float(delta[bigrams(crcs(ws))].sum(dtype=np.float64)) for ws in lists]
                z = sums.add(read)[:, 0] / n + np.asarray(pairs) / np.maximum(of - 1, 1) + bias
                out += (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted. Learned from labels whose remainder is not 1."""
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
