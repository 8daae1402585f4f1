"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole text. Learned filters, each as wide as
``WIDTH`` bytes over a learned byte embedding, slide over a chunk; the largest response of each filter is the chunk's
feature. A document's features are the largest and the mean of its chunks' features, and logistic regression combines
them into one probability.

The network is trained on the driver from a bounded sample of labelled rows: ``SAMPLE`` rows in the order of a hash of
their doc_id, and ``SAMPLE_CHUNKS`` chunks of each, spread over the whole text. Scoring reads every chunk of every text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from .shared import crc_mod, quoted

CHUNK = 512
OVERLAP = 32
WIDTH = 6
FILTERS = 24
EMBEDDING = 8
THRESHOLD = 0.3
SAMPLE = 2500
SAMPLE_CHUNKS = 6
EPOCHS = 14
SEED = 5


def chunks(text: str | None, most: int | None = None) -> list[bytes]:
    """Overlapping chunks of the whole text, or ``most`` of them evenly spread; an empty text has one empty chunk."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts = np.arange(0, max(1, len(data) - OVERLAP), CHUNK - OVERLAP)
    if most and len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
    return [data[s : s + CHUNK] for s in starts.tolist()]


def as_array(parts: Iterable[bytes]) -> np.ndarray:
    """Chunks as rows of bytes, the shorter ones filled with 0 bytes, with room for a filter at the end."""
    parts = list(parts)
    width = max(WIDTH, max(map(len, parts))) + WIDTH - 1
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "bytes": rng.normal(0, 0.5, (256, EMBEDDING)),
            "filters": rng.normal(0, 0.4, (WIDTH, EMBEDDING, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 2 * FILTERS),
            "offset": np.zeros(1),
        }

    def lookup(self) -> np.ndarray:
        """The response of each filter's position to each byte: (WIDTH, 256, FILTERS)."""
        return np.einsum("be,wef->wbf", self.p["bytes"], self.p["filters"]).astype(np.float32)

    def pooled(self, x: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk (rows of x), and where."""
        n = x.shape[1] - WIDTH + 1
        total = lookup[0][x[:, :n]]
        for w in range(1, WIDTH):
            total += lookup[w][x[:, w : w + n]]
        at = total.argmax(1)
        return np.take_along_axis(total, at[:, None, :], 1)[:, 0, :], at

    def peaks(self, x: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        n = x.shape[1] - WIDTH + 1
        best = np.empty((len(x), FILTERS), np.float32)
        for k in range(0, len(x), 16):  # small enough for the cache
            part = x[k : k + 16]
            total = lookup[0][part[:, :n]]
            for w in range(1, WIDTH):
                total += lookup[w][part[:, w : w + n]]
            best[k : k + 16] = total.max(1)
        return best

    def document(self, z: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Features of the documents whose chunks (in order) have responses z, and how many chunks each has."""
        n = np.bincount(owner, minlength=docs)
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        a = np.tanh(z + self.p["bias"])
        return np.concatenate([np.maximum.reduceat(a, starts), np.add.reduceat(a, starts) / n[:, None]], 1), n

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((features * self.p["out"]).sum(1) + self.p["offset"], -30, 30)))

    def train(self, texts: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(SEED)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        rounds = max(1, round(1500 / max(1, len(texts))))  # small samples are seen more often
        for _ in range(epochs * min(4, rounds)):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), 32):
                batch = order[at : at + 32]
                step += 1
                for name, g in self.gradients([texts[k] for k in batch], labels[batch]).items():
                    g = g + decay * self.p[name]
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[name] = self.p[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def gradients(self, texts: list[list[bytes]], labels: np.ndarray) -> dict[str, np.ndarray]:
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        x = as_array([c for t in texts for c in t])
        z, at = self.pooled(x, self.lookup())
        features, n = self.document(z, owner, len(texts))
        err = (self.probability(features) - labels) / len(texts)
        g = {"out": features.T @ err, "offset": np.array([err.sum()])}
        top, mean = np.outer(err, self.p["out"][:FILTERS]), np.outer(err, self.p["out"][FILTERS:])
        a = np.tanh(z + self.p["bias"])
        best = a == features[owner, :FILTERS]
        best = best / np.add.reduceat(best, np.cumsum(n) - n, dtype=float)[owner]  # chunks overlap, so several may have the largest
        d = (top[owner] * best + mean[owner] / n[owner][:, None]) * (1 - a * a)
        g["bias"] = d.sum(0)
        g["bytes"], g["filters"] = np.zeros_like(self.p["bytes"]), np.zeros_like(self.p["filters"])
        rows = np.arange(len(x))[:, None]
        for w in range(WIDTH):
            seen = x[rows, at + w]  # (chunks, filters)
            np.add.at(g["bytes"], seen, d[:, :, None] * self.p["filters"][w].T[None])
            g["filters"][w] = np.einsum("cfe,cf->ef", self.p["bytes"][seen], d)
        return g

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability for each text, from all of its chunks."""
        lookup, out = self.lookup(), np.empty(len(texts))
        at = 0
        while at < len(texts):
            parts, owner, first = [], [], at
            while at < len(texts) and (not parts or len(parts) < 512):
                cut = chunks(texts[at])
                parts += cut
                owner += [at - first] * len(cut)
                at += 1
            z = np.concatenate([self.peaks(as_array(parts[k : k + 1024]), lookup) for k in range(0, len(parts), 1024)])
            features, _ = self.document(z, np.array(owner), at - first)
            out[first:at] = self.probability(features)
        return out


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[list[bytes]], np.ndarray]:
    """At most ``size`` labelled documents outside of the held-out fold, as bounded lists of chunks, and their labels.

    Rows come in the order of a hash of doc_id; null labels and null ids are left out. Of several labels of an id the
    smallest counts, of several texts that of the smallest hash.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    @pandas_udf(ArrayType(BinaryType()))
    def some(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunks(t, SAMPLE_CHUNKS))

    met = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``size`` rows
    first = met.select("doc_id", "quality", F.xxhash64("text").alias("h"), some("text").alias("parts"))
    rows = first.groupBy("doc_id").agg(F.min_by(F.struct("quality", "parts"), "h").alias("x")).select("doc_id", "x.quality", "x.parts").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [[bytes(b) for b in r["parts"]] for r in rows], np.array([r["quality"] for r in rows], float)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, the higher the likelier label 1) and ``predicted`` (0 or 1).

    Every row is scored by its whole text; a null text is empty, and empty texts have a score too. Rows are never
    dropped, repeated ones come back as often as they occur. ``held_out`` says that crc32(doc_id as text) mod 5 is 0
    (false for a null id); such rows are never learned from. Without labels every score is that of the untrained
    network. Columns of the table with one of the three names give way, others stay. An empty table gives no rows.
    """
    docs = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")])
    texts, quality = sample(docs, labels)
    network = Network()
    if len(texts):
        network.train(texts, quality)
    shared = docs.sparkSession.sparkContext.broadcast(network.p)

    @pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        net = Network()
        net.p = shared.value
        return pd.Series(net.scores(list(text)))

    out = docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))).withColumn("score", score(F.coalesce("text", F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
