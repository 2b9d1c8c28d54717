"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  Every passage of the
whole text is encoded as a vector of shares (kinds of characters, word lengths,
repeats) and passed through a small layer; a gated attention (tanh times
sigmoid, Ilse and others, 2018) learns from the document labels alone which
passages matter, and the document is scored on the weighted mean of its
passages.  Labels, language, source and identifier are never inputs of a score.

The fit uses a bounded sample: the ``max_docs`` labelled documents with the
smallest hash of their identifier; a text of more than ``max_passages`` passages
is stood for by that many, hash-chosen from the whole of it.  That is at most ``max_docs * max_passages`` vectors of 26 numbers
(27 MB as given), fitted with numpy on the driver.  Scoring is one pass over
all documents without a shuffle.

Cases: a null text counts as empty, and an empty text is one empty passage and
gets a score like any other; null or conflicting labels (the same document
labelled twice in different ways) are not used; a null identifier is scored but
never held out or learned from; repeated rows are scored apart; without any
usable label, or with labels of one kind only, every score is the share of
label 1 (0.5 without any); other columns are left out, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PASSAGE = 512
MAX_DOCS = 4096
MAX_PASSAGES = 64
CHUNK = 1 << 18
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY = 300, 0.02, 1e-4

# Kinds of bytes, by what the passage vector holds the share of.
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", "\t\r", ".", ",", "!", "?", "|", ":;", "'\"", "-_", "()[]{}<>", "#$%&*", "/\\@=+~^`"]
N_FEATURES = len(KINDS) + 9


def _kind_table() -> np.ndarray:
    kind = np.full(256, len(KINDS), dtype=np.int64)  # the rest: control bytes and all of the non-ASCII
    for i, chars in enumerate(KINDS):
        for c in chars.encode():
            kind[c] = i
    return kind


KIND = _kind_table()
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
BASE = 0x9E3779B97F4A7C15


def passage_vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One vector per passage, and the number of passages of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n_of = np.maximum(1, -(-sizes // PASSAGE))
    first_of = np.concatenate([[0], np.cumsum(n_of)])
    n = int(first_of[-1])
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(raw):
        return out, n_of
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text_of = np.repeat(np.arange(len(texts)), sizes)
    at = first_of[text_of] + (np.arange(len(raw)) - starts[text_of]) // PASSAGE
    kinds = np.bincount(at * (len(KINDS) + 1) + KIND[raw], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    length = kinds.sum(axis=1)
    out[:, : len(KINDS) + 1] = kinds / np.maximum(length, 1)[:, None]

    # Words: runs of other bytes than white space, ended by the end of a text as well.
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (text_of[1:] != text_of[:-1])
    word_at = np.flatnonzero(begins)
    col = len(KINDS) + 1
    if len(word_at):
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | (text_of[1:] != text_of[:-1])
        word_end = np.flatnonzero(ends) + 1
        long = word_end - word_at
        # A word's hash: the wrapped sum of its bytes, each times a power of its place.
        powers = np.full(len(raw) + 1, BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)])])
        scale = np.full(len(raw) + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        scale[0] = 1
        hashes = (sums[word_end] - sums[word_at]) * np.multiply.accumulate(scale)[word_at]
        place = at[word_at]
        words = np.maximum(np.bincount(place, minlength=n), 1)

        def share(flags: np.ndarray) -> np.ndarray:
            return np.bincount(place, weights=flags, minlength=n) / words

        upper = KIND[raw[word_at]] == 0
        second = KIND[raw[np.minimum(word_at + 1, len(raw) - 1)]] == 0
        again = np.zeros(len(word_at), dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1])
        order = np.lexsort((hashes, place))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (place[order][1:] != place[order][:-1])
        distinct = np.bincount(place[order], weights=new, minlength=n)
        out[:, col] = share(long) / 10
        out[:, col + 1] = share(long <= 3)
        out[:, col + 2] = share(long > 12)
        out[:, col + 3] = share(upper)
        out[:, col + 4] = share(upper & second & (long > 1))
        out[:, col + 5] = share(again)
        out[:, col + 6] = distinct / words
    out[:, col + 7] = np.log1p(length) / np.log1p(PASSAGE)
    return out, n_of


class Attention:
    """Weights of the passage layer, the gate and the document score."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: dict[str, np.ndarray], share: float | None = None):
        self.mean, self.spread, self.weights, self.share = mean, spread, weights, share

    def forward(self, x: np.ndarray, n_of: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        first = np.concatenate([[0], np.cumsum(n_of)[:-1]])
        doc = np.repeat(np.arange(len(n_of)), n_of)
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(z @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        m = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "m": m, "doc": doc, "first": first, "p": 1 / (1 + np.exp(-(m @ w["c"] + w["d"])))}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        x, n_of = passage_vectors(texts)
        return self.forward(x.astype(np.float64), n_of)["p"]


def fit(x: np.ndarray, n_of: np.ndarray, y: np.ndarray, seed: int = 7) -> Attention:
    """Full-batch Adam on the log loss of the document labels."""
    if not len(y) or y.min() == y.max():
        return Attention(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 0.5)
    x = x.astype(np.float64)
    rnd = np.random.default_rng(seed)
    n = x.shape[1]
    model = Attention(x.mean(axis=0), x.std(axis=0) + 1e-3, {
        "W": rnd.normal(0, n**-0.5, (n, HIDDEN)), "b": np.zeros(HIDDEN), "V": rnd.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": rnd.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rnd.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1),
    })
    w = model.weights
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        f = model.forward(x, n_of)
        up = (f["p"] - y) / len(y)
        by_passage = up[f["doc"]]
        g = {"c": f["m"].T @ up, "d": np.array([up.sum()])}
        from_h = f["h"] @ w["c"]
        centred = from_h - (f["m"] @ w["c"])[f["doc"]]
        e = by_passage * f["a"] * centred  # through the softmax of the attention
        g["w"] = (f["t"] * f["s"]).T @ e
        d_t = e[:, None] * w["w"] * f["s"] * (1 - f["t"] ** 2)
        d_s = e[:, None] * w["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ d_t, f["h"].T @ d_s
        d_h = (by_passage * f["a"])[:, None] * w["c"] + d_t @ w["V"].T + d_s @ w["U"].T
        d_z = d_h * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["z"].T @ d_z, d_z.sum(axis=0)
        for k in w:
            grad = g[k] + DECAY * w[k]
            mean[k] = 0.9 * mean[k] + 0.1 * grad
            square[k] = 0.999 * square[k] + 0.001 * grad**2
            w[k] = w[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _chunks(texts: pa.Array):
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def chosen(n: int, most: int) -> np.ndarray:
    """Which of ``n`` passages speak for a document in the sample: all, or ``most`` that a hash of their place picks from the whole text."""
    if n <= most:
        return np.arange(n)
    mixed = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return np.sort(np.argsort(mixed, kind="stable")[:most])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One row for each document, though the table may repeat it; the sample is taken before any text is read.
    there = rows.select("id").join(known, "id", "left_semi").distinct()
    sample = known.join(there, "id").orderBy(F.xxhash64("id"), "id").limit(max_docs)

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, _ = passage_vectors([batch.column(2)[k].as_py().encode()])
                x = x[chosen(len(x), max_passages)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([x.tobytes()], pa.binary())], names=["id", "y", "x"]
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    vectors = rows.join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(work, f"id {id_type}, y double, x binary")
    # Repeats of a document are taken together before they leave the executors: at most max_docs rows arrive.
    got = {r.id: (r.y, r.x) for r in vectors.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()}
    ids = sorted(got)
    parts = [np.frombuffer(got[i][1], dtype=np.float32).reshape(-1, N_FEATURES) for i in ids]
    x = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))
    return fit(x, np.array([len(p) for p in parts], dtype=np.int64), np.array([got[i][0] for i in ids]))


def score(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) in a column ``_score``."""
    names = docs.columns

    def work(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            scores = [model.score(part) for part in _chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*names, "_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("_score", F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(work, f"{schema}, _score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """``id, held_out, score, predicted`` for every row."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **bounds)
    rows = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "id", "text")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
