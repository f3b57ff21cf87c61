"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the lowered text with everything but letters made a space. Each
hashes to one of `buckets` embeddings; a document is their mean over all its subwords, and a linear softmax
gives the language. Trained by stochastic gradient descent in numpy on a bounded sample of the labelled rows.

A text is rejected for either of two things, whose levels are set on labelled rows kept out of training: its
calibrated probability is too low, or its subwords are too strange to every language. How strange those of an
unknown language are is told by each known one as the others see it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, remainder, table, texts

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
CLEAN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
CHUNK = 1 << 20


def _hashed(data: np.ndarray):
    """For each n: the buckets of the n-grams that begin at each byte (n - 1 fewer than bytes)."""
    wide = data.astype(np.uint32)
    gram = wide
    for n in range(2, max(GRAMS) + 1):
        gram = (gram[:-1] << np.uint32(8)) | wide[n - 1 :]
        if n in GRAMS:
            yield n, ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(17)).astype(np.int32)


def prepared(text: bytes) -> list[bytes]:
    """A text lowered, letters kept, in pieces of bounded size, each between spaces."""
    return [b" " + p.decode("utf-8", "replace").lower().encode().translate(CLEAN).strip() + b" " for p in pieces(text)]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords and how often each occurs; nothing for a text of no bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    for piece in prepared(text):
        for _, hashed in _hashed(np.frombuffer(piece, np.uint8)):
            counts += np.bincount(hashed, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found]


@dataclass
class Model:
    """langs, the class scores of each bucket, the bias, and what calibration set."""

    langs: list[str]
    scores: np.ndarray  # buckets x langs: embeddings times the softmax's weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    likely: np.ndarray | None = None  # buckets x langs: log share of the bucket in the language's subwords
    slack: float = 0.0  # how far a short text may stray, times the root of its subwords
    familiar: float = -np.inf  # the least mean of `likely`, slack added
    figures: dict = field(default_factory=dict)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax((logits + self.bias) / self.temperature)

    def strange(self, mean: np.ndarray, subwords: np.ndarray) -> np.ndarray:
        return mean + self.slack / np.sqrt(np.maximum(subwords, 1)) < self.familiar


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 8, rate: float = 4.0, reject_share: float = 0.001, seed: int = 7) -> Model:
    """Fit on (lang, buckets, counts); every tenth row is kept out for calibration. No rows: a model without
    languages, which gives `und` with score 0; one language: always that one."""
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    index = {x: i for i, x in enumerate(langs)}
    rows = [r for r in rows if len(r[1])]
    kept_out = [r for i, r in enumerate(rows) if i % 10 == 9]
    fit = [r for i, r in enumerate(rows) if i % 10 != 9]
    embedding = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights = rng.uniform(-1 / dim, 1 / dim, (dim, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    seen = np.zeros((BUCKETS, len(langs)))
    steps, done = epochs * len(fit), 0
    for epoch in range(epochs):
        for i in rng.permutation(len(fit)):
            lang, found, counts = fit[i]
            share = (counts / counts.sum()).astype(np.float32)
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ embedding[found]
            error = _softmax(hidden @ weights + bias)
            error[index[lang]] -= 1
            back = weights @ error
            weights -= (lr * 0.1) * np.outer(hidden, error)
            bias -= (lr * 0.01) * error
            embedding[found] -= lr * np.outer(share, back)
            if not epoch:
                seen[found, index[lang]] += share
    model = Model(langs, (embedding @ weights).astype(np.float32), bias)
    model.likely = np.log(seen / np.maximum(seen.sum(axis=0), 1e-9) + 1e-6).astype(np.float32)
    if usable := kept_out or fit:
        calibrate(model, usable, reject_share)
    return model


def calibrate(model: Model, rows: list[tuple[str, np.ndarray, np.ndarray]], reject_share: float) -> None:
    """Set the temperature, as if one row more had been misplaced, and the two levels of rejection."""
    index = {x: i for i, x in enumerate(model.langs)}
    at = np.arange(len(rows))
    sizes = np.array([r[2].sum() for r in rows], float)
    means = lambda table: np.array([r[2] @ table[r[1]].astype(float) for r in rows]) / sizes[:, None]
    logits, likely = means(model.scores), means(model.likely)
    truth = np.array([index[r[0]] for r in rows])
    losses = []
    for t in np.geomspace(0.01, 5, 80):
        model.temperature = float(t)
        p = np.maximum(model.probabilities(logits), 1e-12)
        losses.append((-np.log(p[at, truth]).sum() - np.log(np.maximum(1 - p[at, truth], 1e-12)).mean(), t))
    model.temperature = float(min(losses)[1])
    p = model.probabilities(logits)
    right = p.argmax(axis=1) == truth
    sure = np.sort(p.max(axis=1)[right])
    low = lambda x: float(np.sort(x)[int(len(x) * reject_share)])
    model.reject_below = min(low(sure), 1.2 / len(model.langs), 0.5) if len(sure) else 0.0
    own = likely[at, truth]
    # the mean over n subwords, of which each three or so overlap, strays by three standard errors at most
    spread = np.mean([r[2] @ (model.likely[r[1], c].astype(float) - m) ** 2 / r[2].sum() for r, c, m in zip(rows, truth, own, strict=True)])
    model.slack = 3 * math.sqrt(3 * spread)
    ease = model.slack / np.sqrt(sizes)
    lowest = low(own + ease)
    if len(model.langs) > 1:
        # each language as the others see it stands for one that no row has
        others = np.where(truth[:, None] == np.arange(len(model.langs)), -np.inf, likely).max(axis=1)
        model.familiar = min(lowest, (lowest + 2 * float(np.median(others))) / 3)
    else:
        model.familiar = lowest - 2.0
    model.figures = {"kept_out": len(rows), "right": float(right.mean()), "temperature": model.temperature, "reject_below": model.reject_below, "slack": model.slack, "familiar": model.familiar}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000, most_langs: int = 200, held_out: tuple[int, int] = (4, 2)) -> Model:
    """Train on about `sample` rows in equal shares of the languages, the `most_langs` commonest at most: those with
    the smallest hash of the id, among rows with an id and a lang whose crc32(id as text) mod held_out[0] is not
    held_out[1]. Only their subword counts come to the driver, and no more rows than `sample`, however often an id
    repeats."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    slim = slim.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (remainder("id", held_out[0]) != held_out[1])).withColumn("h", F.xxhash64(F.lit("langid"), "id"))
    sizes = slim.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not sizes:
        return train([])
    # hashes are even, so a share of their range holds that share of the rows
    upto = {r["lang"]: min(2**63 - 1, int(1.1 * sample / len(sizes) / r["count"] * 2**64) - 2**63) for r in sizes}
    edge = F.create_map(*[x for k, v in upto.items() for x in (F.lit(k), F.lit(v))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [features(t or b"") for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0].astype(np.uint16).tobytes() for f in found], pa.binary()), pa.array([np.minimum(f[1], 65535).astype(np.uint16).tobytes() for f in found], pa.binary())], names=["h", "lang", "buckets", "counts"])

    rows = slim.filter(F.col("text").isNotNull() & (F.col("h") <= F.element_at(edge, F.col("lang")))).select("h", "lang", "text").mapInArrow(run, "h bigint, lang string, buckets binary, counts binary")
    got = sorted((r.h, r.lang, bytes(r.buckets), bytes(r.counts)) for r in rows.orderBy("h", "lang", F.xxhash64("buckets", "counts")).limit(sample).collect())
    return train([(lang, np.frombuffer(b, np.uint16).astype(np.int32), np.frombuffer(c, np.uint16).astype(np.int64)) for _, lang, b, c in got])


def predict(model: Model, column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(lang, score, rejected) for an Arrow string array: `und` with score 0, rejected, where the text is null
    or has no letter; else the likeliest language, rejected where its calibrated probability is too low or the text's
    subwords are too strange to all languages."""
    n, k = len(column), len(model.langs)
    sums, grams = np.zeros((n, max(k, 1)), complex), np.zeros(n)  # scores and, as the imaginary part, `likely`
    empty = np.ones(n, bool)
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        data = np.frombuffer(b"".join(held), np.uint8)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for gram, hashed in _hashed(data):
            stops = np.maximum(starts + lengths - gram + 1, starts)
            pairs = np.stack((starts, stops), axis=1).ravel()
            some = stops > starts
            hashed = np.append(hashed, np.zeros(len(data) + 1 - len(hashed), np.int32))
            for c in range(k):
                total = np.add.reduceat(columns[c][hashed], pairs)[::2]
                np.add.at(sums[:, c], owner, np.where(some, total, 0))
            np.add.at(grams, owner, stops - starts)
        held.clear()
        owner.clear()
        size = 0

    columns = [(model.scores[:, c] + 1j * model.likely[:, c]).astype(np.complex64) for c in range(k)]
    for i, text in enumerate(texts(column)):
        if not text:
            continue
        for piece in pieces(text):
            empty[i] &= not LETTER.search(piece.decode("utf-8", "replace"))
        for piece in prepared(text) if not empty[i] and k else ():
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    if not k:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    means = sums[:, :k] / np.maximum(grams, 1)[:, None]
    p = model.probabilities(means.real)
    score = np.where(empty, 0.0, p.max(axis=1))
    best = p.argmax(axis=1)
    strange = model.strange(means.imag.max(axis=1), grams)  # to every language
    return ["und" if e else model.langs[b] for e, b in zip(empty, best, strict=True)], score, empty | (score < model.reject_below) | strange


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, lang, score, rejected. Null or letterless texts: `und`, 0, rejected.
    Only id and text are read. An empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, a fixed size

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score, rejected = predict(held.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["id", "lang", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model does not reject, with all columns as they are. Null and letterless texts go;
    repeated rows share their fate; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            _, _, rejected = predict(held.value, batch.column(at))
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 4) == 2, F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")
