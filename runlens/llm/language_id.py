"""Language identification: averaged hashed subword embeddings, linear softmax.

A text's feature is the mean of the embeddings of its hashed byte n-grams
(2 to 4 bytes of the lower-case text, characters other than letters as one
blank, so n-grams mark word ends). Embeddings and the linear layer are trained
by stochastic gradient descent in numpy, in one task, on a bounded sample of
labelled rows (about ``max_rows`` in all, as many of each of the ``max_labels``
most frequent labels), each also cut to short passages so that short texts are
judged well; only the model, 2 ** ``bits`` times (labels + 1) numbers, comes to
the driver. A fifth of the sample is kept back to fit
the temperature of the softmax and the rejection. A text's familiarity is the
mean log frequency of its n-grams in the learned texts, which is low in other
languages and in gibberish, whichever label scores best; texts below a normal
tail of the familiarity of what is kept back, short passages too, are rejected.
Prediction sums one row of a small table per n-gram over the whole text.

Bounds: labels beyond ``max_labels`` are never learned or predicted; the task
that learns holds at most 6 * 2 ** ``bits`` bytes for each sampled text, however
long.

Defined results: null texts and texts without letters are ``und`` with score
0; rows with a null label or id are never learned from; without labelled rows
every text is ``und``; with fewer than 30 passages kept back only ``und`` texts
are rejected; ties go to the first label in order; an empty table
gives no rows; only the id, text and label columns are read, and the label
only for learning.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes of the lower-case text that stay: a to z and all of several-byte characters.
KEEP = np.zeros(256, np.uint8) + 32
KEEP[97:123] = np.arange(97, 123)
KEEP[128:] = np.arange(128, 256)
ORDERS = (0xFFFF, 0xFFFFFF, 0xFFFFFFFF)
MULTIPLIER = np.uint32(0x9E3779B1)


def buckets_of(text: bytes, bits: int) -> np.ndarray:
    """The hash bucket of each n-gram: one row per order."""
    padded = KEEP[np.frombuffer(b" " + text + b"    ", np.uint8)].astype(np.uint32)
    n = len(padded) - 3
    four = padded[:n] | padded[1 : n + 1] << np.uint32(8) | padded[2 : n + 2] << np.uint32(16) | padded[3 : n + 3] << np.uint32(24)
    out = np.empty((len(ORDERS), n), np.uint32)
    for k, mask in enumerate(ORDERS):
        h = (four & np.uint32(mask)) * MULTIPLIER
        h ^= h >> np.uint32(15)
        out[k] = (h * MULTIPLIER + np.uint32(k * 0x05EBCA6B)) >> np.uint32(32 - bits)
    return out


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels, embeddings times the linear layer; last, log frequencies
    bias: np.ndarray
    temperature: float
    reject_below: float  # familiarity
    bits: int

    def judge(self, text: str) -> tuple[np.ndarray, float]:
        """Calibrated probabilities of the labels; familiarity."""
        total, n = np.zeros(len(self.labels) + 1), 0
        data = text.lower().encode("utf-8", "replace")
        for a in range(0, len(data), 1 << 16):  # slabs keep memory small; n-grams across their edges are cut
            at = buckets_of(data[a : a + (1 << 16)], self.bits).ravel()
            total += self.table[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        total /= max(n, 1)
        z = (total[:-1] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum(), float(total[-1])

    def usable(self, text: str | None) -> bool:
        return text is not None and bool(self.labels) and LETTER.search(text) is not None

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.usable(text):
            return UNKNOWN, 0.0
        p, _ = self.judge(text)
        k = int(p.argmax())
        return self.labels[k], float(p[k])

    def accepts(self, text: str | None) -> bool:
        return self.usable(text) and self.judge(text)[1] >= self.reject_below


def _features(bits: int):
    """Sparse counts of whole texts and of two short passages of each."""

    def run(batches):
        for batch in batches:
            rows = []
            for label, text, seed in zip(*(batch.column(c).to_pylist() for c in ("label", "text", "seed"))):
                data = (text or "").lower().encode("utf-8", "replace")
                rng = np.random.default_rng(seed & 0x7FFFFFFF)
                parts = [data]
                for size in (200, 40):
                    if len(data) > size:
                        at = int(rng.integers(0, len(data) - size))
                        parts.append(data[at : at + size].decode("utf-8", "ignore").encode())
                for k, part in enumerate(parts):
                    at, n = np.unique(buckets_of(part, bits), return_counts=True)
                    rows.append((label, k, seed, at.astype(np.uint16).tobytes(), n.astype(np.float32).tobytes()))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["label", "part", "seed", "at", "n"])

    return run


SAMPLED = "label string, part int, seed long, at binary, n binary"
LEARNED = "labels array<string>, table binary, bias binary, temperature double, reject_below double"


def sample(docs: DataFrame, max_rows: int, bits: int, max_labels: int) -> DataFrame | None:
    """Features of at most about ``max_rows`` rows of (id, text, label), as many of each label."""
    known = docs.where("label is not null and id is not null and text is not null")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_labels).collect()}
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))))
    seed = F.xxhash64("id", F.lit(11))
    chosen = known.withColumn("seed", seed).where(F.pmod("seed", F.lit(1 << 20)) < F.lit(1 << 20) * F.try_element_at(share, F.col("label")))
    return chosen.select("label", "text", "seed").mapInArrow(_features(bits), SAMPLED)


def train(rows: list[dict], bits: int, dims: int = 16, epochs: int = 12, rate: float = 0.5, cost: float = 1e-6, seed: int = 7) -> Model:
    """Fit on sampled rows; ``cost``: share of texts of the labels that the
    rejection may cost, if their familiarity is normal."""
    rows = sorted(rows, key=lambda r: (r["seed"], r["part"], r["label"]))
    labels = sorted({r["label"] for r in rows})
    index = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    data, seen = [], np.full(1 << bits, 0.5)
    for r in rows:
        n = np.frombuffer(r["n"], np.float32)
        data.append((np.frombuffer(r["at"], np.uint16), n / max(1.0, float(n.sum())), index[r["label"]], r["part"], r["seed"] % 5 == 0))
        if r["part"] == 0 and not data[-1][4]:
            seen[data[-1][0]] += n
    fit, held = [d for d in data if not d[4]] or data, [d for d in data if d[4]] or data
    emb = rng.normal(0, 0.1, (1 << bits, dims)).astype(np.float32)
    weight, bias = np.zeros((dims, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    steps = 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            at, share, label, _, _ = fit[i]
            step = rate * (1 - steps / (epochs * len(fit)))
            steps += 1
            vectors = emb[at]
            x = share @ vectors
            z = x @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            # the mean of many n-grams moves each embedding little: steps are scaled up to match
            emb[at] = vectors - np.outer(share * (step * 20), weight @ p)
            weight -= step * np.outer(x, p)
            bias -= step * 0.1 * p
    table = emb @ weight
    logits = np.array([d[1] @ table[d[0]] + bias for d in held])
    truth = np.array([d[2] for d in held])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = min((float(t) for t in np.geomspace(0.2, 5, 60)), key=loss)
    often = np.log(seen / seen.sum()).astype(np.float32)
    familiar = np.array([d[1] @ often[d[0]] for d in held])
    reject = float(familiar.mean() + NormalDist().inv_cdf(cost) * familiar.std()) if len(held) >= 30 else -np.inf
    return Model(labels, np.column_stack((table, often)).astype(np.float32), bias, temperature, reject, bits)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = 2000, bits: int = 15, max_labels: int = 200) -> Model:
    """Learn the ``max_labels`` most frequent labels; others are never predicted.

    ``bits``: at most 16.
    """
    rows = sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")), max_rows, bits, max_labels)

    def learn(batches):
        sampled = [r for b in batches for r in b.to_pylist()]
        if sampled:
            m = train(sampled, bits)
            got = [m.labels], [m.table.tobytes()], [m.bias.tobytes()], [m.temperature], [m.reject_below]
            kinds = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(got, kinds)], names=[x.split()[0] for x in LEARNED.split(", ")])

    found = materialise(rows, "language-sample").repartition(1).mapInArrow(learn, LEARNED).collect() if rows is not None else []
    if not found:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0, 0.0, bits)
    labels, table, bias, temperature, reject = found[0]
    return Model(list(labels), np.frombuffer(table, np.float32).reshape(1 << bits, -1), np.frombuffer(bias, np.float32), temperature, reject, bits)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels numbers, whatever the corpus

    def run(batches):
        m = model.value
        for batch in batches:
            texts = batch.column("text")
            found = [m.predict(t.as_py()) for t in texts]
            yield pa.record_batch([batch.column("id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.accepts(t.as_py()) for t in texts], pa.bool_())

    return docs.where(keeps(F.col(text_col)))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
