"""Language identification: averaged embeddings of hashed subwords under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, WIDTH, LONGEST = 1 << 13, 16, 4

_LETTER = regex.compile(r"\p{L}")
_TO_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SEED = np.uint32(0x9E3779B1)


def subwords(text: str) -> np.ndarray:
    """Buckets of all byte strings of up to LONGEST bytes that don't reach over a space between them."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    solid = b != 32
    out = [((b[solid] + np.uint32(1)) * _SEED) >> np.uint32(19)]
    h, inner = b, np.ones(len(b), bool)
    for n in range(2, LONGEST + 1):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        inner = inner[:-1] & (solid[n - 2 : -1] if n > 2 else True)
        out.append((h[inner] * _SEED) >> np.uint32(19))
    return np.concatenate(out)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 30, rate: float = 0.5, seed: int = 7) -> dict:
    """Stochastic gradient descent on (buckets, counts) of whole documents.

    A tenth of the rows is held aside: the softmax is flattened or sharpened by one factor to fit them, and the score
    below which a caller may reject is the lowest one that 99 of 100 right answers among them reach.
    """
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, count) in enumerate(rows):
        x[i, at] = count / max(1, count.sum())
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside, used = order[: len(order) // 10], order[len(order) // 10 :]
    emb = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in range(0, len(used), 32):
            part = used[k : k + 32]
            mean = x[part] @ emb * 10
            p = _softmax(mean @ out + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ out.T
            out -= step * (mean.T @ p)
            bias -= step * p.sum(0)
            emb -= step * 10 * (x[part].T @ back)
        rng.shuffle(used)
    logits = x[aside] @ (emb * 10 @ out) + bias
    sharp, floor = 1.0, 0.0
    if len(aside):
        loss = lambda s: -np.log(_softmax(logits * s)[np.arange(len(aside)), y[aside]] + 1e-9).mean()
        sharp = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
        p = _softmax(logits * sharp)
        right = p.argmax(1) == y[aside]
        floor = float(np.quantile(p.max(1)[right], 0.01)) if right.any() else 0.0
    return {"names": names, "table": (emb * 10 @ out * sharp).astype(np.float32), "bias": bias * np.float32(sharp), "floor": floor}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, max_rows: int = 4000) -> dict:
    """Train on a sample of docs (text, lang): about max_rows distinct texts, as many for each language, chosen by their hash.

    Rows with null or letterless text or null lang teach nothing. All languages are learned, from 20 texts each at
    least where they have them, so very many languages make a larger sample. The sample's subword counts are made on the executors; only they come to the driver.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return {"names": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0, np.float32), "floor": 0.0}
    each = max(20, max_rows / len(counts))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / max(1, n))) for lang, n in counts.items()], "lang string, share double")
    chosen = usable.select("lang", "text").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    sample = chosen.select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if _LETTER.search(text):
                    at, n = np.unique(subwords(text), return_counts=True)
                    rows.append((lang, at.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.binary(), pa.binary()])], ["lang", "at", "n"])

    got = sample.select("lang", "text").mapInArrow(count, "lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r["at"]), bytes(r["n"])))
    return train([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u4").astype(np.float32)) for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: dict, reject: bool = False) -> DataFrame:
    """doc_id with lang_pred, score (0 to 1) and accepted, from the whole of each text.

    accepted says whether the score reaches the floor that was calibrated on rows held aside. A null text or one without
    a letter gets `und`, 0 and false. With reject, a text that isn't accepted gets `und` too. A model without languages
    answers `und`. Of languages with equal scores the first by name is taken. Repeated rows get equal answers, long texts
    are read whole, an empty table gives an empty result, other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                name, score, accepted = "und", 0.0, False
                if text and m["names"] and _LETTER.search(text):
                    n = np.bincount(subwords(text), minlength=BUCKETS).astype(np.float32)
                    p = _softmax((n / max(1.0, n.sum()) @ m["table"] + m["bias"])[None])[0]
                    best = int(p.argmax())
                    score, accepted = min(1.0, float(p[best])), bool(p[best] >= m["floor"])
                    if accepted or not reject:
                        name = m["names"][best]
                    else:
                        score = 0.0
                rows.append((name, score, accepted))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")
