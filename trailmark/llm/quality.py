"""Quality by compression: zstandard dictionaries of good and of bad text.

A text that resembles good text compresses smaller with the dictionary built from good rows than with
the one built from bad rows.  The difference of the two sizes, normalised by the size without a
dictionary, by the length, and by the sum of both, goes into a logistic calibration together with the
compression ratios and the length, which say how far the difference is to be trusted (a text of one
repeated word compresses to nothing with either).  The README has what each part is worth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import PER_CLASS, held_out, training_rows
from ._shared import broadcast_value

LEVEL, DICTIONARY = 3, 112 << 10
#: Bytes of text, per class, from which a dictionary is built: whole texts in the order of their hashes.
DICTIONARY_SAMPLE = 6 << 20


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes() if len(texts) > 7 else b"".join(texts)[-DICTIONARY:]
    except zstandard.ZstdError:  # too little text for the trainer: the text itself is the dictionary
        return b"".join(texts)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of a text with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for raw in (good, bad, b""):
            data = zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
            if data:
                data.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": data} if data else {})))

    def features(self, texts: list[bytes]) -> np.ndarray:
        n = np.array([len(t) for t in texts], float) + 1
        g, b, c = (np.array([len(z.compress(t)) for t in texts], float) for z in self.by)
        d = b - g
        return np.column_stack([d / c, d / n, d / (b + g), c / n, g / n, np.log(n)])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict:
    """Ridge logistic regression by damped Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (a @ w)).sum() + ridge / 2 * (w[1:] ** 2).sum()
    penalty = np.diag([1e-9] + [ridge] * (len(w) - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-6 * np.eye(len(w)), grad)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w -= t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w}


def apply(cal: dict, x: np.ndarray) -> np.ndarray:
    if cal is None:
        return np.full(len(x), 0.5)
    z = cal["w"][0] + ((x - cal["mean"]) / cal["scale"]) @ cal["w"][1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _encoded(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Dictionaries from half of the bounded sample, calibration on the other half, which they have not seen."""
    spark = docs.sparkSession
    rows = training_rows(docs, labels, label, doc_id=doc_id, text=text, per_class=per_class)
    half = F.xxhash64(F.col("text"), F.lit(3)) % 2 == 0
    size = F.octet_length("text")
    # sizes first (2 * per_class rows at most), so that only texts that fit are fetched; both classes in one reading each
    some = rows.where(half & (size > 0)).select("y", F.xxhash64("text", F.lit(11)).alias("h"), F.xxhash64("text", F.lit(12)).alias("g"), "text")
    fits, total = [], {0: 0, 1: 0}
    for h, g, y, n in sorted(map(tuple, some.select("h", "g", "y", size.alias("size")).distinct().collect())):
        if total[y] + n <= DICTIONARY_SAMPLE:
            fits.append((h, g, y))
            total[y] += n
    wanted = F.broadcast(spark.createDataFrame(fits, "h long, g long, y int"))
    found = some.join(wanted, ["h", "g", "y"]).dropDuplicates(["h", "g", "y"]).collect()  # DICTIONARY_SAMPLE bytes a class at most
    texts = [[r["text"].encode() for r in sorted(found, key=lambda r: (r["h"], r["g"])) if r["y"] == y] for y in (1, 0)]
    good, bad = map(_dictionary, texts)
    shared = broadcast_value(spark, (good, bad))

    def run(batches):
        sizes = Sizes(*shared.value)
        for batch in batches:
            x = sizes.features(_encoded(batch.column("text")))
            yield pa.record_batch([pa.array(c) for c in x.T] + [batch.column("y")], [f"x{i}" for i in range(x.shape[1])] + ["y"])

    fresh = rows.where(~half | (size == 0)).mapInArrow(run, ", ".join(f"x{i} double" for i in range(6)) + ", y int").toPandas()
    y = fresh.pop("y").to_numpy() if len(fresh) else np.zeros(0)
    order = np.lexsort(fresh.to_numpy().T) if len(fresh) else []
    return {"good": good, "bad": bad, "calibration": calibrate(fresh.to_numpy()[order], y[order]) if 0 < y.sum() < len(y) else None}


def classify(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; a null text is scored as an empty one.

    Repeated rows each give their row; an empty table gives none.  Where the training rows lack one of the
    classes, every score is 0.5.
    """
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches):
        m = shared.value
        sizes = Sizes(m["good"], m["bad"])
        for batch in batches:
            for part in X.slices(batch, "text"):
                s = apply(m["calibration"], sizes.features(_encoded(part.column("text"))))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that the model does not reject, with all their columns, whatever their names; no row moves.

    A null text is scored as an empty one, repeated rows and null ids are rows like others, texts of any length are
    compressed whole; an empty table gives no rows, and without labels of both classes all stay.
    """
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches):
        m = shared.value
        sizes = Sizes(m["good"], m["bad"])
        for batch in batches:
            for part in X.slices(batch, text):
                yield part.filter(pa.array(apply(m["calibration"], sizes.features(_encoded(part.column(text)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """Fit on the labelled rows that are not held out, and classify every document."""
    return classify(docs, train(docs, labels, **names), **{k: v for k, v in names.items() if k in ("doc_id", "text")})
