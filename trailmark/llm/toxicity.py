"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words, hashed into ``BUCKETS``.  The machine scores
``b + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms present, so that a pair of words can weigh what
neither weighs alone.  Buckets are first screened on the training rows by chi-square with the label, alone and
in pairs: of the pairs of ``COMMON`` frequent buckets those count that tell more together than either does alone.
At most ``FEATURES`` buckets are kept, ``PAIRED`` of them for pairs; all others have no weight.  Fitting uses a
bounded sample (see _labels), scoring every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import PER_CLASS, held_out, training_rows
from ._shared import broadcast_value

BUCKET_BITS = 18
#: Buckets that have a weight, those of them that are kept for pairs, and frequent buckets whose pairs are looked at.
FEATURES, PAIRED, COMMON = 1024, 256, 768
FACTORS = 8


def terms(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs, ordered; with ``keep`` (bucket -> feature or -1), features."""
    words = X.scan(data, offsets, X.ALNUM)
    bucket = (words.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    doc = words.doc_of()
    if keep is not None:
        feature = keep[bucket]
        at = feature >= 0
        bucket, doc = feature[at].astype(np.int64), doc[at]
    both = np.unique((doc << BUCKET_BITS) | bucket)
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


def _chi_square(tp: np.ndarray, df: np.ndarray, pos: int, n: int) -> np.ndarray:
    """The statistic of "holds it" against the label, of counts among positive and among all rows; 0 for rare ones."""
    expect = df * pos / n
    return np.where((df >= 5) & (df < n), (tp - expect) ** 2 / np.maximum(expect * (1 - pos / n) * (1 - df / n), 1e-9), 0)


def paired(rows: list[np.ndarray], y: np.ndarray, chi: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Frequent buckets whose pairs tell more of the label than either bucket alone, the best pairs first."""
    common = np.argsort(-df, kind="stable")[:COMMON]
    common = common[df[common] >= 5]
    spot = np.full(1 << BUCKET_BITS, -1, np.int32)
    spot[common] = np.arange(len(common))
    both = {}
    for label in (1, 0):
        total = np.zeros((len(common), len(common)), np.float32)
        some = [r for r, k in zip(rows, y, strict=True) if k == label]
        for at in range(0, len(some), 2000):
            x = np.zeros((len(some[at : at + 2000]), len(common)), np.float32)
            for i, r in enumerate(some[at : at + 2000]):
                f = spot[r]
                x[i, f[f >= 0]] = 1
            total += x.T @ x
        both[label] = total.astype(float)
    i, j = np.triu_indices(len(common), 1)
    tp, n_both = both[1][i, j], both[1][i, j] + both[0][i, j]
    pair = _chi_square(tp, n_both, int(y.sum()), len(y))
    alone = np.maximum(chi[common[i]], chi[common[j]])
    good = np.flatnonzero((pair > 4 * alone) & (pair > 30))  # far beyond chance among all pairs
    order = good[np.argsort(-pair[good], kind="stable")][:PAIRED]
    return np.array(list(dict.fromkeys(np.column_stack([common[i[order]], common[j[order]]]).ravel().tolist())), np.int64)[:PAIRED]


def fit(rows: list[np.ndarray], y: np.ndarray, *, epochs: int = 12, seed: int = 5) -> dict:
    """Train on rows of bucket numbers; the empty model (score 0) where a class is missing."""
    keep = np.full(1 << BUCKET_BITS, -1, np.int16)
    model = {"keep": keep, "b": np.float64(-4.0), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    pos, n = int(y.sum()), len(y)
    if not pos or pos == n:
        return model
    size = 1 << BUCKET_BITS
    tp = np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k]), minlength=size).astype(float)
    fp = np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if not k]), minlength=size).astype(float)
    chi = _chi_square(tp, tp + fp, pos, n)
    best = np.argsort(-chi, kind="stable")[: FEATURES - PAIRED]
    best = best[chi[best] > 6.6]
    more = np.setdiff1d(paired(rows, y, chi, tp + fp), best)
    best = np.concatenate([best, more])
    keep[best] = np.arange(len(best))
    m = len(best)
    rng = np.random.default_rng(seed)
    b, w, v = 0.0, np.zeros(m), rng.normal(0, 0.02, (m, FACTORS))
    v[m - len(more) :] *= 10  # what tells in pairs only has to leave the saddle at 0
    gw, gv, gb = np.full(m, 1e-2), np.full((m, FACTORS), 1e-2), 1e-2
    rate = np.full((m, 1), 0.05)
    rate[m - len(more) :] = 0.3
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    dense = np.zeros((n, m), np.float32)
    for i, r in enumerate(rows):
        f = keep[r]
        dense[i, f[f >= 0]] = 1
    for _ in range(epochs * (3 if len(more) else 1)):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = order[at : at + 256]
            x = dense[pick]
            xv = x @ v
            z = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            dw = x.T @ g + 1e-5 * w
            dv = (x * g[:, None]).T @ xv - (x.T @ g)[:, None] * v + 1e-4 * v
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= 0.3 * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            b -= 0.3 * g.sum() / np.sqrt(gb)
    return model | {"b": b, "w": w, "v": v}


def score(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc, f = terms(data, offsets, model["keep"])
    n = len(offsets) - 1
    z = np.full(n, float(model["b"]))
    if len(f):
        w, v = model["w"], model["v"]
        z += np.bincount(doc, w[f] - 0.5 * (v[f] ** 2).sum(1), n)
        for k in range(FACTORS):
            z += 0.5 * np.bincount(doc, v[f, k], n) ** 2
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(batches):
    for batch in batches:
        for part in X.slices(batch, "text"):
            data, offsets = X.utf8(part.column("text"))
            doc, bucket = terms(data, offsets)
            edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
            blobs = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch([part.column("_id"), pa.array(blobs, pa.binary()), part.column("y")], ["_id", "terms", "y"])


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    rows = training_rows(docs, labels, label, doc_id=doc_id, text=text, per_class=per_class)
    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.mapInArrow(_features, f"_id {kind}, terms binary, y int").toPandas()
    got = got.sort_values("_id", kind="stable")
    return fit([np.frombuffer(x, "<u4") for x in got["terms"]], got["y"].to_numpy())


def classify(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; a null text is scored as an empty one.

    Empty texts get the score of the bias alone.  Repeated rows each give their row; an empty table gives
    none.  Where the training rows lack one of the classes, every score is that of a low constant bias.
    """
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "text"):
                s = score(shared.value, *X.utf8(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that the model does not call toxic, with all their columns, whatever their names; no row moves.

    Null and empty texts are scored by the bias alone, repeated rows and null ids are rows like others, texts of any
    length are scored whole; an empty table gives no rows, and without labels of both classes all stay.
    """
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, text):
                yield part.filter(pa.array(score(shared.value, *X.utf8(part.column(text))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """Fit on the labelled rows that are not held out, and classify every document."""
    return classify(docs, train(docs, labels, **names), **{k: v for k, v in names.items() if k in ("doc_id", "text")})
