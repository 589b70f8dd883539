"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of 2 to 4 bytes of the lower-case UTF-8 text, everything but
letters folded to one blank, hashed into ``buckets``. A text is the mean of its
subwords' embeddings; a softmax over the languages follows. Embeddings and
softmax are trained together by stochastic gradient descent in numpy on a
bounded sample. A part of the sample is kept back to calibrate: a temperature
for the probabilities, and the probability below which a prediction is
rejected, the least one whose accepted predictions are right often enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_below, map_batches

#: Unicode category L, as in training: no fractions, superscripts, circled or Roman numerals.
LETTER = regex.compile(r"\p{L}")
#: Bytes that aren't ASCII letters or part of a longer character become blanks.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def subwords(text: str, buckets: int) -> np.ndarray:
    """Shares of the hashed subwords of a whole text, a vector of ``buckets``."""
    b = FOLD[np.frombuffer(f" {text} ".lower().encode("utf-8", "replace"), np.uint8)]
    blank = b == 32
    b = b[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    counts = np.zeros(buckets, np.int64)
    h = b * np.uint32(MULTIPLIERS[0])
    for n in range(2, 5):
        if len(b) < n:
            break
        h = (h[:len(b) - n + 1] ^ (h[:len(b) - n + 1] >> np.uint32(15))) * np.uint32(MULTIPLIERS[n - 1]) + b[n - 1:] * np.uint32(MULTIPLIERS[0] + 2 * n)
        counts += np.bincount((h ^ (h >> np.uint32(13))) % np.uint32(buckets), minlength=buckets)
    return (counts / max(1, counts.sum())).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], buckets: int = 8192, dim: int = 16, epochs: int = 12, rate: float = 8.0, batch: int = 32,
        calibration: float = 0.2, accepted: float = 0.99, seed: int = 11) -> dict:
    """Train on texts with their languages; ``calibration`` of them are kept back."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "buckets": buckets}
    x = [subwords(t, buckets) for t in texts]
    kept = [np.flatnonzero(v).astype(np.int32) for v in x]
    shares = [v[i] for v, i in zip(x, kept, strict=True)]
    del x
    y = np.array([names.index(s) for s in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    n_cal = int(calibration * len(y)) if len(y) >= 50 else 0
    cal, train = order[:n_cal], order[n_cal:]
    emb = rng.normal(0, 0.5, (buckets, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (dim, len(names))).astype(np.float32), np.zeros(len(names), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        m = np.zeros((len(rows), buckets), np.float32)
        for i, r in enumerate(rows):
            m[i, kept[r]] = shares[r]
        return m

    steps, total = 0, epochs * -(-len(train) // batch)
    for _ in range(epochs):
        for i in range(0, len(train), batch):
            rows = np.arange(i, min(i + batch, len(train)))
            m = dense(train[rows])
            hidden = m @ emb
            g = _softmax(hidden @ out + bias)
            g[np.arange(len(rows)), y[train[rows]]] -= 1
            g /= len(rows)
            lr = rate * (1 - steps / total)
            back = g @ out.T
            out -= lr * 0.1 * (hidden.T @ g)
            bias -= lr * 0.1 * g.sum(0)
            emb -= lr * buckets**0.5 * (m.T @ back)
            steps += 1
        train = train[rng.permutation(len(train))]
    model = {"names": names, "buckets": buckets, "emb": emb, "out": out, "bias": bias, "temperature": 1.0, "reject_below": 0.0}
    if n_cal:
        logits = np.concatenate([dense(cal[i:i + 256]) @ emb @ out + bias for i in range(0, n_cal, 256)])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(n_cal), y[cal]] + 1e-12).mean()
        model["temperature"] = float(min(np.geomspace(0.2, 20, 60), key=loss))
        p = _softmax(logits / model["temperature"])
        score, right = p.max(1), p.argmax(1) == y[cal]
        by = np.argsort(-score)
        good = np.cumsum(right[by]) / np.arange(1, n_cal + 1) >= accepted
        model["reject_below"] = float(score[by][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def train(docs: DataFrame, max_rows: int = 4000, max_chars: int = 20_000, max_langs: int = 500, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit on about ``max_rows`` rows (1.2 times that at most) with a language, none of the held fold.

    The ``max_langs`` most frequent languages share the sample evenly. Sampled
    are rows with a letter and at most ``max_chars`` characters (the bound on
    what the driver holds), by a hash of the id.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.dropna().where((F.crc32(F.col("id").cast("string")) % folds != held_fold) & (F.length("text") <= max_chars)
                               & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return fit([], [])
    share = max_rows / len(counts)
    # Each language by the share of the hash range that holds about its part of the sample.
    wanted = rows.sparkSession.createDataFrame([(r["lang"], (share + 10) / r["n"]) for r in counts], "lang string, share double")
    ids = (rows.select("id", "lang").join(F.broadcast(wanted), "lang").where(hash_below("id", F.col("share")))
           .select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(int(1.2 * max_rows)))
    sample = rows.join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy("id").collect()  # 1.2 * max_rows rows at most
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability), rejected (score below the calibrated bound).

    A text that is null or has no letter is ``und``, with score 0, and counts as
    rejected; so is every text if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by buckets x dim

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        m, lang, score = shared.value, [], []
        for i in range(0, b.num_rows, 256):
            texts = b.column(1).slice(i, 256).to_pylist()
            known = [j for j, t in enumerate(texts) if t is not None and m["names"] and LETTER.search(t)]
            picked, p = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                x = np.stack([subwords(texts[j], m["buckets"]) for j in known])
                prob = _softmax((x @ m["emb"] @ m["out"] + m["bias"]) / m["temperature"])
                for j, row in zip(known, prob, strict=True):
                    picked[j], p[j] = m["names"][int(row.argmax())], float(row.max())
            lang += picked
            score += p
        rejected = [n == "und" or s < m.get("reject_below", 0) for n, s in zip(lang, score, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, lang_pred string, score double, rejected boolean")
