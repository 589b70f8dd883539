"""Toxic spans and document scores by a linear-chain conditional random field.

Two states (clean, toxic) run over the words of each sentence. Word labels for
training come from the document labels: a word of a toxic document is labelled
toxic if the word's document frequencies in toxic and clean training documents
differ beyond chance (binomial log-likelihood ratio against the vocabulary
size). The CRF is fitted by stochastic gradient on its exact likelihood
(forward-backward), in numpy, on a bounded sample of labelled rows. Executors
score every whole text: forward-backward marginals of all sentences of a batch
in lock step, then a logistic of (largest marginal, log of their sum) gives the
document score; runs of words with marginal >= 0.5 are the offending offsets.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_below, map_batches, release

#: Words, and sentence ends, which break chains.
TOKEN = re.compile(r"\w+|[.!?\n]")
ENDS = (".", "!", "?", "\n")


def _lower(text: str) -> str:
    """Lower case of the same length, so that offsets hold in the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _chains(is_end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Chain number of each token; a chain ends at a sentence end or with its document."""
    step = np.empty(len(is_end), bool)
    step[:1] = False
    step[1:] = is_end[:-1] | (doc[1:] != doc[:-1])
    return np.cumsum(step)


class Lockstep:
    """Forward-backward for many two-state chains at once: step t handles every chain longer than t."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.first, sizes = first[order], lengths[order]
        top = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(1, top + 1), side="right")

    def run(self, gap: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of the toxic state and the backward log ratio, for the emission gap (toxic - clean) of each token.

        With r = log(alpha_toxic / alpha_clean) one float per token carries the whole recursion.
        """
        (t00, t01), (t10, t11) = np.exp(trans)
        fwd, bwd = np.empty(len(gap)), np.zeros(len(gap))
        for t, k in enumerate(self.active):
            at = self.first[:k] + t
            if t == 0:
                fwd[at] = start + gap[at]
            else:
                ratio = np.exp(np.clip(fwd[at - 1], -60, 60))
                fwd[at] = gap[at] + np.log((t01 + ratio * t11) / (t00 + ratio * t10))
        for t in range(len(self.active) - 1, 0, -1):
            at = self.first[:self.active[t]] + t
            ratio = np.exp(np.clip(gap[at] + bwd[at], -60, 60))
            bwd[at - 1] = np.log((t10 + ratio * t11) / (t00 + ratio * t01))
        return 1 / (1 + np.exp(-np.clip(fwd + bwd, -60, 60))), bwd

    def edges(self, gap: np.ndarray, bwd: np.ndarray, p: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """Expected transition counts, 2 x 2: P(previous) * P(next | previous)."""
        out = np.zeros((2, 2))
        e = np.exp(trans)
        for t in range(1, len(self.active)):
            at = self.first[:self.active[t]] + t
            ratio = np.exp(np.clip(gap[at] + bwd[at], -60, 60))
            for a, mass in ((0, 1 - p[at - 1]), (1, p[at - 1])):
                to1 = ratio * e[a, 1] / (e[a, 0] + ratio * e[a, 1])
                out[a, 1] += (mass * to1).sum()
                out[a, 0] += (mass * (1 - to1)).sum()
        return out


def _features(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: bias, largest marginal, log of one plus their sum."""
    top = np.zeros(n_docs)
    np.maximum.at(top, doc, p)
    return np.stack([np.ones(n_docs), top, np.log1p(np.bincount(doc, p, n_docs))], 1)


def fit(texts: list[str], toxic: np.ndarray, prior: float, epochs: int = 6, seed: int = 7) -> dict:
    """Fit word labels, CRF and document logistic. ``prior``: share of toxic rows among all labelled ones."""
    toxic = np.asarray(toxic, bool)
    docs = [TOKEN.findall(_lower(t)) for t in texts]
    vocab: dict[str, int] = {}
    flat = np.fromiter((vocab.setdefault(w, len(vocab)) for d in docs for w in d), np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    n_tox, n_cl, size = int(toxic.sum()), int((~toxic).sum()), len(vocab)
    if not n_tox or not n_cl or not len(flat):
        return {"gap": {}, "rare": 0.0, "start": 0.0, "trans": np.zeros((2, 2)).tolist(),
                "head": [float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), 0.0, 0.0]}
    pairs = np.unique(doc * size + flat)
    in_tox = np.bincount(pairs % size, toxic[pairs // size], size)
    in_all = np.bincount(pairs % size, minlength=size).astype(float)
    base, share = n_tox / (n_tox + n_cl), in_tox / in_all
    with np.errstate(divide="ignore", invalid="ignore"):
        llr = in_all * (np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base))))
    llr[share <= base] = 0
    marked = llr >= np.log(max(2, (in_all >= 3).sum())) + 1
    if not marked.any():  # very small samples: the strongest few
        marked[np.argsort(-llr, kind="stable")[:5]] = True
        marked &= llr > 0
    is_end = np.isin(flat, [vocab[e] for e in ENDS if e in vocab])
    chain = _chains(is_end, doc)
    word = ~is_end
    flat, doc, chain = flat[word], doc[word], chain[word]
    label = (marked[flat] & toxic[doc]).astype(float)
    known = in_all >= 2  # words of one document share a weight with unseen ones
    ids = np.where(known, np.cumsum(known), 0)[flat]
    weights, start, trans = np.zeros(int(known.sum()) + 1), 0.0, np.zeros((2, 2))
    squares, sq_start, sq_trans = np.full(len(weights), 1e-2), 1e-2, np.full((2, 2), 1e-2)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(chain)) + 1, [len(chain)]])
    rng = np.random.default_rng(seed)
    groups = np.array_split(rng.permutation(len(cut) - 1), max(1, (len(cut) - 1) // 4000))
    for _ in range(epochs):
        for g in groups:
            lens = cut[g + 1] - cut[g]
            at = np.repeat(cut[g] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            steps, y, w = Lockstep(lens), label[at], ids[at]
            gap = weights[w]
            p, bwd = steps.run(gap, start, trans)
            grad = np.bincount(w, p - y, len(weights)) + 1e-3 * weights
            heads = np.concatenate([[0], np.cumsum(lens)[:-1]])
            inner = np.ones(len(at), bool)
            inner[heads] = False
            prev, now = y[np.flatnonzero(inner) - 1], y[inner]
            seen = np.array([[((1 - prev) * (1 - now)).sum(), ((1 - prev) * now).sum()],
                             [(prev * (1 - now)).sum(), (prev * now).sum()]])
            g_trans, g_start = steps.edges(gap, bwd, p, trans) - seen, (p[heads] - y[heads]).sum()
            squares += grad**2
            weights -= 0.7 * grad / np.sqrt(squares)
            sq_start, sq_trans = sq_start + g_start**2, sq_trans + g_trans**2
            start -= 0.7 * g_start / np.sqrt(sq_start)
            trans -= 0.7 * g_trans / np.sqrt(sq_trans)
    p, _ = Lockstep(np.diff(cut)).run(weights[ids], start, trans)
    x = _features(p, doc, len(docs))
    importance = np.where(toxic, prior / n_tox, (1 - prior) / n_cl)
    head = np.zeros(3)
    for _ in range(200):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ head, -40, 40)))
        step = np.linalg.solve((x * (importance * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(3),
                               x.T @ (importance * (q - toxic)) + 1e-4 * head * np.array([0, 1, 1]))
        head -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    number = np.where(known, np.cumsum(known), 0)
    gaps = {w: float(weights[number[i]]) for w, i in vocab.items() if known[i] and w not in ENDS}
    return {"gap": gaps, "rare": float(weights[0]), "start": float(start), "trans": trans.tolist(), "head": head.tolist()}


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 3000, max_train_chars: int = 40_000,
          label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0) -> dict:
    """Fit on at most ``max_train_rows`` labelled rows (half of them toxic where there are enough), none of the held fold.

    Sampled rows are chosen by a hash of the id; rows longer than
    ``max_train_chars`` are not sampled (the bound on what the driver holds).
    Conflicting labels of an id count as toxic; null labels and ids are ignored.
    """
    spark = docs.sparkSession
    rows = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
            .where(F.crc32(F.col("id").cast("string")) % folds != held_fold)
            .groupBy("id").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    half = max(1, max_train_rows // 2)
    # Each class by a share of the hash range that holds about 1.5 times the rows wanted, then cut to the bound.
    picked = [r for y in (0, 1) for r in rows.where((F.col("y") == y) & hash_below("id", (1.5 * half + 20) / max(1, counts.get(y, 0))))
              .orderBy(F.xxhash64("id"), "id").limit(half).collect()]
    if not picked:
        return fit([], np.zeros(0), prior)
    ids = spark.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int")
    text = F.col(f"`{text_col}`")
    sample = (docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.length(text) <= max_train_chars)
              .join(F.broadcast(ids), "id").dropDuplicates(["id"]).collect())  # at most max_train_rows ids
    sample.sort(key=lambda r: r["id"])
    texts, toxic = [r["text"] for r in sample], np.array([r["y"] for r in sample])
    del sample
    model = fit(texts, toxic, prior)
    del texts
    release(spark)
    return model


def _score_batch(texts: list[str | None], model: dict) -> tuple[np.ndarray, list[list[dict]]]:
    gaps, rare, end = model["gap"], model["rare"], {e: np.nan for e in ENDS}
    lookup = (gaps | end).get
    low = [_lower(t) if t else "" for t in texts]
    words = [TOKEN.findall(t) for t in low]
    gap = np.fromiter((lookup(w, rare) for d in words for w in d), np.float64)
    doc = np.repeat(np.arange(len(texts)), [len(d) for d in words])
    is_end = np.isnan(gap)
    chain = _chains(is_end, doc)[~is_end]
    at = np.flatnonzero(~is_end)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(chain)) + 1, [len(chain)]]) if len(chain) else np.zeros(1, int)
    p, _ = Lockstep(np.diff(cut)).run(gap[at], model["start"], np.array(model["trans"]))
    head = np.array(model["head"])
    score = 1 / (1 + np.exp(-np.clip(_features(p, doc[at], len(texts)) @ head, -40, 40)))
    spans: list[list[dict]] = [[] for _ in texts]
    first = np.concatenate([[0], np.cumsum([len(d) for d in words])])
    flagged = np.flatnonzero(p >= 0.5)
    for d, group in _by_doc(doc[at][flagged], flagged):
        offsets = [m.span() for m in TOKEN.finditer(low[d])]
        for run in np.split(group, np.flatnonzero(np.diff(at[group]) > 1) + 1):
            a, b = at[run[0]] - first[d], at[run[-1]] - first[d]
            spans[d].append({"start": offsets[a][0], "end": offsets[b][1], "p": float(p[run].max())})
    return score, spans


def _by_doc(doc: np.ndarray, rows: np.ndarray):
    cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    for a, b in pairwise(cut):
        if b > a:
            yield doc[a], rows[a:b]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id (null stays null), score, predicted, spans (offsets in characters, largest marginal), then ``carry``.

    Null and empty texts get the score of a text without words. Repeated rows
    are scored each for itself. Every word of every text is read. A batch goes
    through in slices of about 1M characters, so that memory doesn't follow its size.
    """
    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"),
                       *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    outputs = [f for f in kept.schema.fields if f.name.startswith("_c") or f.name == "_text" and carry]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        scores, spans, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= 1_000_000):
                size += len(texts[end] or "")
                end += 1
            s, found = _score_batch(texts[at:end], shared.value)
            scores.append(s)
            spans += found
            at = end
        s = np.concatenate(scores)
        arrays = [b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, SPANS)]
        names = ["doc_id", "score", "predicted", "spans"]
        for f in outputs:
            arrays.append(b.column(b.schema.get_field_index(f.name)))
            names.append(f.name)
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,p:double>>"
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in outputs)
    return map_batches(kept, one, schema)


def reject(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns as they were."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    out = score(docs, model, id_col, text_col, others or (id_col,)).where("predicted = 0")
    place = {id_col: "doc_id", text_col: "_text"} | {c: f"_c{i}" for i, c in enumerate(others)}
    return out.select(*[F.col(place[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
