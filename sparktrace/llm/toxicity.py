"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is a hashed word embedding beside the mean of the hashed embeddings of its character
trigrams. Overlapping windows of WINDOW words, STEP apart, cover every text; a document's score is
the calibrated score of its worst window. Labels mark documents, so training picks windows: at first
by log odds of words, then by the network's own choice.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import named, numbered, tidy
from sparktrace.llm.exchange import distinct, vocabulary
from sparktrace.llm.lsa_decontaminate import batches_of, words

WINDOW, STEP = 32, 16
WORD_ROWS, CHAR_ROWS, WIDE, HIDDEN = 16384, 8192, 12, 12
TRIGRAMS = 24
#: Words whose inputs a worker keeps; beyond that it starts anew.
KEPT_WORDS = 80_000
#: Logit of every text where labels of both classes aren't there to learn from.
UNTAUGHT = -4.0
#: Windows that are cut or looked up at once.
PIECE = 20_000
#: Labelled rows of each class that training takes at most, and the longest text among them; documents that make a word frequent; share of words hidden in training.
SAMPLE, LONGEST = {1: 1000, 0: 2000}, 12_000
FREQUENT, DROP = 4, 0.2


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def rows_of(word: bytes) -> tuple[int, list[int]]:
    """Rows of a word and of its character trigrams; 0 is for the padding only."""
    around = b"<" + word + b">"
    grams = [1 + xxhash.xxh32_intdigest(around[i : i + 3]) % (CHAR_ROWS - 1) for i in range(len(around) - 2)]
    return 1 + xxhash.xxh32_intdigest(word) % (WORD_ROWS - 1), grams


def window_starts(n: int) -> range:
    """Starts of the windows that cover n words; one window at least."""
    return range(0, max(n - WINDOW + STEP, 1), STEP)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters by name; inputs are word vectors (windows, WINDOW, 2 * WIDE) and a mask of real words."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / shape[0] ** 0.5).astype(np.float32)
        self.p = {"word": (rng.standard_normal((WORD_ROWS, WIDE)) * 0.3).astype(np.float32), "char": (rng.standard_normal((CHAR_ROWS, WIDE)) * 0.5).astype(np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": normal(2 * WIDE, 3 * HIDDEN), f"h{side}": normal(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": normal(2 * HIDDEN, HIDDEN), "v": normal(HIDDEN), "o": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0
        self.frequent = np.zeros(WORD_ROWS, np.float32)

    def vectors(self, found: list[bytes]) -> np.ndarray:
        """Input vectors of words; a zero row comes first, for the padding."""
        out = np.zeros((len(found) + 1, 2 * WIDE), np.float32)
        at = [rows_of(w) for w in found]
        if at:
            rows = np.array([w for w, _ in at])
            out[1:, :WIDE] = self.p["word"][rows] * self.frequent[rows, None]
            flat = np.fromiter((g for _, grams in at for g in grams), np.int64)
            sizes = np.array([len(grams) for _, grams in at])
            out[1:, WIDE:] = np.add.reduceat(self.p["char"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return out

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return np.concatenate([vectors @ self.p["xf"] + self.p["cf"], vectors @ self.p["xb"] + self.p["cb"]], 1)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window; gates is (WINDOW, windows, 6 * HIDDEN). keep collects what training needs."""
        n = gates.shape[1]
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        for side, first in (("f", 0), ("b", 1)):
            u, h = self.p[f"h{side}"], np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                x = gates[t, :, first * 3 * HIDDEN : (first + 1) * 3 * HIDDEN]
                hu = h @ u
                zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                if keep is not None:
                    keep.append((side, t, h, z, r, new, hu[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                states[t, :, first * HIDDEN : (first + 1) * HIDDEN] = h
        told = np.tanh(states @ self.p["a"])
        weight = np.exp(np.clip(told @ self.p["v"], -30, 30)) * mask.T
        share = weight / np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", share, states)
        if keep is not None:
            keep.append((states, told, share, pooled))
        return pooled @ self.p["o"] + self.p["bias"][0]

    def gradients(self, gates: np.ndarray, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients by name and those of the word vectors, of the weighted logistic loss."""
        keep: list = []
        logit = self.run(gates, mask, keep)
        states, told, share, pooled = keep.pop()
        d = (sigmoid(logit) - y) * weight / len(y)
        g = {"o": pooled.T @ d, "bias": np.array([d.sum()])}
        d_pooled = d[:, None] * self.p["o"]
        d_states = share[:, :, None] * d_pooled
        d_share = np.einsum("tnh,nh->tn", states, d_pooled)
        d_energy = share * (d_share - (share * d_share).sum(0))
        g["v"] = np.einsum("tn,tnh->h", d_energy, told)
        d_told = d_energy[:, :, None] * self.p["v"] * (1 - told**2)
        g["a"] = np.einsum("tnh,tnk->hk", states, d_told)
        d_states += d_told @ self.p["a"].T
        d_gates = np.zeros_like(gates)
        for side, first in (("f", 0), ("b", 1)):
            u = self.p[f"h{side}"]
            g[f"h{side}"] = np.zeros_like(u)
            back = np.zeros((gates.shape[1], HIDDEN), np.float32)
            for s, t, h, z, r, new, hn in reversed(keep):
                if s != side:
                    continue
                dh = back + d_states[t, :, first * HIDDEN : (first + 1) * HIDDEN]
                d_new = dh * (1 - z) * (1 - new**2)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                inside = np.concatenate([d_z, d_r, d_new * r], 1)
                g[f"h{side}"] += h.T @ inside
                back = dh * z + inside @ u.T
                d_gates[t, :, first * 3 * HIDDEN : (first + 1) * 3 * HIDDEN] = np.concatenate([d_z, d_r, d_new], 1)
        flat = d_gates.transpose(1, 0, 2).reshape(-1, 6 * HIDDEN)
        by_word = np.zeros((len(vectors), 6 * HIDDEN), np.float32)
        np.add.at(by_word, ids.ravel(), flat)
        d_vectors = np.zeros_like(vectors)
        for side, first in (("f", 0), ("b", 1)):
            part = by_word[:, first * 3 * HIDDEN : (first + 1) * 3 * HIDDEN]
            g[f"x{side}"], g[f"c{side}"] = vectors.T @ part, part.sum(0)
            d_vectors += part @ self.p[f"x{side}"].T
        d_vectors[0] = 0
        return g, d_vectors

    def logits(self, gates_of: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of windows given as word numbers (0: padding)."""
        out = [self.run(gates_of[part.T], (part > 0).astype(np.float32)) for part in (ids[i : i + 2048] for i in range(0, len(ids), 2048))]
        return np.concatenate(out) if out else np.zeros(0, np.float32)


def cut(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of word numbers (from 1; 0 pads) of all texts in a row, and each window's text."""
    many = np.maximum(-(-(counts - WINDOW + STEP) // STEP), 1)
    text = np.repeat(np.arange(len(counts), dtype=np.int32), many)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    first, end = start + (np.cumsum(counts) - counts)[text], np.cumsum(counts)[text]
    padded = np.append(ids, 0).astype(np.int32) + 1
    out = np.empty((len(text), WINDOW), np.int32)
    for i in range(0, len(out), PIECE):  # in pieces, so that no second array is as large as the result
        at = first[i : i + PIECE, None] + np.arange(WINDOW)
        out[i : i + PIECE] = np.where(at < end[i : i + PIECE, None], padded[np.minimum(at, len(ids))], 0)
    return out, text


def train(texts: list[list[bytes]], labels: np.ndarray, prior: float | None = None, epochs: int = 6, least_steps: int = 150, seed: int = 11) -> Network:
    """Fit on documents given as words; labels are 0 and 1 and prior the share of 1 to calibrate for.

    texts is emptied. Words in fewer than FREQUENT documents have no embedding of their own, only their characters'.
    """
    net = Network(seed)
    if len(set(labels.tolist())) < 2:
        net.scale, net.shift = 0.0, UNTAUGHT
        return net
    ids, counts, known = vocabulary(texts)
    texts.clear()  # as numbers they take a small part of that
    windows, text = cut(ids, counts)
    found = list(known)
    rng = np.random.default_rng(seed)
    share = max(labels.mean(), 1e-3)
    net.p["bias"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
    # log odds of words by documents, for the first choice of windows
    of_text = np.repeat(np.arange(len(counts)), counts)
    pairs = distinct(of_text * np.int64(len(found)) + ids)
    bad = np.bincount(pairs % len(found), labels[pairs // len(found)], len(found)) if len(pairs) else np.zeros(0)
    all_ = np.bincount(pairs % len(found), minlength=len(found)) if len(pairs) else np.zeros(0)
    odds = np.concatenate([[0.0], np.log((bad + share) / (all_ - bad + 1 - share)) - np.log(share / (1 - share + 1e-9) + 1e-9)])
    value = np.concatenate([odds[windows[i : i + PIECE]].max(1) for i in range(0, len(windows), PIECE)])
    at = [rows_of(w) for w in found]
    word_rows = np.array([0] + [w for w, _ in at])
    sizes = np.array([len(g) for _, g in at]) if at else np.zeros(0, int)
    net.frequent[word_rows[1:][all_ >= FREQUENT]] = 1
    grams = np.fromiter((g for _, gs in at for g in gs), np.int64)
    gram_first = np.cumsum(sizes) - sizes
    # the first coordinate of frequent words and trigrams starts at their log odds
    net.p["word"] *= 0.3
    net.p["char"] *= 0.3
    if len(pairs):
        net.p["word"][word_rows[1:], 0] = np.clip(odds[1:], -3, 5) / 2
        bad, seen = np.zeros(CHAR_ROWS), np.zeros(CHAR_ROWS)
        for i in range(0, len(labels), 100):  # some documents at a time: their trigrams are many more than their words
            some = pairs[np.searchsorted(pairs, i * len(found)) : np.searchsorted(pairs, (i + 100) * len(found))]
            word, of = some % len(found), some // len(found)
            used = sizes[word]
            at_gram = grams[np.arange(used.sum()) + np.repeat(gram_first[word] - np.cumsum(used) + used, used)]
            both = distinct(np.repeat(of, used) * np.int64(CHAR_ROWS) + at_gram)
            bad += np.bincount(both % CHAR_ROWS, labels[both // CHAR_ROWS], CHAR_ROWS)
            seen += np.bincount(both % CHAR_ROWS, minlength=CHAR_ROWS)
        gram_odds = np.log((bad + share) / (seen - bad + 1 - share)) - np.log(share / (1 - share + 1e-9) + 1e-9)
        net.p["char"][:, 0] = np.where(seen >= FREQUENT, np.clip(gram_odds, -3, 5), 0) / 2
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, best, checked = 0, None, np.zeros(len(labels), bool)
    for k in (0, 1):  # every fifth document of a class tells which state of the network is kept
        checked[np.flatnonzero(labels == k)[::5]] = True
    odds_only = value.copy()
    for epoch in range(10_000):
        if epoch >= epochs and step >= least_steps:
            break
        order = np.lexsort((-value, text))
        first = np.flatnonzero(np.diff(text[order], prepend=-1))
        chosen = order[first]
        chosen = chosen[~checked[text[chosen]]]
        y_doc = labels[text[chosen]]
        negative = np.flatnonzero((labels[text] == 0) & ~checked[text])
        extra = rng.choice(negative, min(len(negative), 2 * len(labels)), replace=False) if len(negative) else negative
        rows = np.concatenate([chosen, extra])
        y = np.concatenate([y_doc, np.zeros(len(extra))]).astype(np.float32)
        weight = np.where(y > 0, max(1.0, (y == 0).sum() / max((y > 0).sum(), 1) * 0.5), 1.0).astype(np.float32)
        mixed = rng.permutation(len(rows))
        for i in range(0, len(mixed), 128):
            part = mixed[i : i + 128]
            seen = np.where(rng.random((len(part), WINDOW)) < DROP, 0, windows[rows[part]])
            there, local = np.unique(np.append(seen.ravel(), 0), return_inverse=True)
            local = local[:-1].reshape(len(part), WINDOW)
            vectors = net.vectors([found[j - 1] for j in there[1:]])
            gates = net.inputs(vectors)[local.T]
            g, d_vectors = net.gradients(gates, vectors, local, (local > 0).astype(np.float32), y[part], weight[part])
            used = sizes[there[1:] - 1]
            back = np.repeat(np.arange(1, len(there)), used)
            inside = np.arange(used.sum()) + np.repeat(gram_first[there[1:] - 1] - np.cumsum(used) + used, used)
            g["word"], g["char"] = {}, {}
            step += 1
            rate = 0.01 * min(1, step / 20)
            for name, rows_at, grad in (("word", word_rows[there[1:]], d_vectors[1:, :WIDE] * net.frequent[word_rows[there[1:]], None]), ("char", grams[inside], d_vectors[back, WIDE:] / sizes[there[back] - 1][:, None])):
                spot, where = np.unique(rows_at, return_inverse=True)
                total = np.zeros((len(spot), WIDE), np.float32)
                np.add.at(total, where, grad)
                m, s = moment[name]
                m[spot] = 0.9 * m[spot] + 0.1 * total
                s[spot] = 0.99 * s[spot] + 0.01 * total**2
                net.p[name][spot] -= rate * m[spot] / (np.sqrt(s[spot]) + 1e-6)
            for name in net.p.keys() - {"word", "char"}:
                m, s = moment[name]
                m[:] = 0.9 * m + 0.1 * g[name]
                s[:] = 0.99 * s + 0.01 * g[name] ** 2
                net.p[name] -= rate * m / (np.sqrt(s) + 1e-6)
        if epoch % 3 == 2 or len(rows) > 2000:
            value = net.logits(net.inputs(net.vectors(found)), windows).astype(float)
            worst = np.full(len(labels), -np.inf)
            np.maximum.at(worst, text, value)
            rank = np.argsort(np.argsort(worst[checked]))
            told = float(rank[labels[checked] == 1].mean()) if labels[checked].any() else 0.0
            if best is None or told >= best[0]:
                best = (told, {k: v.copy() for k, v in net.p.items()}, value)
            if len(labels) < 1000:
                value = odds_only  # too few documents to let the network choose its own windows
    net.p, value = best[1:]
    # calibrate the worst window's logit on the documents, weighted to the prior
    worst = np.full(len(labels), -np.inf)
    np.maximum.at(worst, text, value)
    prior = share if prior is None else prior
    weight = np.where(labels > 0, prior / share, (1 - prior) / max(1 - share, 1e-3))
    x, beta = np.stack([np.clip(worst, -20, 20), np.ones(len(worst))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ beta)
        curve = (x.T * (weight * p * (1 - p))) @ x + np.diag([0.05, 0.05])
        beta = beta - np.clip(np.linalg.solve(curve, x.T @ (weight * (p - labels)) + 0.05 * (beta - [1, 0])), -2, 2)
    a, b = float(beta[0]), float(beta[1])
    net.scale, net.shift = max(a, 0.05), b
    return net


class Scorer:
    """A network with the inputs of words seen so far."""

    def __init__(self, net: Network):
        self.net, self.place, self.gates = net, {}, net.inputs(net.vectors([]))

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        ids, counts, known = vocabulary(texts)
        if len(self.place) > KEPT_WORDS:
            self.place, self.gates = {}, self.gates[:1]
        new = [w for w in known if w not in self.place]
        if new:
            self.place |= {w: len(self.place) + i for i, w in enumerate(new)}
            self.gates = np.concatenate([self.gates, self.net.inputs(self.net.vectors(new))[1:]])
        at = np.fromiter((self.place[w] for w in known), np.int64, len(known))
        windows, text = cut(at[ids], counts)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text, self.net.logits(self.gates, windows))
        return sigmoid(self.net.scale * worst + self.net.shift)


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on at most SAMPLE labelled documents of each class that are not held out and no longer than LONGEST, chosen by a hash of the id.

    One task of an executor trains; only the network comes to the driver.
    """
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    short = docs.where(F.length("text") <= LONGEST).select("doc_id").distinct().join(rows, "doc_id")
    some = [short.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id", F.lit(k)), "doc_id").limit(SAMPLE[k]) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # as many rows as SAMPLE has in all
    found = named(docs.join(chosen, "doc_id").where(F.length("text") <= LONGEST).select("doc_id", F.col("text").alias("t"), "toxic"), F.col("t").alias("text"), "toxic")
    prior = rows.agg(F.avg("toxic")).first()[0]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        held = [b for b in batches if len(b)]
        texts, marks = [], np.zeros(0)
        if held:
            rows = pd.concat(held, ignore_index=True).sort_values(["doc_id", "text"])
            texts, marks = [words(t) for t in rows["text"]], rows["toxic"].to_numpy(float)
            del rows
        held.clear()
        net = pickle.dumps(train(texts, marks, prior))
        tidy()
        yield pd.DataFrame({"network": [net]})

    row = found.repartition(1).mapInPandas(fit, "network binary").first()
    return pickle.loads(row["network"]) if row else train([], np.zeros(0))  # without rows no task runs


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every document.

    A null or empty text is a window of padding; a null doc_id stays null, is never learnt from and
    counts as text "None"; labels other than 0 and 1 are ignored; without labels of both classes all
    scores are equal and none is predicted toxic; equal texts get equal scores; repeated rows get equal scores; further columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        scorer = Scorer(shared.value)
        for ids, texts in batches_of(batches):
            scores = scorer.scores(texts).astype(float)
            names = [None if pd.isna(d) else d for d in ids]
            yield pd.DataFrame({"doc_id": names, "held_out": [held_out(d) for d in names], "score": scores, "predicted": (scores >= 0.5).astype(int)})

    return numbered(named(docs, "text").mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is predicted toxic; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pandas()
            scores = [scorer.scores(some) for _, some in batches_of(iter([pd.DataFrame({"doc_id": 0, "text": texts})]))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(run, docs.schema)
