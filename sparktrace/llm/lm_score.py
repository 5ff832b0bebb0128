"""Language-model scores by deleted interpolation.

P(w | u) = l2 c(u w) / c(u) + l1 c(w) / N + l0 / (V + 1), the three weights chosen by the bucket that
the frequency of the context u falls into. The weights of each bucket come from expectation-
maximisation on held-out counts: every training token is scored with itself deleted from all counts.
A text's first token has the end of text as context.

Counts are exact sums over all training texts, by 64-bit hash, through a packed exchange: each unit
of documents sends each distinct word and pair once, so frequent ones don't meet in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import named, stored
from sparktrace.llm.exchange import ANSWER, BUCKETS_EACH, PACKED, UNIT, UNITS_EACH, coded, dealt, decoded, hashes, mix, pack, sizes, spread, unpack, vocabulary
from sparktrace.llm.simhash_dedup import words

#: Steps per power of ten at which token probabilities are tallied for expectation-maximisation, and its rounds.
FINE, ROUNDS = 20, 60
MAX_BUCKETS = 64


def held_out(doc_id: object) -> bool:
    """Whether a document is kept from learning: crc32 of its id as text modulo 7 is 2. A null id is text "None"."""
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(rows: pd.DataFrame) -> dict:
    """All tokens of a unit: numbers of the words and pairs, their hashes, document and context of each token."""
    texts = [[*words(t), b""] for t in rows["text"]]
    ids, counts, known = vocabulary(texts)
    of = hashes(known)[:, 0]
    doc = np.repeat(np.arange(len(counts)), counts)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[0] = known[b""]  # after a text's last token, the end, comes the next text's first
    pair_keys, pairs = np.unique(mix(of[before] * np.uint64(0xD6E8FEB86659FD93) + of[ids]), return_inverse=True)
    names = [None if pd.isna(d) else d for d in rows["doc_id"]]
    held = np.array([held_out(d) for d in names], bool)
    return {"ids": ids, "before": before, "pairs": pairs, "words": of, "pair_keys": pair_keys, "doc": doc, "names": names, "held": held, "counts": counts}


def ask(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    x = tokens(rows)
    unit, learn = int(rows[UNIT].iloc[0]), ~x["held"][x["doc"]]
    tally = lambda at, n: np.bincount(at[learn], minlength=n)
    single = pack(unit, x["words"], tally(x["ids"], len(x["words"])), buckets, coded)
    double = pack(unit, x["pair_keys"], tally(x["pairs"], len(x["pair_keys"])), buckets, coded, buckets)
    return pd.concat([single, double])


def total(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Each key's count over all units, for each unit in the order of its keys; and a row (unit -1) of a word bucket's N and V."""
    keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
    sent = rows["keys"].map(len).to_numpy() // 8
    counts = np.concatenate([decoded(more, n) for more, n in zip(rows["more"], sent.tolist(), strict=True)])
    distinct, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    bucket = int(rows["bucket"].iloc[0])
    out = [(u, bucket, coded(x)) for u, x in zip(rows["unit"], np.split(sums[at], np.cumsum(sent)[:-1]), strict=True)]
    if bucket < buckets:
        out.append((-1, bucket, np.array([sums.sum(), np.count_nonzero(sums)], "<i8").tobytes()))
    return pd.DataFrame(out, columns=["unit", "bucket", "found"])


def corpus_size(answers: DataFrame) -> tuple[int, int]:
    """(N, V): training tokens and distinct ones, the end included; one row per word bucket comes to the driver."""
    told = [np.frombuffer(row["found"], "<i8") for row in answers.where("unit = -1").toLocalIterator()]
    return tuple(int(x) for x in np.sum(told, 0)) if told else (0, 0)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, then one per power of two."""
    return np.minimum(np.frexp(np.maximum(count, 0).astype(float))[1], MAX_BUCKETS - 1)


def parts(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The three estimates of each token."""
    return pair / np.maximum(context, 1), word / max(n, 1), 1 / (v + 1)


def level(p: np.ndarray) -> np.ndarray:
    """Probability on a fine logarithmic scale, -1 for zero."""
    return np.where(p > 0, np.rint(-np.log10(np.maximum(p, 1e-300)) * FINE), -1).astype(np.int64)


def fit(tally: pd.DataFrame, v: int) -> np.ndarray:
    """Weights (l2, l1, l0) per context-frequency bucket from tallied deleted estimates; an empty bucket has those of all."""
    out = np.zeros((MAX_BUCKETS, 3))
    value = lambda x: np.where(x < 0, 0.0, 10.0 ** (-x / FINE))

    def weights(rows: pd.DataFrame) -> np.ndarray:
        p = np.stack([value(rows["p2"].to_numpy()), value(rows["p1"].to_numpy()), np.full(len(rows), 1 / (v + 1))], 1)
        n, w = rows["n"].to_numpy(float), np.array([0.4, 0.4, 0.2])
        for _ in range(ROUNDS):
            share = p * w
            w = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            w = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()
        return w

    out[:] = weights(tally) if len(tally) else [0, 0, 1]
    for bucket, rows in tally.groupby("bucket"):
        out[int(bucket)] = weights(rows)
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    A null or empty text is one token, the end; a null doc_id is in training; repeated rows count
    each time and get equal scores; further columns are ignored; an empty table gives no rows. If no
    document is in training, every token has the uniform probability. Ids keep their type and value,
    text like "007" too.
    """
    kind = docs.select("doc_id").schema[0].dataType
    docs = named(docs, F.col("text").cast("string").alias("text"))
    _, units, buckets = sizes(docs)
    sent = spread(dealt(docs, units), UNIT, units, UNITS_EACH)
    asked = spread(sent.groupBy(UNIT).applyInPandas(lambda rows: ask(rows, buckets), PACKED), "bucket", 2 * buckets, BUCKETS_EACH)
    answers = stored(asked.groupBy("bucket").applyInPandas(lambda rows: total(rows, buckets), ANSWER))
    n, v = corpus_size(answers)
    answers = answers.where("unit >= 0")

    def counted(rows: pd.DataFrame, answers: pd.DataFrame) -> dict:
        x = tokens(rows)
        x["c1"] = unpack(x["words"], answers, buckets, decoded)
        x["c2"] = unpack(x["pair_keys"], answers, buckets, decoded, buckets)
        return x

    def tally(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        x = counted(rows, answers)
        learn = ~x["held"][x["doc"]]
        pair, context, word = (x["c2"][x["pairs"]] - 1)[learn], (x["c1"][x["before"]] - 1)[learn], (x["c1"][x["ids"]] - 1)[learn]
        p2, p1, _ = parts(pair, context, word, n - 1, v)
        bucket, levels = bucket_of(context), 400 * FINE
        code, count = np.unique((bucket * levels + level(p2) + 1) * levels + level(p1) + 1, return_counts=True)
        return pd.DataFrame({"bucket": code // levels // levels, "p2": code // levels % levels - 1, "p1": code % levels - 1, "n": count})

    both = sent.groupBy(UNIT).cogroup(spread(answers, "unit", units, UNITS_EACH).groupBy("unit"))
    seen = both.applyInPandas(tally, "bucket int, p2 int, p1 int, n long").groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))
    weights = fit(seen.toPandas(), v)  # probabilities are 1 / N at least: (FINE * log10 N) ** 2 rows per bucket and log2 N buckets at most, whatever the rows

    def apply(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        x = counted(rows, answers)
        word, context = x["c1"][x["ids"]], x["c1"][x["before"]]
        p2, p1, p0 = parts(x["c2"][x["pairs"]], context, word, n, v)
        w = weights[bucket_of(context)]
        sums = lambda each: np.bincount(x["doc"], weights=each, minlength=len(x["names"]))
        return pd.DataFrame({
            "doc_id": x["names"], "held_out": x["held"], "n_tokens": x["counts"], "n_known": sums(word > 0).astype(np.int64), "train_tokens": n,
            "base_score": sums(np.log10((word + 1) / (n + v + 1))), "score": sums(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)),
        })

    out = both.applyInPandas(apply, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
