"""Removal of repeated word windows: a count-min prefilter, then exact grouping of what it lets through.

Pass 1 hashes every window of every document into count-min sketches, one set per stretch of a
partition, sent as gaps between filled cells and merged block by block. Merged cells hold 0, 1 or
"2 and more"; as a sketch never underestimates, a window with a cell below 2 occurs once and needs
no grouping. Pass 2 groups the others exactly by 128-bit hash through a packed exchange. The sketch
is the only thing sent to all: DEPTH * MAX_CELLS bits at most, whatever the input. If the input
outgrows it, more windows reach the exact pass; results stay the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import named, numbered, safe, stored, tidy
from sparktrace.llm.exchange import BUCKETS_EACH, PACKED, UNIT, UNITS_EACH, answered, dealt, fresh, hashes, mix, pack, sizes, spread, unpack, vocabulary

DEPTH, BLOCK, MAX_CELLS = 2, 1 << 22, 1 << 28
#: Windows of a stretch: a partition's sketch is sent whenever it has counted so many.
STRETCH = 2_000_000
#: Order of documents: the doc_id, or this for a null one.
NONE, ORDER = (1 << 63) - 1, "order_of_doc"


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def windows(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two 64-bit hashes per window, document of each window, first word of each within all words)."""
    ids, counts, known = vocabulary(texts)
    if len(ids) < size:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = hashes(known)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    last = len(ids) - size + 1
    at = np.flatnonzero(doc[:last] == doc[size - 1 :])
    both = []
    for column, odd in ((0, 0xD6E8FEB86659FD93), (1, 0xA0761D6478BD642F)):
        word = of[ids, column]
        total = word[:last].copy()
        for j in range(1, size):
            total = total * np.uint64(odd) + word[j : last + j]
        both.append(mix(total[at]))
    return np.stack(both, 1), doc[at], at


def gaps(cells: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct numbers as gaps: one byte each, four more where it is 255 or over."""
    gap = np.diff(cells, prepend=-1) - 1
    return np.minimum(gap, 255).astype(np.uint8).tobytes(), gap[gap >= 255].astype("<u4").tobytes()


def ungaps(small: bytes, large: bytes) -> np.ndarray:
    gap = np.frombuffer(small, np.uint8).astype(np.int64)
    gap[gap == 255] = np.frombuffer(large, "<u4")
    return np.cumsum(gap + 1) - 1


def merge_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Cells of one block that count 2 or more over all partial sketches, as bits."""
    count = np.zeros(BLOCK, np.uint8)
    for small, large, twice in zip(rows["small"], rows["large"], rows["twice"], strict=True):
        cells = ungaps(small, large)
        more = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells))
        count[cells] = np.minimum(count[cells] + more, 2)
    return pd.DataFrame({"depth": rows["depth"][:1], "block": rows["block"][:1], "bits": [np.packbits(count >= 2, bitorder="little").tobytes()]})


def sketch(docs: DataFrame, size: int, cells: int) -> list[np.ndarray]:
    """Merged count-min sketch of all windows: per depth, one bit a cell, set where the count is 2 or more."""

    def partial(hashed: list[np.ndarray]) -> pd.DataFrame:
        rows = []
        for depth in range(DEPTH):
            found, count = np.unique(np.concatenate([h[:, depth] for h in hashed]) & np.uint64(cells - 1), return_counts=True)
            found = found.astype(np.int64)
            cuts = np.searchsorted(found, np.arange(0, cells + BLOCK, BLOCK))
            for block, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    rows.append((depth, block, *gaps(found[a:b] - block * BLOCK), np.packbits(count[a:b] > 1).tobytes()))
        return pd.DataFrame(rows, columns=["depth", "block", "small", "large", "twice"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            hashed = windows([split(t) for t in batch["text"]], size)[0]
            held.append(hashed)
            n += len(hashed)
            if n >= STRETCH:
                yield partial(held)
                held, n = [], 0
        if n:
            yield partial(held)
        held.clear()
        tidy()

    parts = docs.select("text").mapInPandas(count, "depth int, block int, small binary, large binary, twice binary")
    merged = parts.groupBy("depth", "block").applyInPandas(merge_blocks, "depth int, block int, bits binary")
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(DEPTH)]
    for row in merged.collect():  # DEPTH * cells bits in all
        at = row["block"] * BLOCK // 8
        bits[row["depth"]][at : at + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def without_repeats(docs: DataFrame, size: int = 13, digest: bool = False) -> DataFrame:
    """docs without each word that a window of size words covers whose words also start in a document of smaller doc_id.

    Columns stay, text is replaced: unchanged where nothing goes, else the kept words joined by one
    space; n_words and n_removed are added (a clashing column is replaced). With digest, gives
    doc_id, n_words, n_removed and kept_sha256 only. A null or empty text has no words; a null
    doc_id counts as larger than any; of rows with one doc_id neither is smaller, so repeated rows
    lose alike; an empty table gives no rows.
    """
    types = docs.drop("n_words", "n_removed").dtypes
    docs = named(docs, "text") if digest else safe(docs.drop("n_words", "n_removed"))
    chars, units, buckets = sizes(docs)
    unit, rank = fresh(UNIT, docs.columns), fresh(ORDER, docs.columns)
    cells = BLOCK
    while cells < min(MAX_CELLS, chars // 3):
        cells *= 2
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, cells))

    def suspects(rows: pd.DataFrame) -> tuple:
        """Windows that the sketch calls repeated: distinct hashes, each window's number among them, document, first word."""
        texts = [split(t) for t in rows["text"]]
        hashed, doc, at = windows(texts, size)
        keep = np.ones(len(hashed), bool)
        for depth, bits in enumerate(shared.value):
            cell = (hashed[:, depth] & np.uint64(cells - 1)).astype(np.int64)
            keep &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        hashed, doc, at = hashed[keep], doc[keep], at[keep]
        order = np.lexsort((hashed[:, 1], hashed[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (hashed[order][1:] != hashed[order][:-1]).any(1)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        names = rows[rank].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        least = np.full(int(new.sum()), NONE)
        np.minimum.at(least, number, names[doc])
        return texts, hashed[order][new], number, doc, at, names, least

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        tidy()
        _, keys, _, _, _, _, least = suspects(rows)
        wide = np.empty(len(keys), [("h", "<u8"), ("d", "<i8")])
        wide["h"], wide["d"] = keys[:, 1], least
        return pack(int(rows[unit].iloc[0]), keys[:, 0], wide, buckets)

    def decide(keys: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        """Per key and unit: the smallest doc_id over all units is smaller than the unit's own."""
        wide = np.frombuffer(b"".join(rows["more"]), [("h", "<u8"), ("d", "<i8")])
        order = np.lexsort((wide["d"], wide["h"], keys))
        k, h, d = keys[order], wide["h"][order], wide["d"][order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        out = np.empty(len(k), np.uint8)
        out[order] = d[np.flatnonzero(new)][np.cumsum(new) - 1] < d
        return out

    def apply(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        tidy()
        texts, keys, number, doc, at, names, least = suspects(rows)
        elsewhere = unpack(keys[:, 0], answers, buckets, lambda data, n: np.frombuffer(data, np.uint8)).astype(bool)
        gone = elsewhere[number] | (names[doc] > least[number])
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        edge = np.zeros(starts[-1] + 1, np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + size, -1)
        keep = np.cumsum(edge)[:-1] == 0
        rows = rows.drop(columns=[unit, rank])
        kept = []
        for text, words, a, b in zip(rows["text"], texts, starts, starts[1:], strict=False):
            if digest or not keep[a:b].all():
                kept.append(b" ".join([w for w, k in zip(words, keep[a:b].tolist(), strict=True) if k]))
            else:
                kept.append(text)
        n_words = np.diff(starts)
        n_removed = n_words - np.array([np.count_nonzero(keep[a:b]) for a, b in zip(starts, starts[1:], strict=False)], np.int64)
        if digest:
            return pd.DataFrame({"doc_id": rows["doc_id"].array, "n_words": n_words, "n_removed": n_removed, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})
        texts = [k.decode("utf-8", "surrogatepass") if isinstance(k, bytes) else k for k in kept]
        return rows.assign(text=texts, n_words=n_words, n_removed=n_removed)

    sent = spread(dealt(docs, units, unit).withColumn(rank, F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))), unit, units, UNITS_EACH)
    answers = stored(answered(spread(sent.groupBy(unit).applyInPandas(ask, PACKED), "bucket", buckets, BUCKETS_EACH), decide))
    both = sent.groupBy(unit).cogroup(spread(answers, "unit", units, UNITS_EACH).groupBy("unit"))
    if digest:
        schema = "doc_id string, n_words long, n_removed long, kept_sha256 string"
        return numbered(both.applyInPandas(apply, schema))
    out = both.applyInPandas(apply, docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).schema)
    return out.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in types), "n_words", "n_removed")
