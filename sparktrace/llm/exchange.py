"""Packed exchange: units of documents ask, buckets of keys answer.

Documents are dealt to units by a hash of the row, and each unit sends its distinct keys to buckets
by key hash, packed into one binary value per (unit, bucket). A bucket answers each unit in the
order of its keys, and the unit, dealt the same way again, reads the answer. However frequent a key,
a unit sends it once, so no task gets more than its share; nothing depends on which executor
worked where, so lost ones are simply computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import tidy

#: Bytes of text that a unit has on average at most.
UNIT_CHARS = 4_000_000
#: Characters of text whose keys a bucket answers on average at most.
BUCKET_CHARS = 16_000_000
#: Units and buckets that a task works on one after another, at most on average.
UNITS_EACH, BUCKETS_EACH = 16, 4
UNIT = "unit_of_rows"
ODD = np.uint64(0x9E3779B97F4A7C15)


def sizes(docs: DataFrame) -> tuple[int, int, int]:
    """(characters, units, buckets) from all rows and the session's shuffle partitions; units and buckets keep their size as the input grows."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chars, max(2 * parts, -(-chars // UNIT_CHARS)), max(parts, -(-chars // BUCKET_CHARS))


def spread(df: DataFrame, key: str, groups: int, each: int) -> DataFrame:
    """df dealt by key to more tasks than the session's shuffle partitions where a task would else hold more than each groups."""
    tasks = -(-groups // each)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def fresh(name: str, columns: list[str]) -> str:
    """name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def dealt(docs: DataFrame, units: int, name: str = UNIT) -> DataFrame:
    return docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)))


class Numbers(dict):
    """Numbers new keys in order of appearance."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


def vocabulary(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """(ids of all words in a row, words of each text, id of each distinct word)."""
    known = Numbers()
    parts = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(p) for p in parts], np.int64), known


def hashes(words: Iterable[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, as columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * ODD
    return x ^ (x >> np.uint64(29))


def coded(counts: np.ndarray) -> bytes:
    """Counts as one byte each, four more where it is 255 or over."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def decoded(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u4", offset=n)
    return counts


def raw(values: np.ndarray) -> bytes:
    return values.tobytes()


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], list[int]]:
    """(keys in order of their buckets, the buckets that have any, where each one's keys begin and the last one's end)."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    there = at[order]
    cuts = np.flatnonzero(np.append(True, there[1:] != there[:-1])) if len(there) else np.zeros(0, np.int64)
    return order, there[cuts].tolist(), [*cuts.tolist(), len(there)]


def pack(unit: int, keys: np.ndarray, more: np.ndarray, buckets: int, encode: Callable[[np.ndarray], bytes] = raw, first: int = 0) -> pd.DataFrame:
    """One row per bucket (numbered from first) that has any of the keys: 64-bit keys, distinct and sorted, and a value for each."""
    order, there, cuts = by_bucket(keys, buckets)
    rows = [(first + b, unit, keys[o := order[i:j]].tobytes(), encode(more[o])) for b, i, j in zip(there, cuts, cuts[1:], strict=False)]
    return pd.DataFrame(rows, columns=["bucket", "unit", "keys", "more"])


PACKED = "bucket int, unit long, keys binary, more binary"
ANSWER = "unit long, bucket int, found binary"


def answered(asked: DataFrame, decide: Callable[[np.ndarray, pd.DataFrame], np.ndarray], encode: Callable[[np.ndarray], bytes] = raw) -> DataFrame:
    """Rows of ANSWER; decide gets a bucket's keys and its packed rows and returns one value per key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tidy()
        keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
        sent = rows["keys"].map(len).to_numpy() // 8
        found = decide(keys, rows)
        cuts = np.cumsum(sent)[:-1]
        return pd.DataFrame({"unit": rows["unit"], "bucket": rows["bucket"], "found": [encode(x) for x in np.split(found, cuts)]})

    return asked.groupBy("bucket").applyInPandas(run, ANSWER)


def unpack(keys: np.ndarray, answers: pd.DataFrame, buckets: int, decode: Callable[[bytes, int], np.ndarray], first: int = 0) -> np.ndarray:
    """A unit's answers in the order of its keys; a missing one is an error."""
    order, there, cuts = by_bucket(keys, buckets)
    found = dict(zip(answers["bucket"], answers["found"], strict=True))
    out = np.zeros(len(keys), np.int64)
    for b, i, j in zip(there, cuts, cuts[1:], strict=False):
        out[order[i:j]] = decode(found[first + b], j - i)
    return out
