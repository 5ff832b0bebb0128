"""Removal of byte strings that occur more than once, by column-wise construction of a collection's
Burrows-Wheeler transform with common prefixes.

A window is LENGTH bytes of one document. Its anchor is the gram of least hash in it, leftmost of
equals; equal windows have equal anchors at equal places. Consecutive windows with one anchor form a
stretch, and stretches meet by anchor, so that documents are never brought together whole:

1. Units of documents send each distinct stretch's digest; buckets answer which stretches occur
   again as they are, which share their anchor with others, and which can't repeat at all.
2. Stretches that share an anchor with other ones go to buckets as strings whose anchors are aligned.
   A bucket inserts one symbol per string each round, from the last column to the first, keeping
   the order of the suffixes and the longest common prefix of neighbours. A symbol counts as tagged
   with its column, so a round's suffixes all follow those of the round before: a new segment of the
   transform is made from the last one alone, in one sequential pass, and earlier segments are never
   read again. A window repeats if a neighbour's common prefix at its first column reaches LENGTH.
3. Units read both answers and remove the bytes that repeated windows cover.

The sequential files between rounds of the construction are shuffle files between these steps, as
a task has no folder of its own that would outlive it; within a bucket segments stay in memory, one
batch of anchors at a time. An anchor with more than CROWD different stretches is split further, by
what all windows of BLOCK neighbouring columns have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import named, numbered, stored
from sparktrace.llm.exchange import BUCKETS_EACH, PACKED, UNIT, UNITS_EACH, answered, dealt, mix, pack, sizes, spread, unpack

LENGTH, GRAM = 400, 16
CROWD, BLOCK = 64, 32
#: Bytes of documents worked on at once, strings in a batch of the construction, and bits of a place in a chunk.
CHUNK, BATCH, PLACE = 2_000_000, 30_000, 32
AGAIN, SHARED, SENDS, CROWDED = 1, 2, 4, 8
STRINGS = "bucket int, unit long, keys binary, first binary, sizes binary, data binary"


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK bytes."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    n = len(values) - width + 1
    blocks = np.append(values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(joined bytes, start of each document in them, rows (first window, windows, anchor's place, anchor's hash))."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    empty = np.zeros(0, [("at", "<i8"), ("n", "<i8"), ("anchor", "<i8"), ("hash", "<u8")])
    if len(data) < length:
        return data, starts, empty
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    hashed = mix(eight[: -(GRAM - 8)] * np.uint64(0xD6E8FEB86659FD93) + mix(eight[GRAM - 8 :]))
    place = np.arange(len(hashed), dtype=np.uint64)
    key = hashed >> np.uint64(PLACE) << np.uint64(PLACE) | place
    anchor = (least(key, length - GRAM + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    room = np.zeros(len(data) + 1, np.int64)
    long = ends - starts >= length
    np.add.at(room, starts[long], 1)
    np.add.at(room, ends[long] - length + 1, -1)
    valid = np.cumsum(room)[: len(anchor)] > 0
    windows = np.flatnonzero(valid)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[windows[1:]] != anchor[windows[:-1]]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    out = np.empty(len(first), empty.dtype)
    out["at"] = windows[first]
    out["n"] = np.diff(np.append(first, len(windows)))
    out["anchor"] = anchor[out["at"]]
    out["hash"] = hashed[out["anchor"]]
    return data, starts, out


class Unit:
    """A unit's documents with its distinct stretches, in an order that only their bytes decide."""

    def __init__(self, rows: pd.DataFrame, length: int):
        self.length, self.parts = length, []
        self.texts = [raw_bytes(t) for t in rows["text"]]
        digests, hashes, self.where = [], [], []
        for a, b in chunks(self.texts):
            data, starts, found = stretches(self.texts[a:b], length)
            self.parts.append((a, b, data, starts, found))
            view = memoryview(data)
            digests += [xxhash.xxh3_128_digest(view[s : s + n + length - 1]) for s, n in zip(found["at"].tolist(), found["n"].tolist(), strict=True)]
            hashes.append(found["hash"])
            self.where += [(len(self.parts) - 1, i) for i in range(len(found))]
        of = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.lexsort((of[:, 1], of[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (of[order][1:] != of[order][:-1]).any(1)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.digest, self.count = of[order][new], np.bincount(self.number)
        self.one = order[new]
        self.hash = np.concatenate(hashes)[self.one] if hashes else np.zeros(0, np.uint64)

    def ask(self, unit: int, buckets: int) -> pd.DataFrame:
        more = np.empty(len(self.hash), [("a", "<u8"), ("b", "<u8"), ("n", "<u4")])
        more["a"], more["b"], more["n"] = self.digest[:, 0], self.digest[:, 1], self.count
        return pack(unit, self.hash, more, buckets)

    def strings(self, told: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(stretch, group, first column, first window, bytes) of what this unit sends to the construction; the anchor is column 0."""
        length = self.length
        for e in np.flatnonzero(told & SENDS).tolist():
            part, i = self.where[self.one[e]]
            _, _, data, _, found = self.parts[part]
            at, n, anchor = int(found["at"][i]), int(found["n"][i]), int(found["anchor"][i])
            group = int(self.hash[e])
            if not told[e] & CROWDED:
                yield e, group, at - anchor, 0, data[at : at + n + length - 1]
                continue
            for block in range((at - anchor) // BLOCK, (at - anchor + n - 1) // BLOCK + 1):
                a, b = max(at, anchor + block * BLOCK), min(at + n, anchor + (block + 1) * BLOCK)
                core = data[anchor + (block + 1) * BLOCK - 1 : anchor + block * BLOCK + length]
                yield e, xxhash.xxh3_64_intdigest(core, group + block & 0xFFFFFFFFFFFFFFFF), a - anchor, a - at, data[a : b + length - 1]


def decide(keys: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Per distinct stretch of each unit: flags of whether it occurs again, shares its anchor, and who sends it."""
    more = np.frombuffer(b"".join(rows["more"]), [("a", "<u8"), ("b", "<u8"), ("n", "<u4")])
    order = np.lexsort((more["b"], more["a"], keys))
    k, m = keys[order], more[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= (m["a"][1:] != m["a"][:-1]) | (m["b"][1:] != m["b"][:-1])
    same, anchor = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    times = np.bincount(same, weights=m["n"])[same]
    kinds = np.bincount(anchor, weights=new)[anchor]
    flags = AGAIN * (times > 1) + (SHARED + SENDS * new + CROWDED * (kinds > CROWD)) * (kinds > 1)
    out = np.empty(len(k), np.uint8)
    out[order] = flags
    return out


def repeated(group: np.ndarray, first: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> list[np.ndarray]:
    """Column-wise construction over strings with aligned columns: per string, which windows repeat within its group.

    group holds small numbers in ascending order, first each string's first column. Rounds go from the last
    column to the first; order has the strings by suffix from the round's column, prefix[i] the
    common prefix of order[i - 1] and order[i].
    """
    n = len(group)
    base = np.cumsum(size) - size
    windows = size - length + 1
    mark_base = np.cumsum(windows) - windows
    marks = np.zeros(int(windows.sum()), bool)
    last = first + size - 1
    by_last = np.argsort(-last, kind="stable")
    column, entered = int(last.max()), 0
    lowest = int(first.min())
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while column >= lowest:
        to = entered
        while to < n and last[by_last[to]] == column:
            to += 1
        if to > entered:  # strings whose last symbol this is: their suffix so far is empty and goes first in its group
            fresh = np.sort(by_last[entered:to])
            entered = to
            merged = np.concatenate([fresh, order])
            spot = np.argsort(group[merged], kind="stable")
            old = np.concatenate([np.zeros(len(fresh), np.int64), prefix])[spot]
            order = merged[spot]
            after = np.ones(len(order), bool)
            after[1:] = (spot[1:] < len(fresh)) | (spot[:-1] < len(fresh))
            prefix = np.where(after, 0, old)
        gone = first[order] > column
        if gone.any():  # strings that begin further right: neighbours close up
            keep = np.flatnonzero(~gone)
            prefix = np.minimum.reduceat(prefix[: keep[-1] + 1], np.append(0, keep[:-1] + 1)) if len(keep) else prefix[:0]
            order = order[keep]
        if len(order):
            symbol, of = data[base[order] + column - first[order]], group[order]
            spot = np.argsort(symbol, kind="stable")
            spot = spot[np.argsort(of[spot], kind="stable")]
            symbol, of = symbol[spot], of[spot]
            same = np.zeros(len(spot), bool)
            same[1:] = (symbol[1:] == symbol[:-1]) & (of[1:] == of[:-1])
            new = np.zeros(len(spot), np.int64)
            b = spot[same]
            a = spot[np.flatnonzero(same) - 1]
            low = prefix[b]
            far = np.flatnonzero(b - a > 1)
            if len(far):
                pairs = np.stack([a[far] + 1, b[far] + 1], 1).ravel()
                low[far] = np.minimum.reduceat(np.append(prefix, 0), pairs)[::2]
            new[same] = low + 1
            order, prefix = order[spot], new
            hit = prefix >= length
            hit[:-1] |= hit[1:]
            hit &= column - first[order] < windows[order]
            at = order[hit]
            marks[mark_base[at] + column - first[at]] = True
        column -= 1
    return np.split(marks, mark_base[1:])


def construct(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Answers of one bucket: for each unit, the packed marks of its strings in the order sent."""
    keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
    first, size = (np.frombuffer(b"".join(rows[c]), "<i4").astype(np.int64) for c in ("first", "sizes"))
    data = np.frombuffer(b"".join(rows["data"]), np.uint8)
    base = np.cumsum(size) - size
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else np.zeros(0, int)
    bits: list[bytes] = [b""] * len(keys)
    cuts = [0]
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        if b - cuts[-1] > BATCH and a > cuts[-1]:
            cuts.append(int(a))
    cuts.append(len(order))
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = order[a:b]
        if not len(some):
            continue
        group = np.cumsum(np.append(False, keys[some][1:] != keys[some][:-1])).astype(np.uint16)
        joined = np.concatenate([data[base[i] : base[i] + size[i]] for i in some])
        for i, marks in zip(some.tolist(), repeated(group, first[some], size[some], joined, length), strict=True):
            bits[i] = np.packbits(marks).tobytes()
    sent = np.cumsum(rows["keys"].map(len).to_numpy() // 8)
    return pd.DataFrame({"unit": rows["unit"], "bucket": rows["bucket"], "found": [b"".join(bits[a:b]) for a, b in zip(np.append(0, sent[:-1]), sent, strict=True)]})


def without_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans and the bytes kept (with digest: kept_sha256 instead).

    Every byte covered by a string of length bytes that also starts elsewhere, in any document, goes.
    Null texts count as empty; documents shorter than length lose nothing; a null doc_id stays null
    and its text takes part; repeated rows repeat each other; further columns are ignored; an empty
    table gives no rows.
    """
    docs = named(docs, "text")
    _, units, buckets = sizes(docs)
    sent = spread(dealt(docs, units), UNIT, units, UNITS_EACH)
    kind = lambda data, n: np.frombuffer(data, np.uint8)

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        return Unit(rows, length).ask(int(rows[UNIT].iloc[0]), buckets)

    answers = stored(answered(spread(sent.groupBy(UNIT).applyInPandas(ask, PACKED), "bucket", buckets, BUCKETS_EACH), decide))

    def laid_out(unit: Unit, told: np.ndarray) -> list[tuple[int, list[tuple[int, int, int, int, bytes]]]]:
        """Strings per bucket, in the order sent."""
        out: dict[int, list] = {}
        for string in unit.strings(told):
            out.setdefault(string[1] % buckets, []).append(string)
        return sorted(out.items())

    def send(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["bucket", "unit", "keys", "first", "sizes", "data"])
        unit = Unit(rows, length)
        out = []
        for bucket, strings in laid_out(unit, unpack(unit.hash, answers, buckets, kind)):
            column = lambda i, t, strings=strings: np.array([s[i] for s in strings], t).tobytes()
            out.append((bucket, int(rows[UNIT].iloc[0]), column(1, "<u8"), column(2, "<i4"), np.array([len(s[4]) for s in strings], "<i4").tobytes(), b"".join(s[4] for s in strings)))
        return pd.DataFrame(out, columns=["bucket", "unit", "keys", "first", "sizes", "data"])

    strings = sent.groupBy(UNIT).cogroup(spread(answers, "unit", units, UNITS_EACH).groupBy("unit")).applyInPandas(send, STRINGS)
    marks = stored(spread(strings, "bucket", buckets, BUCKETS_EACH).groupBy("bucket").applyInPandas(lambda rows: construct(rows, length), "unit long, bucket int, found binary"))

    def apply(rows: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        unit = Unit(rows, length)
        told = unpack(unit.hash, both[both["step"] == 1], buckets, kind)
        found = dict(zip(both["bucket"][both["step"] == 2], both["found"][both["step"] == 2], strict=True))
        known: dict[int, np.ndarray] = {}
        for bucket, strings in laid_out(unit, told):
            at, data = 0, found[bucket]
            for e, _, _, start, string in strings:
                n = len(string) - length + 1
                size = -(-n // 8)
                if not told[e] & AGAIN:
                    part, i = unit.where[unit.one[e]]
                    marks = known.setdefault(e, np.zeros(int(unit.parts[part][4]["n"][i]), bool))
                    marks[start : start + n] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n)
                at += size
        out, at = [], 0
        for a, b, data, starts, stretch in unit.parts:
            number = unit.number[at : at + len(stretch)]
            at += len(stretch)
            edge = np.zeros(len(data) + 1, np.int32)
            whole = (told[number] & AGAIN).astype(bool) if len(number) else np.zeros(0, bool)
            np.add.at(edge, stretch["at"][whole], 1)
            np.add.at(edge, stretch["at"][whole] + stretch["n"][whole] + length - 1, -1)
            for i in np.flatnonzero(~whole).tolist():
                if (marks := known.get(int(number[i]))) is not None:
                    spots = stretch["at"][i] + np.flatnonzero(marks)
                    np.add.at(edge, spots, 1)
                    np.add.at(edge, spots + length, -1)
            covered = np.cumsum(edge)[:-1] > 0
            bytes_ = np.frombuffer(data, np.uint8)
            for doc, start in zip(range(a, b), starts.tolist(), strict=True):
                n = len(unit.texts[doc])
                gone = covered[start : start + n]
                lost = int(np.count_nonzero(gone))
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(n > 0 and gone[0]) if lost else 0
                kept = bytes_[start : start + n][~gone].tobytes() if lost else unit.texts[doc]
                out.append((n, lost, spans, hashlib.sha256(kept).hexdigest() if digest else kept))
        result = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])
        result.insert(0, "doc_id", rows["doc_id"].array)
        return result

    both = answers.withColumn("step", F.lit(1)).unionByName(marks.withColumn("step", F.lit(2)))
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return numbered(sent.groupBy(UNIT).cogroup(spread(both, "unit", units, UNITS_EACH).groupBy("unit")).applyInPandas(apply, schema))
