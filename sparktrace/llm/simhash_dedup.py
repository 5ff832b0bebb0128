"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: two binary Golay codes over 46 of the 64 fingerprint bits,
2^24 anchors with covering radius 3 + 3. Each fingerprint has one home anchor within the radius, and
two fingerprints at distance t or less are both within radius + t of the home anchor of either. So
every fingerprint goes to all anchors within radius + t (78 on average for t = 2), and at each
anchor the fingerprints at home there are compared with all that came. No link can be lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import components, keeps, named, numbered, stored, tidy
from sparktrace.llm.exchange import BUCKETS_EACH, PACKED, UNIT, UNITS_EACH, answered, coded, dealt, decoded, distinct, fresh, pack, sizes, spread, unpack

HALF, RADIUS = 23, 3
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: A fingerprint that a HOT-th of all rows have is hot: there are so many of them at most, whatever the input.
HOT = 1000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_EIGHT = np.array([[byte >> bit & 1 for bit in range(8)] for byte in range(256)], np.float64)


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z in lower case; separators are the ASCII white space characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(found: list[bytes], n: int) -> list[bytes]:
    """Runs of n words, repeats included; the whole sequence where there are fewer; none without words."""
    if len(found) < n:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(n)), strict=False)))


def fingerprint(text: str | None, n: int = 3) -> int:
    """64-bit SimHash, unsigned; a bit is 1 if over half the shingle hashes have it."""
    parts = shingles(words(text), n)
    if not parts:
        return 0
    return simhash(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts)))


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, unsigned; a bit is 1 if over half of them have it."""
    cells = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    votes = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256).astype(np.float64) @ _EIGHT
    return int(np.packbits(2 * votes.ravel() > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp), fp being the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, n) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": fps})

    return numbered(named(docs, "text").mapInPandas(run, "doc_id string, fp long"))


@lru_cache(1)
def code(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each of the 2048 syndromes the error patterns up to weight reach, lightest first.

    Gives (syndrome of each byte-wise part of a word, patterns, start of each syndrome's, how many up to each weight).
    """
    syndrome = np.zeros(1, np.int32)
    for bit in range(HALF):
        value = 1 << bit
        for high in range(HALF - 1, 10, -1):
            if value >> high & 1:
                value ^= GOLAY << (high - 11)
        syndrome = np.concatenate([syndrome, syndrome ^ value])
    every = np.arange(1 << HALF, dtype=np.int32)
    weight = np.bitwise_count(every)
    near = every[weight <= reach]
    order = np.lexsort((near, weight[near], syndrome[near]))
    near = near[order]
    counts = np.zeros((2048, reach + 1), np.int64)
    np.add.at(counts, (syndrome[near], weight[near]), 1)
    start = np.concatenate([[0], np.cumsum(counts.sum(1))[:-1]])
    return syndrome, near.astype(np.int64), start, np.cumsum(counts, 1)


keeps("simhash", code.cache_clear)


def anchors(fps: np.ndarray, t: int, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the home anchor of each fingerprint, or every anchor within covering radius + t."""
    reach = 2 * RADIUS + t
    syndrome, near, start, upto = code(reach)
    half = [(fps & (1 << HALF) - 1).astype(np.int64), (fps >> np.uint64(HALF) & np.uint64((1 << HALF) - 1)).astype(np.int64)]
    at = [syndrome[h] for h in half]
    if home:
        a, b = (h ^ near[start[s]] for h, s in zip(half, at, strict=True))
        return np.arange(len(fps)), a << HALF | b
    rows, keys = [], []
    for w in range(reach + 1):
        below = upto[at[0], w - 1] if w else np.zeros(len(fps), np.int64)
        n1, n2 = upto[at[0], w] - below, upto[at[1], reach - w]
        row = np.repeat(np.arange(len(fps)), n1 * n2)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n1 * n2) - n1 * n2, n1 * n2)
        a = half[0][row] ^ near[start[at[0][row]] + below[row] + nth // n2[row]]
        b = half[1][row] ^ near[start[at[1][row]] + nth % n2[row]]
        rows.append(row)
        keys.append(a << HALF | b)
    return np.concatenate(rows), np.concatenate(keys)


def links(fps: DataFrame, t: int = 2) -> DataFrame:
    """Pairs (fp, fp2), fp < fp2, of distinct fingerprints that differ in 1 to t bits.

    A fingerprint has no more neighbours than there are patterns of t bits (2,080 for t = 2), so the
    pairs of a dense cluster grow with its distinct fingerprints, not with their square or the rows.
    """

    def deal(home: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                values = batch.iloc[:, 0].to_numpy(np.int64)
                rows, keys = anchors(values.view(np.uint64), t, home)
                yield pd.DataFrame({"anchor": keys, "fp": values[rows]})

        return run

    near = fps.select("fp").mapInPandas(deal(False), "anchor long, fp long").withColumnRenamed("fp", "fp2")
    home = fps.select("fp").mapInPandas(deal(True), "anchor long, fp long")
    within = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= t)
    return near.join(home.hint("shuffle_hash"), "anchor").where(within).select("fp", "fp2")


def groups(docs: DataFrame, n: int = 3, t: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents that links of t bits or fewer connect; the smallest doc_id names each.

    Documents without words (null or empty text) have fingerprint zero and are linked like any
    other; a null doc_id belongs to its text's component and never names one unless no other is in
    it; repeated rows stay; further columns are ignored; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, n))
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    joined = components(links(fps, t).toDF("a", "b"))
    whole = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = stored(whole.join(least, "component").select("fp", "component_id", "rows"))
    # rows of hot fingerprints don't meet in one task: those few fingerprints go to the rows instead
    least_rows = F.lit((fps.agg(F.sum("rows")).first()[0] or 0) / HOT)
    hot = F.broadcast(whole.where(F.col("rows") > least_rows).select("fp", "component_id"))  # under HOT rows
    rest = rows.join(hot, "fp", "left_anti").join(whole.where(F.col("rows") <= least_rows).select("fp", "component_id"), "fp")
    return rows.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, n: int = 3, t: int = 2) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id); see groups."""
    return groups(docs, n, t).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by exact Jaccard similarity, for similarities at which 64 bits differ in more places than a radius can cover.

#: Rounds, after that of SimHash links, in which each set is compared with one other only, before what is left is compared pair by pair.
STARS = 1
#: What a row of a key says of a set: sizes are those of the set, of the part that no other set has, and of its keys; place is the key's among these.
SET = ["fp", "component", "n", "own", "sent", "place"]
#: 64-bit words of a set's parity map.
MAP = [f"map{i}" for i in range(16)]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    parts = set(shingles(words(text), n))
    return distinct(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts)))


def parity(found: np.ndarray) -> np.ndarray:
    """Parity map of a set: each hash turns one of 64 * len(MAP) bits over, so maps differ in no more bits than sets in hashes."""
    bits = np.bincount((found >> np.uint64(48)).astype(np.int64) % (64 * len(MAP)), minlength=64 * len(MAP)) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def least_common(size: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles that a set of some size shares at least with any set of the similarity."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def rarities(sent: DataFrame, unit: str, units: int, buckets: int, n: int) -> DataFrame:
    """Answers to each unit: in how many rows each of its distinct shingles is, over all rows."""

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        tidy()
        keys, counts = np.unique(np.concatenate([shingle_set(t, n) for t in rows["text"]]), return_counts=True)
        return pack(int(rows[unit].iloc[0]), keys, counts, buckets, coded)

    def add(keys: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        counts = np.concatenate([decoded(more, len(k) // 8) for more, k in zip(rows["more"], rows["keys"], strict=True)])
        distinct_keys, at = np.unique(keys, return_inverse=True)
        return np.minimum(np.bincount(at, counts, len(distinct_keys)), (1 << 32) - 1).astype(np.int64)[at]

    return answered(spread(sent.groupBy(unit).applyInPandas(ask, PACKED), "bucket", buckets, BUCKETS_EACH), add, coded)


def hashed_alike(prints: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of sets, rows (fp, print), whose SimHash fingerprints differ in t bits or fewer, by anchors (links).

    Sets of one fingerprint are paired with the least of them, which is compared with those of the fingerprints linked to theirs.
    """
    least = stored(prints.groupBy("print").agg(F.min("fp").alias("least")))
    side = lambda end, name: least.select(F.col("print").alias(end), F.col("least").alias(name))
    linked = links(least.select(F.col("print").alias("fp")), t).join(side("fp", "a"), "fp").join(side("fp2", "b"), "fp2").select("a", "b")
    same = prints.join(least, "print").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return linked.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def starred(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (a, b) of each set with one other, the same one for all sets of a key: that of the key that most sets have. Rows are (key, *SET).

    At first it is the set with the least share of shingles of its own, which copies of one text have in common.
    """
    share = F.col("own") / F.col("n") if turn == 0 else F.lit(0.0)
    least = rows.groupBy("key").agg(F.min(F.struct(share.alias("share"), F.xxhash64("fp", F.lit(turn)).alias("order"), "fp", "n", "component")).alias("rep"), F.count("*").alias("sets"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    fit = F.least("n", "rep.n") >= F.ceil(similarity * F.greatest("n", "rep.n") - 1e-9)
    met = rows.join(least.select("key", "rep", "sets"), "key").where((F.col("component") != F.col("rep.component")) & fit)
    one = met.groupBy("fp").agg(F.max(F.struct("sets", "key", F.col("rep.fp").alias("other")))["other"].alias("other"))
    return one.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def across(rows: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets of different components among rows (key, *SET) that can have the similarity; no pair that has it is left out.

    With p of its n shingles as keys, a set has n - p others. Of the shingles that two sets share, all
    that aren't keys of both are among the others of one of them, so they have many keys in common;
    the first of these is so early in both that the rest can follow, and only there the two meet. Parity maps
    differ in no more bits than the sets in shingles. A key's largest component isn't compared with itself.
    """
    sets = rows.groupBy("key", "component").agg(F.count("*").alias("sets"))
    largest = sets.groupBy("key").agg(F.max(F.struct("sets", "component"))["component"].alias("largest"), F.count("*").alias("components")).where("components > 1")
    told = rows.join(largest.select("key", "largest"), "key").join(maps, "fp")
    some = told.where("component <> largest").select("key", *[F.col(c).alias(f"other_{c}") for c in (*SET, *MAP)])
    n, m = F.col("n"), F.col("other_n")
    others = lambda size: F.ceil(similarity * size - 1e-9) - 1
    need = F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9) - F.greatest(others(n), others(m))
    early = (F.col("place") <= F.col("sent") - need) & (F.col("other_place") <= F.col("other_sent") - need)
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"other_{w}"))) for w in MAP), F.lit(0))
    near = apart <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9
    fit = F.least(n, m) >= F.ceil(similarity * F.greatest(n, m) - 1e-9)
    pairs = told.join(some, "key").where("component <> other_component and (component = largest or fp < other_fp)").where(fit & early & near)
    return pairs.select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b")).distinct()


def still_open(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (key, *SET but component) with their component, of the keys that sets of different components have."""
    now = rows.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    still = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return stored(now.join(still.select("key"), "key", "left_semi").select("key", *SET))


def alike(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts, of rows (fp, text), have an exact Jaccard similarity of at least the given one over their sets of shingles."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fp": batch["fp"], "found": [shingle_set(t, n).tobytes() for t in batch["text"]]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                both = len(x) // 8 + len(y) // 8
                common = both - len(distinct(np.frombuffer(x + y, np.uint64)))
                good.append(common >= similarity * (both - common) - 1e-9)
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    pairs = stored(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    found = stored(texts(needed).mapInPandas(sets, "fp long, found binary"))
    side = lambda end, name: found.select(F.col("fp").alias(end), F.col("found").alias(name))
    return stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(check, "a long, b long"))


def one_of_each(docs: DataFrame, n: int = 5, similarity: float = 0.8, t: int = 2) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id; columns stay as they are.

    Near copies are texts whose sets of shingles of n words have a Jaccard similarity of at least the
    given one. Candidates are first the sets whose SimHash fingerprints differ in t bits or fewer, found by anchors
    like any other links; whole sets decide, and what is alike is one group from there on. More bits than an anchor's radius covers may differ
    at that similarity, so the rest follows by the keys that sets share: shingles are counted over all rows, and each set has its rarest ones as
    keys, so many that two sets of the similarity share one of them (prefix filter); a shingle of
    one row only is no key, so most texts that are like no other have none. Each set is
    compared with one other, then what isn't in one group yet is compared pair by pair, as far
    as sizes, places of keys and parity maps allow the similarity; whole sets decide. Texts
    without words are copies of each other. Rows
    are told apart by doc_id and text: of rows equal in both one stays, rows of one doc_id or a null one whose texts are in
    different groups all stay, and of those in one group one. A row of a null doc_id stays only where
    its group has no other; an empty table gives no rows.
    """
    nameless, row = F.col("doc_id").isNull(), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    _, units, buckets = sizes(docs)
    each = docs.select(nameless.alias("nameless"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text", row.alias("row"))
    sent = spread(dealt(each, units), UNIT, units, UNITS_EACH)
    answers = stored(rarities(sent, UNIT, units, buckets, n))

    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        tidy()
        found = [shingle_set(t, n) for t in rows["text"]]
        fps = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
        size = np.array([len(x) for x in found], np.int64)
        known = distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        rare = unpack(known, told, buckets, decoded)
        keys, own = [], []
        for x, k in zip(found, np.where(size > 0, size - least_common(size, similarity) + 1, 0).tolist(), strict=True):
            count = rare[np.searchsorted(known, x)]
            first = np.argsort(count, kind="stable")[:k]  # by count, then by hash: one order for all sets
            keys.append(x[first][count[first] > 1].view(np.int64))
            own.append(int(np.count_nonzero(count == 1)))
        maps = np.stack([parity(x) for x in found]).T
        prints = np.array([simhash(x) if len(x) else 0 for x in found], np.uint64).view(np.int64)
        return pd.DataFrame({"nameless": rows["nameless"], "doc_id": rows["doc_id"], "row": rows["row"], "fp": fps, "print": prints, "n": size, "own": own, "keys": keys} | dict(zip(MAP, maps, strict=True)))

    both = sent.groupBy(UNIT).cogroup(spread(answers, "unit", units, UNITS_EACH).groupBy("unit"))
    told = stored(both.applyInPandas(run, "nameless boolean, doc_id long, row long, fp long, print long, n long, own long, keys array<long>, " + ", ".join(f"{w} long" for w in MAP)))
    sets = stored(told.groupBy("fp").agg(F.min(F.struct("nameless", "doc_id", "row")).alias("least")))
    listed = told.where("size(keys) > 0").select("fp", "n", "own", "keys").dropDuplicates(["fp"]).select(F.posexplode("keys").alias("place", "key"), "fp", "n", "own", F.size("keys").alias("sent"))
    maps = told.where("size(keys) > 0").select("fp", *MAP).dropDuplicates(["fp"])

    def texts(needed: DataFrame) -> DataFrame:
        return docs.select(row.alias("row"), "text").join(sets.join(needed, "fp", "left_semi").select("least.row", "fp"), "row").select("fp", "text").dropDuplicates(["fp"])

    near = alike(hashed_alike(told.where("n > 0").select("fp", "print").distinct(), t), texts, n, similarity)
    joined = components(near)
    open_ = still_open(listed, joined)
    for turn in range(STARS + 1):
        found = alike(starred(open_, similarity, turn) if turn < STARS else across(open_, maps, similarity), texts, n, similarity)
        near = near.unionByName(found)
        joined = components(near)
        if turn < STARS:
            open_ = still_open(open_.drop("component"), joined)
    groups_of = sets.select("fp", "least").join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    key = fresh("kept_id", docs.columns)
    kept = groups_of.groupBy(F.coalesce("component", "fp")).agg(F.min("least")["row"].alias(key)).select(key)
    first = docs.withColumn(key, row).dropDuplicates([key])
    return first.join(kept, key).select(docs.columns)
