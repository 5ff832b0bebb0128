"""Benchmark decontamination by latent semantic retrieval.

TF-IDF vectors of all passages of all documents (hashed words, DIMS dimensions) get a randomised
SVD: with a random test matrix R, each task adds its part of C = A'A R, the parts are summed, and the
right singular vectors V follow from C and R'C alone (Nystroem). Passages and benchmark items are
centred and projected: whitened on V, and by random directions on what V leaves over, since texts
without common topics differ mostly there. Pairs of high cosine are candidates, and so is every passage that
has GRAM words of an item in a row, whatever its cosine. A candidate is a leak if the
longest common subsequence of the item's words and the words around the passage is long enough and
the item's answer (its last words) is in it; so reordering, insertions and replacements are seen
through up to a point, and common words alone don't make a leak.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import named, numbered, tidy
from sparktrace.llm.exchange import ODD, UNIT_CHARS, distinct, fresh, mix

DIMS, SIZE = 8192, 32
#: Columns of the test matrix, singular vectors kept, and random directions for the rest.
TEST, RANK, REST = 16, 10, 38
#: Weight of the singular vectors' part of the cosine.
LATENT = 0.25
STEP = SIZE // 2
#: Dimensions in a row of partial sums.
ROW = 512
#: Benchmark passages looked for in one pass over the documents; more take more passes.
BLOCK = 20_000
#: Words between the passages of an item.
SHIFT = 8
#: Items of fewer words are no evidence of a leak.
LEAST_WORDS = 8
#: Words in a row that make a passage a candidate for the items that have them.
GRAM = 3
_PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits separate them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash of every word in a row, words of each text)."""
    counts = np.array([len(words) for words in texts], np.int64)
    return np.fromiter(map(zlib.crc32, chain.from_iterable(texts)), np.uint32, counts.sum()), counts


def terms(code: np.ndarray) -> np.ndarray:
    """Dimension of every word."""
    return (code % np.uint32(DIMS)).astype(np.int64)


def grams(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each run of GRAM words, its text, its place in there)."""
    code = code.astype(np.uint64) * ODD
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
    full = np.flatnonzero(at + GRAM <= counts[text]) if len(code) else np.zeros(0, np.int64)
    found = np.zeros(len(full), np.uint64)
    for k in range(GRAM):
        found = mix(found * ODD + code[full + k])
    return found, text[full], at[full]


def halves(dim: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive half passages of texts: (sum of the weights of each one's words, its words, its text).

    The last row of weights is for no word and must be zero.
    """
    n = -(-counts // STEP)
    text = np.repeat(np.arange(len(counts)), n)
    padded = np.full(int(n.sum()) * STEP, DIMS, np.int64)
    shift = np.cumsum(n) * STEP - n * STEP - (np.cumsum(counts) - counts)
    padded[np.arange(len(dim)) + np.repeat(shift, counts)] = dim
    size = np.full(len(text), STEP)
    size[np.cumsum(n)[counts > 0] - 1] = ((counts - 1) % STEP + 1)[counts > 0]
    return weights[padded.reshape(-1, STEP)].sum(1), size, text


def batches_of(rows: Iterator[pd.DataFrame], words_at_once: int = 60_000) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Short runs of documents: ids and words."""
    for batch in rows:
        ids, texts, n = [], [], 0
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(doc)
            texts.append(words(text))
            n += len(texts[-1])
            if n >= words_at_once:
                yield ids, texts
                ids, texts, n = [], [], 0
        if ids:
            yield ids, texts


WIDTH = 3 + TEST


def tallied(docs: DataFrame, test: np.ndarray) -> np.ndarray:
    """Sums over all passages, per dimension: passages that have it, occurrences, number of passages (in the first), and T'T test for counts T."""
    weights = np.concatenate([test, np.zeros((1, TEST))]).astype(np.float32)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((DIMS, WIDTH))
        for _, texts in batches_of(rows):
            code, counts = codes(texts)
            if not len(code):
                continue
            dim = terms(code)
            sums, size, text = halves(dim, counts, weights)
            first = np.searchsorted(text, text)
            nth = (np.arange(len(text)) - first) // 2 * 2 + first  # the half that a half's passage starts with; these passages don't overlap
            of = np.repeat(nth, size)
            out[:, 0] += np.bincount(distinct(of * DIMS + dim) % DIMS, minlength=DIMS)
            out[:, 1] += np.bincount(dim, minlength=DIMS)
            out[0, 2] += np.count_nonzero(nth == np.arange(len(nth)))
            each = np.ascontiguousarray(pairs(sums, text)[nth].T, float)  # a column's values lie side by side
            for k in range(TEST):
                out[:, 3 + k] += np.bincount(dim, np.repeat(each[k], size), DIMS)
        tidy()
        yield pd.DataFrame({"row": range(DIMS // ROW), "part": [out[i : i + ROW].tobytes() for i in range(0, DIMS, ROW)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": rows["row"][:1], "part": [sum(np.frombuffer(p) for p in rows["part"]).tobytes()]})

    sums = docs.mapInPandas(run, "row int, part binary").groupBy("row").applyInPandas(add, "row int, part binary")
    out = np.zeros((DIMS, WIDTH))
    for row in sums.collect():  # DIMS * WIDTH numbers in all
        out[row["row"] * ROW : (row["row"] + 1) * ROW] = np.frombuffer(row["part"]).reshape(ROW, WIDTH)
    return out


def pairs(sums: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each half with the one after it in the same text."""
    out = sums.copy()
    out[:-1] += np.where((text[1:] == text[:-1]).reshape(-1, *[1] * (sums.ndim - 1)), sums[1:], 0)
    return out


class Space:
    """Projection of word counts: weights of dimensions (a last row of zeros for no word) and the centre per word."""

    def __init__(self, weights: np.ndarray, centre: np.ndarray):
        self.weights, self.centre = np.concatenate([weights, np.zeros((1, weights.shape[1]))]).astype(np.float32), centre.astype(np.float32)

    def vectors(self, dim: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit vectors of passages of two halves that start at each half, text of each)."""
        sums, size, text = halves(dim, counts, self.weights)
        total = pairs(sums, text) - pairs(size, text)[:, None] * self.centre
        return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), text


def fit(docs: DataFrame, seed: int = 7) -> Space:
    """Randomised SVD of the passages of all documents, in one pass.

    A is T times the inverse document frequencies; with a test matrix of the form (those)^-1 test,
    C = A'A R is what tallied sums up times the frequencies, and R'C is test' T'T test.
    """
    rng = np.random.default_rng(seed)
    test, rest = rng.standard_normal((DIMS, TEST)), rng.standard_normal((DIMS, REST)) / REST**0.5
    stats = tallied(docs, test)
    n = max(stats[0, 2], 1)
    idf = np.where(stats[:, 0] > 0, np.log((n + 1) / (stats[:, 0] + 0.5)), np.log(n + 1))
    counts = stats[:, 1] / n
    mean, gram = counts * idf, stats[:, 3:] - n * np.outer(counts, counts @ test)
    c, w = idf[:, None] * gram, test.T @ gram
    value, vector = np.linalg.eigh((w + w.T) / 2)
    good = value > max(value[-1], 1e-9) * 1e-7
    u, s, _ = np.linalg.svd(c @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    u, s = u[:, :RANK], np.maximum(s[:RANK], s[:1] * 1e-4 + 1e-12) / n**0.5
    left = rest - u @ (u.T @ rest)
    spread = np.sqrt(max(float((stats[:, 1] * idf**2).sum() / n), 1e-9))
    both = np.concatenate([u / s * (LATENT / RANK) ** 0.5, left / spread], axis=1)
    return Space(idf[:, None] * both, mean @ both / SIZE)


def common_subsequence(masks: dict[bytes, int], n: int, found: list[bytes]) -> int:
    """Length of the longest common subsequence of found with a text of n words whose places are masks (bit-parallel)."""
    row = full = (1 << n) - 1
    for word in found:
        if m := masks.get(word):
            both = row & m
            row = (row + both | row - both) & full
    return n - row.bit_count()


def masks_of(item: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, word in enumerate(item):
        out[word] = out.get(word, 0) | 1 << i
    return out


class Items:
    """A block of benchmark items: passages with their vectors, and what the checks need."""

    def __init__(self, rows: list[tuple[int, list[bytes]]], space: Space):
        at = [(w[a : a + SIZE], i) for i, (_, w) in enumerate(rows) for a in range(0, max(len(w) - SIZE, 0) + SHIFT, SHIFT)]
        code, counts = codes([w for w, _ in at])
        vectors, text = space.vectors(terms(code), counts)
        first = np.searchsorted(text, np.arange(len(at)))
        self.item, self.vectors = np.array([i for _, i in at]), vectors[first]
        gram, of, _ = grams(*codes([w for _, w in rows]))
        order = np.argsort(gram, kind="stable")
        self.gram, self.gram_item = gram[order], of[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.gram >> np.uint64(42)] = True
        self.names = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        self.masks = [masks_of(w) for w in self.words]
        self.answers = [w[-min(8, max(3, len(w) // 4)) :] for w in self.words]
        self.answer_masks = [masks_of(a) for a in self.answers]


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.45, common: float = 0.6, answer: float = 0.5) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer) of every document that holds an item, verbatim or paraphrased.

    common is the share of the item's words in the longest common subsequence with the words around
    a candidate passage, answer the same of its last words; both must reach their thresholds. Items
    under LEAST_WORDS words (null and empty texts too) are no evidence; documents without words
    have no passages; a null doc_id or item_id is returned as it is; repeated rows give repeated
    results; further columns are ignored; with an empty table on either side there are no rows.
    """
    return numbered(found_leaks(named(docs, "text"), benchmark, cosine, common, answer), "doc_id", "item_id")


def found_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.45, common: float = 0.6, answer: float = 0.5) -> DataFrame:
    """See leaks; doc_id is a string, and so is item_id in the result."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    few = docs.coalesce(max(1, -(-chars // UNIT_CHARS)))
    space, out, block, held = fit(few), None, [], 0

    def search(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((space, items))

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tidy()
            space, items = shared.value
            for ids, texts in batches_of(rows):
                found = [(ids[d], items.names[i], *told) for d, i, told in candidates(texts, space, items, cosine, common, answer)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "cosine", "common", "answer"])

        return few.mapInPandas(run, "doc_id string, item_id string, cosine double, common double, answer double")

    for row in named(benchmark, "text", name="item_id").toLocalIterator():
        if len(found := words(row["text"])) >= LEAST_WORDS:
            block.append((row["item_id"], found))
            held += -(-len(found) // SHIFT)
        if held >= BLOCK:
            part, block, held = search(Items(block, space)), [], 0
            out = part if out is None else out.unionByName(part)
    if block:
        part = search(Items(block, space))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id string, item_id string, cosine double, common double, answer double")


def runs_shared(code: np.ndarray, counts: np.ndarray, first: np.ndarray, items: Items) -> np.ndarray:
    """Distinct rows (half passage, item) where GRAM words in a row of the item begin; first is the first half of each text."""
    gram, text, at = grams(code, counts)
    hit = np.flatnonzero(items.maybe[gram >> np.uint64(42)])
    low, high = (np.searchsorted(items.gram, gram[hit], side) for side in ("left", "right"))
    hit, low, many = hit[high > low], low[high > low], (high - low)[high > low]
    which = np.repeat(hit, many)
    item = items.gram_item[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(which))]
    width = np.int64(len(items.words))
    return np.stack(np.divmod(distinct((first[text[which]] + at[which] // STEP) * width + item), width), axis=1)


def candidates(texts: list[list[bytes]], space: Space, items: Items, cosine: float, common: float, answer: float) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
    """(text, item, (cosine, common, answer)) of leaks among all passages of some texts."""
    code, counts = codes(texts)
    if not len(code):
        return
    vectors, text = space.vectors(terms(code), counts)
    first = np.searchsorted(text, np.arange(len(texts)))
    near = vectors @ items.vectors.T
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    checked: set[tuple[int, int]] = set()
    rows, cols = np.divmod(np.flatnonzero(near.ravel() >= cosine), near.shape[1])
    shared = runs_shared(code, counts, first, items)
    for passage, i, column in chain(zip(rows.tolist(), items.item[cols].tolist(), cols.tolist(), strict=True), ((p, i, None) for p, i in shared.tolist())):
        if (passage, i) in checked:
            continue
        checked.add((passage, i))
        whole, d = items.words[i], int(text[passage])
        a = (passage - int(first[d])) * STEP
        around = texts[d][max(0, a - len(whole)) : a + SIZE + len(whole)]
        there = set(around)
        if sum(w in there for w in whole) < common * len(whole):
            continue
        told = (float(near[passage, column] if column is not None else near[passage, items.item == i].max()), common_subsequence(items.masks[i], len(whole), around) / len(whole), common_subsequence(items.answer_masks[i], len(items.answers[i]), around) / len(items.answers[i]))
        if told[1] >= common and told[2] >= answer and told[1:] > best.get((d, i), (0, 0, 0))[1:]:
            best[d, i] = told
    for (d, i), told in sorted(best.items()):
        yield d, i, told


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leaks finds, each judged by its own text; columns stay as they are.

    Rows without words stay; rows of one doc_id or a null one are judged one by one, repeated rows
    alike; an empty table on either side changes nothing.
    """
    key = fresh("leak_key", docs.columns)
    keyed = docs.withColumn(key, F.sha2(F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("|"), "text"), 256))
    found = found_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(docs.columns)
