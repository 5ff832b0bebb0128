"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

A state of the nondeterministic machine is (trie node of the token being read, last whole token):
reading a byte follows the trie, and a node that is a token may close it if the pair (last token,
token) is one that the merges leave alone. A sequence is the BPE result exactly when all its
neighbouring pairs are of that kind, so one path survives at each prefix. Determinising keeps, per
set of states, the tokens that paths disagree on; what they agree on is emitted. A token can stay
open for at most its length, so lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from sparktrace.llm.common import keeps, named, numbered, tidy

#: Bounds of what a worker keeps; when one is reached that memory starts anew, results don't change.
MOVES, WORDS, PAIRS = 1_500_000, 400_000, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.closes = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if (to := self.child[node].get(byte)) is None:
                    to = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.closes.append(-1)
                node = to
            self.closes[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, ()),)
        self.states, self.number, self.moves = [start], {start: 0}, {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Merges applied one by one, lowest rank first: the definition, used for pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, last: int, token: int) -> bool:
        if (found := self.pairs.get((last, token))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            whole = [self.tokens[t] for t in (last, token) if t >= 0]
            found = self.pairs[last, token] = self.merged(b"".join(whole)) == whole
        return found

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and the tokens emitted; worked out once per state and byte."""
        paths = []
        for node, last, held in self.states[state]:
            if (to := self.child[node].get(byte)) is None:
                continue
            if self.child[to]:
                paths.append((to, last, held))
            if (token := self.closes[to]) >= 0 and self.stays(last, token):
                paths.append((0, token, (*held, token)))
        if not paths:
            raise ValueError(f"byte {byte} isn't covered by the vocabulary")
        first = min((p[2] for p in paths), key=len)
        same = 0
        while same < len(first) and all(p[2][same] == first[same] for p in paths):
            same += 1
        new = tuple(sorted((n, u, held[same:]) for n, u, held in paths))
        if (to := self.number.get(new)) is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        out = self.moves[state << 8 | byte] = (to, first[:same])
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) > MOVES:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            state, told = moves.get(state << 8 | byte) or self.move(state, byte)
            if told:
                out += told
        out += next(held for node, _, held in self.states[state] if node == 0)
        return out


class Words(dict):
    """Matches of the pattern seen so far, as packed ids."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> bytes:
        ids = self.machine.encode(word.encode("utf-8", "surrogatepass"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 40:
            self[word] = packed
        return packed


#: First and last byte of the next continuation and how many follow, for each lead byte of UTF-8.
LEADS = [(range(0xC2, 0xE0), 1, 0x80, 0xBF), ((0xE0,), 2, 0xA0, 0xBF), (range(0xE1, 0xED), 2, 0x80, 0xBF), ((0xED,), 2, 0x80, 0x9F), (range(0xEE, 0xF0), 2, 0x80, 0xBF), ((0xF0,), 3, 0x90, 0xBF), (range(0xF1, 0xF4), 3, 0x80, 0xBF), ((0xF4,), 3, 0x80, 0x8F)]


class Utf8:
    """Incremental UTF-8 machine: a state is the bytes of the code point under way. Malformed parts give U+FFFD."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.lead = {b: rule[1:] for rule in LEADS for b in rule[0]}
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}

    def read(self, state: bytes, data: bytes) -> tuple[bytes, str]:
        out = []
        for byte in data:
            if state:
                need, low, high = self.lead[state[0]]
                if len(state) > 1:
                    low, high = 0x80, 0xBF
                if low <= byte <= high:
                    state += bytes([byte])
                    if len(state) == need + 1:
                        out.append(state.decode())
                        state = b""
                    continue
                out.append("�")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.lead:
                state = bytes([byte])
            else:
                out.append("�")
        return state, "".join(out)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain, token by token."""
        state = b""
        known = self.moves[state]
        for token in ids:
            if (move := known.get(token)) is None:
                move = known[token] = self.read(state, self.tokens[token])
            if move[0] is not state and move[0] != state:
                state = move[0]
                known = self.moves.setdefault(state, {})
            yield move[1]
        if state:
            yield "�"


@lru_cache(2)
def machines(path: str, pattern: str) -> tuple[Words, Utf8, regex.Pattern]:
    machine = Transducer(load_ranks(path))
    return Words(machine), Utf8(machine.tokens), regex.compile(pattern)


keeps("byte_bpe", machines.cache_clear)


def encode_text(text: str | None, path: str, pattern: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    words, _, split = machines(path, pattern)
    return b"".join(map(words.__getitem__, split.findall(text or "")))


def decode_ids(packed: bytes, path: str, pattern: str) -> str:
    return "".join(machines(path, pattern)[1].decode(np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """Per document n_tokens, digests of ids and of the decoded text, and (on request) the ids.

    A null text counts as empty and gives no tokens; a null doc_id stays null; repeated rows give
    repeated results; further columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy("byte_bpe")
        words = machines(path, pattern)[0]
        for batch in batches:
            if len(words) > WORDS:
                words.clear()
            rows = []
            for text in batch["text"]:
                packed = encode_text(text, path, pattern)
                back = decode_ids(packed, path, pattern).encode("utf-8", "surrogatepass")
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
                rows.append((*row, np.frombuffer(packed, "<i4")) if ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return numbered(named(docs, "text").mapInPandas(run, schema))
