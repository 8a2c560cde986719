"""Encoding and decoding with a byte-pair tokenizer compiled to a deterministic automaton.

Compilation follows the merge-gadget construction (Berglund, Martens and van der Merwe, 2024). It starts with one state
that has an arc for each single symbol and leads back to itself. A merge of u and v takes the state that u leads to:
u is sent to a copy of it that lacks the arc v, and the new token gets an arc beside every arc u, to where v led. The
sequences of arc labels that the automaton accepts are then exactly the tokenizations that applying the merges in
order gives. A state is stored as the state it was copied from and the arc it lost; arcs that later merges add beside
a lost arc are missing with it, which the chain of first halves of a token tells.

A word has one accepted path, and so has each of its prefixes; the encoder follows it from left to right through the
transition table, one arc into each position.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vestigo.llm.common import Remembered, by_batches, dropped_by, narrowed

#: Words, pieces and arcs remembered by one worker process.
KEPT_WORDS, KEPT_PIECES, KEPT_ARCS = 400_000, 250_000, 200_000
NEVER = 1 << 60
#: First symbols by which the longest token that can follow is known.
HEAD = 4
BATCH_TOKENS = 1_000_000


#: The first character without a category.
FIRST_UNKNOWN = "\u0378"
#: str.split() also breaks at these four control characters, the pattern's blanks do not include them.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
SPACES = regex.compile(r"[^\S\x1c-\x1f]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Automaton:
    """Transition table of a merge list; tokens are numbered as in the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.ids, self.end = vocabulary, end
        self.labels = {i: t for t, i in vocabulary.items()}
        size = max(vocabulary.values()) + 1
        self.first, self.second = [-1] * size, [-1] * size  # halves of a token, -1 for single symbols
        self.born = [-1] * size                             # merge that made a token
        self.after = [0] * size                             # state that a token's arcs lead to
        self.owner, self.made = [-1], [-1]                  # by state: token that leads to it, merge that copied it
        self.lost: dict[int, int] = {}                      # merge at which the state after a token lost an arc
        self.known: dict[int, bool] = {}
        for k, (u, v) in enumerate(merges):
            self._add(k, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self.known.clear()
        self.longest = max((len(t) for t in vocabulary), default=1)
        self.size, self.shorter = [0] * size, [-1] * size   # length of a token, the longest token that it begins with
        self.reach: dict[str, int] = {}                     # by first symbols: length of the longest token inside words
        for text, token in vocabulary.items():
            self.size[token] = len(text)
            self.shorter[token] = next((vocabulary[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in vocabulary), -1)
            if not end or not text.endswith(end):
                self.reach[text[:HEAD]] = max(self.reach.get(text[:HEAD], 0), len(text))

    def _add(self, k: int, u: int, v: int, new: int) -> None:
        if self.first[new] >= 0:
            raise ValueError("two merges make the same token")
        to = self.after[v]
        if self.arc(self.after[u], v):
            self.lost[u << 20 | v] = k
            self.owner.append(u)
            self.made.append(k)
            self.after[u] = len(self.owner) - 1
        self.first[new], self.second[new], self.born[new], self.after[new] = u, v, k, to

    def arc(self, state: int, token: int) -> bool:
        """Whether a state has an arc for a token.

        The state after a token lost arcs in that token's merges up to the copy, and before the token was made, when
        it was the state after its second half, in that half's merges, and so on. An arc that was lost takes along
        the tokens that begin with it and were made later, or by that very merge when a token is doubled.
        """
        key = state << 20 | token
        found = self.known.get(key)
        if found is None:
            if len(self.known) > KEPT_ARCS:
                self.known.clear()
            found = self.known[key] = self._has(state, token)
        return found

    def _has(self, state: int, token: int) -> bool:
        heads, part, until = [], token, NEVER
        while part >= 0:
            heads.append((part, until))
            part, until = self.first[part], self.born[part]
        tail, limit = self.owner[state], self.made[state] + 1
        while tail >= 0:
            for part, until in heads:
                at = self.lost.get(tail << 20 | part, NEVER)
                if at < limit and at <= until:
                    return False
            tail, limit = self.second[tail], self.born[tail]
        return True

    def longest_at(self, symbols: str, at: int, last: int) -> int:
        """The longest token that the symbols from ``at`` begin with and that ends at ``last`` or before, else -1."""
        to = min(last, at + self.reach.get(symbols[at:at + HEAD], HEAD - 1))
        while to > at:
            token = self.ids.get(symbols[at:to])
            if token is not None:
                return token
            to -= 1
        return -1

    def encode(self, symbols: str) -> list[int]:
        """Tokens of a word given as byte symbols; ``end`` is joined to its last symbol.

        At each place the arc to the word's end is tried first, then arcs from the longest token on, each followed by the
        longest token that it begins with. Where none goes on, the path steps back. A place in the word is reached by one
        path only, so none is tried twice.
        """
        known, arc, after, size, shorter, n = self.known, self.arc, self.after, self.size, self.shorter, len(symbols)
        if not n:
            return []
        seen, path, places = bytearray(n + 1), [], []
        at, state, token = 0, 0, None
        while True:
            if token is None:  # a place just reached
                token = self.ids.get(symbols[at:] + self.end) if n - at <= self.longest else None
                if token is not None and arc(state, token):
                    path.append(token)
                    return path
                token = self.longest_at(symbols, at, n - 1)
            while token >= 0:
                to = at + size[token]
                if not seen[to]:
                    found = known.get(state << 20 | token)
                    if found or found is None and arc(state, token):
                        break
                token = shorter[token]
            if token >= 0:
                seen[to] = 1
                path.append(token)
                places.append(at)
                at, state, token = to, after[token], None
            elif path:
                token, at = shorter[path.pop()], places.pop()
                state = after[path[-1]] if path else 0
            else:
                raise ValueError("a symbol is not in the vocabulary")


class WordTokenizer:
    """A word-level byte BPE file (its own JSON format) as an automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, self.end)
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.of_piece = Remembered(self._packed, KEPT_PIECES)
        self.of_word = Remembered(lambda w: b"".join(map(self.of_piece.__getitem__, self._pieces(w))), KEPT_WORDS)
        self.labels = dict(self.automaton.labels) | {i: t for t, i in self.special.items()}

    def _packed(self, piece: str) -> bytes:
        symbols = "".join(map(self.symbols.__getitem__, piece.encode()))
        return np.array(self.automaton.encode(symbols), np.int32).tobytes()

    def _pieces(self, word: str) -> list[str]:
        """Pieces by the file's pattern; characters without a category yet are no letters, whatever ``regex`` knows."""
        if word.isascii() or max(word) < FIRST_UNKNOWN:
            return self.pieces.findall(word)
        known = "".join(c if unicodedata.category(c) != "Cn" else "\ue000" for c in word)
        return [word[m.start():m.end()] for m in self.pieces.finditer(known)]

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:  # lower-case one character at a time: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join(map(self.of_word.__getitem__, text.split() if not SEPARATORS.search(text) else SPACES.split(text)))

    def encode(self, text: str) -> np.ndarray:
        """Token ids; the names of special tokens in a text are those tokens, as the file's library has it."""
        if "<|" not in text:
            return np.frombuffer(self._plain(text), np.int32)
        parts = [np.int32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in self.marks.split(text)]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        """The labels of a path's arcs; the file names no decoder, so they are set apart by one blank."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


dropped_by(__name__, tokenizer.cache_clear)


def _encoded(batch, path: str):
    """(ids of rows, token lists) of an Arrow batch, in parts of about BATCH_TOKENS tokens; a text that equals the one
    before it, as copies of a mix do, is encoded once and its list is the same object."""
    words, texts = tokenizer(path), batch.column(1)
    held, begun, total = [], 0, 0
    last, ids = None, None
    for i in range(len(texts)):
        text = texts[i].as_py()
        if text != last:
            last, ids = text, words.encode(text)
        held.append(ids)
        total += len(held[-1])
        if total > BATCH_TOKENS or i == len(texts) - 1:
            ends = np.zeros(len(held) + 1, np.int32)
            np.cumsum([len(h) for h in held], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held), pa.int32()))
            yield batch.column(0).slice(begun, len(held)), lists, held
            held, begun, total = [], i + 1, 0


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null or empty text has no ids, ids of rows are passed on as they are."""
    def work(batch):
        for rows, lists, _ in _encoded(batch, path):
            yield rows, lists

    return by_batches(narrowed(docs), work, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ``decode`` of ``encode``, in one Python worker a task instead of two."""
    def work(batch):
        for rows, lists, held in _encoded(batch, path):
            decoded = []
            for i, ids in enumerate(held):
                decoded.append(decoded[-1] if i and ids is held[i - 1] else tokenizer(path).decode(ids.tolist()))
            yield rows, lists, pa.array(decoded, pa.string())

    return by_batches(narrowed(docs), work, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded string) of rows (doc_id, ids); null ids count as none."""
    def work(batch):
        words, lists = tokenizer(path), batch.column(1)
        step = max(1, len(lists) * BATCH_TOKENS // max(1, len(lists.values)))
        for at in range(0, len(lists), step):
            part = lists.slice(at, step)
            decoded = [words.decode(x.values.to_pylist()) if x.is_valid else "" for x in part]
            yield batch.column(0).slice(at, step), part, pa.array(decoded, pa.string())

    return by_batches(encoded.select("doc_id", "ids"), work, "doc_id long, ids array<int>, decoded string")
