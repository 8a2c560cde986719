"""Exact token counts at every prefix of a text, for piece tokenizers that merge by vocabulary (SentencePiece BPE).

The last piece of a text's encoding, taken off, leaves the encoding of the shorter text; and pieces in a row are an
encoding exactly when each neighbouring pair of them is one. So one pass over a chunk finds, for every prefix, the one
last piece that fits its predecessor, and with it the exact number of pieces, in time that grows with the length.
Chunks start at runs of blanks, which no piece of the vocabulary crosses from the left; that is checked on loading.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import Remembered, by_batches, narrowed

BLANK = "▁"
#: Chunks of at most this many characters are remembered; their counts fit in a byte, four bytes a character at most.
KEPT_LENGTH = 60
#: Chunks and pairs of pieces remembered by one worker process.
KEPT_CHUNKS = 1_200_000
KEPT_PAIRS = 300_000
#: Beginnings remembered, and their length.
KEPT_HEADS, HEAD = 60_000, 5
NEVER = float("inf")
#: Prefixes in one batch sent back to Spark.
BATCH_PREFIXES = 2_000_000

CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*")


class PrefixCounter:
    """Counts of pieces by prefix, with a vocabulary and its ranks."""

    def __init__(self, model: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.rank = {}
        for i in range(processor.get_piece_size()):
            if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i)):
                self.rank[processor.id_to_piece(i)] = -processor.get_score(i)
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.rank):
            raise ValueError("a piece of this vocabulary spans words")
        self.number, self.heads, self.tails = {"": 0}, {}, {}
        self.odd: set[str] = set()  # pieces that rank before a part of theirs: pairs with them are merged in full
        for piece in sorted(self.rank, key=len):
            parts, halves = self.merged(piece)
            if parts == [piece]:
                self._keep(piece, halves)
        self.longest = max(map(len, self.number))
        self.fits: dict[int, bool] = {}
        self.of_head = Remembered(self._walk, KEPT_HEADS)
        self.of_word = Remembered(lambda w: bytes(self.prefixes(BLANK + w)), KEPT_CHUNKS)  # a byte per prefix

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a short text by the definition, the best pair first, the leftmost of equals; the last pair merged."""
        parts, halves = list(text), None
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            i = min(ranked)[1]
            halves = parts[i], parts[i + 1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts, halves

    def _keep(self, piece: str, halves) -> None:
        """Number a piece; note what it begins and ends with while it is merged: parts, when made, when merged on."""
        self.number[piece] = len(self.number)
        made = self.rank[piece] if halves else -1.0
        self.heads[piece], self.tails[piece] = [(piece, made, NEVER)], [(piece, made, NEVER)]
        if halves:
            if any(h in self.odd or self.heads[h][0][1] >= made for h in halves):
                self.odd.add(piece)
            self.heads[piece] += [(p, m, min(until, made)) for p, m, until in self.heads[halves[0]]]
            self.tails[piece] += [(p, m, min(until, made)) for p, m, until in self.tails[halves[1]]]

    def follows(self, left: str, piece: str) -> bool:
        """Whether two pieces side by side stay apart: no end of the first is merged with a beginning of the second.

        Two parts merge at the rank of what they make, or when the later of them is made, if both are still there;
        of equal ranks the left merge comes first.
        """
        key = self.number[left] << 20 | self.number[piece]
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > KEPT_PAIRS:
                self.fits.clear()
            known, rank = True, self.rank.get
            if left in self.odd or piece in self.odd:
                known = self.merged(left + piece)[0] == [left, piece]
                self.fits[key] = known
                return known
            for tail, tail_made, tail_until in self.tails[left]:
                for head, head_made, head_until in self.heads[piece]:
                    at = rank(tail + head)
                    if at is not None:
                        at = max(at, tail_made, head_made)
                        if at < tail_until and at <= head_until:
                            known = False
            self.fits[key] = known
        return known

    def prefixes(self, chunk: str) -> list[int]:
        """Number of tokens of chunk[:1], chunk[:2], ...; a character outside the vocabulary counts one per byte."""
        return self._walk(chunk)[2][1:]

    def _walk(self, chunk: str):
        """By prefix, the empty one included: its last piece, that piece's number or -1, its tokens.

        Chunks with the same beginning share the walk over it.
        """
        number, longest, fits = self.number.get, self.longest, self.fits.get
        if len(chunk) > HEAD:
            pieces, numbers, counts = map(list, self.of_head[chunk[:HEAD]])
        else:
            pieces, numbers, counts = [""], [0], [0]
        for end in range(len(pieces), len(chunk) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = chunk[start:end]
                found = number(piece)
                if found is None:
                    continue
                before = numbers[start]
                if start and before >= 0:
                    apart = fits(before << 20 | found)
                    if apart is None:
                        apart = self.follows(pieces[start], piece)
                    if not apart:
                        continue
                pieces.append(piece)
                numbers.append(found)
                counts.append(counts[start] + 1)
                break
            else:
                pieces.append("")
                numbers.append(-1)
                counts.append(counts[end - 1] + len(chunk[end - 1].encode()))
        return pieces, numbers, counts

    def count_prefixes(self, text: str) -> np.ndarray:
        """Exact number of tokens of each prefix of a text, by characters, from the first to the whole."""
        if not text:
            return np.zeros(0, np.int32)
        words = text.split(" ")
        if BLANK not in text and words[0] and words[-1] and "" not in words and max(map(len, words)) < KEPT_LENGTH:
            counts = np.frombuffer(b"".join(map(self.of_word.__getitem__, words)), np.uint8).astype(np.int32)
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        else:
            chunks = CHUNK.findall(BLANK + text.replace(" ", BLANK))
            counts = np.concatenate([np.array(self.prefixes(c), np.int32) if len(c) > KEPT_LENGTH or c[1:2] == BLANK
                                     else np.frombuffer(self.of_word[c[1:]], np.uint8).astype(np.int32) for c in chunks])
            sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        totals = counts[np.cumsum(sizes) - 1]
        counts += np.repeat(np.cumsum(totals) - totals, sizes).astype(np.int32)
        return counts[1:]


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, counts array<int>) of every row: tokens of the text's first 1, 2, ... characters.

    A null text is empty and has no counts; ids are passed on as they are, null and repeated ones too.
    """
    def work(batch):
        found, ids, sizes = counter(model), batch.column(0), []
        held, begun, total = [], 0, 0
        texts = batch.column(1)
        for i in range(len(texts)):
            text = texts[i].as_py()
            counts = found.count_prefixes(text)
            held.append(counts)
            sizes.append(len(text.encode()))
            total += len(counts)
            if total > BATCH_PREFIXES or i == len(texts) - 1:
                ends = np.zeros(len(held) + 1, np.int32)
                np.cumsum([len(c) for c in held], out=ends[1:])
                yield (ids.slice(begun, len(held)), pa.array(sizes, pa.int64()),
                       pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held), pa.int32())))
                held, sizes, begun, total = [], [], i + 1, 0

    return by_batches(narrowed(docs), work, "doc_id long, n_bytes long, counts array<int>")


def total_tokens(counts="counts"):
    """Tokens of the whole text from its prefix counts."""
    return F.when(F.size(counts) > 0, F.element_at(counts, -1)).otherwise(0).cast("long")


def longest_within(budget: int, counts="counts"):
    """Characters of the longest prefix that has at most ``budget`` tokens; 0 when there is none."""
    at = F.transform(counts, lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(at), F.lit(0)).cast("long")
