"""Term search: the score of a document is the dot product of its term counts with the query's."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestigo.functions.text import BLANK, tokens
from vestigo.operators import blocks
from vestigo.operators.ranking import WINDOW_CUT, scored, top_k
from vestigo.operators.terms import Index, token_rows
from vestigo.schemas import require
from vestigo.sources.bounds import wanted
from vestigo.sources.tables import written

DEFAULT_K = 10
# Blocks that a bounded search scores before it knows a threshold.
FIRST_BLOCKS = 16
# Queries a task scores at a time in a batch search, entries of a score matrix, and the share of pairs from which on a term's
# counts are multiplied as a matrix.
QUERIES, CELLS, COMMON = 1 << 14, 1 << 21, 1 / 512
# Documents of one block at most while a part's documents are taken by falling length.
BLOCK_WIDTH = 1 << 14


def query_terms(queries: DataFrame, text: str = "text", pattern: str = BLANK, stop_words: Iterable[str] = ()) -> DataFrame:
    """(query_id, term, qtf) of query texts."""
    rows = token_rows(queries, "query_id", text, pattern, stop_words)
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _hint(terms: DataFrame):
    """``F.broadcast`` when the measured size of the query terms allows it, else no hint.

    The answer also holds for any join result with at most one row per query term.
    """
    return F.broadcast if blocks.fits(terms, F.octet_length("term")) else lambda df: df


def _top(scores: DataFrame, k: int, id: str, queries: DataFrame | None = None) -> DataFrame:
    """Top k per query. A large k of a single query is taken by order and limit, which keep k rows per task in the JVM."""
    alone = k > WINDOW_CUT and queries is not None and queries.select("query_id").distinct().limit(2).count() < 2
    return top_k(scores, k, [("score", "descending"), (id, "ascending")], per=[] if alone else ["query_id"])


def search_texts(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, id: str = "doc_id", text: str = "text",
                 pattern: str = BLANK, stop_words: Iterable[str] = ()) -> DataFrame:
    """Best k documents per query straight from the texts: (query_id, id, score, rank).

    Meant for one or a few queries. Tokens that no query holds are dropped in the scan, and since a document's
    tokens sit in one task its score is summed up before the shuffle. For many queries use ``search_batch``.
    """
    wanted = query_terms(queries, text, pattern, stop_words)
    hits = token_rows(docs, id, text, pattern, stop_words).join(_hint(wanted)(wanted), "term")
    return _top(hits.groupBy("query_id", id).agg(F.sum("qtf").alias("score")), k, id, queries)


def search_postings(postings: DataFrame, terms: DataFrame, k: int = DEFAULT_K, id: str = "doc_id") -> DataFrame:
    """Best k documents per query from postings (term, id, tf) and query terms (query_id, term, qtf)."""
    require(terms, "query_id", "term", "qtf")
    hits = postings.join(_hint(terms)(terms), "term")
    return _top(hits.groupBy("query_id", id).agg(F.sum(F.col("qtf") * F.col("tf")).alias("score")), k, id, terms)


def search_weighted(index: Index, terms: DataFrame, k: int = DEFAULT_K, id: str = "doc_id", digits: int = 9) -> DataFrame:
    """As ``search_postings`` with squared idf weights and scores divided by the document norm; NaN scores drop out.

    Scores are rounded before ranking, so that equal documents tie in whatever order their terms were added up.
    """
    hint = _hint(terms)
    weights = index.terms.join(hint(terms), "term").select(
        "query_id", "term", (F.col("qtf") * F.pow("idf", F.lit(2))).alias("weight"))
    hits = index.postings.join(hint(weights), "term")
    raw = hits.groupBy("query_id", id).agg(F.sum(F.col("weight") * F.col("tf")).alias("raw"))
    scores = raw.join(index.docs, id).select(
        "query_id", id, F.when(F.col("norm") > 0, F.round(F.col("raw") / F.col("norm"), digits)).alias("score"))
    return _top(scored(scores), k, id, terms)


def search_bounded(bounds, terms: DataFrame, k: int = DEFAULT_K, weighted: bool = False, digits: int = 9,
                   first: int = FIRST_BLOCKS) -> DataFrame:
    """``search_postings`` (or ``search_weighted``) over an index with bounds, without scoring blocks that cannot hold a hit.

    A document's score is at most the sum of its block's largest term weights. The ``first`` blocks with the largest
    sums are scored; the k-th score found there is a threshold, and of the other blocks only those whose sum reaches it
    are scored (max-score, Turtle and Flood, 1995; by blocks, Ding and Suel, 2011). Ties at the threshold are scored, so the
    result is exact. ``bounds`` comes from ``sources.bounds``.
    """
    plan = bounded_plan(bounds, terms, k, weighted, digits, first)
    return _top(plan.scores, k, bounds.id, terms)


class BoundedPlan(NamedTuple):
    """Scores (query_id, id, score) of the blocks that had to be scored; per query its matching and its scored postings."""

    scores: DataFrame
    cost: DataFrame


def bounded_plan(bounds, terms: DataFrame, k: int, weighted: bool = False, digits: int = 9, first: int = FIRST_BLOCKS) -> BoundedPlan:
    require(terms, "query_id", "term", "qtf")
    cut, maxima = wanted(bounds, terms)
    if weighted:
        weights = cut.terms.join(_hint(terms)(terms), "term").select(
            "query_id", "term", (F.col("qtf") * F.pow("idf", F.lit(2))).alias("weight"))
        value, slack = "share", 2.0 * 10.0 ** -digits  # scores are rounded; sums in another order differ by less
    else:
        weights, value, slack = terms.select("query_id", "term", F.col("qtf").alias("weight")), "tf", 0.0
    sums = maxima.join(_hint(terms)(weights), "term").groupBy("query_id", "block").agg(
        F.sum(F.col("weight") * F.col(value)).alias("most"), F.sum("n").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    tried = written(sums.withColumn("tried", F.row_number().over(order) <= first), "blocks")
    ahead = written(_block_scores(cut, weights, terms, tried.filter("tried"), value, weighted, digits), "scores")
    least = top_k(ahead, k, [("score", "descending"), (bounds.id, "ascending")], per=["query_id"])
    floor = least.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = written(tried.filter("not tried").join(floor, "query_id", "left").filter(
        F.col("floor").isNull() | (F.col("most") + slack >= F.col("floor"))).select("query_id", "block", "n"), "blocks")
    scores = ahead.unionByName(_block_scores(cut, weights, terms, rest, value, weighted, digits))
    read = tried.filter("tried").select("query_id", "n").unionByName(rest.select("query_id", "n"))
    cost = sums.groupBy("query_id").agg(F.sum("n").alias("matched")).join(
        read.groupBy("query_id").agg(F.sum("n").alias("scored")), "query_id")
    return BoundedPlan(scores, cost)


def _block_scores(cut, weights: DataFrame, terms: DataFrame, wanted_blocks: DataFrame, value: str, weighted: bool, digits: int) -> DataFrame:
    hits = cut.postings.join(_hint(terms)(weights), "term").join(wanted_blocks.select("query_id", "block"), ["query_id", "block"])
    total = F.sum(F.col("weight") * F.col(value))
    scores = hits.groupBy("query_id", cut.id).agg((F.round(total, digits) if weighted else total).alias("score"))
    return scored(scores) if weighted else scores


def search_batch(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, id: str = "doc_id", text: str = "text",
                 pattern: str = BLANK, stop_words: Iterable[str] = (), ship_bytes: int = blocks.SHIP_BYTES,
                 block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``search_texts`` for any number of queries.

    Tasks score their documents against all queries at once and hand on only the best k per query, so a term shared
    by most queries and most documents never turns into rows of a shuffle. A task that holds a part of the documents takes
    them by falling length of their count vectors and drops the queries that no later document can serve (``whole_counts``).
    """
    require(queries, "query_id", text)
    left = queries.select("query_id", tokens(text, pattern, stop_words).alias("tokens"))
    right = docs.select(id, tokens(text, pattern, stop_words).alias("tokens")).filter(F.size("tokens") > 0)
    size = F.octet_length(F.array_join("tokens", " "))
    found = blocks.best_k(
        left.filter(F.size("tokens") > 0), right, k, blocks.dense(count_scores), query_id="query_id", id=id,
        query_size=size, corpus_size=size,
        ship_bytes=ship_bytes, block_bytes=block_bytes, prepare=query_counts, at_once=QUERIES, whole=whole_counts)
    return _top(found.select("query_id", id, F.col("score").cast("bigint").alias("score")), k, id)


class QueryCounts(NamedTuple):
    """Queries by term: the vocabulary, where each term's entries begin, and the entries' queries and counts."""

    vocab: pa.Array | np.ndarray
    n: int
    start: np.ndarray
    query: np.ndarray
    count: np.ndarray


def query_counts(queries: pa.Table) -> QueryCounts:
    lists = queries.column("tokens").combine_chunks()
    vocab, n = lists.flatten().unique(), queries.num_rows
    code = pc.index_in(lists.flatten(), value_set=vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    pair, count = np.unique(code * n + lists.value_parent_indices().to_numpy().astype(np.int64), return_counts=True)
    return QueryCounts(vocab, n, np.searchsorted(pair // max(n, 1), np.arange(len(vocab) + 1)), pair % max(n, 1), count)


def _grouped(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``n`` codes begins in their order, and that order."""
    order = np.argsort(codes, kind="stable")
    return np.searchsorted(codes[order], np.arange(n + 1)), order


def _list_counts(lists: pa.ListArray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, code, count) of token lists from their tokens' codes, by list; codes below 0 are left out. A slice at a time."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets, size, parts = offsets - offsets[0], int(codes.max(initial=0)) + 1, []
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CELLS, side="right")) - 1)
        some = codes[offsets[first]:offsets[last]].astype(np.int64)
        row = np.repeat(np.arange(last - first), np.diff(offsets[first:last + 1]))
        pair, count = np.unique((row * size + some)[some >= 0], return_counts=True)
        parts.append(((first + pair // size).astype(np.int32), (pair % size).astype(np.int32), count.astype(np.int32)))
        first = last
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (list(zip(*parts)) or ((), (), ())))


def whole_counts(docs: pa.Table):
    """``count_scores`` for all documents of a part: a finder of the best for tables of queries (``blocks.Whole``).

    A score is at most the product of the lengths of both count vectors (Cauchy and Schwarz). Documents are scored by falling
    length, so a query whose k-th score lies above its product with the next document's length is done.
    """
    lists = docs.column("tokens").combine_chunks()
    named = lists.flatten().dictionary_encode()
    vocab = named.dictionary
    row, code, tf = _list_counts(lists, named.indices.to_numpy(zero_copy_only=False))
    length = np.sqrt(np.bincount(row, weights=tf.astype(float) ** 2, minlength=len(lists)))
    order = np.argsort(-length, kind="stable")
    n = np.bincount(row, minlength=len(lists))
    begin, n = (np.cumsum(n) - n)[order], n[order]
    start = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(begin - start[:-1], n) + np.arange(len(row))
    code, tf, length = code[at], tf[at], length[order]

    def search(queries: pa.Table, best: blocks.BestK):
        q_lists = queries.column("tokens").combine_chunks()
        q_code = pc.fill_null(pc.index_in(q_lists.flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False)
        names = np.unique(q_code[q_code >= 0])
        known = np.full(len(vocab), -1, np.int32)
        known[names] = np.arange(len(names))
        asked, term, count = _list_counts(q_lists, np.where(q_code < 0, -1, known[q_code]) if len(names) else q_code)
        who, reach = np.arange(len(q_lists)), np.sqrt(np.bincount(asked, weights=count.astype(float) ** 2, minlength=len(q_lists)))
        left, first = None, 0
        while first < len(lists):
            most = reach[who] * length[first] * (1 + 1e-9)
            open_ = (most >= best.floor[who]) & (most > 0)
            if not open_.any():
                return
            if left is None or open_.sum() < 0.75 * len(who):
                used = open_[asked]
                asked, term, count = (np.cumsum(open_) - 1)[asked[used]], term[used], count[used]
                who = who[open_]
                begin, by = _grouped(term, len(names))
                left = QueryCounts(names, len(who), begin, asked[by], count[by])
            width = min(max(CELLS // len(who), 256), BLOCK_WIDTH, len(lists) - first)
            lo, hi = start[first], start[first + width]
            some, row = known[code[lo:hi]], np.repeat(np.arange(width), n[first:first + width])
            used = some >= 0
            exact = reach[who].max() * length[first] < 1 << 24  # no sum of a score then leaves the whole numbers of a float
            scores = _scored_block(left, some[used], row[used], tf[lo:hi][used], width, exact)
            q, d = best.chosen(scores, who)
            yield who[q], order[first + d], scores[q, d]
            first += width

    return search


def _scored_block(queries: QueryCounts, code: np.ndarray, row: np.ndarray, tf: np.ndarray, width: int, exact: bool = False) -> np.ndarray:
    """Score matrix of queries and the documents of a block from the documents' counts; NaN where no term is shared."""
    shared = np.bincount(code, minlength=len(queries.vocab)) * np.diff(queries.start)
    common = np.flatnonzero(shared > queries.n * width * COMMON)
    scores = _common_scores(queries, common, code, row, tf, width, exact)
    known = (shared > 0)
    known[common] = False
    known = known[code]
    _add_rare(scores, queries, code[known], row[known], tf[known], width, CELLS)
    scores[scores == 0] = np.nan
    return scores.reshape(queries.n, width)


def count_scores(queries: QueryCounts, docs: pa.Table, cells: int = CELLS):
    """Score matrices of token lists: summed products of term counts, NaN where no term is shared."""
    vocab, n_q, start = queries.vocab, queries.n, queries.start
    d_lists = docs.column("tokens").combine_chunks()
    code = pc.index_in(d_lists.flatten(), value_set=vocab)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    d_row = d_lists.value_parent_indices().to_numpy().astype(np.int64)[known]
    code = code.drop_null().to_numpy().astype(np.int64)
    posting, tf = np.unique(d_row * max(len(vocab), 1) + code, return_counts=True)
    d_row, code = posting // max(len(vocab), 1), posting % max(len(vocab), 1)

    step = max(1, cells // max(n_q, 1))
    for first in range(0, docs.num_rows, step):
        width = min(step, docs.num_rows - first)
        lo, hi = np.searchsorted(d_row, [first, first + width])
        some, row, times = code[lo:hi], d_row[lo:hi] - first, tf[lo:hi]
        shared = np.bincount(some, minlength=len(vocab)) * np.diff(start)
        common = np.flatnonzero(shared > n_q * width * COMMON)
        scores = _common_scores(queries, common, some, row, times, width)
        rest = ~np.isin(some, common)
        some, row, times = some[rest], row[rest], times[rest]
        _add_rare(scores, queries, some, row, times, width, cells)
        scores[scores == 0] = np.nan
        yield first, scores.reshape(n_q, width)


def _add_rare(scores: np.ndarray, queries: QueryCounts, code: np.ndarray, row: np.ndarray, tf: np.ndarray, width: int, cells: int) -> None:
    """Add to a flat score matrix what postings and the query entries of their terms give."""
    start = queries.start
    spread = start[code + 1] - start[code]
    edges = np.concatenate([[0], np.cumsum(spread)])
    at = 0
    while at < len(code):
        # a slice of postings whose matching query entries stay near ``cells``
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + cells, side="right")) - 1)
        n = spread[at:end]
        entry = np.repeat(start[code[at:end]] - (edges[at:end] - edges[at]), n) + np.arange(n.sum())
        cell = queries.query[entry] * width + np.repeat(row[at:end], n)
        scores += np.bincount(cell, weights=queries.count[entry] * np.repeat(tf[at:end], n), minlength=len(scores))
        at = end


def _common_scores(queries: QueryCounts, common: np.ndarray, code: np.ndarray, row: np.ndarray, tf: np.ndarray, width: int,
                   exact: bool = False) -> np.ndarray:
    """Flat score matrix over the terms that many queries and documents hold, by one matrix product of their counts."""
    if not len(common):
        return np.zeros(queries.n * width)
    place = np.full(len(queries.vocab), -1)
    place[common] = np.arange(len(common))
    n = np.diff(queries.start)[common]
    entry = np.repeat(queries.start[common] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    held = place[code] >= 0
    largest = float(queries.count[entry].max()) * float(tf[held].max()) * len(common)
    kind = np.float32 if exact or largest < 1 << 24 else np.float64  # whole numbers below this are exact
    left, right = np.zeros((queries.n, len(common)), kind), np.zeros((len(common), width), kind)
    left[queries.query[entry], np.repeat(np.arange(len(common)), n)] = queries.count[entry]
    right[place[code[held]], row[held]] = tf[held]
    return (left @ right).astype(np.float64).ravel()
