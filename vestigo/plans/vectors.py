"""Queries on feature vectors: distances, ranking, codebook histograms, fusion, cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.functions.vectors import histogram_string, similarity, slice_vector
from vestigo.operators import features, fusion, models, search
from vestigo.operators.distances import feature_distance, nearest
from vestigo.operators.metric import nearest_pruned
from vestigo.operators.ranking import in_top, merge_top, sort_by_distance, top_k
from vestigo.plans.tables import table
from vestigo.sources.readers import queries_from
from vestigo.sources.tables import written

QUERY_ITEM = 0
DIGITS = 6
SLICE = 8
LABELS = 10
WORDS = 80
CLUSTERS = 32
ASKED = 100
SETTLED = 1e-3
NEAREST = [("distance", "ascending"), ("vec_id", "ascending")]


def _items(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _query(items):
    return queries_from(items, [QUERY_ITEM], "vec_id")


def _distance(metric):
    def run(spark, folder):
        items = _items(spark, folder)
        return feature_distance(items, _query(items), metric, "vec_id", digits=DIGITS)
    return run


def _histogram_distance(metric):
    def run(spark, folder):
        bins = written(features.dense_histogram(_histogram(spark, folder), WORDS, "vec_id"), "bins")
        return feature_distance(bins, queries_from(bins, [QUERY_ITEM], "vec_id"), metric, "vec_id", digits=DIGITS)
    return run


def _nearest(metric, k=10):
    def run(spark, folder):
        items = _items(spark, folder)
        return nearest(items, items.withColumnRenamed("vec_id", "query_id"), k, metric, "vec_id", digits=DIGITS)
    return run


def _nearest_pruned(metric, k=10):
    """Neighbours of every row whose id is divisible by 100 among all rows."""
    def run(spark, folder):
        items = _items(spark, folder)
        asked = items.filter(F.col("vec_id") % ASKED == 0).withColumnRenamed("vec_id", "query_id")
        return nearest_pruned(items, asked, k, metric, "vec_id", digits=DIGITS, cell=64).found
    return run


def sort_descending(spark, folder):
    ranked = sort_by_distance(_distance("l2")(spark, folder), "descending", id="vec_id")
    return ranked.select("vec_id", "distance")


def sort_limit(spark, folder):
    return top_k(_distance("l2")(spark, folder), 100, [("distance", "descending"), ("vec_id", "ascending")])


def filter_top(spark, folder):
    top = top_k(_distance("l2")(spark, folder), 100, NEAREST)
    return in_top(_items(spark, folder).select("vec_id", "label"), top, "vec_id")


def feature_long(spark, folder):
    local = features.cut_vectors(_items(spark, folder), SLICE, "vec_id")
    return local.select("vec_id", "pos", F.posexplode("vector").alias("dim", "value"))


def feature_joined(spark, folder):
    back = features.join_vectors(features.cut_vectors(_items(spark, folder), SLICE, "vec_id"), "vec_id")
    return back.select("vec_id", F.posexplode("vector").alias("dim", "value"))


def _codebook(spark, folder):
    """Mean slice of each label and slice position as an 80-word codebook."""
    local = features.cut_vectors(_items(spark, folder), SLICE, "vec_id")
    cells = (local.join(_items(spark, folder).select("vec_id", "label"), "vec_id")
             .select((F.col("label") * SLICE + F.col("pos")).alias("word"), F.posexplode("vector").alias("dim", "x"))
             .groupBy("word", "dim").agg(F.round(F.avg("x"), 6).alias("x")))
    entries = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return cells.groupBy("word").agg(F.transform(entries, lambda e: e["x"]).alias("vector"))


def _assigned(spark, folder):
    local = features.cut_vectors(_items(spark, folder), SLICE, "vec_id")
    return features.assign_words(local, _codebook(spark, folder), "vec_id", digits=DIGITS)


def _histogram(spark, folder):
    return features.word_histogram(_assigned(spark, folder), "vec_id")


def codebook_assign(spark, folder):
    return _assigned(spark, folder)


def codebook_hist(spark, folder):
    return _histogram(spark, folder)


def codebook_dense(spark, folder):
    dense = features.dense_histogram(_histogram(spark, folder), WORDS, "vec_id")
    return dense.select("vec_id", F.posexplode("vector").alias("word", "n"))


def hist_terms(spark, folder):
    return features.histogram_terms(_histogram(spark, folder), "vec_id")


def hist_strings(spark, folder):
    dense = features.dense_histogram(_histogram(spark, folder), WORDS, "vec_id")
    return dense.select("vec_id", histogram_string("vector").alias("words"))


def hist_truncated(spark, folder):
    scaled = F.transform("vector", lambda x: F.abs(x) * 10)
    dense = _items(spark, folder).select("vec_id", scaled.alias("vector"))
    return features.sparse_histogram(dense, "vec_id")


def bovw_search(spark, folder):
    postings = written(features.histogram_terms(_histogram(spark, folder), "vec_id"), "postings")
    query = postings.filter(F.col("vec_id") == QUERY_ITEM).select(
        F.col("vec_id").alias("query_id"), "term", F.col("tf").alias("qtf"))
    return search.search_postings(postings, query, 10, "vec_id")


def bovw_batch(spark, folder):
    dense = features.dense_histogram(_histogram(spark, folder), WORDS, "vec_id")
    docs = written(dense.select("vec_id", histogram_string("vector").alias("text")), "words")
    return search.search_batch(docs, docs.withColumnRenamed("vec_id", "query_id"), 10, "vec_id")


def kmeans_hist(spark, folder):
    local = features.cut_vectors(_items(spark, folder), SLICE, "vec_id")
    model = models.train_codebook(local, CLUSTERS)
    return features.word_histogram(models.model_words(model, local, "vec_id"), "vec_id")


def kmeans_fit(spark, folder):
    """Whether training settled: parts whose word is not the nearest centre by exact distance, and words whose centre is not
    the mean of their parts."""
    local = features.cut_vectors(_items(spark, folder), SLICE, "vec_id")
    model = models.train_codebook(local, CLUSTERS, max_iter=200)
    book = models.codebook_table(model, spark)
    named = models.model_words(model, local, "vec_id").join(local, ["vec_id", "pos"])
    exact = features.assign_words(local, book, "vec_id").withColumnRenamed("word", "nearest")
    wrong = named.join(exact, ["vec_id", "pos"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("word") != F.col("nearest")).alias("wrong"))
    means = named.select("word", F.posexplode("vector").alias("at", "x")).groupBy("word", "at").agg(F.avg("x").alias("mean"))
    centres = book.select("word", F.posexplode("vector").alias("at", "centre"))
    off = centres.join(means, ["word", "at"]).agg(
        F.count_distinct("word").alias("words"), F.count_if(F.abs(F.col("mean") - F.col("centre")) > SETTLED).alias("off"))
    one = F.lit(1).alias("one")
    return wrong.select("*", one).join(off.select("*", one), "one").select("n", "wrong", "words", "off")


def bovw_kmeans(spark, folder):
    postings = written(features.histogram_terms(kmeans_hist(spark, folder), "vec_id"), "postings")
    query = postings.filter(F.col("vec_id") == QUERY_ITEM).select(
        F.col("vec_id").alias("query_id"), "term", F.col("tf").alias("qtf"))
    return search.search_postings(postings, query, 10, "vec_id")


def _halves(spark, folder):
    items = _items(spark, folder)
    return features.feature_lists({
        "front": items.select("vec_id", slice_vector("vector", 1, 32).alias("vector")),
        "back": items.select("vec_id", slice_vector("vector", 33, 32).alias("vector"))}, "vec_id")


def feature_lists(spark, folder):
    return _halves(spark, folder).select("vec_id", "kind", F.posexplode("vector").alias("pos", "value"))


def fused(spark, folder):
    halves = _halves(spark, folder)
    return fusion.fused_query(halves, _query(halves), ["front", "back"], fusion.pair_weights(0.5), 10, top_n=100,
                              id="vec_id", digits=DIGITS)


def fused_all(spark, folder):
    halves = _halves(spark, folder)
    return fusion.fused_query(halves, _query(halves), ["front", "back"], [0.7, 0.3], 20, id="vec_id", digits=DIGITS)


def fused_same(spark, folder):
    halves = _halves(spark, folder)
    return fusion.fused_query(halves, _query(halves), ["front", "front"], fusion.pair_weights(0.5), 10, id="vec_id",
                              digits=DIGITS)


def fused_batch(spark, folder):
    halves = _halves(spark, folder)
    return fusion.fused_batch(halves, halves.withColumnRenamed("vec_id", "query_id"), ["front", "back"],
                              fusion.pair_weights(0.5), 50, 10, id="vec_id", digits=DIGITS)


def fused_batch_exact(spark, folder):
    halves = _halves(spark, folder)
    return fusion.fused_batch(halves, halves.withColumnRenamed("vec_id", "query_id"), ["front", "back"],
                              fusion.pair_weights(0.5), k=10, id="vec_id", digits=DIGITS)


def fused_threshold(spark, folder):
    """Exact fusion for every row whose id is divisible by 100 against all rows, by the threshold algorithm."""
    halves = _halves(spark, folder)
    asked = halves.filter(F.col("vec_id") % ASKED == 0).withColumnRenamed("vec_id", "query_id")
    return fusion.fused_threshold(halves, asked, ["front", "back"], fusion.pair_weights(0.5), 10, id="vec_id", digits=DIGITS,
                                  cell=64).found


def fused_lists(spark, folder):
    items = _items(spark, folder)
    lists = []
    for start in (1, 33):
        half = items.select("vec_id", slice_vector("vector", start, 32).alias("vector"))
        near = top_k(feature_distance(half, _query(half), "l2", "vec_id", digits=DIGITS), 100, NEAREST)
        lists.append(near.select(F.lit(QUERY_ITEM).cast("bigint").alias("query_id"), "vec_id",
                                 similarity("distance").alias("score")))
    out = fusion.fuse(lists, [0.6, 0.4], "vec_id")
    return out.select("query_id", "vec_id", F.round("score", DIGITS).alias("score"))


def union_merge(spark, folder):
    items = _items(spark, folder)
    lists = []
    for start in (1, 33):
        half = items.select("vec_id", slice_vector("vector", start, 32).alias("vector"))
        near = feature_distance(half, _query(half), "l2", "vec_id", digits=DIGITS)
        lists.append(top_k(near, 10, NEAREST, rank=None).withColumn("part", F.lit(start)))
    return merge_top(lists, 10, NEAREST + [("part", "ascending")])


def cascade(spark, folder):
    items = _items(spark, folder).select("vec_id", "vector", slice_vector("vector", 1, 16).alias("first"),
                                         slice_vector("vector", 17, 16).alias("second"))
    stages = [fusion.Stage("first", "l2", 200), fusion.Stage("second", "l1", 50), fusion.Stage("vector", "cosine", 10)]
    return fusion.cascade(items, _query(items), stages, "vec_id", DIGITS)


QUERIES = {
    "distance_l2": _distance("l2"),
    "distance_l1": _distance("l1"),
    "distance_cosine": _distance("cosine"),
    "distance_tanimoto": _histogram_distance("tanimoto"),
    "distance_chi2": _histogram_distance("chi2"),
    "nearest_l2": _nearest("l2"),
    "nearest_l1": _nearest("l1"),
    "nearest_pruned_l2": _nearest_pruned("l2"),
    "nearest_pruned_cosine": _nearest_pruned("cosine"),
    "nearest_cosine": _nearest("cosine"),
    "sort_descending": sort_descending,
    "sort_limit": sort_limit,
    "filter_top": filter_top,
    "feature_long": feature_long,
    "feature_joined": feature_joined,
    "codebook_assign": codebook_assign,
    "codebook_hist": codebook_hist,
    "codebook_dense": codebook_dense,
    "hist_terms": hist_terms,
    "hist_strings": hist_strings,
    "hist_truncated": hist_truncated,
    "bovw_search": bovw_search,
    "bovw_batch": bovw_batch,
    "kmeans_fit": kmeans_fit,
    "kmeans_hist": kmeans_hist,
    "bovw_kmeans": bovw_kmeans,
    "feature_lists": feature_lists,
    "fusion": fused,
    "fusion_all": fused_all,
    "fusion_same": fused_same,
    "fusion_batch": fused_batch,
    "fusion_batch_exact": fused_batch_exact,
    "fusion_threshold": fused_threshold,
    "fusion_lists": fused_lists,
    "union_merge": union_merge,
    "cascade": cascade,
}

_ITEMS = "items AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_Q = f"q AS (SELECT v AS qv FROM items WHERE vec_id = {QUERY_ITEM})"


def _l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i])))"


def _one(value: str) -> str:
    return f"WITH {_ITEMS}, {_Q} SELECT vec_id, round({value}, {DIGITS}) AS distance FROM items, q"


def _all_pairs(value: str, k: int = 10) -> str:
    return f"""WITH {_ITEMS},
d AS (SELECT a.vec_id AS query_id, b.vec_id, round({value}, {DIGITS}) AS distance FROM items a, items b),
r AS (SELECT query_id, vec_id, distance,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT * FROM r WHERE rank <= {k}"""


_CODEBOOK = f"""{_ITEMS},
local AS (SELECT vec_id, label, CAST(p AS INTEGER) AS pos, v[p * {SLICE} + 1 : (p + 1) * {SLICE}] AS s
  FROM items, range({SLICE}) r(p)),
cells AS (SELECT label * {SLICE} + pos AS word, j, round(avg(s[j]), 6) AS m FROM local, range(1, {SLICE} + 1) d(j) GROUP BY ALL),
book AS (SELECT word, list(m ORDER BY j) AS c FROM cells GROUP BY word),
pairs AS (SELECT vec_id, pos, word, round(list_distance(s, c), {DIGITS}) AS distance FROM local, book),
assigned AS (SELECT vec_id, pos, word, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id, pos ORDER BY distance, word) AS n FROM pairs) WHERE n = 1),
hist AS (SELECT vec_id, word, count(*) AS n FROM assigned GROUP BY ALL)"""

_DENSE = f"""{_CODEBOOK},
dense AS (SELECT v.vec_id, CAST(w AS INTEGER) AS word, CAST(coalesce(n, 0) AS DOUBLE) AS n
  FROM (SELECT DISTINCT vec_id FROM hist) v CROSS JOIN range({WORDS}) r(w) LEFT JOIN hist h ON h.vec_id = v.vec_id AND h.word = w),
bins AS (SELECT vec_id, list(n ORDER BY word) AS v FROM dense GROUP BY vec_id),
q AS (SELECT v AS qv FROM bins WHERE vec_id = {QUERY_ITEM})"""

_TERMS = """, terms AS (SELECT 'v' || word AS term, vec_id, n AS tf FROM hist WHERE word >= 1)"""


def _term_search(where: str) -> str:
    return f"""WITH {_CODEBOOK}{_TERMS},
scores AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.tf * b.tf) AS BIGINT) AS score
  FROM terms a JOIN terms b USING (term) {where} GROUP BY ALL),
r AS (SELECT query_id, vec_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT * FROM r WHERE rank <= 10"""


_HALVES = f"""{_ITEMS}, halves AS (SELECT vec_id, 'front' AS kind, v[1:32] AS v FROM items
  UNION ALL SELECT vec_id, 'back', v[33:64] FROM items)"""


def _fused(weights: str, top_n: int, k: int, queries: str = f"WHERE a.vec_id = {QUERY_ITEM}", kinds: str = "") -> str:
    return f"""WITH {_HALVES},
d AS (SELECT a.vec_id AS query_id, a.kind, b.vec_id, round(list_distance(a.v, b.v), {DIGITS}) AS distance
  FROM halves a JOIN halves b USING (kind) {queries}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY distance, vec_id) AS n FROM d),
scores AS (SELECT query_id, vec_id, round(sum(({weights}) / (1 + distance)), {DIGITS}) AS score
  FROM near WHERE n <= {top_n} {kinds} GROUP BY ALL),
r AS (SELECT query_id, vec_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT * FROM r WHERE rank <= {k}"""


_WHOLE = 1 << 40

SQL = {
    "kmeans_fit": f"""SELECT CAST(sum(len(embedding) // {SLICE}) AS BIGINT) AS n, CAST(0 AS BIGINT) AS wrong,
CAST({CLUSTERS} AS BIGINT) AS words, CAST(0 AS BIGINT) AS off FROM embeddings""",
    "distance_l2": _one("list_distance(v, qv)"),
    "distance_l1": _one(_l1("v", "qv")),
    "distance_cosine": _one("1 - list_cosine_similarity(v, qv)"),
    "distance_chi2": f"""WITH {_DENSE} SELECT vec_id, round(list_sum(list_transform(range(1, {WORDS} + 1), lambda i:
  CASE WHEN v[i] + qv[i] <> 0 THEN (v[i] - qv[i]) * (v[i] - qv[i]) / (v[i] + qv[i]) ELSE 0 END)), {DIGITS}) AS distance
FROM bins, q""",
    "distance_tanimoto": f"""WITH {_DENSE} SELECT vec_id, round(1 - list_dot_product(v, qv) /
  (list_dot_product(v, v) + list_dot_product(qv, qv) - list_dot_product(v, qv)), {DIGITS}) AS distance FROM bins, q""",
    "nearest_l2": _all_pairs("list_distance(a.v, b.v)"),
    "nearest_l1": _all_pairs(_l1("a.v", "b.v")),
    "nearest_pruned_l2": f"SELECT * FROM ({_all_pairs('list_distance(a.v, b.v)')}) WHERE query_id % {ASKED} = 0",
    "nearest_pruned_cosine": f"SELECT * FROM ({_all_pairs('1 - list_cosine_similarity(a.v, b.v)')}) WHERE query_id % {ASKED} = 0",
    "nearest_cosine": _all_pairs("1 - list_cosine_similarity(a.v, b.v)"),
    "sort_descending": _one("list_distance(v, qv)"),
    "sort_limit": f"""SELECT vec_id, distance, CAST(row_number() OVER (ORDER BY distance DESC, vec_id) AS INTEGER) AS rank
FROM ({_one("list_distance(v, qv)")}) ORDER BY rank LIMIT 100""",
    "filter_top": f"""SELECT vec_id, label FROM embeddings WHERE vec_id IN (
SELECT vec_id FROM ({_one("list_distance(v, qv)")}) ORDER BY distance, vec_id LIMIT 100)""",
    "feature_long": f"""WITH {_ITEMS} SELECT vec_id, CAST(d // {SLICE} AS INTEGER) AS pos, CAST(d % {SLICE} AS INTEGER) AS dim,
v[d + 1] AS value FROM items, range(64) r(d)""",
    "feature_joined": f"WITH {_ITEMS} SELECT vec_id, CAST(d AS INTEGER) AS dim, v[d + 1] AS value FROM items, range(64) r(d)",
    "codebook_assign": f"WITH {_CODEBOOK} SELECT * FROM assigned",
    "codebook_hist": f"WITH {_CODEBOOK} SELECT * FROM hist",
    "codebook_dense": f"WITH {_DENSE} SELECT * FROM dense",
    "hist_terms": f"WITH {_CODEBOOK}{_TERMS} SELECT term, vec_id, tf FROM terms",
    "hist_strings": f"""WITH {_DENSE} SELECT vec_id,
coalesce(string_agg(CASE WHEN word >= 1 AND n >= 1 THEN rtrim(repeat('v' || word || ' ', CAST(n AS BIGINT))) END, ' '
  ORDER BY word), '') AS words FROM dense GROUP BY vec_id""",
    "hist_truncated": f"""WITH {_ITEMS} SELECT vec_id, CAST(d AS INTEGER) AS word,
CAST(floor(abs(v[d + 1]) * 10) AS BIGINT) AS n FROM items, range(64) r(d) WHERE floor(abs(v[d + 1]) * 10) >= 1""",
    "bovw_search": _term_search(f"WHERE a.vec_id = {QUERY_ITEM}"),
    "bovw_batch": _term_search(""),
    "feature_lists": f"""WITH {_HALVES} SELECT vec_id, kind, CAST(d AS INTEGER) AS pos, v[d + 1] AS value
FROM halves, range(32) r(d)""",
    "fusion": _fused("0.5", 100, 10),
    "fusion_all": _fused("CASE kind WHEN 'front' THEN 0.7 ELSE 0.3 END", _WHOLE, 20),
    "fusion_same": _fused("1.0", _WHOLE, 10, kinds="AND kind = 'front'"),
    "fusion_batch": _fused("0.5", 50, 10, queries=""),
    "fusion_batch_exact": _fused("0.5", _WHOLE, 10, queries=""),
    "fusion_threshold": _fused("0.5", _WHOLE, 10, queries=f"WHERE a.vec_id % {ASKED} = 0"),
    "fusion_lists": _fused("CASE kind WHEN 'front' THEN 0.6 ELSE 0.4 END", 100, _WHOLE).replace(
        "SELECT * FROM r", "SELECT query_id, vec_id, score FROM r"),
    "union_merge": f"""WITH {_ITEMS}, {_Q},
d AS (SELECT vec_id, part, round(list_distance(v[part : part + 31], qv[part : part + 31]), {DIGITS}) AS distance
  FROM items, q, (VALUES (1), (33)) p(part)),
best AS (SELECT vec_id, distance, part FROM (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY distance, vec_id) AS n FROM d) WHERE n <= 10)
SELECT vec_id, distance, part, CAST(row_number() OVER (ORDER BY distance, vec_id, part) AS INTEGER) AS rank FROM best
ORDER BY rank LIMIT 10""",
    "cascade": f"""WITH {_ITEMS}, {_Q},
a AS (SELECT vec_id, v FROM items, q ORDER BY round(list_distance(v[1:16], qv[1:16]), {DIGITS}), vec_id LIMIT 200),
b AS (SELECT vec_id, v FROM a, q ORDER BY round({_l1("v[17:32]", "qv[17:32]")}, {DIGITS}), vec_id LIMIT 50),
c AS (SELECT vec_id, round(1 - list_cosine_similarity(v, qv), {DIGITS}) AS distance FROM b, q)
SELECT vec_id, distance, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank FROM c ORDER BY rank LIMIT 10""",
}
