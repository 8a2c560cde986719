"""Queries on texts: term tables, term search, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.functions.text import WORD_BREAKS, base_name, flat_key, page_text, page_title
from vestigo.operators import refresh, search, terms
from vestigo.operators.features import pipeline
from vestigo.operators.ranking import ids, keep, scored
from vestigo.plans.tables import documents, table
from vestigo.sources import bounds, segments, tables
from vestigo.sources.readers import TEXT, load, queries_from, read_descriptions

# English function words, a fixed list.
STOP_WORDS = (
    "a", "about", "all", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he",
    "her", "his", "if", "in", "is", "it", "its", "no", "not", "of", "on", "or", "our", "she", "so", "that", "the",
    "their", "them", "they", "this", "to", "was", "we", "were", "which", "will", "with", "you", "your",
)

QUERY_DOC = 1
K = 10
DEEP = 2000
SEGMENT = 256
BLOCK_DOCS = 64
BUCKETS = 16

TOKENS = """tok AS (
  SELECT doc_id, term FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents) WHERE term <> ''
)"""
POSTINGS = TOKENS + """, postings AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id)"""


def _docs(spark, folder):
    return documents(spark, folder).select("doc_id", "text")


def _one_query(spark, folder):
    return queries_from(table(spark, folder, "documents").select("doc_id", "text"), [QUERY_DOC], "doc_id")


def tokens_tf(spark, folder):
    return terms.term_frequencies(_docs(spark, folder))


def doc_freq(spark, folder):
    return terms.document_frequencies(terms.term_frequencies(_docs(spark, folder)))


def posting_lists(spark, folder):
    lists = terms.posting_segments(terms.counted_terms(_docs(spark, folder)), SEGMENT)
    entries = F.transform("postings", lambda p: F.concat(p["doc_id"].cast("string"), F.lit(":"), p["tf"].cast("string")))
    return lists.select("term", "segment", F.array_join(entries, ",").alias("entries"))


def collection_size(spark, folder):
    return terms.collection_size(_docs(spark, folder))


def _index(spark, folder):
    return tables.save_index(_docs(spark, folder), tables.fresh_path(spark, "index"), buckets=BUCKETS)


def index_docs(spark, folder):
    docs = _index(spark, folder).docs
    return docs.select("doc_id", "length", F.round("norm", 6).alias("norm"))


def index_terms(spark, folder):
    docs = _docs(spark, folder)
    weights = terms.term_weights(terms.term_frequencies(docs), docs)
    return weights.select("term", "df", F.round("idf", 6).alias("idf"))


def search_count(spark, folder):
    return search.search_texts(_docs(spark, folder), _one_query(spark, folder), K)


def search_postings(spark, folder):
    postings = terms.term_frequencies(_docs(spark, folder))
    return search.search_postings(postings, search.query_terms(_one_query(spark, folder)), K)


def search_batch(spark, folder):
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search_batch(_docs(spark, folder), queries, K)


def search_turns(spark, folder):
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    return search.search_batch(_docs(spark, folder), turns, K)


def search_index(spark, folder):
    index = _index(spark, folder)
    query = search.query_terms(_one_query(spark, folder))
    return search.search_postings(tables.only_terms(index, query).postings, query, K)


def search_tfidf(spark, folder):
    index = _index(spark, folder)
    query = search.query_terms(_one_query(spark, folder))
    return search.search_weighted(tables.only_terms(index, query), query, K, digits=6)


def _bounds(spark, folder):
    index, path = _index(spark, folder), tables.fresh_path(spark, "bounds")
    bounds.save_bounds(index, path, BLOCK_DOCS)
    return bounds.load_bounds(spark, path, index)


def search_bounded(spark, folder):
    return search.search_bounded(_bounds(spark, folder), search.query_terms(_one_query(spark, folder)), K)


def search_bounded_tfidf(spark, folder):
    query = search.query_terms(_one_query(spark, folder))
    return search.search_bounded(_bounds(spark, folder), query, K, weighted=True, digits=6)


def _three_queries(spark, folder):
    return queries_from(_docs(spark, folder), [QUERY_DOC, QUERY_DOC + 1, QUERY_DOC + 2], "doc_id")


def search_deep_batch(spark, folder):
    """More hits than Spark's own limit on windows, for several queries."""
    return search.search_texts(_docs(spark, folder), _three_queries(spark, folder), DEEP)


def search_stopwords(spark, folder):
    return search.search_texts(_docs(spark, folder), _one_query(spark, folder), K, pattern=WORD_BREAKS,
                               stop_words=STOP_WORDS)


def stop_word_table(spark, folder):
    words = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    return terms.drop_stop_words(terms.term_frequencies(_docs(spark, folder)), words).select("term", "doc_id", "tf")


def index_refresh(spark, folder):
    docs = _docs(spark, folder)
    stored_docs = _earlier(spark, folder)
    return refresh.refresh_postings(terms.term_frequencies(stored_docs), refresh.content_hashes(stored_docs), docs)


def _earlier(spark, folder):
    """An earlier state of the collection: toxic documents not there yet, German ones longer, some that vanished."""
    docs = documents(spark, folder)
    new = table(spark, folder, "labels").filter("toxic = 1")
    text = F.when(F.col("lang") == "de", F.concat_ws(" ", "text", "source")).otherwise(F.col("text"))
    vanished = table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    return docs.join(new, "doc_id", "left_anti").select("doc_id", text.alias("text")).unionByName(vanished)


def refresh_saved(spark, folder):
    index = _segments(spark, folder)[0]
    return index.docs.select("doc_id", "length", F.round("norm", 6).alias("norm"))


def _segments(spark, folder):
    """An index of the collection's earlier state, brought up to date by one segment; and its folder."""
    path = tables.fresh_path(spark, "segments")
    segments.create(_earlier(spark, folder), path, buckets=BUCKETS)
    return segments.refresh(_docs(spark, folder), path), path


def refresh_search(spark, folder):
    """Search of an index in two segments."""
    query = search.query_terms(_one_query(spark, folder))
    return search.search_postings(tables.only_terms(_segments(spark, folder)[0], query).postings, query, K)


def refresh_merged(spark, folder):
    """Term weights after the segments were merged into one."""
    index = segments.compact(spark, _segments(spark, folder)[1], 0)
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def refresh_changes(spark, folder):
    stored = refresh.content_hashes(_earlier(spark, folder))
    docs = _docs(spark, folder)
    changed = refresh.changed_docs(docs, stored).select("doc_id", F.lit("index").alias("action"))
    return changed.unionByName(refresh.gone_docs(docs, stored).select("doc_id", F.lit("drop").alias("action")))


def filter_predicate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return keep(docs, (F.col("lang") != "en") & (F.col("n_chars") > 1000))


def query_source(spark, folder):
    return _one_query(spark, folder)


def page_texts(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", page_title("html").alias("title"), page_text("html").alias("body"))


def url_basename(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", base_name("url").alias("name"), flat_key("url").alias("key"))


def search_count_deep(spark, folder):
    return search.search_texts(_docs(spark, folder), _one_query(spark, folder), DEEP)


def posting_lists_named(spark, folder):
    """Posting lists of string ids."""
    docs = table(spark, folder, "documents").select(F.concat_ws("/", "source", "doc_id").alias("name"), "text")
    lists = terms.posting_segments(terms.counted_terms(docs, "name"), SEGMENT, "name")
    entries = F.transform("postings", lambda p: F.concat(p["name"], F.lit(":"), p["tf"].cast("string")))
    return lists.select("term", "segment", F.array_join(entries, ",").alias("entries"))


def ranked_ids(spark, folder):
    return ids(search_count(spark, folder), "doc_id")


def composed(spark, folder):
    """Two projections as one, on a collection."""
    step = pipeline(lambda df: df.withColumn("name", base_name("url")), lambda df: df.withColumn("size", F.length("name").cast("bigint")))
    return step(table(spark, folder, "pages")).select("page_id", "name", "size")


def catalog_counts(spark, folder):
    """Items by category of a description catalog in its file format, read back by the catalog reader."""
    path = tables.fresh_path(spark, "catalog")
    table(spark, folder, "documents").select(F.col("doc_id").cast("string"), "lang", "source").write.option("sep", "\t").csv(path)
    return read_descriptions(spark, path).groupBy("category").agg(F.count("doc_id").alias("n"))


def xml_documents(spark, folder):
    """The collection written as XML documents with one image each, read back by the document reader."""
    path = tables.fresh_path(spark, "xml")
    image = F.struct(F.col("lang").alias("_VALUE"), F.concat(F.lit("i"), "doc_id").alias("_id"), F.col("source").alias("_name"),
                     F.lit("1").alias("_sectnum"))
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("_name"), (F.col("n_chars") % 10).cast("int").alias("_cat"), "text",
        F.struct(F.array(image).alias("image")).alias("imageset"))
    rows.write.format("xml").option("rowTag", "document").option("rootTag", "documents").save(path)
    read = load(spark, path, TEXT)
    words = F.trim(F.regexp_replace("text", r"\s+", " "))
    return read.select("doc_id", "name", "cat", F.md5(words).alias("words"), F.get("images", F.lit(0))["id"].alias("image"),
                       F.get("images", F.lit(0))["path"].alias("image_path"))


def filter_scored(spark, folder):
    """Mean word length of texts, without the texts that have no word; German ones get no score."""
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    score = F.when(F.col("lang") != "de", F.when(words > 0, F.length("text") / words).otherwise(F.lit(float("nan"))))
    return scored(table(spark, folder, "documents").select("doc_id", score.alias("score"))).select("doc_id", F.round("score", 6).alias("score"))


def signatures(spark, folder):
    """Signatures of tables: the same for other orders and files of the rows, another when a row is missing."""
    rows = []
    for name in ("documents", "pages", "labels"):
        whole = table(spark, folder, name)
        print_ = tables.fingerprint(whole)
        first = whole.columns[0]
        rows.append((name, tables.fingerprint(whole.repartition(7, F.rand(3)).select(*reversed(whole.columns))) == print_,
                     tables.fingerprint(whole.filter(F.col(first) != whole.agg(F.max(first)).first()[0])) != print_))
    return spark.createDataFrame(rows, "name string, same boolean, differs boolean")


def label_counts(spark, folder):
    labels = table(spark, folder, "labels")
    return labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "search_count_deep": search_count_deep,
    "posting_lists_named": posting_lists_named,
    "ranked_ids": ranked_ids,
    "composed": composed,
    "catalog_counts": catalog_counts,
    "xml_documents": xml_documents,
    "filter_scored": filter_scored,
    "signatures": signatures,
    "tokens_tf": tokens_tf,
    "doc_freq": doc_freq,
    "posting_lists": posting_lists,
    "collection_size": collection_size,
    "index_docs": index_docs,
    "index_terms": index_terms,
    "search_count": search_count,
    "search_postings": search_postings,
    "search_batch": search_batch,
    "search_turns": search_turns,
    "search_index": search_index,
    "search_tfidf": search_tfidf,
    "search_bounded": search_bounded,
    "search_bounded_tfidf": search_bounded_tfidf,
    "search_deep_batch": search_deep_batch,
    "search_stopwords": search_stopwords,
    "stop_word_table": stop_word_table,
    "index_refresh": index_refresh,
    "refresh_saved": refresh_saved,
    "refresh_search": refresh_search,
    "refresh_merged": refresh_merged,
    "refresh_changes": refresh_changes,
    "filter_predicate": filter_predicate,
    "query_source": query_source,
    "page_text": page_texts,
    "url_basename": url_basename,
    "label_counts": label_counts,
}


def _ranked(order: str, partition: str = "PARTITION BY query_id ") -> str:
    return f"row_number() OVER ({partition}ORDER BY {order})"


_COUNT_SEARCH = f"""WITH {POSTINGS},
q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM postings WHERE doc_id = {QUERY_DOC}),
scores AS (SELECT query_id, p.doc_id, CAST(sum(qtf * tf) AS BIGINT) AS score FROM postings p JOIN q USING (term) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, CAST({_ranked('score DESC, doc_id')} AS INTEGER) AS rank FROM scores)
SELECT * FROM ranked WHERE rank <= {K}"""


def _batch_search(source: str) -> str:
    return f"""WITH {POSTINGS},
q AS (SELECT query_id, term, count(*) AS qtf FROM (
  SELECT query_id, unnest(string_split(lower(text), ' ')) AS term FROM ({source})) WHERE term <> '' GROUP BY ALL),
scores AS (SELECT query_id, p.doc_id, CAST(sum(qtf * tf) AS BIGINT) AS score FROM postings p JOIN q USING (term) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, CAST({_ranked('score DESC, doc_id')} AS INTEGER) AS rank FROM scores)
SELECT * FROM ranked WHERE rank <= {K}"""


_IDF = """, n AS (SELECT count(*) AS n FROM documents),
terms AS (SELECT term, count(*) AS df, ln(any_value(n) / CAST(count(*) AS DOUBLE)) AS idf FROM postings, n GROUP BY term),
norms AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS length, sqrt(sum(tf * idf * idf)) AS norm
  FROM postings JOIN terms USING (term) GROUP BY doc_id)"""

_INDEX_DOCS = f"""WITH {POSTINGS}{_IDF}
SELECT doc_id, coalesce(length, 0) AS length, round(coalesce(norm, 0), 6) AS norm
FROM documents LEFT JOIN norms USING (doc_id)"""

_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)

_TFIDF_SEARCH = f"""WITH {POSTINGS}{_IDF},
q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM postings WHERE doc_id = {QUERY_DOC}),
scores AS (SELECT query_id, p.doc_id, sum(qtf * tf * idf * idf) AS raw
  FROM postings p JOIN q USING (term) JOIN terms USING (term) GROUP BY ALL),
normed AS (SELECT query_id, doc_id, round(raw / norm, 6) AS score FROM scores JOIN norms USING (doc_id) WHERE norm > 0),
ranked AS (SELECT query_id, doc_id, score, CAST({_ranked('score DESC, doc_id')} AS INTEGER) AS rank FROM normed)
SELECT * FROM ranked WHERE rank <= {K}"""

SQL = {
    "search_tfidf": _TFIDF_SEARCH,
    "search_bounded": _COUNT_SEARCH,
    "search_bounded_tfidf": _TFIDF_SEARCH,
    "search_deep_batch": _COUNT_SEARCH.replace(f"rank <= {K}", f"rank <= {DEEP}").replace(
        f"doc_id = {QUERY_DOC}", f"doc_id BETWEEN {QUERY_DOC} AND {QUERY_DOC + 2}"),
    "search_count_deep": _COUNT_SEARCH.replace(f"rank <= {K}", f"rank <= {DEEP}"),
    "posting_lists_named": f"""WITH named AS (SELECT source || '/' || doc_id AS doc_id, text FROM documents),
{POSTINGS.replace("FROM documents", "FROM named")}
SELECT term, CAST(('0x' || left(md5(doc_id), 8))::BIGINT % {SEGMENT} AS BIGINT) AS segment,
string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id DESC) AS entries FROM postings GROUP BY ALL""",
    "ranked_ids": f"SELECT doc_id FROM ({_COUNT_SEARCH})",
    "composed": r"""SELECT page_id, name, length(name) AS size FROM (SELECT page_id, regexp_replace(
  string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '\.[^.]*$', '') AS name FROM pages)""",
    "catalog_counts": "SELECT lang AS category, count(*) AS n FROM documents GROUP BY ALL",
    "tokens_tf": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM postings",
    "doc_freq": f"WITH {POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY term",
    "posting_lists": f"""WITH {POSTINGS} SELECT term, doc_id // {SEGMENT} AS segment,
string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id DESC) AS entries FROM postings GROUP BY ALL""",
    "xml_documents": r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS name, CAST(n_chars % 10 AS INTEGER) AS cat,
  md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS words, 'i' || doc_id AS image, lang AS image_path FROM documents""",
    "filter_scored": """SELECT doc_id, round(length(text) / len(list_filter(string_split(text, ' '), lambda w: w <> '')), 6) AS score
FROM documents WHERE lang <> 'de' AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) > 0""",
    "signatures": "SELECT name, true AS same, true AS differs FROM (VALUES ('documents'), ('pages'), ('labels')) v(name)",
    "collection_size": "SELECT count(doc_id) AS n_docs FROM documents",
    "index_docs": _INDEX_DOCS,
    "index_terms": f"WITH {POSTINGS}{_IDF} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "search_count": _COUNT_SEARCH,
    "search_postings": _COUNT_SEARCH,
    "search_index": _COUNT_SEARCH,
    "search_batch": _batch_search("SELECT item_id AS query_id, text FROM benchmark"),
    "search_turns": _batch_search("SELECT conv_id || '-' || turn AS query_id, text FROM conversations"),
    "search_stopwords": f"""WITH tok AS (SELECT doc_id, term FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{WORD_BREAKS}')) AS term FROM documents)
  WHERE term <> '' AND term NOT IN ({_WORDS})),
q AS (SELECT doc_id AS query_id, term, count(*) AS qtf FROM tok WHERE doc_id = {QUERY_DOC} GROUP BY ALL),
scores AS (SELECT query_id, t.doc_id, CAST(sum(qtf) AS BIGINT) AS score FROM tok t JOIN q USING (term) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, CAST({_ranked('score DESC, doc_id')} AS INTEGER) AS rank FROM scores)
SELECT * FROM ranked WHERE rank <= {K}""",
    "stop_word_table": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM postings WHERE term NOT IN ({_WORDS})",
    "index_refresh": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM postings",
    "refresh_saved": _INDEX_DOCS,
    "refresh_search": _COUNT_SEARCH,
    "refresh_merged": f"WITH {POSTINGS}{_IDF} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "refresh_changes": """SELECT doc_id, 'index' AS action FROM documents
WHERE lang = 'de' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL
SELECT doc_id, 'drop' FROM documents
WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT -1 - item_id, 'drop' FROM benchmark""",
    "filter_predicate": "SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'en' AND n_chars > 1000",
    "query_source": f"SELECT doc_id AS query_id, text FROM documents WHERE doc_id = {QUERY_DOC}",
    "page_text": r"""WITH bare AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<head.*?</head>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS body FROM pages),
plain AS (SELECT page_id,
  replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title,
  replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS body FROM bare)
SELECT page_id, title, trim(replace(body, chr(10), ' ')) AS body FROM plain""",
    "url_basename": r"""SELECT page_id, regexp_replace(
  string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '\.[^.]*$', '') AS name,
  replace(url, '/', '-') AS key FROM pages""",
    "label_counts": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
}
