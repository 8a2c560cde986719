"""Registered queries of the operators in this folder, with the SQL they must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigo.llm import bpe, chat, exact_dedup, licences, line_dedup, mixing, passages, prefix_trie, quality, repair, simhash, token_counts, vectors
from vestigo.sources.tables import written

WORDS_FILE, PIECES_FILE = "word_bpe_49k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark, folder):
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_quality(spark, folder):
    docs = table(spark, folder, "documents")
    weights = quality.train(quality.training_rows(docs, table(spark, folder, "labels")))
    return quality.score(docs, weights).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def op3_line_dedup(spark, folder):
    return line_dedup.line_classes(table(spark, folder, "documents"))


def op4_vectors(spark, folder):
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op5_exact_dedup(spark, folder):
    """Every other document is taken as the snapshot, the rest as the new batch."""
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"), F.col("doc_id") % 2 == 0)
    return found.withColumnRenamed("digest", "text_sha256")


def op6_mixing(spark, folder):
    found = mixing.mix(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def encoded_digests(docs: DataFrame) -> DataFrame:
    return bpe.encode_and_decode(docs, vocabulary(WORDS_FILE)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe(spark, folder):
    return encoded_digests(table(spark, folder, "documents"))


def op8_passages(spark, folder):
    return passages.repeated_spans(table(spark, folder, "documents")).drop("row")


def op9_token_counts(spark, folder):
    counts = token_counts.prefix_counts(table(spark, folder, "documents"), vocabulary(PIECES_FILE))
    return counts.select("doc_id", "n_bytes", token_counts.total_tokens().alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_licences(spark, folder):
    return licences.licence_scan(table(spark, folder, "documents"), licences.known_digests(spark))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, k, code): each conversation's turns after the first h are its own, those before are of the conversation whose
    id is the last multiple of five; h is a checksum of the id. One more row without a code stands for each conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                      prefix_trie.turn_code(role, text).alias("code"))
    k = F.expr("cast(row_number() over (partition by conv_id order by turn nulls first, code) - 1 as long)").alias("k")
    placed = rows.select("conv_id", k, "code")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    lender = F.col("conv_id") - F.col("conv_id") % 5
    members = rows.select("conv_id").distinct()
    lent = placed.filter((F.col("conv_id") == lender) & (F.col("k") < 8)).select(F.col("conv_id").alias("from"), "k", "code")
    borrowed = members.filter(F.col("conv_id") != lender).withColumns({"from": lender, "h": taken}).join(lent, "from").filter("k < h")
    own = placed.filter((F.col("conv_id") == lender) | (F.col("k") >= taken))
    none = members.select("conv_id", F.lit(-1).cast("long").alias("k"), F.lit(None).cast("binary").alias("code"))
    return own.unionByName(borrowed.select("conv_id", "k", "code")).unionByName(none)


def op11_prefix_trie(spark, folder):
    found = prefix_trie.prefix_nodes(rebuilt(table(spark, folder, "conversations")))
    return found.withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, cut short, repeated or given to the user, by a checksum of their place."""
    space = F.lit(" ")
    id, turn, role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text"))
    harm = F.crc32(F.concat(id, F.lit(":"), turn).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), harm.alias("harm")).filter("harm <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_repair(spark, folder):
    turns = table(spark, folder, "conversations")
    rows = repair.turn_rows(damaged(turns))
    found = written(repair.repairs(rows), "repairs")
    same = lambda other: F.col("conv_id").eqNullSafe(other["id"])
    named = found.withColumnRenamed("conv_id", "id")
    digest = repair.digests(repair.repaired(rows, found)).withColumnRenamed("conv_id", "id")
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = whole.join(named, same(named), "left").drop("id")
    whole = whole.join(digest, same(digest), "left").drop("id")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_chat(spark, folder):
    """All conversations and one more, number -1, whose texts hold the template's own control strings."""
    own = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select(*more.columns)
    found = chat.read_back(chat.format_paths(chat.replies_of(rows.unionByName(more), "conv_id", "turn")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join("masked", "")
    return found.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"),
                        F.sha2(masked, 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


def pipeline(spark, folder):
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_line_dedup, op4_vectors, op5_exact_dedup, op6_mixing, op7_bpe,
                                   op8_passages, op9_token_counts, op10_licences, op11_prefix_trie, op12_repair, op13_chat, pipeline)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit from the lowest bit of each byte; 3988292384 is its reversed polynomial."""
    bits = (f"flatten(list_transform(range(1, length({value}) + 1), lambda i: list_transform(range(0, 8), "
            f"lambda j: (ascii(substr({value}, i, 1)) >> j) & 1)))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), "
            "4294967295)")


#: Repair costs before a row, in SQL: state by state (letter kept there, state it leads to, role wanted there); the letters
#: of a row are those of ``repair.signatures``. Candidates are (cost, audit) pairs, of which the least is the answer.
def _before(state: int) -> str:
    extra = f"CASE WHEN letter IN ('S', 'U', 'A', 'O') THEN {repair.CUT_SHORT} ELSE 0 END"
    wanted = repair.STEPS[state][repair.WANTED[state]]
    found = [f"{{'c': b{state}.c + {repair.DELETE}, 'a': 'D' || b{state}.a}}",
             f"CASE WHEN letter <> 'x' THEN {{'c': b{wanted}.c + {repair.REROLE} + {extra}, 'a': 'R' || b{wanted}.a}} END"]
    found += [f"CASE WHEN lower(letter) = '{k}' THEN {{'c': b{to}.c + {extra}, 'a': 'K' || b{to}.a}} END" for k, to in repair.STEPS[state].items()]
    return f"list_min(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)) AS p{state}"


def _inserted(state: int) -> str:
    one = repair.STEPS[state][repair.WANTED[state]]
    two = repair.STEPS[one][repair.WANTED[one]]
    return (f"list_min([p{state}, {{'c': p{one}.c + {repair.INSERT}, 'a': 'I' || p{one}.a}}, "
            f"{{'c': p{two}.c + {2 * repair.INSERT}, 'a': 'II' || p{two}.a}}]) AS b{state}")


SQL = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id::VARCHAR AS id FROM conversations
           WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS k FROM t),
c AS (SELECT conv_id, {crc32_sql('id')} % 9 AS h FROM (SELECT DISTINCT conv_id, id FROM t)),
r AS (SELECT c.conv_id, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND k < h
      UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND k >= h),
p AS (SELECT conv_id, row_number() OVER whole AS depth, md5(string_agg(md5(role) || md5(text), '') OVER whole) AS node, strlen(text) AS size
      FROM r WINDOW whole AS (PARTITION BY conv_id ORDER BY k)),
m AS (SELECT conv_id, depth, node, size, max(depth) OVER (PARTITION BY conv_id) AS length FROM p
      UNION ALL SELECT conv_id, 0, '', 0, coalesce(n, 0) FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM p GROUP BY conv_id) USING (conv_id)),
n AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(size) AS size, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends FROM m GROUP BY node),
e AS (SELECT n.*, above.node AS above FROM n LEFT JOIN m above ON above.conv_id = n.conv_id AND above.depth = n.depth - 1),
f AS (SELECT above, count(*) AS fan FROM e GROUP BY above),
s AS (SELECT up.node, count(*) FILTER (f.fan IS NULL) AS n_leaves, sum((e.n_convs - 1) * e.size)::BIGINT AS saved
      FROM e JOIN m up ON up.conv_id = e.conv_id AND up.depth <= e.depth LEFT JOIN f ON f.above = e.node GROUP BY up.node)
SELECT e.conv_id, e.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, e.n_convs, coalesce(fan, 0) AS n_children, n_leaves,
       saved AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN s USING (node) LEFT JOIN n parent ON parent.node = e.above LEFT JOIN f ON f.above = e.node""",
    "op12_repair": f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
h AS (SELECT *, {crc32_sql('place')} % 20 AS harm FROM t),
d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
             CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, range(2) AS copies(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k,
             regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS final FROM d),
s AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
             CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
                  WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
l AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN initial NOT IN ('s', 'u', 'a') THEN CASE fault WHEN 't' THEN 'O' ELSE 'o' END
                WHEN fault = 't' THEN upper(initial) ELSE initial END AS letter FROM s),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id),
f AS (SELECT conv_id, n + 1 AS k, {', '.join(f"{{'c': {c}, 'a': '{a}'}} AS b{i}" for i, (c, a) in enumerate(repair.END))} FROM g
      UNION ALL
      SELECT conv_id, k, {', '.join(map(_inserted, range(4)))} FROM (
          SELECT f.conv_id, l.k, {', '.join(map(_before, range(4)))} FROM f JOIN l ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.k = f.k - 1)),
best AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM f WHERE k = 1),
x AS (SELECT conv_id, i, audit[i] AS edit, length(replace(left(audit, i), 'I', '')) AS k FROM (
          SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)),
y AS (SELECT x.*, l.role, l.text, row_number() OVER (PARTITION BY x.conv_id ORDER BY i) AS j,
             first_value(edit = 'K' AND l.initial = 's') OVER (PARTITION BY x.conv_id ORDER BY i) AS system
      FROM x LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM x.conv_id AND l.k = x.k AND x.edit <> 'I' WHERE edit <> 'D'),
z AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - system::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                        || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS digest FROM y GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op4_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
         AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id a, b.vec_id b FROM good a JOIN good b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.vec_id
          WHERE reach.root < links.b),
least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT l.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, l.vec_id = component_id AS kept
FROM least l LEFT JOIN counts USING (vec_id)""",
    "op5_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), {ALPHABET}) AS body FROM documents) WINDOW same AS (PARTITION BY body)""",
    "op6_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER before, 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(weight * (SELECT min_by(level, most / weight) FROM c WHERE level * weight < most), most) AS target FROM c)
SELECT doc_id, size, source_size, target,
       (size * (floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)
        + CASE WHEN ('0x' || left(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE
               < CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "op8_passages": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
o AS (SELECT doc_id, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS base,
             regexp_extract_all(line, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+') AS chunks FROM l),
w AS (SELECT doc_id, k, base, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS i FROM o),
p AS (SELECT doc_id, k, i, regexp_replace(chunk, '^[\\x20\\x09-\\x0D]+', '') AS raw,
             base + sum(length(chunk)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM w),
q AS (SELECT *, translate(raw, {ALPHABET}) AS word, coalesce(sum((right(raw, 1) IN ('.', '!', '?'))::INTEGER) OVER (
             PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k, sentence) > {passages.LONG_WORDS} AND left(md5(word), 1) = '0' AS ends FROM q),
d AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id, k, sentence ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM c),
g AS (SELECT doc_id, min(stop - length(raw))::BIGINT AS begin, max(stop)::BIGINT AS stop, count(*) AS n,
             md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM d GROUP BY doc_id, k, sentence, part HAVING count(*) >= {passages.UNIT_WORDS}),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY begin) AS unit FROM g),
f AS (SELECT *, min((doc_id, unit)) OVER (PARTITION BY digest) AS first FROM u),
r AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM f WHERE (doc_id, unit) > first)
SELECT doc_id, min(begin) AS begin, max(stop) AS stop, count(*) AS n_units, sum(n)::BIGINT AS n_words, min_by(first[1], unit) AS first_doc_id
FROM r GROUP BY doc_id, run HAVING sum(n) >= {passages.LEAST_WORDS}""",
    "op10_licences": f"""
WITH known AS (SELECT md5({licences.canonical_sql('body')}) AS digest, min(licence) AS licence, min_by(commercial, licence) AS commercial
               FROM (VALUES {', '.join(f'({_text(n)}, {str(c).lower()}, {_text(t)})' for n, c, t in licences.KNOWN)}) AS v(licence, commercial, body)
               GROUP BY 1),
u AS (SELECT doc_id, unnest(list_prepend(text, string_split(text, chr(10)))) AS body,
             generate_subscripts(list_prepend(text, string_split(text, chr(10))), 1) - 1 AS unit FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unit::BIGINT AS unit, licence, commercial FROM u JOIN known ON md5({licences.canonical_sql('u.body')}) = digest
WHERE digest <> md5('')""",
    "op13_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS line FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(line) + len(regexp_extract_all(line, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
