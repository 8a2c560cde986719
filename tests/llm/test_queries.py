"""Registered queries of the training-data operators against their SQL, plain Python or the tokenizers' own libraries."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.check_queries import database, difference
from vestigo.llm import components, line_dedup, queries, quality, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", queries.SQL)
def test_query_agrees(spark, con, name):
    problem, rows, _ = difference(spark, con, FOLDER, name)
    assert problem is None
    assert rows > 0


def least_reachable(nodes, linked):
    """Smallest node reachable from each, by plain search over all pairs."""
    found = {}
    for node in sorted(nodes):
        if node in found:
            continue
        found[node], front = node, [node]
        while front:
            at = front.pop()
            for other in nodes:
                if other not in found and linked(at, other):
                    found[other] = node
                    front.append(other)
    return found


def plain_fingerprint(text):
    words = text.encode().lower().split()
    runs = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = least_reachable(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def brute_components(prints):
    """Least document reachable over all pairs of fingerprints that differ in four bits or fewer."""
    values, first = np.unique(np.array(list(prints.values()), np.uint64), return_inverse=True)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    least = np.full(len(values), 2 ** 62)
    np.minimum.at(least, first, np.array(list(prints), np.int64))
    while True:
        spread = np.array([least[row].min() for row in near])
        if (spread == least).all():
            return dict(zip(prints, least[first].tolist()))
        least = spread


def test_simhash_links_across_the_highest_bit(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = queries.op1_simhash(spark, folder).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(prints)


@pytest.mark.parametrize("bucket", [2048, 8])
def test_simhash_planted_bits(spark, bucket):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2 ** 64, 40, np.uint64, endpoint=False)
    flips = [sum(1 << int(b) for b in draw.choice(64, n, replace=False)) for n in draw.integers(0, 7, 240)]
    values = [1, 2 ** 63, 2 ** 63 + 1, 2 ** 64 - 1, 0] + [int(base[i % 40]) ^ f ^ ((i % 2) << 63) for i, f in enumerate(flips)]
    nodes = {v: k for k, v in reversed(list(enumerate(values)))}
    frame = spark.createDataFrame([(v - (v >> 63 << 64), k) for v, k in nodes.items()], "fp long, node long")
    found = dict(map(tuple, components.components(simhash.near_links(frame, 4, bucket), "a", "b").collect()))
    assert {k: found.get(k, k) for k in nodes.values()} == brute_components({k: v for v, k in nodes.items()})


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_lines(texts):
    places = defaultdict(list)
    for i, text in sorted(texts.items()):
        for k, line in enumerate(text.split("\n")):
            plain = " ".join(line.encode().lower().decode().split())
            if plain:
                places[plain].append((i, k))
    return places


def plain_firsts(places):
    by_length = defaultdict(list)
    for line in places:
        by_length[len(line)].append(line)

    def near(a, b):
        if min(len(a), len(b)) < line_dedup.LEAST_CHARS:
            return a == b
        return abs(len(a) - len(b)) <= 2 and (sum(x != y for x, y in zip(a, b)) <= 2 and len(a) == len(b) or
                                              a[:len(a) // 3] == b[:len(a) // 3] or a[-(len(a) // 3):] == b[-(len(a) // 3):]
                                              or a[10:15] in b) and edits(a, b) <= 2

    roots = least_reachable(list(places), near)
    first = {}
    for line, root in roots.items():
        first[root] = min(first.get(root, places[line][0]), places[line][0])
    return {p: first[roots[line]] for line, where in places.items() for p in where}


def test_line_dedup(spark, texts):
    few = {i: t for i, t in texts.items() if i < 60}
    want = plain_firsts(plain_lines(few))
    rows = line_dedup.line_classes(spark.createDataFrame([(i, t) for i, t in few.items()], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line"]): (r["first_doc_id"], r["first_line"]) for r in rows} == want
    assert all(r["kept"] == ((r["doc_id"], r["line"]) == (r["first_doc_id"], r["first_line"])) for r in rows)
    whole = queries.op3_line_dedup(spark, FOLDER).collect()
    assert len(whole) == sum(map(len, plain_lines(texts).values()))


def test_encoding(spark, texts):
    from tokenizers import Tokenizer
    reader = Tokenizer.from_file(queries.vocabulary(queries.WORDS_FILE))
    for r in queries.op7_bpe(spark, FOLDER).collect():
        ids = reader.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reader.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts(spark, texts):
    import sentencepiece
    reader = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECES_FILE))
    for r in queries.op9_token_counts(spark, FOLDER).collect():
        n = len(reader.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in queries.table(spark, folder, "labels").collect()}
    rows = queries.op2_quality(spark, folder).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 500
    good = np.array([truth[r["doc_id"]] for r in held], bool)
    said = np.array([r["predicted"] for r in held], bool)
    assert (said & good).sum() / good.sum() > 0.98
    assert (~said & ~good).sum() / (~good).sum() > 0.8


def test_pipeline(spark, con, texts, tmp_path):
    """The whole run: each stage against plain Python on what the stage before it kept."""
    docs = queries.table(spark, FOLDER, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "line_dedup", "near_dedup", "mixing", "encoding"]

    def step(name, before):
        stage[name](spark, before, FOLDER).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = step("quality", docs)
    weights = quality.train(quality.training_rows(docs, queries.table(spark, FOLDER, "labels")))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert kept == {i: t for i, t in texts.items() if scores[i] >= 0.3} and good.columns == docs.columns

    lines = step("line_dedup", good)
    cut = {(r["doc_id"], r["line"]) for r in line_dedup.line_classes(good).collect() if not r["kept"]}
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in cut) for i, t in kept.items()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == left and lines.columns == docs.columns and cut

    single = step("near_dedup", lines)
    prints = {i: plain_fingerprint(t) for i, t in left.items()}
    root = least_reachable(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r["doc_id"]: r["text"] for r in single.collect()} == {i: left[i] for i in left if root[i] == i}

    mixed = step("mixing", single)
    con.execute(f"CREATE OR REPLACE VIEW kept AS SELECT * FROM '{tmp_path}/near_dedup/*.parquet'")
    want = con.execute(queries.SQL["op6_mixing"].replace("FROM documents", "FROM kept")).fetchdf()
    took = mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert {r.doc_id: took.get(r.doc_id, 0) * r.size for r in want.itertuples(index=False)} == dict(zip(want.doc_id, want.taken))
    assert mixed.columns == docs.columns

    ids = step("encoding", mixed)
    assert ids.count() == mixed.count() == sum(took.values())
    assert ids.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
