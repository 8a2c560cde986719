import random
from collections import defaultdict

import numpy as np
import xxhash

from vestigo.llm import common, line_dedup
from vestigo.llm.line_dedup import _lines, _sieve, _sifted, line_keys, segments


def plain_keys(line, edits):
    """Substrings with their seeds, one by one: true for own segments."""
    found, n = {}, len(line)
    for length in range(max(edits + 1, n - edits), n + 1):
        for k, (start, size) in enumerate(segments(length, edits)):
            more = n - length
            for at in range(max(0, start - k, start + more - (edits - k)), min(n - size, start + k, start + more + edits - k) + 1):
                found.setdefault((length, k, line[at:at + size]), False)
    for k, (start, size) in enumerate(segments(n, edits)):
        found[n, k, line[start:start + size]] = True
    return found


def test_keys_meet_as_the_substrings_do():
    draw = random.Random(5)
    lines = ["".join(draw.choice("abé ß漢😀"[:draw.choice([2, 3, 8])]) for _ in range(draw.randint(3, 60))) for _ in range(700)]
    lines = [(len(line), line.encode()) for line in sorted(set(lines), key=len)] + [(700_000, b"ab" * 350_000)]
    got, want = defaultdict(set), defaultdict(set)
    for key, own, place in zip(*[c.tolist() for c in line_keys(lines, 2)]):
        got[key].add((place, own))
    for place, (_, line) in enumerate(lines):
        for key, own in plain_keys(line.decode(), 2).items():
            want[key].add((place, own))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_lines_are_normalised_whatever_their_blanks():
    texts = ["One two\nthree", "Ä  b\n \n\nc\td ", " lead\r\ntail \n", "", "\n", "a\x0bb\x0cc\nÉ x\x1cy", " ", "x\n y\nz \n漢 字"]
    for text in texts:
        want, at = [], 0
        for k, line in enumerate(text.split("\n")):
            plain = b" ".join(line.encode().lower().split())
            if plain:
                want.append((k, at, at + len(line), plain))
            at += len(line) + 1
        assert list(_lines(text.encode())) == want


def test_sieve_keeps_all_its_numbers_and_few_others(spark):
    draw = random.Random(7)
    numbers = [draw.getrandbits(63) for _ in range(500)]
    sieve = _sieve(spark.createDataFrame([(n,) for n in numbers], "line long"), 1 << 16)
    assert sieve.nbytes == 1 << 13
    others = [xxhash.xxh64_intdigest(str(n)) >> 1 for n in range(5000)]
    some = _sifted(sieve, np.array(numbers + others, np.uint64))
    assert set(range(500)) <= set(some.tolist()) and len(some) < 700
    assert not _sieve(spark.createDataFrame([], "line long"), 1 << 16).any()


def test_a_worker_forgets_the_words_of_other_operators():
    make = lambda word: len(word)
    words = common.Remembered(make, 100)
    assert [words[str(n)] for n in range(80)] and len(words) + len(words.older) >= 80
    list(common.frugal(lambda batches: batches, __name__)([]))
    assert len(words)
    list(common.frugal(lambda batches: batches, line_dedup.__name__)([]))
    assert not len(words) and not words.older and words["abc"] == 3
