import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import documents, empty, plain
from trailmetrics.llm import spelling_variants as sv

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100))


def edits(word):
    halves = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in halves if b} | {a + c + b for a, b in halves for c in ALPHABET}
    return (found | {a + c + b[1:] for a, b in halves if b for c in ALPHABET}) - {word}


def brute(texts, every=199, least_length=6, least_count=5, ratio=5):
    counts = Counter()
    for doc_id, text in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [o for o in edits(w) if o in words] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return rows


def result(frame, **given):
    rows = [tuple(r) for r in sv.spelling_variants(frame, **given).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(seed=5, n=300):
    rng = np.random.default_rng(seed)
    stems = ["colour", "Éclair×", "straße", "aaaaaaaa", "banana", "lettres", "ÀÖ÷øþÿ", "zebras"]
    found = []
    for i in range(n):
        words = []
        for _ in range(40):
            word = stems[min(int(rng.exponential(2.0)), 7)]
            for _ in range(rng.integers(0, 3)):
                word = sorted(edits(word.lower()))[rng.integers(0, 40) * 13] if rng.random() < 0.2 else word
            words.append(word)
        found.append((i, " ".join(words) + " short café, İstanbul ﬁligree Kelvin_x"))
    return found


def test_brute_force_with_chains(spark, monkeypatch):
    given = texts()
    frame = spark.createDataFrame(given, "doc_id bigint, text string").repartition(4)
    want = brute(given, every=7, least_count=3, ratio=2)
    assert sum(r[1] is not None and r[1] != r[2] for r in want) > 0  # forms of forms
    assert result(frame, every=7, least_count=3, ratio=2) == want
    assert result(frame, every=7, least_count=3, ratio=2, filter_blocks=3) == want  # several passes
    monkeypatch.setattr(sv, "CHUNK_WORDS", 3)
    monkeypatch.setattr(sv, "PROBES", 1 << 10)
    assert result(frame) == brute(given)


def test_awkward_rows(spark):
    frame = documents(spark)
    assert result(frame) == brute(plain(frame))
    assert result(frame, least_count=1) == brute(plain(frame), least_count=1)


def test_very_long_words(spark):
    long = "ab" * 2_000
    given = [(1, f"{long} {long}x {long[:-1]}c {long[:-2]}"), (2, f"{long} {long}")]
    frame = spark.createDataFrame(given, "doc_id bigint, text string")
    rows = {r["word"]: r for r in sv.spelling_variants(frame, every=10**9, least_count=1, ratio=2).collect()}
    assert {len(w): r["n_near"] for w, r in rows.items() if w.endswith("ab") or w.endswith("x")} == {4_000: 2, 4_001: 1, 3_998: 0}
    assert rows[long + "x"]["form"] == long and rows[long]["form"] is None


@pytest.mark.parametrize("word", ["banana", "aab", "zz", "ÿàab"])
def test_edit_codes(word):
    letters = sv.letters_of([word.encode("latin-1")], len(word))
    codes = sv.word_codes(letters)
    code = lambda w: int(sv.word_codes(sv.letters_of([w.encode("latin-1")], len(w)))[0])
    gone = [int(c) for _, found in sv.deletions(letters, codes) for c in found]
    assert sorted(gone) == sorted({code(word[:i] + word[i + 1 :]) for i in range(len(word))})
    new = {int(c) for _, found in sv.replacements(letters, codes) for c in found}
    assert new == {code(word[:i] + c + word[i + 1 :]) for i in range(len(word)) for c in ALPHABET if c > word[i]}


def test_false_positives_are_few():
    shard = sv.Shard(20_000)
    codes = sv.mixed(np.arange(60_000, dtype=np.uint64))
    hashes = sv.mixed(codes[:20_000])
    np.bitwise_or.at(shard.blocks, sv.block_of(hashes, len(shard.blocks)), sv.bits_of(hashes))
    assert shard.holds(codes[:20_000]).all() and shard.holds(codes[20_000:]).mean() < 0.005


def test_empty_table(spark):
    assert sv.spelling_variants(empty(spark)).collect() == []
