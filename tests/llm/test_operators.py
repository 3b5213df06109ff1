import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.cases import DDL, documents, empty, plain
from trailmetrics.llm import (
    exact_dedup, language_id, license_scan, mixing, near_dedup, packing, queries, substring_dedup, url_filter, warc,
    winnowing,
)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.mark.parametrize("operator", [
    license_scan.scan, near_dedup.near_duplicates, language_id.language_ids, exact_dedup.exact_duplicates,
    exact_dedup.keepers, mixing.assignments, mixing.mixed_documents, substring_dedup.without_repeats,
    winnowing.edited_documents, winnowing.fingerprints,
])
def test_empty_table(spark, operator):
    assert operator(empty(spark)).collect() == []


# --- 1 ---------------------------------------------------------------------------


def test_license_scan(spark, docs):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert (by_id[1]["n_base"], by_id[1]["first_word"], by_id[1]["base_labels"], by_id[1]["score"]) == (1, 9, "mit", 1.0)
    assert (by_id[15]["n_base"], by_id[15]["labels"]) == (2, "mit")
    assert (by_id[4]["n_words"], by_id[4]["n_base"], by_id[4]["first_word"], by_id[4]["score"]) == (0, 0, None, 0.0)
    text = "so permission is hereby granted entirely free of charge to any person obtaining a copy of this " \
           "software and associated documentation files the software to deal in the software without restriction"
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert found["labels"] == "mit-text" and found["base_labels"] == "" and 0.9 < found["score"] < 1


def test_license_text_with_words_put_in(spark):
    header = ("This program is free software; you can redistribute it and/or modify it under the terms of {}the GNU General "
              "Public License as published by the Free Software Foundation.")
    texts = [(1, header.format("")), (2, header.format("version 2 of ")), (3, "intro " * 50 + header.format("version two of ")),
             (4, header.format("one two three four five six seven eight nine ten ")),
             (5, "this wor\u212a is licensed under a creative commons attribution"),
             (6, "under the terms of the shop you can modify it and redistribute the free software " * 40)]
    rows = license_scan.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[1] == labels[2] == labels[3] == "gpl,gpl-text" and labels[4] == "gpl" and labels[6] == ""
    assert {r["doc_id"]: (r["n_words"], r["score"]) for r in rows}[5] == (9, 0.75)  # the Kelvin sign is no k


# --- 2 ---------------------------------------------------------------------------


def linked(texts, width, percent):
    sets = [near_dedup.shingle_set(t.encode(), width) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                label[root(i)] = root(j)
    return sets, [root(i) for i in range(len(texts))]


def test_near_duplicates_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # many blocks
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 400, 120) for _ in range(6)]
    texts = []
    for i in range(150):
        words = base[i % 6].copy()
        words[rng.integers(0, 120, i // 30)] = rng.integers(400, 9999, i // 30)
        texts.append(" ".join(f"w{w}" for w in words))
    texts += ["", "one", "One", "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets, want = linked(texts, 3, 85)
    smallest = {}
    for i, r in enumerate(want):
        smallest[r] = min(smallest.get(r, i), i)
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame, 3, 85).collect()}
    for i, r in rows.items():
        assert r["n_shingles"] == len(sets[i])
        assert r["component_id"] == (i if not sets[i] else smallest[want[i]])
        assert r["kept"] == (r["component_id"] == i)


def test_near_duplicates_of_awkward_rows(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    found = {(r["doc_id"], r["n_shingles"]): r for r in rows}
    assert found[2, found_size(rows, 1)]["component_id"] == 1 and not found[2, found_size(rows, 1)]["kept"]
    assert found[4, 0]["kept"] and found[4, 0]["component_id"] == 4
    assert all(r["kept"] for r in rows if r["doc_id"] is None)


def test_near_texts_of_a_repeated_id(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{w}{i * 37 % 101}" for i in range(120)) for w in "ab")
    rows = [(5, a), (5, b), (2, a + " end"), (9, b + " end"), (5, a)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    found = near_dedup.labelled_rows(frame, 5, 80).select("doc_id", "component_id", "kept").collect()
    assert Counter(map(tuple, found)) == Counter([
        (5, 2, False), (5, 2, False), (5, 5, True), (2, 2, True), (9, 5, False)])
    kept = corpus_pipeline.near(spark, frame, "").collect()
    assert sorted(map(tuple, kept)) == [(2, a + " end"), (5, b)]


def found_size(rows, doc_id):
    return next(r["n_shingles"] for r in rows if r["doc_id"] == doc_id)


def test_match_threshold_misses_little():
    assert near_dedup.match_threshold(85) == 34 and near_dedup.match_threshold(80, 512) < 512 * 0.8


# --- 3 ---------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_ids(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found} == {True}
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_awkward_rows(docs):
    rows = {r["doc_id"]: r for r in language_id.language_ids(docs).collect()}
    assert rows[4]["lang_pred"] == rows[6]["lang_pred"] == rows[12]["lang_pred"] == "und" and rows[4]["score"] == 0.0
    assert rows[11]["lang_pred"] != "und"


def test_codewords_differ():
    for n in (2, 3, 4, 9, 40):
        code = language_id.codewords(n)
        assert len({tuple(row) for row in code.tolist()}) == n and (abs(code.sum(axis=0)) < n).all()


# --- 4 ---------------------------------------------------------------------------


def test_url_verdicts(spark):
    entries = spark.createDataFrame([
        ("b.com", "x", True, "2024-01-01"), ("b.com", "x", False, "2024-02-01"), ("a.b.com", "y", True, "2024-01-10"),
        (None, "z", True, "2024-01-01"), ("c.com", "z", True, None),
    ], "pattern string, category string, listed boolean, at string").withColumn("at", F.to_timestamp("at"))
    captures = spark.createDataFrame([
        (1, "http://A.b.com/x", "2024-01-05"), (2, "http://a.b.com", "2024-01-10"), (3, "http://b.com:80/", "2024-02-01"),
        (4, "http://xb.com", "2024-01-05"), (5, None, "2024-01-05"), (6, "http://c.com", None), (None, "http://b.com", "2024-01-31"),
        (2, "http://a.b.com", "2024-01-10"),
    ], "page_id bigint, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    rows = url_filter.verdicts(captures, entries).collect()
    assert Counter((r["page_id"], r["blocked"], r["pattern"]) for r in rows) == Counter([
        (1, True, "b.com"), (2, True, "a.b.com"), (3, False, None), (4, False, None), (5, False, None), (6, False, None),
        (None, True, "b.com"), (2, True, "a.b.com")])


def test_url_lists_do_not_end_each_other(spark):
    entries = spark.createDataFrame([
        ("b.com", "malware", True, "2024-01-01"), ("B.com", "ads", True, "2024-01-10"), ("b.com", "ads", False, "2024-02-01"),
        ("c.com", "malware", True, "2024-01-01"), ("c.com", "ads", False, "2024-01-01"),
        ("d.com", None, True, "2024-01-01"), ("d.com", "ads", True, "2024-01-05"), ("d.com", "ads", False, "2024-01-08"),
    ], "pattern string, category string, listed boolean, at string").withColumn("at", F.to_timestamp("at"))
    captures = spark.createDataFrame([
        (1, "http://b.com/", "2024-01-05"), (2, "http://b.com/", "2024-01-15"), (3, "http://x.b.com/", "2024-03-01"),
        (4, "http://c.com/", "2024-01-02"), (5, "http://d.com/", "2024-01-06"), (6, "http://d.com/", "2024-01-08"),
    ], "page_id bigint, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    rows = url_filter.verdicts(captures, entries).withColumn("valid_from", F.date_format("valid_from", "MM-dd")).collect()
    assert sorted((r["page_id"], r["blocked"], r["category"], r["valid_from"]) for r in rows) == [
        (1, True, "malware", "01-01"), (2, True, "ads", "01-10"), (3, True, "malware", "01-01"),
        (4, True, "malware", "01-01"), (5, True, "ads", "01-05"), (6, True, None, "01-01")]


def test_url_hosts_and_far_captures(spark):
    entries = spark.createDataFrame([
        ("[2001:DB8::1]", "x", True), ("b.com.", "x", True), ("com", "tld", True), ("1]", "x", True)],
        "pattern string, category string, listed boolean").withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    captures = spark.createDataFrame([
        (1, "http://[2001:db8::1]/", "2024-01-05"), (2, "http://u@[2001:db8::1]:80/x", "9999-12-31"),
        (3, "http://a.B.com./", "2024-02-05"), (4, "https://b.com.:443", "2030-02-05"), (5, "http://c.com", "1999-01-01"),
        (6, "http://[::ffff:1.1.1.1]/", "2024-01-05"), (7, "http://c.com..", "2024-01-05")],
        "page_id bigint, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    rows = {r["page_id"]: (r["host"], r["pattern"]) for r in url_filter.verdicts(captures, entries).collect()}
    address = "[2001:db8::1]"
    assert rows == {1: (address, address), 2: (address, address), 3: ("a.b.com", "b.com"), 4: ("b.com", "b.com"),
                    5: ("c.com", None), 6: ("[::ffff:1.1.1.1]", None), 7: ("c.com", "com")}
    assert url_filter.verdicts(captures.limit(0), entries).collect() == []
    assert {r["pattern"] for r in url_filter.verdicts(captures, entries.limit(0)).collect()} == {None}


def test_example_entries_put_names_on_two_lists(spark):
    entries = queries.example_entries(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    lists = entries.groupBy("pattern").agg(F.countDistinct("category").alias("n")).groupBy("n").count().collect()
    assert {r["n"] for r in lists} >= {2}


def test_url_filter_of_deep_hosts(spark):
    deep = ".".join("abcdefghijkl") + ".com"
    entries = spark.createDataFrame([(deep, "x", True), (None, "x", True)], "pattern string, category string, listed boolean")
    captures = spark.createDataFrame([(1, f"http://z.{deep}/"), (2, "http://l.com/")], "page_id bigint, url string")
    day = F.to_timestamp(F.lit("2024-01-01"))
    seen, listed = captures.withColumn("fetched_at", day), entries.withColumn("at", day)
    assert {r["page_id"]: r["pattern"] for r in url_filter.verdicts(seen, listed).collect()} == {1: deep, 2: None}
    none = url_filter.verdicts(seen, listed.filter("pattern is null")).collect()
    assert sorted((r["page_id"], r["blocked"]) for r in none) == [(1, False), (2, False)]


# --- 5 ---------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [exact_dedup.BUCKET_BYTES, 4096])
def test_exact_duplicates(docs, bucket_bytes):
    groups = defaultdict(list)
    for doc_id, text in plain(docs):
        groups[text].append(doc_id)
    rows = exact_dedup.exact_duplicates(docs, bucket_bytes).collect()
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want


def test_bucket_cuts_recurse(spark):
    sizes = spark.range(64).select((F.col("id") * 8).alias("code"), F.lit(1000).cast("bigint").alias("bytes"))
    cuts = exact_dedup.bucket_cuts(sizes, 4000)
    assert len(cuts) > 3 and max(bits for bits, _ in cuts) > 50  # codes differ in their last bits only
    assert exact_dedup.bucket_cuts(sizes.filter("id = 1"), 10)[1:] == []  # one text is never cut


# --- 6 ---------------------------------------------------------------------------


def test_warc_round_trip_and_checks(spark):
    html = "<p>" + "é" * 200
    pages = spark.createDataFrame([
        (3, "http://a/ b", html), (1, "http://a/1", html), (2, None, None), (4, "u", "x"), (5, "u", "x"), (None, "u", html),
        (1, "http://a/1", html),
    ], "page_id bigint, url string, html string")
    paths = warc.write_archives(pages, 200)
    rows = warc.read_archives(paths).collect()
    size = len(html.encode())
    assert all(r["problem"] is None for r in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows) == Counter([
        (3, size, "revisit", 1), (1, size, "response", None), (2, 0, "response", None), (4, 1, "response", None),
        (5, 1, "response", None), (None, size, "response", None), (1, size, "response", None)])
    assert {r["payload"] for r in rows if r["page_id"] == 1} == {html}
    assert warc.archived_pages(pages.filter("page_id > 99")).collect() == []


def test_warc_reader_finds_faults():
    good = warc.record_bytes(7, "u", b"hello", 5, hashlib.sha256(b"hello").hexdigest(), None)
    dictionary = zstandard.train_dictionary(2048, [good + bytes([i]) * 40 for i in range(200)]).as_bytes()
    pack = warc.compressor(dictionary)

    def read(*records, head=None):
        data = (warc.dictionary_frame(dictionary) if head is None else head) + b"".join(map(pack.compress, records))
        return list(warc.read_records(io.BytesIO(data)))

    assert [r.problem for r in read(good, good)] == [None, None] and read(good)[0].payload == b"hello"
    for bad in (good[:-3], good.replace(b"hello", b"hellO"), good.replace(b"WARC/1.1", b"WARC/9"),
                good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b": response", b": request")):
        assert read(bad)[0].problem
    assert "dictionary" in read(good, head=b"")[0].problem
    cut = warc.dictionary_frame(dictionary) + pack.compress(good)[:-5]
    assert "archive" in list(warc.read_records(io.BytesIO(cut)))[0].problem


# --- 7 ---------------------------------------------------------------------------


def test_mixing(docs):
    rows = mixing.assignments(docs, carry=["source"]).collect()
    assert len(rows) == docs.count()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        source = r["carried"]["source"]
        taken[source] += r["taken"]
        target[source], size[source] = r["target"], r["source_size"]
        assert r["taken"] <= 2 * r["size"] and all(0 <= p["position"] <= 1 for p in r["passes"])
    assert all(taken[s] == int(target[s]) and target[s] <= 2 * size[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_schedules_are_inverted(spark):
    schedule = [(0.0, 1.0), (0.25, 3.0), (1.0, 0.5)]
    got = [r[0] for r in spark.range(101).select(mixing.progress_at(F.col("id") / 100, schedule)).collect()]
    t = np.linspace(0, 1, 200_001)
    w = np.interp(t, *zip(*schedule))
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
    assert np.allclose(got, np.interp(np.arange(101) / 100 * area[-1], area, t), atol=1e-4)


# --- 8 ---------------------------------------------------------------------------


def brute_repeats(texts):
    seen, out = set(), {}
    for i, text in sorted(texts):
        data, gone = text.encode(), set()
        for s in range(len(data) - 99):
            window = data[s : s + 100]
            if window in seen:
                gone.update(range(s, s + 100))
            seen.add(window)
        kept = bytes(b for p, b in enumerate(data) if p not in gone)
        spans = sum(p - 1 not in gone for p in gone)
        out[i] = (len(data), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [substring_dedup.CHUNK, 4000])
def test_repeats_match_brute_force(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    letters = np.array(list("ab "))
    extra = ["".join(rng.choice(letters, 400)) for _ in range(4)]
    extra += [extra[0][100:350] + extra[1][:120], "ab" * 150, extra[2][:99], extra[2][:100], "ß" * 80]
    rows = [(i, t) for i, t in plain(docs) if i is not None and i != 7 and len(t) < 9000]
    rows += [(100 + i, t) for i, t in enumerate(extra)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.without_repeats(frame).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_awkward_rows(docs):
    rows = substring_dedup.without_repeats(docs).collect()
    assert len(rows) == docs.count()
    late = [r for r in rows if r["doc_id"] is None and r["n_bytes"]]
    assert late and late[0]["n_removed"] == late[0]["n_bytes"]  # rows without id come last


@pytest.mark.parametrize("kind", ["no ids", "repeated ids"])
def test_repeats_of_rows_without_own_ids(spark, kind):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefgh "))
    shared = ["".join(rng.choice(letters, 150)) for _ in range(20)]
    texts = ["".join(rng.choice(letters, rng.integers(170, 430))) for _ in range(1500)]
    for i in range(0, 1500, 10):
        texts[i] += shared[i % 20]
    texts += ["".join(rng.choice(letters, 200)) for _ in range(2)] * 2 + ["x", "", "x" * 99]
    ids = [None if kind == "no ids" else int(i) for i in rng.integers(0, 40, len(texts))]
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(5)
    order = {(None if r["sub"] % 2 else r["doc"], r["text"]): (r["doc"], r["sub"])
             for r in substring_dedup.identified(frame).collect()}
    assert len(set(order.values())) == len(order) == len(set(zip(ids, texts)))
    want = brute_repeats([(number, key[1]) for key, number in order.items()])
    rows = [(i, *want[order[i, t]]) for i, t in zip(ids, texts)]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in substring_dedup.without_repeats(frame).collect())


# --- 9 ---------------------------------------------------------------------------


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    want = Counter()
    for doc_id, text in plain(docs):
        want[doc_id, tuple(whole.encode(text, add_special_tokens=False).ids + [2])] += 1
    pieces = packing.packed_sequences(docs, path, shard_tokens=20_000).collect()
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p["row"], p["doc_id"], p["doc_tokens"]].append(p)
    for (_, doc_id, tokens), parts in by_row.items():
        ids = next(ids for (i, ids), n in want.items() if i == doc_id and len(ids) == tokens and n)
        want[doc_id, ids] -= 1
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == tokens
    assert not any(want.values())
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= packing.CAPACITY


def test_pack_balances_cost():
    lengths = np.random.default_rng(1).integers(1, 3000, 400)
    cost = Counter()
    for _, _, length, sequence, _ in packing.pack(lengths):
        cost[sequence] += packing.cost(length)
    full = [c for s, c in cost.items() if s < int(lengths.sum()) // packing.CAPACITY]
    assert max(full) < 3 * min(full)


# --- 10 --------------------------------------------------------------------------


def test_winnowing_matches_brute_force(spark, docs):
    rows = [r for r in winnowing.edited_documents(docs).collect()]
    assert len(rows) == docs.count()
    texts = sorted([t for t in plain(docs) if t[0] is not None and t[0] != 7], key=lambda t: -t[0])
    prints = {r["doc_id"]: r for r in rows}
    words = {i: spark.createDataFrame([(t,)], "t string").select(
        F.regexp_extract_all("t", F.lit(winnowing.WORD), 1)).first()[0] for i, t in texts}
    for doc_id, text in texts[:6] + texts[-4:]:
        w = words[doc_id]
        grams = [w[i : i + winnowing.GRAM] for i in range(max(len(w) - winnowing.GRAM + 1, min(len(w), 1)))]
        hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame(
            [(i, g) for i, g in enumerate(grams)], "i int, g array<string>").orderBy("i").select(F.xxhash64("g")).collect()]
        short = [h >> (64 - 39) for h in hashes]
        chosen = []
        for start in range(max(len(short) - winnowing.WINDOW + 1, min(len(short), 1))):
            window = short[start : start + winnowing.WINDOW]
            at = start + max(i for i, h in enumerate(window) if h == min(window))
            if at not in chosen:
                chosen.append(at)
        assert prints[doc_id]["fingerprint"] == " ".join(f"{short[i]:010x}@{i}" for i in chosen)
        assert prints[doc_id]["n_chars"] == len(text)


def test_edits_follow_the_order(spark):
    texts = {i: f"{chr(97 + i % 26)}é日" * (i % 7) for i in range(3000)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = winnowing.edited_documents(frame).select("doc_id", "edited_sha256").collect()
    assert len(rows) == len(texts)
    for doc_id, found in rows:
        text, after = texts[doc_id], texts[(doc_id - 1) % 3000]
        half = len(text) // 2
        assert found == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_equal_texts_have_equal_fingerprints(docs):
    rows = winnowing.edited_documents(docs).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[2] and prints[4] == prints[5] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


@pytest.mark.parametrize("name, in_parts", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_of_other_vocabularies(name, in_parts):
    import os

    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(queries.tokenizer_path()), name)
    ours, theirs = packing.PieceTokenizer(path), Tokenizer.from_file(path)
    assert ours._in_parts == in_parts
    for text in ["Hello World again", "", "  two  blanks\n\tand it's", "été où ß Σ 日本語 I\u0307", "a1b22 --- !?", "x" * 3000]:
        assert np.frombuffer(ours.ids(text), np.uint32).tolist() == theirs.encode(text, add_special_tokens=False).ids


# --- pipeline ----------------------------------------------------------------------


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == docs.columns
        kept.append({r["doc_id"] for r in rows.collect()})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    assert {4, 5, 6, 12}.isdisjoint(kept[0]) and {1, 2, 7, 8, 9, 11} <= kept[0]  # no letters
    assert 1 not in kept[1] and 2 in kept[1]  # the largest id of equal texts stays
    assert 13 not in kept[2] and 9 in kept[2]  # the smallest id of near texts stays
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() > 0


CLASHING = ["score", "lang_pred", "ambiguous", "_content", "_keep_id", "keep_id", "n_keep", "row", "extra_id",
            "extra_hash", "text_hash", "text_sha256", "carried", "a.b", "c`d", "c1"]


def test_pipeline_columns_of_any_name(spark, docs):
    import corpus_pipeline

    rows = docs.drop(*CLASHING).select("*", *[F.lit(name).alias(name) for name in CLASHING])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == [c for c in docs.columns if c not in CLASHING] + CLASHING
        assert {tuple(r)[-len(CLASHING):] for r in rows.collect()} == {tuple(CLASHING)}


def test_one_row_of_each_text_stays(spark):
    texts = [(5, "same", 1), (5, "same", 2), (5, "same", 2), (4, "same", 0), (None, "other", 3), (None, "other", 4),
             (None, "mixed", 5), (2, "mixed", 6), (5, "own", 7), (8, None, 8), (9, "", 9)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, n int").repartition(3)
    found = sorted((tuple(r) for r in exact_dedup.keepers(frame).collect()), key=str)
    again = sorted((tuple(r) for r in exact_dedup.keepers(frame.repartition(2)).collect()), key=str)
    assert found == again and set(found) <= set(texts)
    assert Counter((r[0], r[1]) for r in found) == Counter(
        [(5, "same"), (None, "other"), (2, "mixed"), (5, "own"), (9, "")])


def python_pipeline(rows, tokenizer):
    """The texts that are packed, by the rules of the five stages, as (doc_id, text) with repeats."""
    lettered = [r for r in rows if r[1] and language_id.LETTER.search(r[1])]
    last = {}
    for r in lettered:
        if r[1] not in last or r[0] > last[r[1]][0]:
            last[r[1]] = r
    kept = sorted(last.values())
    sets = [shingle_set(t, 5) for _, t, _ in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    by_source = defaultdict(list)
    for r in kept:
        by_source[r[2]].append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(t)) for _, t, _ in by_source[s]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) >= 2 * size[s]}
        if not full:
            target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
            break
        target |= {s: 2 * size[s] for s in full}
        left, open_ = left - sum(2 * size[s] for s in full), open_ - full
    taken = []
    for s in names:
        due = 0
        for _ in range(2):
            for doc_id, text, _ in sorted(by_source[s], key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
                n, room = len(words(text)), int(target[s] + 1e-6) - due
                if room >= n > 0:
                    taken.append((doc_id, text))
                elif n and room > 0:
                    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                    taken.append((doc_id, text[: ends[room - 1]]))
                due += n
    return [(doc_id, [*tokenizer.encode(text, add_special_tokens=False).ids, 2]) for doc_id, text in taken]


def shingle_set(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(found[i : i + width]) for i in range(max(len(found) - width, 0) + 1)} if found else set()


def test_run_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    base = [" ".join(f"{chr(97 + k % 26)}w{(i * 31 + k * 17) % (50 + k)}" for i in range(40 + 9 * k)) for k in range(24)]
    rows = [(i + 1, t, ("a", "b", None, "c")[i % 4]) for i, t in enumerate(base)]
    rows += [(40 + i, t, "b") for i, t in enumerate(base[:5])]  # exact copies
    rows += [(60 + i, base[8 + i] + " changed end", "a") for i in range(5)]  # near copies
    rows += [(80, None, "a"), (81, "12 34", "b"), (82, "", None), (83, " ".join(f"long{i}" for i in range(5000)), "c")]
    frame = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows],
                                  "doc_id bigint, text string, source string, lang string, n_chars bigint")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = python_pipeline(rows, Tokenizer.from_file(queries.tokenizer_path()))
    assert len(expected) > len(base)  # some texts are read twice
    wanted = defaultdict(Counter)
    for doc_id, ids in expected:
        wanted[doc_id, len(ids)][tuple(ids)] += 1
    found = defaultdict(list)
    for p in pieces:
        found[p["doc_id"], p["doc_tokens"]].append(p)
    assert set(found) == set(wanted)
    for key, texts in wanted.items():
        assert len(texts) == 1  # the readings of one length are the same text
        (ids, times), = texts.items()
        covered = Counter()
        for p in found[key]:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            covered.update(range(p["start"], p["start"] + p["length"]))
        assert covered == Counter({i: times for i in range(len(ids))})
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]]
        ends[p["sequence_id"]] += p["length"]
    assert max(ends.values()) <= 4096


def test_pipeline_keeps_unlabelled_documents(spark, docs):
    import corpus_pipeline

    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, unlabelled, "").collect()
    assert {r["doc_id"] for r in kept} == {1, 2, 3, 7, 8, 9, 10, 11, 13, 14, 15, None}
    assert {r["lang"] for r in kept} == {None}
    und = docs.withColumn("lang", F.when(F.col("doc_id") < 9, F.lit("und")).otherwise(F.col("lang")))
    assert {1, 2, 3, 7, 8} <= {r["doc_id"] for r in corpus_pipeline.language(spark, und, "").collect()}


def test_letters_are_the_same_in_spark(spark):
    texts = [(i, chr(i)) for i in [*range(0x250), 0x2160, 0x3007, 0x3042, 0x4E00, 0x0661, 0x2460, 0x1F600]]
    frame = spark.createDataFrame([*texts, (-1, None), (-2, "")], "i int, text string")
    found = {r["i"]: r["has"] for r in frame.select("i", language_id.has_letter(F.col("text")).alias("has")).collect()}
    assert found == {i: bool(language_id.LETTER.search(t)) for i, t in texts} | {-1: False, -2: False}


def test_letters_of_every_script_stay(spark, docs):
    """All that LETTER finds, also letters that Java's tables are too old for (U+1E4D0, U+10570, U+31350)."""
    import corpus_pipeline

    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and language_id.LETTER.search(chr(i))]
    frame = spark.createDataFrame([(c,) for c in letters], "text string").repartition(4)
    assert frame.filter(language_id.has_letter(F.col("text"))).count() == len(letters)
    newer = docs.withColumn("text", F.when(F.col("doc_id") == 1, "\U0001E4D0 \U0001E4D1").when(
        F.col("doc_id") == 2, "\U00010570").when(F.col("doc_id") == 7, "12 \U00031350").otherwise(F.col("text")))
    assert {1, 2, 7} <= {r["doc_id"] for r in corpus_pipeline.language(spark, newer, "").collect()}


def test_oracles_on_the_smallest_tables(spark):
    from tests.compare import compare, connect
    from trailmetrics.llm.oracles import all_oracles

    con = connect("/root/testdata/sf0.001")
    for name, sql in all_oracles().items():
        assert compare(spark, con, "/root/testdata/sf0.001", queries.all_queries()[name], sql)[1] == [], name


def test_ddl_has_clashing_names():
    assert {"size", "row", "one", "target"} <= {f.split()[0] for f in DDL.split(", ")}
