"""BPE, line dedup, packing, exact and near dedup against brute force on small and adverse tables."""

import base64
import collections
import dataclasses
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import bpe, exact_dedup, line_dedup, near_dedup, packing

KIND = "doc_id long, text string, key string, body string, n int, digest string"
VOCAB, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    ids = range(1, len(texts) + 1) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", None, 3, "d") for i, t in zip(ids, texts, strict=True)], KIND).repartition(3)


def adverse():
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdeé漢🙂'") for _ in range(rng.randint(1, 9))) for _ in range(4_000))
    return [None, "", " ", "\n\n", "a", "It's  we'll 123\t\n x", "x" * 9_000, " " * 5_000 + "y", long, long, "ends 'r", "漢字🙂" * 2_000, "\x00\x1c<|endoftext|>"]


def test_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = adverse()
    for chunk, overlap in ((200, 40), (32_768, 1_024)):  # many seams, some that never agree; none
        got = {r.doc_id: r for r in bpe.round_trip_digests(table(spark, texts), VOCAB, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()}
        for i, text in enumerate(texts, 1):
            ids = whole.encode_ordinary(text or "")
            assert got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_packing_equals_the_tokenizer_and_is_gapless(spark):
    whole = Tokenizer.from_file(WORDS)
    texts = [*adverse(), *(" ".join(f"word{k}" for k in range(n)) for n in range(0, 900, 30)), "İ Σας ΣΑΣ é ﬁ ½ naïve don't I'LL  \u0085x"]
    docs = table(spark, texts)
    rows = packing.pack_documents(docs, WORDS).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, text in enumerate(texts, 1):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096)) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.length == len(ids[r.start : r.start + 4096])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    check_places(rows)
    assert packing.pack_documents(table(spark, []), WORDS).count() == 0


def check_places(rows, slack=1.02):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r.length for r in rows) // 4096)
    assert len(sequences) <= least * slack + 2


def test_sum_of_squares_is_near_the_bound():
    lengths = np.minimum(np.random.default_rng(0).lognormal(6.5, 1.0, 5_000).astype(int) + 1, 4096)
    sequence, offset = packing.place(lengths)
    assert len(set(sequence)) <= 1.005 * lengths.sum() / 4096 + 1
    filled = collections.Counter()
    for i in np.lexsort((offset, sequence)):
        assert offset[i] == filled[sequence[i]]
        filled[sequence[i]] += lengths[i]
    assert max(filled.values()) <= 4096


def test_exact_groups(spark):
    texts = ["a", "a", "A", None, "", "b\n", "b", "a", "x" * 100_000, "x" * 100_000]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(table(spark, texts), capacity=2).collect()}
    by = collections.defaultdict(list)
    for i, t in enumerate(texts, 1):
        by[t or ""].append(i)
    for text, ids in by.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(table(spark, texts)).collect()) == sorted(map(max, by.values()))
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    twice = table(spark, ["a", "a", "a"], [5, 5, None])
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(twice).collect()) == [("5", 5, 3, True), ("5", 5, 3, True), ("None", 5, 3, False)]


def test_directory_doubles_where_buckets_are_full():
    counts = {0: 10, 1: 10, 2: 10, 3000: 1}
    slots = exact_dedup.directory_of(counts, 12, 10)
    assert [s for s, _, _ in slots] == list(range(1 << 12)) and sorted({b for _, b, _ in slots}) == list(range(max(b for _, b, _ in slots) + 1))
    held = collections.Counter()
    for slot, bucket, _ in slots:
        held[bucket] += counts.get(slot, 0)
    assert max(held.values()) <= 10
    assert {d for s, _, d in slots if s >= 2048} == {1}
    assert exact_dedup.directory_of({0: 4, 7: 4}, 3, 5) == [(0, 0, 1), (1, 1, 1)] and exact_dedup.directory_of({}, 3, 5) == [(0, 0, 0)]


def test_the_directory_routes_texts_and_lookups(spark):
    texts = [f"text {i % 700}" for i in range(1_000)]
    docs = table(spark, texts)
    index = exact_dedup.build_index(docs, capacity=8)
    slots = {r.slot: r.bucket for r in index.directory.collect()}
    rows = index.entries.collect()
    assert sorted(slots) == list(range(1 << index.bits)) and len(rows) == 700
    assert all(slots[(r.key & (1 << 64) - 1) >> 64 - index.bits] == r.bucket for r in rows)
    assert max(collections.Counter(r.bucket for r in rows).values()) <= 8
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, capacity=8).collect()}
    assert all(got[i].keep_id == (i + 700 if i + 700 <= 1_000 else i) for i in range(1, 1_001))
    # a directory that names other buckets finds nothing there
    wrong = dataclasses.replace(index, directory=index.directory.withColumn("bucket", (F.col("bucket") + 1) % (max(slots.values()) + 1)))
    assert exact_dedup.lookup(wrong, docs).where("keep_id IS NOT NULL").count() == 0
    twice = table(spark, ["a", "a", "b", "b", "c", "c", None, ""], [5, 5, None, None, 6, 7, None, None])
    assert sorted((str(r.doc_id), r.text or "") for r in exact_dedup.drop_copies(twice).collect()) == [("5", "a"), ("7", "c"), ("None", ""), ("None", "b")]


def test_owners_of_bucket_ranges_fold_texts(spark):
    """Texts are dealt by ranges of buckets and by nothing else; a bucket of very many rows goes to several owners first."""
    docs = table(spark, ["copy"] * 500 + [f"text {i}" for i in range(300)])
    index = exact_dedup.build_index(docs, capacity=8)
    rows = exact_dedup._routed(exact_dedup._rows(docs, "doc_id", "text"), index.directory, index.bits)
    assert rows.agg(F.max("slices")).first()[0] >= 500 // (8 * exact_dedup.SLICE_ROWS)
    owned = rows.withColumn("slice", F.pmod(F.xxhash64("id"), "slices")).repartitionByRange("bucket", "slice").groupBy("bucket", "slice", "slices", "key", "body").count()
    plan = owned._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(bucket" in plan and "hashpartitioning" not in plan
    assert [(r.group_size, r.keep_id) for r in index.entries.where("group_size > 1").collect()] == [(500, 500)] and index.entries.count() == 301


def test_a_second_batch_extends_the_index(spark):
    texts = [f"text {i % 90}" for i in range(400)] + [None, ""]
    one, two = table(spark, texts[:150]), table(spark, texts[150:] + [f"new {i}" for i in range(300)], range(1_000, 1_552))
    grown = exact_dedup.insert(exact_dedup.build_index(one, capacity=8), two)
    whole = exact_dedup.build_index(one.unionByName(two), capacity=8)
    told = lambda index: sorted(tuple(r) for r in index.entries.select("key", "digest", "keep_id", "group_size").collect())
    assert told(grown) == told(whole) and grown.bits > exact_dedup.build_index(one, capacity=8).bits
    assert max(collections.Counter(r.bucket for r in grown.entries.collect()).values()) <= 8
    assert exact_dedup.lookup(grown, two).where("keep_id IS NULL").count() == 0


def test_dropping_copies_leaves_any_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", 5), (2, "a", None, "z", 6), (3, "b", "x", "y", 7)], "doc_id long, text string, __text string, __id string, __digest int")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(2, "a", None, "z", 6), (3, "b", "x", "y", 7)]


def test_a_text_of_very_many_lines(spark):
    lines = [f"line number {i} of a document with very many lines" for i in range(200_000)]
    shared = lines[:20_000]
    docs = table(spark, ["\n".join(lines)] + ["\n".join([*shared, f"own line {k} that is long enough to have a key"]) for k in range(5)])
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got == {1: (200_000, 20_000)} | {k: (20_001, 20_000) for k in range(2, 6)} | {6: (20_001, 0)}
    assert time.time() - began < 60


def lines_by_hand(docs):
    white = " \t\n\x0b\f\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(white))
    held = collections.defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    lost = {k: max(ids) for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if lost.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_and_its_reversal(spark):
    rng = random.Random(5)
    common = ["This Line Is Repeated Over And Over Again In Many %d" % k for k in range(6)] + ["x" * 39, "é" * 40]
    docs = [(i, "\n".join(rng.choice([" " * rng.randint(0, 2) + rng.choice(common), f"own line {rng.random()}", ""]) + rng.choice(["", "\t", " "]) for _ in range(rng.randint(0, 9)))) for i in range(1, 60)] + [(99, None), (100, "")]
    frame = lambda rows: spark.createDataFrame([(i, t, "d", None) for i, t in rows], "doc_id long, text string, digest string, drop string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_repeated_lines(frame(docs)).collect()}
    assert got == lines_by_hand(docs)
    first, rest = docs[:40], docs[40:]
    counts = lambda index: sorted((bytes(r.digest), r.n_docs, r.last_doc) for r in index.counts.collect())
    before = line_dedup.index_lines(frame(first))
    both = line_dedup.insert(before, frame(rest))
    assert counts(both) == counts(line_dedup.index_lines(frame(docs)))
    after = line_dedup.delete(both, frame(rest).select("doc_id"))
    assert counts(after) == counts(before)
    for index in (both, after):
        blobs = {r.shard: line_dedup.CuckooFilter.loads(bytes(r.blob)) for r in index.filters.collect()}
        hashes = line_dedup._hashes([bytes(r.digest) for r in index.frequent.collect()])
        assert blobs[0].contains(hashes).all()
    assert line_dedup.drop_repeated_lines(frame([])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.insert(before, frame(docs[:1] + docs[39:41]))
    twice = [(5, common[0] + "\n" + common[0]), (5, common[0]), (None, common[0]), (None, None), (6, common[0]), (7, common[0]), (8, "x")]
    rows = sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(frame(twice)).collect())
    assert rows == [("5", 1, 1), ("5", 2, 2), ("6", 1, 1), ("7", 1, 0), ("8", 1, 0), ("None", 1, 0), ("None", 1, 1)]


def test_filters_dealt_by_shard_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    lines = [f"a line of forty characters and some more, number {k}" for k in range(60)]
    docs = spark.createDataFrame([(i, "\n".join(rng.sample(lines, 8) + [f"own {i}"] + [lines[0]])) for i in range(1, 90)], "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    got = []
    for size in (64 << 20, 0):
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", size)
        index = line_dedup.index_lines(docs)
        passed = line_dedup._maybe_frequent(index)
        assert index.shards > 3 and passed.count() < index.postings.count() + 1
        exact = index.postings.join(index.frequent.select("digest"), "digest", "left_semi")
        assert exact.join(passed, ["digest", "doc_id"], "left_anti").isEmpty()
        got.append(sorted(map(tuple, line_dedup.drop_repeated_lines(docs).collect())))
    assert got[0] == got[1]


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(0)
    ins, other = rng.integers(0, 1 << 63, 50_000, np.uint64), rng.integers(0, 1 << 63, 50_000, np.uint64)
    made = line_dedup.CuckooFilter(len(ins))
    assert made.insert(ins) and made.contains(ins).all() and made.contains(other).mean() < 0.001
    made.delete(ins[:5_000])
    assert made.contains(ins[5_000:]).all() and made.contains(ins[:5_000]).mean() < 0.01


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    texts, ids = ["same words here", "same words here", "same words here", None, "other text", "other text"], [5, 5, None, None, 6, 7]
    docs = table(spark, texts, ids)
    assert sorted(str(r.doc_id) for r in bpe.round_trip_digests(docs, VOCAB, public_tokenizers.PATTERN).collect()) == sorted(map(str, ids))
    assert bpe.round_trip_digests(table(spark, []), VOCAB, public_tokenizers.PATTERN).count() == 0
    pieces = packing.pack_documents(docs, WORDS).collect()
    assert sorted(str(r.doc_id) for r in pieces) == sorted(map(str, ids)) and len({(r.sequence_id, r.offset) for r in pieces}) == 6
    groups = near_dedup.near_groups(docs, 3, 85).collect()
    assert sorted(((str(r.doc_id), r.component_id, r.kept) for r in groups), key=str) == [("5", 5, True), ("5", 5, True), ("6", 6, True), ("7", 6, False), ("None", 5, False), ("None", None, True)]


def test_a_bucket_of_many_unlinked_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # many pairs of blocks
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):  # a template: near each other, below the threshold but for a few
        copy = list(base)
        for at in rng.sample(range(120), 14):
            copy[at] = f"x{k}y{at}"
        texts.append(" ".join(copy))
        if k % 30 == 0:
            texts.append(" ".join([*copy[:-1], "end"]))
    rows = near_dedup.near_groups(table(spark, texts), 3, 85).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert [got[i] for i in range(1, len(texts) + 1)] == near_by_hand(texts, 3, 85)


def near_by_hand(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [(len(s), find(k) + 1) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    texts = [None, "", " \t", "one", "ONE", "one two", "one  two\n"]
    for _ in range(6):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 160))]
        for _ in range(40):  # edits of every degree, so that buckets hold several components
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9)}"
            texts.append(" ".join(copy))
    rows = near_dedup.near_groups(table(spark, texts), words, percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert [got[i] for i in range(1, len(texts) + 1)] == near_by_hand(texts, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = near_dedup.drop_near_copies(table(spark, texts), words, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert near_dedup.near_groups(table(spark, [])).count() == 0


def test_bands_and_signatures():
    for percent in (80, 85, 95):
        bands, rows = near_dedup.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS and bands * rows <= near_dedup.HASHES
        assert 0 < near_dedup.least_matches(percent) < bands * rows
