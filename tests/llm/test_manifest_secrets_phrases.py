"""Merkle manifest, secret scan and collocations against brute force on small and adverse tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandloom.llm import collocations, merkle, secret_scan
from strandloom.session import make_importable

KIND = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, words string, body string, tampered string, spans string"


def table(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with columns whose names the operators use themselves."""
    make_importable(spark)
    return spark.createDataFrame([(*r, "t", 7, "w", None, "x", "s") for r in rows], KIND).repartition(3)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row, text):
    doc_id, _, lang, source, n_chars = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_by_hand(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, k):
    steps = []
    for nodes in levels[:-1]:
        low = k // 16 * 16
        steps.append((nodes[low:k], nodes[k + 1 : low + 16]))
        k //= 16
    return steps


def manifest_by_hand(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[3]].append((row[0] is not None, row[0] or 0, leaf_by_hand(row, row[1]), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_by_hand([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    forest = levels_by_hand([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for k, (_, _, leaf, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = siblings(trees[s], k) + siblings(forest, at)
            lower = row[1] and re.sub("[A-Z]", lambda m: m[0].lower(), row[1])
            node = leaf_by_hand(row, lower) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else leaf
            for before, after in path:
                node = digest(*before, node, *after)
            out.append((row[0], leaf, trees[s][-1][0], forest[-1][0], digest(*(x for step in path for side in step for x in side)), node, node == forest[-1][0]))
    return sorted(out, key=str)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"Text {i} É", "en" if i % 3 else None, "hot", i) for i in range(4_500)]  # two superblocks, the last with one run at the top
    rows += [(10_000 + i, f"t{i}", "de", f"s{i % 40}", None) for i in range(600)]  # more than 16 sources
    rows += [(20_000, None, None, None, None), (20_005, "", "é", "", 0), (20_006, "A" * 300_000, "x", "alone", 1), (20_007, "A", "x", "漢", -1)]
    rows += [(20_010, "Same", "en", "s1", 4)] * 3 + [(20_010, "Other", "en", "s1", 5), (None, "No id", "en", "s2", 1), (None, "NO ID", "en", "s2", 1), ((1 << 62) + 1, "Far", "en", "s2", 1)]
    rows += [(30_000 + i, "x", "en", "sixteen", 1) for i in range(16)] + [(31_000 + i, "x", "en", "seventeen", 1) for i in range(17)]
    rng.shuffle(rows)
    got = merkle.manifest(table(spark, rows), merkle.lowered(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == manifest_by_hand(rows)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "Aa", "en", "one", 2) for i in range(n)]
    got = merkle.manifest(table(spark, rows) if rows else table(spark, [(1, "", "", "", 1)]).where("doc_id < 0"), merkle.lowered(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest_by_hand(rows)


def test_one_changed_row_is_the_only_one_that_fails(spark):
    docs = table(spark, [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(300)])
    got = merkle.manifest(docs, F.when(F.col("doc_id") == 77, F.lit("other"))).where("NOT verified").collect()
    assert [r.doc_id for r in got] == [77]


def base_by_hand(text):
    assign = r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
    kinds = [[m.span() for m in re.finditer(assign, text, re.A | re.I) if len(m[2]) >= 8]]
    kinds += [[m.span() for m in re.finditer(p, text) if len(m[0]) >= n] for p, n in (("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32))]
    return kinds


def high_by_hand(run, window, bits):
    """Characters of ``run`` in a window of enough entropy, each window counted anew."""
    high = set()
    for i in range(len(run) - window + 1):
        counts = collections.Counter(run[i : i + window]).values()
        if math.log2(window) - sum(c * math.log2(c) for c in counts) / window >= bits:
            high |= set(range(i, i + window))
    return high


def test_window_entropy_by_counts_equals_entropy_counted_anew():
    rng = random.Random(4)
    for _ in range(300):
        run = bytes(rng.choice(b"abcdefABCDEF0123456789xyzXYZ+/"[: rng.randint(2, 30)]) for _ in range(rng.randint(0, 120)))
        window, bits = rng.choice([8, 24, 32]), rng.choice([1.5, 2.3, 3.03, 3.7, 4.01])
        got = {i for a, b in secret_scan.high_windows(run, window, bits) for i in range(a, b)}
        assert got == high_by_hand(run, window, bits)


def test_secrets_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["token", "PassWd", "secret", " = ", ":", '"', "'", "api_key", "APIKEY", "é", "漢", "ſecret", "toKen", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 5, "=", "==", "abcdefgh", "\n", "\0", " " * 5, "Zk3+/x9A", "..", "-_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1_500)]
    texts += [None, "", "token=" + "a" * 300_000, "token" + " " * 100_000, "é" * 50_000 + " secret: abcdefgh1", "f" * 400_000, "x y " * 200_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = secret_scan.scan_secrets(table(spark, rows)).collect()
    assert len(got) == len(texts)
    for r in got:
        kinds = base_by_hand(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, kinds))
        base = [f"{name}:{a}:{b}" for a, _, b, name in sorted((a, k, b, secret_scan.BASE[k]) for k, spans in enumerate(kinds) for a, b in spans)]
        assert r.base_sha256 == digest(",".join(base))
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if x.split(":")[0] in secret_scan.BASE] == base and len(spans) == len(base) + r.n_entropy
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), secret_scan.Scanner().kinds.index(x.split(":")[0])))


def test_entropy_adds_secrets_and_the_allow_list_takes_harmless_ones():
    scanner = secret_scan.Scanner()
    added = lambda t: [scanner.kinds[k] for _, k, _ in scanner.spans(t.encode())[1] if k >= 3]
    key = "wJalrXUtnF9MI/K7MDENG/bPxRfiCYzQ8dTyUkAA"
    assert added(f"é {key}") == ["entropy_base64"] and scanner.told(scanner.spans(f"é {key}".encode())[1]) == "entropy_base64:2:42"
    assert added("9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822C") == ["entropy_hex"]
    assert added("q7w2e9r4t1y8u3i6o5p0a2s7d4f9g1h") == ["entropy_alnum"]
    for harmless in (f"password = {key}", f"data:image/png;base64,{key}", "sha256: 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B", f"https://host/{key}", "AbcdefghijklMNOPqrstuvwxyz0123456789", "thononerhaanonthetionerhathe", "aB1" * 30, "src/main/java/Com/Widget/Foo/Bar2/BazQux", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"):
        assert added(harmless) == [], harmless
    assert secret_scan.Scanner(allowed_text=(), allowed_before=()).spans(f"base64,{key}".encode())[1]


def test_secrets_of_an_empty_table(spark):
    assert secret_scan.scan_secrets(table(spark, [(1, "", "", "", 1)]).where("doc_id < 0")).collect() == []


def phrases_by_hand(rows, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _, _ in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if inside[p] < a:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(6)
    words = ["a", "B", "b", "the", "é", "漢字", "of", "x\x00y", " ", "ﬁ"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words[: rng.choice([4, 10, 70])]) + rng.choice([" ", " ", " ", "  \t", ", ", ".\n", "\x0b"]) for _ in range(rng.randint(0, 200)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""]), "s", 1))
    rows += [(1_000, None, "en", "s", 1), (1_001, "", None, "s", 1), (1_002, " ".join(["new york city hall"] * 40_000), "en", "s", 1), (1_003, "z" * 300_000 + " z", "en", "s", 1)]
    return rows + [(1_004, "one two three. One two three four", "fr", "s", 1)] * 9


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (9, 20)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = phrase_rows()
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), least, top).collect())
    assert got == phrases_by_hand(rows, least, top) and len(got) > 50


def test_phrases_across_seams_and_in_small_folds(spark, monkeypatch):
    rows = phrase_rows()[:120]
    docs = table(spark, rows)
    bits = collocations._frequent_slots(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("body")), 5, collocations.BASES[0])
    assert sum(zlib.decompress(bits)) > 0
    text = b"one two three four five six seven. eight nine"
    monkeypatch.setattr(collocations, "CHUNK", 7)
    seen = []
    for data, own, at in collocations._chunks(text):
        words = collocations._Words(data, own, collocations.np.array([0]) - at, collocations.np.array([0]), collocations.BASES[0])
        for i in range(words.own):
            k = 1
            while k < 5 and i + k - 1 < len(words.same) and words.same[i + k - 1]:
                k += 1
            seen.append([data[words.first[j] : words.after[j]] for j in range(i, i + k)])
    whole = [piece.split() for piece in text.split(b".")]
    assert seen == [piece[i : i + 5] for piece in whole for i in range(len(piece))]


def test_words_that_share_a_hash_are_counted_with_other_hashes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BASES", (1, *collocations.BASES[1:]))  # the polynomial in 1 can't tell anagrams apart
    rows = [(i, "ab ba ab ba", "en", "s", 1) for i in range(6)]
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), 5, 9).collect())
    assert got == phrases_by_hand(rows, 5, 9) and got


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(table(spark, [(1, "", "", "", 1)]).where("doc_id < 0")).collect() == []


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_op12_equals_brute_force_on_the_given_table(spark):
    from strandloom.llm import catalog

    make_importable(spark)
    texts = {d["doc_id"]: d["text"] or "" for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    got = catalog.queries()["op12_secret_scan"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in got} == {i: tuple(map(len, base_by_hand(t))) for i, t in texts.items()}
