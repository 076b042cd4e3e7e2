"""HTML extraction, WARC, toxicity, license scans, embeddings and the pipeline on small and adverse tables."""

import hashlib
import os
import random
import textwrap
import time

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import embedding_dedup, html_extract, license_scan, toxicity, warc

PAGE = "page_id long, url string, html string, text string, host string"


def test_blocks_by_markup():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>\n  text<br>next<p>Two &#233;&nbsp;x <a href=#>link</a><div class=ad>Buy</div><form><input><label>Name</label></form><script>var a = "</p>";</script>
    <ul><li>first<li>second</ul><table><tr><td>a<td>b</table><section id="comments"><p>reader</p></section></article><aside>Side</aside><footer>Foot</footer><!-- note --></body></html>"""
    assert [t for p, t in html_extract.blocks_of(page) if p == "article"] == ["Head & line", "One bold text next", "Two é x link", "first", "second", "a", "b"]
    assert [p for p, t in html_extract.blocks_of(page) if p == "open"] == []
    for broken in ("", "<", "<p", "a < b", "<b><p>x</b>y", "</div></article>z", "<script>never closed", "&bogus; &#xZZ;", "<!-- open", "<p " + "a" * 10_000):
        html_extract.blocks_of(broken)


def test_markup_of_articles():
    text = lambda page: [t for p, t in html_extract.blocks_of(page) if p == "article"]
    assert text('<main><article>one</article><article class="comment">reader</article><article class="comment-item">x</article></main>') == ["one"]
    assert text('<article><div class="legal-analysis">a</div><p class="share-price popular">b</p><section class="form-guide">c</section><div class="share-buttons">no</div><div id="related">no</div></article>') == ["a", "b", "c"]
    assert text('<article><p class="x>one</p><p>two</p></article>') == ["one", "two"]
    assert text('<article><a title="a > b" href=\'x>y\'>z</a></article>') == ["z"] and text("<article>x<") == ["x<"] and text("<article>x<b") == ["x"]


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<a " * 330_000, '<a b=">" ' * 110_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "<a b='" * 150_000, "&#" * 300_000):
        html_extract.blocks_of(page)
    assert time.time() - began < 60


def test_crossing_tags_and_open_inline_elements_take_linear_time():
    n = 100_000
    for page in ("<b><div>" + "<i>" * n + "</b>" * n, "<p><object>" + "<i>" * n + "<hr>" * n, "<p>" + "<i>" * n + "<div>" * n, "<li>" + "<b>" * n + "<li>" * n):
        began = time.time()
        html_extract.blocks_of(page)
        assert time.time() - began < 10


def test_crossing_tags_close_what_is_open():
    text = lambda page: [t for _, t in html_extract.blocks_of(page)]
    assert text("<b>a<i>b</b>c</i>d") == ["abcd"] and text("<b><div>x</b>y</div>z") == ["xy", "z"]
    assert text("<div><p>a<b>b</div>c") == ["ab", "c"] and text("<p>a<p>b</p>c") == ["a", "b", "c"] and text("<p><b>a<hr>b") == ["a", "b"]


def test_articles_keep_what_their_host_repeats_in_short_and_what_names_their_parts(spark):
    recipe = lambda i: f"<article><h1>Dish {i}</h1><h2>Ingredients</h2><p>Egg {i}</p><h2>Method</h2><p>Stir well.</p><p>Cook 20 min</p></article>"
    rows = [(i, f"https://r.example/{i}", recipe(i), None, None) for i in range(8)]
    parts = '<article><p>Let <math><mi>x</mi></math> be.</p><div class="notice">Mind the gap.</div><div class="legal">By law.</div><section class="reader-comments">no</section><div id="user-reviews">no</div><ol class="responses"><li>no</ol></article>'
    rows.append((100, "https://s.example/", parts, None, None))
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i] == f"Dish {i} Ingredients Egg {i} Method Stir well. Cook 20 min" for i in range(8))
    assert got[100] == "Let x be. Mind the gap. By law."


def test_hosts_decide_on_blocks_of_articles(spark):
    bar = "We use cookies to make this site better for you"
    page = lambda i, k: f"<article><p>{bar}</p><p>own {i}</p><p>passage {k} shared by few</p></article>"
    rows = [(i, "https://a.example/x", page(i, i // 3), None, None) for i in range(12)]
    rows += [(100 + i, "https://b.example/x", page(i, i), None, None) for i in range(2)]  # too few pages to tell
    rows += [(200 + i, "https://c.example/x", page(7, 7), None, None) for i in range(5)]  # one page, five times
    rows += [(300 + i, "https://d.example/x", f"<div>equal pages keep their whole text of more than eight words {k}</div>", None, None) for i in range(2) for k in (1,)]
    for parts in (2, 5):
        got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, PAGE).repartition(parts)).collect()}
        assert all(got[i] == f"own {i} passage {i // 3} shared by few" for i in range(12))
        assert all(got[100 + i] == f"{bar} own {i} passage {i} shared by few" for i in range(2))
        assert all(got[200 + i] == f"{bar} own 7 passage 7 shared by few" for i in range(5))
        assert all(got[300 + i] == "equal pages keep their whole text of more than eight words 1" for i in range(2))


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    menu = "home news sport weather travel money food health science jobs"
    rows = [(i, f"https://h{i % 2}.example/{i}", f"<div>{menu}</div><div>" + " ".join(f"u{i}x{k}" for k in range(30)) + "</div>", None, None) for i in range(8)]
    rows += [(90, None, None, None, None), (91, None, "", None, None), (92, "u", "<article> a <p> b </article>", None, None), (92, "u", "<article> a <p> b </article>", None, None)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(rows, PAGE)).collect())
    assert got[:8] == [(i, t := " ".join(f"u{i}x{k}" for k in range(30)), len(t)) for i in range(8)]
    assert got[8:] == [(90, "", 0), (91, "", 0), (92, "a b", 3), (92, "a b", 3)]
    assert html_extract.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_repeated_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        tokens, page = [rng.randint(0, 3) for _ in range(60)], sorted(rng.randint(0, 4) for _ in range(60))
        n = rng.choice([2, 3, 5])
        wanted = np.zeros(60, bool)
        runs = [(tuple(tokens[i : i + n]), page[i], i) for i in range(60 - n + 1) if page[i] == page[i + n - 1]]
        for run, owner, i in runs:
            if any(run == other and owner != q for other, q, _ in runs):
                wanted[i : i + n] = True
        assert (html_extract.repeated_runs(np.array(tokens), np.array(page), n) == wanted).all()


def test_a_large_host_is_searched_whole_and_alike_in_any_partitioning(spark):
    n, shared = 2_500, lambda k: " ".join(f"s{k}y{j}" for j in range(9))
    own = [" ".join(f"u{i}x{k}" for k in range(4)) for i in range(n)]
    # each of 20 runs is on two far pages of one host, and once on another host
    bodies = [f"<div>{own[i]}</div>" + (f"<p>{shared(i % 1_250)}</p>" if i % 1_250 < 20 else "") for i in range(n)]
    rows = [(i, f"https://big.example/{i}", b, None, None) for i, b in enumerate(bodies)]
    rows += [(n + k, f"https://small.example/{k}", f"<p>{shared(k)}</p>", None, None) for k in range(20)]
    pages = spark.createDataFrame(rows, PAGE)
    wanted = [(i, own[i]) for i in range(n)] + [(n + k, shared(k)) for k in range(20)]
    for parts in (3, 7):
        assert sorted((r.page_id, r.text) for r in html_extract.main_text(pages.repartition(parts)).collect()) == wanted


def test_repeats_of_whole_hosts_equal_the_suffix_array(spark):
    rng = random.Random(5)
    bodies = [[" ".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    rows = [(7, f"https://h{i % 2}.example/", "".join(f"<p>{b}</p>" for b in blocks), None, None) for i, blocks in enumerate(bodies)]
    wanted = []
    for host in range(2):
        first = {}  # pages of equal blocks are one
        for i in range(host, len(bodies), 2):
            first.setdefault(tuple(bodies[i]), i)
        flat = [(w, i) for i in sorted(first.values()) for b in bodies[i] for w in b.split(" ")]
        covered = html_extract.repeated_runs(np.array([ord(w) for w, _ in flat]), np.array([i for _, i in flat]))
        for i in range(host, len(bodies), 2):
            wanted.append((f"https://h{host}.example/", " ".join(w for (w, page), c in zip(flat, covered, strict=True) if page == first[tuple(bodies[i])] and not c)))
    got = [(r.url, r.text) for r in html_extract.main_text(spark.createDataFrame(rows, PAGE)).collect()]
    assert sorted(got) == sorted(wanted) and any(covered) and not all(covered)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    body = lambda n: "".join(chr(rng.choice([65, 233, 0x6F22])) for _ in range(n))
    same, small = body(500), "tiny"
    htmls = [same, same, small, small, None, "", body(300_000), "WARC/1.1\r\n\r\n" * 20, same] + [body(rng.randint(1, 3_000)) for _ in range(60)]
    rows = [(i + 1, None if i % 7 == 3 else f"http://x/ä b\n{i}", h, None, None) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, PAGE).repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=100_000)
    for split in (997, 50_000, warc.SPLIT_BYTES):
        got = {r.page_id: r for r in warc.read_archives(manifest, split).collect()}
        assert len(got) == len(htmls)
        for i, h in enumerate(htmls):
            data, r = (h or "").encode(), got[i + 1]
            first = next(k for k, other in enumerate(htmls) if (other or "") == (h or ""))
            refers = first + 1 if len(data) >= 100 and first < i else None
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers)
            assert refers is not None or bytes(r.payload) == data
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGE), f"file://{tmp_path}/e")).count() == 0
    assert warc.read_archives(manifest, 997).rdd.getNumPartitions() > 16 > warc.read_archives(manifest).rdd.getNumPartitions()
    twice = warc.write_archives(spark.createDataFrame([(1, "a", same, None, None)] * 2 + [(None, "b", same, None, None), (None, None, None, None, None)], PAGE), f"file://{tmp_path}/t")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_archives(twice).collect()) == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_ranges_own_each_record_once_and_ignore_false_magic():
    import gzip

    records = [warc.record_bytes(k, "u", (warc.MAGIC * 3 + os.urandom(k * 50)), hashlib.sha256(b"").hexdigest(), None) for k in range(1, 12)]
    data = b"".join(gzip.compress(r, 0 if k % 2 else 6) for k, r in enumerate(records))
    for size in (1, 7, 100, 1_000, len(data)):
        source = pa.BufferReader(data)
        got = [r for s in range(0, len(data), size) for r in warc.read_range(source, s, min(s + size, len(data)), ahead=64)]
        assert got == records
    with pytest.raises(EOFError):
        list(warc.read_range(pa.BufferReader(data[:-20]), 0, len(data) - 20))
    place = len(gzip.compress(records[0], 6))
    for at in (0, place, place + 15, place + 60, len(data) // 2, len(data) - 6):  # magic, headers, body, check sum
        damaged = data[:at] + bytes([data[at] ^ 0x5A]) + data[at + 1 :]
        with pytest.raises((ValueError, EOFError)):
            for s in range(0, len(data), 300):
                for record in warc.read_range(pa.BufferReader(damaged), s, min(s + 300, len(data)), ahead=64):
                    assert record in records
    revisit, response = warc.record_bytes(2, "u", b"x" * 200, "d", 1), warc.record_bytes(1, "v", b"x" * 200, "d", None)
    field = lambda record, name: next(line for line in record.decode().split("\r\n") if line.startswith(name + ":")).split(": ")[1]
    assert field(revisit, "WARC-Refers-To") == field(response, "WARC-Record-ID") != field(revisit, "WARC-Record-ID")


def test_trie_walk_equals_edit_distance():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(4)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(30)]
    trie, scorer = toxicity.Trie(dict.fromkeys(terms, 1.0)), toxicity.Scorer(dict.fromkeys(terms, 1.0), {})
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        nearest = min(distance(word, t) for t in terms)
        found = trie.near(word)
        assert (found is None) == (nearest > 1) and (found is None or found[2] == nearest)
        assert (scorer.match(word) is None) == (nearest > 1)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(1_500):
        toxic = i % 6 == 0
        words = [word() for _ in range(60)]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["blockhead", "numskull", "zoqu" + word()]))
        docs.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(toxic)))
    docs += [(5_001, None, "x", 0.0), (5_002, "", "x", 0.0), (5_003, "you blokhead and numskul", "x", 0.0), (5_004, "zz " * 200_000, "x", 0.0), (5_004, "zz " * 200_000, "x", 0.0)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(frame, marks).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    tested = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(tested) > 200 and sum(p == y for p, y in tested) >= 0.99 * len(tested)
    assert got[5_001].score == got[5_002].score < 0.5 < got[5_003].score and all(r.predicted == (r.score >= 0.5) for r in rows)
    assert {i for i, _ in labels if got[i].held_out} == {i for i, _ in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    clean = toxicity.keep_clean(frame, marks)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in rows if not r.predicted)
    assert toxicity.score_documents(frame.where("false"), marks).count() == 0
    again = toxicity.score_documents(frame.repartition(7), marks.repartition(2)).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in rows)


def test_without_usable_labels_every_document_is_clean(spark):
    frame = spark.createDataFrame([(i, f"word{i} and more", None) for i in range(40)] + [(None, "x", None)], "doc_id long, text string, score double")
    for rows in ([], [(i, None) for i in range(40)], [(i, 1) for i in range(40)], [(i, 0) for i in range(40)], [(i, i % 2) for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]):
        marks = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert toxicity.keep_clean(frame, marks).count() == 41
        assert {r.predicted for r in toxicity.score_documents(frame, marks).collect()} == {0}


def test_misspelled_terms_below_a_stem_are_found():
    scorer = toxicity.Scorer(dict.fromkeys(["idiot", "idiots", "idiotic"], 3.0), {"idiot": 3.0})
    assert [scorer.match(w) and scorer.match(w)[1] for w in ("idiot", "idiotism", "idoit", "ldiot", "idioot", "idit", "idiom", "radio")] == [0, 2, 1, 1, 1, 1, 1, None]
    texts = ["fine", "", "an IDOIT!", "x" * 3_000_000 + " ldiot", "é漢 idiot's", "idi_ot"]
    assert scorer.with_hits(texts)[0].tolist() == [False, False, True, True, True, False] == [any(scorer.features(t)[1:]) for t in texts]
    assert [scorer.with_hits([t])[0][0] for t in texts] == scorer.with_hits(texts)[0].tolist()
    assert scorer.features_of(texts).tolist() == [scorer.features(t) for t in texts]


def test_quotation_counts_less():
    scorer = toxicity.Scorer({"blockhead": 3.0}, {})
    abuse, quoted = scorer.features("you are a blockhead indeed"), scorer.features('he said "blockhead" once')
    assert abuse[1] > 0 and quoted[1] == 0 and quoted[3] > 0 and quoted[4] < abuse[4]
    assert toxicity.Scorer({"blockhead": 3.0}, {}, frozenset(["blockheads"])).match("blockheads") is None


def test_license_forms(spark):
    isc = next(t for name, t in license_scan.KNOWN if name == "ISC")
    texts = ["Copyright (c) 2020 A\n" + isc.upper().replace(" ", "\n", 3), "x\nlicensed under the APACHE licence  version 2.0\nReleased under the “MIT” License!\n", None, "", "© me", "Licensed under CC BY-NC 4.0. Really."]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = sorted((r.doc_id, r.license, r.line_licenses, r.n_license_lines) for r in license_scan.scan_licenses(docs, license_scan.known_licenses(spark)).collect())
    assert got == [(0, "ISC", "", 0), (1, None, "Apache-2.0,MIT", 2), (2, None, "", 0), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0)]
    assert license_scan.scan_licenses(docs.where("false"), license_scan.known_licenses(spark)).count() == 0


def test_whole_licenses_are_found_inside_documents(spark):
    published = "/usr/share/common-licenses"
    texts = {name: text for name, text in license_scan.KNOWN if "\n" in text}
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts |= {name: open(f"{published}/{file}", encoding="utf-8").read() for name, file in files.items() if os.path.exists(f"{published}/{file}")}
    rows = [(name, text) for name, text in texts.items()] + [(name, f"Project x\n\nCopyright (c) 2020 me\n{text[:90]} ... {text}\nthe end") for name, text in texts.items()] + [(name + "!", text[: len(text) - 30]) for name, text in texts.items()]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs, license_scan.known_licenses(spark)).collect()}
    for k, (name, _) in enumerate(rows):
        assert name.endswith("!") and not got[k].contained or name in got[k].contained.split(","), name
        assert got[k].license == (name if k < len(texts) else None)


def test_wrapped_licenses_are_found_at_any_width(spark):
    known = [(name, text) for name, text in license_scan.KNOWN if "\n" in text]
    rows = []
    for name, text in known:
        for width in range(60, 101):
            body = "\n\n".join(textwrap.fill(part, width, break_on_hyphens=False) for part in text.split("\n\n"))
            rows += [(name, f"Copyright (c) 2019 A. Person\n\n{body}"), (name, f"Words before.\nCopyright 2019, A. Person\n(c) 2020 B\n{body}\nand behind.")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs, license_scan.known_licenses(spark)).collect()}
    for k, (name, _) in enumerate(rows):
        assert got[k].contained == name and got[k].license == (None if k % 2 else name)


def test_repeated_heads_of_a_license_take_linear_time(spark):
    head = next(t for name, t in license_scan.KNOWN if name == "ISC")[:70]
    docs = spark.createDataFrame([(n, (head + " ") * n) for n in (1_000, 8_000)], "doc_id long, text string")
    began = time.time()
    assert {r.contained for r in license_scan.scan_licenses(docs, license_scan.known_licenses(spark)).collect()} == {""}
    assert time.time() - began < 60


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, near = [], []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(32)
            for _ in range(rng.integers(1, 12)):
                rows.append((len(rows), (base + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.25])).tolist(), label, 0))
    rows += [(len(rows) + k, v, 0, 0) for k, v in enumerate([None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0], [1e200] * 32])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, size int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    units = [embedding_dedup.unit(v) if label is not None else None for _, v, label, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is None or units[b] is None or rows[a][2] != rows[b][2] or len(units[a]) != len(units[b]):
                continue
            cosine = float(units[a] @ units[b])
            if cosine >= 0.93:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
            near.append(cosine)
    assert sum(links) > 100 and [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == [(links[i], find(i)) for i in range(len(rows))]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 50_000, 2_000_000, 100_000_000])
def test_filter_recall(n):
    rng, shared, kept = np.random.default_rng(1), [], []
    codewords, cap, least = embedding_dedup.filters_for(n)
    for _ in range(150):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        other = 0.93 * x + np.sqrt(1 - 0.93**2) * y
        lists = [embedding_dedup.list_decode(v, codewords, cap, least) for v in (x, other)]
        shared.append(len(np.intersect1d(*lists)))
        kept.append(len(lists[0]))
    assert np.mean(np.array(shared) > 0) >= 0.97
    # a vector's filters grow by a power of log n, a filter's vectors hardly
    assert np.mean(kept) < 900 and n * np.mean(kept) / codewords**3 < 12


def test_list_decode_is_complete():
    vector = embedding_dedup.unit(np.random.default_rng(3).standard_normal(16).tolist())
    code = embedding_dedup.product_code(16, 30)
    scores = [words @ vector[dims] for dims, words in code]
    total = (scores[0][:, None, None] + scores[1][:, None] + scores[2]).ravel()
    cut = min(3.75 / 4, np.sort(total)[::-1][31])
    assert set(embedding_dedup.list_decode(vector, 30, 3.75, 32)) == set(np.flatnonzero(total >= cut - 1e-12))


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        assert out.join(docs, columns[0], "left_anti").isEmpty()
        docs = out
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == docs.count()
