"""Small cases of node, variant, interval, dataset and source operators."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import variants as fv
from strandloom.operators import dataset, graph, intervals, nodes, ranks, variants
from strandloom.plans import gam_files
from strandloom.sources import alignment_files, graph_files, json_objects, summary_files, vcf


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlap_join_makes_each_pair_once(spark):
    left = spark.createDataFrame([("c", 0, 5_000, 1), ("c", 990, 1_010, 2), ("d", 0, 10, 3), ("c", 20_000, 20_001, 4)], "chrom string, s long, e long, id int")
    right = spark.createDataFrame([("c", 900, 2_100, 7), ("c", 4_999, 5_001, 8), ("c", 5_000, 5_002, 9)], "r_chrom string, rs long, re long, rid int")
    found = intervals.overlap_join(left, right, ("chrom", F.col("s"), F.col("e")), ("r_chrom", F.col("rs"), F.col("re")))
    assert rows_of(found.select("id", "rid")) == [(1, 7), (1, 8), (2, 7)]
    for how, ids in (("left_semi", [1, 2]), ("left_anti", [3, 4])):
        kept = intervals.overlap_join(left, right, ("chrom", F.col("s"), F.col("e")), ("r_chrom", F.col("rs"), F.col("re")), how)
        assert sorted(r.id for r in kept.collect()) == ids


def test_intervals_of_all_lengths_equal_brute_force(spark):
    rng = random.Random(14)
    size = lambda: rng.choice([0, 1, 5, 900, 1_000, 1_001, 8_000, 8_001, 70_000, 5_000_000, 300_000_000])
    rows = lambda n: [(rng.choice("cd"), at := rng.choice([0, 999, 1_000, 7_999, 8_000, rng.randint(0, 400_000_000)]), at + size(), k) for k in range(n)]
    left, right = rows(150), rows(150)
    l, r = spark.createDataFrame(left, "chrom string, s long, e long, id int"), spark.createDataFrame(right, "r_chrom string, rs long, re long, rid int")
    sides = ("chrom", F.col("s"), F.col("e")), ("r_chrom", F.col("rs"), F.col("re"))
    wanted = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert rows_of(intervals.overlap_join(l, r, *sides).select("id", "rid")) == wanted and len(wanted) > 1_000
    assert sorted(x.id for x in intervals.overlap_join(l, r, *sides, "left_anti").collect()) == sorted({a[3] for a in left} - {a for a, _ in wanted})
    long = spark.createDataFrame([("c", 17, 100_000_017)], "chrom string, __ls long, __le long").withColumn("__lo", intervals._own_level(F.col("__le") - F.col("__ls"), intervals.BIN))
    assert intervals._bins(long, "l", F.col("__lo"), intervals.BIN).count() <= 2


def test_truth_rules(spark):
    truth = spark.createDataFrame([("chr1", 100, "ACGT", ["A"]), ("chr1", 200, "A", ["AGG"]), ("chr1", 300, "C", ["T"]), ("chr1", 400, "A", ["atgg"]), ("chr1", 500, "GT", ["G"])], "chrom string, pos long, ref string, alts array<string>")
    cand = spark.createDataFrame([
        (1, "chr1", 100, 1, "D", "CGT", "*"), (2, "chr1", 200, 0, "I", "A", "GG"), (3, "chr1", 300, 0, "X", "C", "T"), (4, "chr1", 300, 0, "X", "C", "G"), (5, None, None, 0, "X", "C", "T"), (6, "chr1", 299, 0, "X", "C", "T"), (7, "chr1", 302, 0, "X", "C", "T"),
        (8, "chr1", 400, 0, "I", "A", "GG"), (9, "chr1", 400, 0, "I", "A", "TG"), (10, "chr1", 500, 1, "D", "T", "*"), (11, "chr1", 499, 3, "D", "T", "*"), (12, "chr1", 500, 0, "D", "A", "*"),
    ], "node_id long, chrom string, start long, v_pos int, v_type string, v_ref string, v_alt string")
    got = {r.node_id: r.label for r in intervals.truth_label(cand, truth).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: -1, 6: 1, 7: 0, 8: 0, 9: 1, 10: 1, 11: 1, 12: 1}


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(200, 200 + k) for k in range(1, 40)] + [(7, 7), (500, 400)]
    labels = dict(rows_of(graph.connected(spark.createDataFrame(chain, "a long, b long"))))
    assert {labels[i] for i in range(1, 61)} == {1} and {labels[i] for i in range(200, 240)} == {200} and labels[500] == 400
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_logarithmic_rounds(spark):
    chain = spark.range(9_999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 3_000).select(F.lit(1_500).cast("long").alias("a"), F.col("id").alias("b"))
    grid = spark.range(2_500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("b % 50 <> 0").union(spark.range(2_450).select(F.col("id").alias("a"), (F.col("id") + 50).alias("b")))
    for edges, lowest, n in ((chain, 0, 10_000), (star, 1, 2_999), (grid, 0, 2_500)):
        rounds = graph.contractions(edges, alone=0)
        assert len(rounds) <= 12
        assert [tuple(r) for r in graph.labels(rounds).groupBy("component").count().collect()] == [(lowest, n)]


def test_components_equal_a_search(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    lowest = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in range(len(lowest)):
        for a, b in edges:
            if a != b:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    for alone in (0, 100, 10_000):
        assert dict(rows_of(graph.connected(spark.createDataFrame(edges, "a long, b long"), alone))) == lowest


def test_ambiguous_anchor_is_removed_and_missing_segment_fails(spark):
    base = spark.createDataFrame([(1, 5), (2, 5)], "node_id long, length int")
    coords = spark.createDataFrame([(1, "c", 1, "+"), (2, "c", 9, "+"), (2, "d", 3, "-")], "node_id long, chrom string, start long, strand string")
    assert rows_of(nodes.attach_coordinates(base, coords).select("node_id", F.coalesce("chrom", F.lit("-")))) == [(1, "c"), (2, "-")]
    with pytest.raises(Exception, match="no segment for node 3"):
        nodes.path_lengths(spark.createDataFrame([(3, 0, "c")], "node_id long, step int, chrom string"), base).collect()


def test_frequency_levels(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1e-6,), (0.5,), (1.0,)], "af double")
    assert [tuple(r) for r in df.select(nodes.af_level(F.col("af")), nodes.af_digit(F.col("af"))).collect()] == [(0, "0"), (1, "0"), (2, "1"), (8, "7"), (1, "7")]
    histogram = variants.af_histogram(df.select(F.array("af").alias("afs")))
    assert [r.n for r in histogram.orderBy("bin").collect()] == [2, 0, 0, 0, 0, 0, 1, 1]


def test_panels(spark):
    kind = "chrom string, pos long, ref string, alts array<string>, filters array<string>, info map<string,string>"
    calls = spark.createDataFrame([("chrM", 5, "a", ["c", "G"], ["PASS"], {}), ("chr2", 7, "A", ["T"], ["PASS", "x"], {}), ("chr3", 9, "A", ["T"], [], {})], kind)
    panel = lambda *rows: spark.createDataFrame(list(rows), "chrom string, pos long, ref string, alts array<string>") if rows else spark.createDataFrame([], "chrom string, pos long, ref string, alts array<string>")
    matched = variants.pon_match(calls, panel(("MT", 5, "A", ["G", "T"])), panel(("chr2", 7, "A", ["C"])), panel(("2", 7, "G", ["C"])), panel())
    assert [r.panels for r in matched.orderBy("pos").collect()] == [["PoN1"], ["PoN3"], []]
    noted = variants.pon_annotate(matched).orderBy("pos").collect()
    assert [r.filters for r in noted] == [["PanelOfNormals"], ["PASS", "x", "PanelOfNormals"], []]
    assert variants.pon_annotate(matched, drop=True).count() == 1


def test_filters_decisions_and_info(spark):
    f = spark.createDataFrame([(["PASS"],), ([],), (["PASS", "x"],), (["x"],)], "f array<string>")
    assert [tuple(r) for r in f.select(fv.vcf_pass(F.col("f")), fv.vcf_pass(F.col("f"), False)).collect()] == [(True, True), (False, True), (False, True), (False, False)]
    p = spark.createDataFrame([(0.2, False, False), (0.2, True, True), (0.5, True, True), (None, True, True), (0.1, False, False)], "p double, t boolean, a boolean")
    assert [r[0] for r in p.select(fv.keep_decision(F.col("p"), F.col("t"), F.col("a"))).collect()] == ["PASS", None, "PASS", None, None]
    simple = p.select(fv.keep_decision_simple(F.col("t").cast("string"), F.col("p"), 0.4)).collect()
    assert [r[0] for r in simple] == [None, None, "PASS", "PASS", None]
    info = spark.createDataFrame([("DP=3;FLAG;X=a=b",), (".",), ("",)], "i string").select(fv.info_map(F.col("i"))).collect()
    assert [r[0] for r in info] == [{"DP": "3", "FLAG": "true", "X": "a=b"}, {}, {}]


def test_vcf_round_trip_orders_contigs(spark, tmp_path):
    kind = "chrom string, pos long, id string, ref string, alts array<string>, qual string, filters array<string>, info map<string,string>"
    rows = spark.createDataFrame([(c, p, None, "A", ["C"], ".", ["PASS"], {"B": "1", "A": "2"}) for c, p in (("chrX", 1), ("chr10", 5), ("chr2", 9), ("weird", 1), ("chrM", 3), ("chr2", 1))], kind)
    vcf.write_vcf(rows, str(tmp_path / "v"))
    head = [r.value for r in spark.read.text(str(tmp_path / "v/header")).collect()]
    assert head[1:-1] == [f"##contig=<ID={c}>" for c in ("chr2", "chr10", "chrX", "chrM", "weird")] and head[-1].startswith("#CHROM")
    assert rows_of(vcf.read_written(spark, str(tmp_path / "v")).select("chrom", "pos")) == rows_of(rows.select("chrom", "pos"))


def test_framed_alignments(spark, tmp_path):
    row = {"name": "r1", "sequence": "ACGT", "quality": b"\x01\x02\x00\xff", "mapping_quality": 60, "identity": 0.75, "refpos": [{"name": "chr1", "offset": 5, "is_reverse": True}],
           "path": {"mapping": [{"position": {"node_id": 7, "offset": 3, "is_reverse": False}, "edit": [{"from_length": 4, "to_length": 4, "sequence": ""}], "rank": 1}]}}
    plain = gam_files.encode_group([row], b"OTHER") + gam_files.encode_group([row, row | {"name": "r2"}])
    (tmp_path / "a.gam").write_bytes(plain)
    (tmp_path / "b.gam").write_bytes(gzip.compress(plain[:40]) + gzip.compress(plain[40:]))  # two members
    (tmp_path / "c.gam").write_bytes(gam_files.bgzf(plain))
    got = alignment_files.read_gam(spark, str(tmp_path)).orderBy("name").collect()
    assert [r.name for r in got] == ["r1"] * 3 + ["r2"] * 3
    assert got[0].asDict(True) | {"quality": bytes(got[0].quality)} == row
    few = alignment_files.read_gam(spark, str(tmp_path), ("path", "name"))
    assert few.columns == ["name", "path"] and few.orderBy("name").first().path.asDict(True) == row["path"]
    (tmp_path / "c.gam").write_bytes(plain[:-3])
    with pytest.raises(Exception, match="ends within a group"):
        alignment_files.read_gam(spark, str(tmp_path)).collect()


def test_every_alignment_is_owned_once_at_any_split(tmp_path):
    rng = random.Random(9)
    names, content = [], b""
    for group in range(60):
        rows = []
        for _ in range(rng.choice([1, 3, 40, 130])):
            names.append(f"read{len(names)}" + rng.choice(["", "\x03GAM", "\x05\x03GAMx"]))  # names that look like a group's tag
            rows.append({"name": names[-1], "sequence": "ACGT" * rng.randint(1, 60), "quality": rng.randbytes(9), "mapping_quality": group, "identity": 0.5, "refpos": [], "path": {"mapping": []}})
        content += gam_files.encode_group(rows) + (gam_files.encode_group(rows[:2], b"OTHER") if group % 7 == 0 else b"")
    files = {"plain": content, "packed": gam_files.bgzf(content, 3_000), "small": gam_files.bgzf(content, 90), "gzip": gzip.compress(content)}
    for kind, data in files.items():
        path = tmp_path / kind
        path.write_bytes(data)
        for split in (1_500, 9_973, 70_001, len(data)):
            tasks = [[alignment_files.decode_alignment(m, ("name",))["name"] for m in alignment_files.range_messages(f"file:{path}", len(data), lo, lo + split)] for lo in range(0, len(data), split)]
            assert sum(tasks, []) == names, (kind, split)
            assert kind == "gzip" or split > 70_000 or sum(map(bool, tasks)) > 3


def test_shard_numbers_and_probabilities(spark):
    df = spark.createDataFrame([("/x9/shard_00012_data.npy",), ("/a/7_part_3.npy",), ("none",)], "p string")
    assert [tuple(r) for r in df.select(summary_files.shard_of(F.col("p")), summary_files.shard_of(F.col("p"), False)).collect()] == [(12, 12), (3, 7), (None, None)]
    p = spark.createDataFrame([({"TRUE": 0.9}, "false", 0.8), (None, "true", 0.8), (None, "false", 0.75)], "m map<string,double>, c string, q double")
    assert [r[0] for r in p.select(summary_files.true_probability(F.col("m"), F.col("c"), F.col("q"))).collect()] == [0.9, 0.8, 0.25]


def test_global_rank_and_shards(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    ranked = dataset.global_rank(df, "k")
    assert ranked.where("k <> rank").isEmpty() and ranked.count() == 1000
    shards = dataset.tensor_shards(df, 300, "k").groupBy("shard_index").count()
    assert rows_of(shards) == [(0, 300), (1, 300), (2, 300), (3, 100)]


def test_split_sizes_and_errors(spark):
    df = spark.range(103).select("id", (F.col("id") % 2).cast("int").alias("label"), F.lit("chr1").alias("chrom"))
    sizes = {(r.label, r.split): r["count"] for r in dataset.split_stratified(df, "label", ["id"], 0.7, 0.2).groupBy("label", "split").count().collect()}
    assert sizes == {(0, "train"): 36, (0, "val"): 10, (0, "test"): 6, (1, "train"): 35, (1, "val"): 10, (1, "test"): 6}
    with pytest.raises(ValueError, match="empty split"):
        dataset.split_by_chrom(df, {"chr1": "train", "chr2": "val"})


def test_neighbour_reader_and_node_ids(spark, tmp_path):
    from strandloom.sources import graph_files

    (tmp_path / "n.tsv").write_text("NODE_id\tLeft_node\tright_NODE\n1\t.\t2\n2\t1\t\n")
    assert [tuple(r) for r in graph_files.read_neighbor_tsv(spark, str(tmp_path / "n.tsv")).orderBy("node_id").collect()] == [(1, None, 2), (2, 1, None)]
    (tmp_path / "ids").write_text("3\n\n3\n5\n")
    assert rows_of(graph_files.read_node_ids(spark, str(tmp_path / "ids"))) == [(3,), (5,)]
    (tmp_path / "bad").write_text("3\nx\n")
    with pytest.raises(Exception, match="not a node id"):
        graph_files.read_node_ids(spark, str(tmp_path / "bad")).collect()


def test_fasta_splits_and_keeps_contigs(spark, tmp_path):
    rng = random.Random(3)
    contigs = {f"c{k}": "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 5_000))) for k in range(9)}
    text = "".join(f">{name} more words\n" + "".join(bases[at : at + 60] + "\n" for at in range(0, len(bases), 60)) for name, bases in contigs.items())
    (tmp_path / "one.fa").write_text(text)
    wanted = sorted((name, k, bases[at : at + 60]) for name, bases in contigs.items() for k, at in enumerate(range(0, len(bases), 60)))
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            read = graph_files.read_fasta(spark, str(tmp_path / "one.fa"))
            assert rows_of(read) == wanted
        graph_files.write_fasta(read, str(tmp_path / "again"))
        assert rows_of(graph_files.read_fasta(spark, str(tmp_path / "again"))) == wanted
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_json_over_several_lines(spark, tmp_path):
    objects = [{"shard_path": "a/shard_3.npy", "index_in_shard": k, "pred_class": "true", "pred_prob": 0.5} for k in range(3)]
    layouts = ["\n".join(map(json.dumps, objects)), json.dumps(objects), json.dumps(objects, indent=2), "[\n" + ",\n".join(map(json.dumps, objects)) + "\n]"]
    for k, text in enumerate(layouts):
        (tmp_path / f"p{k}.json").write_text(text)
        assert sorted((r.shard_index, r.index_within_shard, r.p_true) for r in summary_files.read_predictions(spark, str(tmp_path / f"p{k}.json")).collect()) == [(3, i, 0.5) for i in range(3)]
    (tmp_path / "n.json").write_text(json.dumps({"nodes": [{"node_id": "5", "sequence": "ACG"}, {"node_id": "6", "length": 4}]}, indent=1))
    assert rows_of(graph_files.read_node_json(spark, str(tmp_path / "n.json")).select("node_id", "length")) == [(5, 3), (6, 4)]


def _node(k):
    return {"node_id": str(k), "sequence": "ACGT"[: k % 4 + 1], "genomead_af": [0.5, None], "note": 'br{ace}s "quoted" \\\\ [x]'}


def _small_splits(spark, size="600b"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")


@pytest.fixture
def split_sizes(spark):
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_broken_json_objects_cost_themselves_only(spark, tmp_path, split_sizes):
    nodes_of = lambda lo, hi: [_node(k) for k in range(lo, hi)]
    lines = [json.dumps(n) for n in nodes_of(0, 100)]
    lines[40] = lines[40][:25]  # cut within a string
    lines[41] = lines[41][:-1]  # no closing brace
    lines[60] = lines[60].replace('"sequence": ', '"sequence" ')  # doesn't parse
    lines[70:70] = ["}", "]", "", "not json", "{", '{"other": 1}']
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "pretty.json").write_text(json.dumps({"meta": {"a": [1]}, "nodes": nodes_of(200, 260)}, indent=2))
    whole = json.dumps(nodes_of(300, 340), indent=1).replace('"node_id": "310"', '"node_id": "310', 1)  # an open quote within one object
    (tmp_path / "array.json").write_text(whole)
    (tmp_path / "one_line.json").write_text(json.dumps(nodes_of(400, 430)))
    with gzip.open(tmp_path / "packed.json.gz", "wt") as f:
        f.write("[\n" + ",\n".join(map(json.dumps, nodes_of(500, 540))) + "\n")  # the end is missing
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "long.json").write_text(json.dumps([_node(600) | {"sequence": "A" * 5_000}, _node(601)], indent=1))  # longer than several splits
    wanted = sorted([*(k for k in range(100) if k not in (40, 41, 60)), *range(200, 260), *(k for k in range(300, 340) if k != 310), *range(400, 430), *range(500, 540), 600, 601])
    for size in ("64m", "700b"):
        _small_splits(spark, size)
        got = graph_files.read_node_json(spark, str(tmp_path)).collect()
        assert sorted(r.node_id for r in got) == wanted
        assert all(r.sequence == _node(r.node_id)["sequence"] for r in got if r.node_id != 600)
        told = {r.file.rsplit("/", 1)[1]: (r.records, r.rejected) for r in json_objects.rejected_objects(spark, str(tmp_path), "node_id").collect()}
        assert told == {"lines.json": (97, 3), "pretty.json": (60, 0), "array.json": (39, 1), "one_line.json": (30, 0), "packed.json.gz": (40, 0), "long.json": (2, 0)}


def test_broken_predictions_cost_themselves_only(spark, tmp_path):
    rows = [json.dumps({"shard_path": "a/shard_3.npy", "index_in_shard": k, "pred_class": "true", "probs": {"True": 0.75}, "pred_prob": 0.5}) for k in range(100)]
    (tmp_path / "p.json").write_text("\n".join([*rows[:50], rows[50][:60], *rows[51:]]))
    got = summary_files.read_predictions(spark, str(tmp_path))
    assert sorted((r.shard_index, r.index_within_shard, r.p_true) for r in got.collect()) == [(3, k, 0.75) for k in range(100) if k != 50]


def test_lists_of_any_length_come_in_ordered_parts(spark):
    rows = spark.range(5_000).selectExpr("'c' AS chrom", "IF(id % 50 = 0, 2, 1) AS pos", "concat('r', lpad(id % 2500, 5, '0')) AS name")  # each name twice
    got = ranks.lists_in_parts(rows, ["chrom", "pos"], "name", "names", 700).orderBy("pos", "part").collect()
    assert [(r.pos, r.part, len(r.names)) for r in got] == [(1, 0, 700), (1, 1, 700), (1, 2, 700), (1, 3, 350), (2, 0, 50)]
    for pos in (1, 2):
        assert sum((r.names for r in got if r.pos == pos), []) == sorted({f"r{k % 2500:05d}" for k in range(5_000) if (k % 50 == 0) == (pos == 2)})


def test_exact_medians_by_selection(spark):
    rng = random.Random(15)
    for values in ([], [None], [3], [1, 2], [rng.random() for _ in range(30_001)], [rng.choice([1, 5, 5, 9]) for _ in range(20_000)], [k % 7 - 3 for k in range(9_999)] + [None] * 50):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
        found = sorted(v for v in values if v is not None)
        assert ranks.exact_median(df, "v", 100) == (None if not found else (found[(len(found) - 1) // 2] + found[len(found) // 2]) / 2)
        for rank in (0, len(found) // 3, len(found) - 1, len(found)):
            assert ranks.value_at(df, "v", rank, 100) == (found[rank] if 0 <= rank < len(found) else None)


def test_running_sums(spark):
    rows = [(k % 3 if k % 7 else None, k, k % 5) for k in range(500)]
    got = {r.k: (r.before, r.nth) for r in ranks.running_sum(ranks.running_sum(spark.createDataFrame(rows, "g int, k int, v int").repartition(9), "g", "k", value="v"), "g", "k", column="nth").collect()}
    for g, k, _ in rows:
        earlier = [r for r in rows if r[0] == g and r[1] < k]
        assert got[k] == (sum(r[2] for r in earlier), len(earlier))


def test_bases_of_an_indel_repair_are_never_broadcast(spark):
    rows = spark.createDataFrame([("c", 3, "D", "G", "*"), ("c", 2, "I", "C", "T"), ("d", 4, "D", "A", "*")], "chrom string, pos long, v_type string, ref string, alt string")
    bases = spark.sql("SELECT * FROM VALUES ('c', 'ACGT') AS t(chrom, sequence)").select("chrom", F.posexplode(F.split("sequence", "")).alias("p", "base")).select("chrom", (F.col("p") + 1).cast("long").alias("pos"), "base")
    fixed = variants.fix_indel(rows, bases)
    assert "Broadcast" not in fixed._jdf.queryExecution().sparkPlan().toString()
    assert rows_of(fixed) == [("c", 2, "D", "CG", "C", "left base"), ("c", 2, "I", "C", "CT", "prefixed"), ("d", 3, "D", "NA", "N", "left base")]


def test_last_row_of_an_alt_id_is_that_of_the_last_file(spark, tmp_path):
    (tmp_path / "part-00000.tsv").write_text("REF_NODE\tALT_NODES\n1\t7;8\n2\t8\n")
    (tmp_path / "part-00001.tsv").write_text("REF_NODE\tALT_NODES\n3\t7\n" + "".join(f"{k}\t{k + 1}\n" for k in range(100, 150)))  # larger files are read first
    found = dict(rows_of(graph_files.read_alt_ref_tsv(spark, str(tmp_path))))
    assert (found[7], found[8], found[101], len(found)) == (3, 2, 100, 52)


def test_ranges_of_alignment_files_go_to_many_tasks(spark, tmp_path):
    rows = [{"name": f"r{k}", "sequence": "ACGT" * 20, "quality": b"", "mapping_quality": 9, "identity": 0.5, "refpos": [], "path": {"mapping": []}} for k in range(400)]
    (tmp_path / "a.gam").write_bytes(b"".join(gam_files.encode_group(rows[at : at + 10]) for at in range(0, 400, 10)))
    read = alignment_files.read_gam(spark, str(tmp_path), ("name",), split=4_000)
    assert read.select("name", F.spark_partition_id().alias("p")).groupBy("p").count().count() > 3
    assert sorted(r.name for r in read.collect()) == sorted(r["name"] for r in rows)
