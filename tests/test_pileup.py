"""Micro cases of pileup semantics, and a row-by-row model over random CIGARs."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.operators import dataset, pileup, tensor

SEGMENT = "node_id long, seg_order long, offset long, seq string, bq array<int>, cigar string, mapq int, strand string"
NODE = "node_id long, length int, sequence string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def segments(spark, rows):
    made = [(n, k, off, seq, bq or [30] * len(seq), cig, mapq, strand) for k, (n, off, seq, bq, cig, mapq, strand) in enumerate(rows)]
    return spark.createDataFrame(made, SEGMENT)


def test_gates_and_validity(spark):
    nodes = spark.createDataFrame([(1, 10, "ACGTACGTAC")], NODE)
    segs = segments(spark, [
        (1, 0, "ACGT", None, "4M", 9, "+"), (1, 0, "ACGT", None, "4M", 10, "+"), (1, 0, "ACGT", [1, 2, 3], "4M", 60, "+"), (1, 0, "ACGT", None, "*", 60, "+"),
        (1, 0, "", [], "4M", 60, "+"), (1, 8, "ACGT", None, "4M", 60, "-"),
    ])
    assert [r.seg_order for r in pileup.valid_segments(segs, nodes).collect()] == [1]


def test_minus_strand_turns_offset_sequence_and_quality(spark):
    nodes = spark.createDataFrame([(1, 12, "AACCGGTTACGT")], NODE)
    segs = segments(spark, [(1, 2, "ACGTT", [1, 2, 3, 4, 5], "2M1I2M", 60, "-")])
    row = pileup.valid_segments(segs, nodes).first()
    assert (row.offset, row.seq, row.bq) == (12 - 4 - 2, "AACGT", [5, 4, 3, 2, 1])


def test_candidate_rules(spark):
    nodes = spark.createDataFrame([(1, 10, "ACGNACGTAC")], NODE)
    segs = segments(spark, [
        (1, 0, "ANGTA", None, "5M", 60, "+"),  # N in read and in reference
        (1, 0, "TTTTT", None, "5=", 60, "+"),  # = never varies
        (1, 0, "GGACG", None, "2I3M", 60, "+"),  # insertion at node start
        (1, 8, "ACT", None, "2M5D1M", 60, "+"),  # deletion past the end; base past the end
        (1, 0, "A" + "C" * 51 + "C", None, "1M51I1M", 60, "+"),  # too long
    ])
    found = pileup.detect_variants(pileup.valid_segments(segs, nodes))
    assert rows_of(found.select("seg_order", "v_pos", "v_type", "v_ref", "v_alt")) == [(2, 0, "I", "A", "GG")]
    summary = pileup.allele_summary(pileup.allele_states(pileup.candidate_counts(found), pileup.valid_segments(segs, nodes)))
    assert summary.first().alt_allele_count == 0  # such an insertion never passes


def test_deletion_states_and_quality(spark):
    nodes = spark.createDataFrame([(1, 10, "ACGTACGTAC")], NODE)
    segs = segments(spark, [
        (1, 1, "CGAC", [1, 2, 3, 4], "2M1D2M", 60, "+"), (1, 3, "ACGT", [9, 9, 9, 9], "1D4M", 60, "+"), (1, 1, "CGTAC", [5, 6, 7, 8, 9], "5M", 60, "+"), (1, 2, "GCGT", [7, 7, 7, 7], "1M2D3M", 60, "+"),
    ])
    cand = spark.createDataFrame([(1, 3, "D", "T", "*")], "node_id long, v_pos int, v_type string, v_ref string, v_alt string")
    states = pileup.allele_states(cand, pileup.valid_segments(segs, nodes))
    assert rows_of(states.select("seg_order", "state", "bq")) == [(0, "alt", 2.0), (1, "alt", 50.0), (2, "ref", 7.0), (3, "other", 7.0)]


def test_insertion_states(spark):
    nodes = spark.createDataFrame([(1, 10, "ACGTACGTAC")], NODE)
    segs = segments(spark, [
        (1, 1, "CGGTTA", [1, 2, 3, 4, 5, 6], "2M2I2M", 60, "+"),  # GT after G at 2: the candidate's
        (1, 1, "CGGTA", None, "2M1I2M", 60, "+"),  # another insertion, equal to the base before it
        (1, 1, "CGATA", None, "2M1I2M", 60, "+"), (1, 1, "CGTA", None, "4M", 60, "+"),
        (1, 1, "CGTTA", [1, 2, 3, 4, 5], "1M1D2I2M", 60, "+"),  # the base is deleted before the insertion
        (1, 1, "CG", None, "2M2I", 60, "+"),  # the read ends before its insertion does
        (1, 3, "GTTAC", None, "2I3M", 60, "+"), (1, 4, "ACGT", None, "4M", 60, "+"),  # an insertion before the first base; beyond it
    ])
    cand = spark.createDataFrame([(1, 2, "I", "G", "GT")], "node_id long, v_pos int, v_type string, v_ref string, v_alt string")
    states = pileup.allele_states(cand, pileup.valid_segments(segs, nodes))
    assert rows_of(states.select("seg_order", "state", "bq")) == [(0, "alt", 3.5), (1, "ref", 30.0), (2, "other", 30.0), (3, "ref", 30.0), (4, "other", 1.0), (6, "alt", 30.0)]


def test_rank_keeps_400_of_many(spark):
    nodes = spark.createDataFrame([(1, 30, "ACGTACGTACGTACGTACGTACGTACGTAC")], NODE)
    for n, kept in ((200, 200), (401, 400), (201, 201)):
        segs = segments(spark, [(1, 0, "ACGT", None, "4M", 60, "+")] * (n - 1) + [(1, 0, "ACGTGA", None, "4M1I1M", 60, "+")])
        ranked = pileup.rank_segments(pileup.valid_segments(segs, nodes), "indel")
        assert ranked.count() == kept
        assert ranked.where("rank = 1").first().seg_order == n - 1


def test_variant_keys(spark):
    rows = spark.createDataFrame([(4, "X", "A", "C", "G"), (4, "I", "A", "GG", "A"), (4, "D", "TT", "*", "C"), (0, "D", "T", "*", "N")], "p int, t string, r string, a string, anchor string")
    keys = [r[0] for r in rows.select(cigar.variant_key(F.col("p"), F.col("t"), F.col("r"), F.col("a"), F.col("anchor"))).collect()]
    assert keys == ["4_X_A_C", "4_I_A_AGG", "3_D_CTT_C", "0_D_T_*"]
    parsed = spark.createDataFrame([(k,) for k in [*keys, "x_X_A_C", "1_X_A"]], "k string").select(cigar.parse_variant_key(F.col("k")).alias("v")).collect()
    assert [p.v is not None for p in parsed] == [True] * 4 + [False] * 2


def model(seq, ref, offset, ops):
    """Variants of one read, base by base."""
    found, n, r = [], offset, 0
    for size, op in ops:
        if op in "MX":
            for i in range(size):
                if r + i < len(seq) and n + i < len(ref) and seq[r + i] != ref[n + i] and "N" not in (seq[r + i], ref[n + i]):
                    found.append((n + i, "X", ref[n + i], seq[r + i]))
        anchor = ref[max(n - 1, 0) : max(n - 1, 0) + 1] or "*"
        if op == "I" and size <= 50 and anchor != "N" and seq[r : r + size] and "N" not in seq[r : r + size]:
            found.append((max(n - 1, 0), "I", anchor, seq[r : r + size]))
        if op == "D" and size <= 50 and n + size <= len(ref) and "N" not in ref[n : n + size]:
            found.append((n, "D", ref[n : n + size], "*"))
        n += size if op in "MX=DN" else 0
        r += size if op in "MX=IS" else 0
    return found


def test_random_cigars_match_the_model(spark):
    rng = random.Random(7)
    nodes, rows, wanted = [], [], []
    for node in range(60):
        ref = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randint(8, 40)))
        nodes.append((node, len(ref), ref))
        for _ in range(3):
            ops = [(rng.randint(1, 5), rng.choice("MMMXID=S")) for _ in range(rng.randint(1, 6))]
            seq = "".join(rng.choice("ACGTN" if rng.random() < 0.3 else "ACGT") for _ in range(sum(n for n, o in ops if o in "MX=IS")))
            seq = seq[: len(seq) - rng.choice([0, 0, 0, 2])]  # some reads end within an op
            if seq:
                rows.append((node, rng.randint(0, 6), seq, None, "".join(f"{n}{o}" for n, o in ops), 60, "+"))
                wanted += [(len(rows) - 1, *v) for v in model(seq, ref, rows[-1][1], ops)]
    found = pileup.detect_variants(pileup.valid_segments(segments(spark, rows), spark.createDataFrame(nodes, NODE)))
    assert rows_of(found.select("seg_order", "v_pos", "v_type", "v_ref", "v_alt")) == sorted(wanted)


def test_earlier_rules(spark):
    nodes = spark.createDataFrame([(1, 6, "ACGTAC")], NODE)
    segs = segments(spark, [(1, 0, "GGACT", None, "2I3M", 60, "+"), (1, 1, "CGTA", None, "1M4D1M2M", 60, "+"), (1, 3, "TAGGG", None, "5M1I", 60, "+"), (1, 3, "TG", None, "1M5D1M", 60, "+")])
    found = pileup.detect_variants_v1(pileup.valid_segments(segs, nodes))
    assert rows_of(found.select("seg_order", "v_pos", "v_type", "v_ref", "v_alt")) == [(0, -1, "I", "-", "GG"), (0, 2, "X", "G", "T"), (1, 2, "D", "GTAC", "-"), (2, 5, "X", "C", "G")]


def test_counts_add_up_and_reverse_complement_is_its_own_inverse(spark):
    nodes = spark.createDataFrame([(1, 20, "ACGTACGTACGTACGTACGT")], NODE)
    segs = segments(spark, [(1, k % 3, "ACCTACGT", None, ("8M", "4M1D4M", "3M1I4M")[k % 3], 60, "+-"[k % 2]) for k in range(12)])
    valid = pileup.valid_segments(segs, nodes)
    s = pileup.allele_summary(pileup.allele_states(pileup.candidate_counts(pileup.detect_variants(valid)), valid))
    assert s.where("alt_allele_count + ref_allele_count_at_locus + other_allele_count_at_locus <> coverage_at_locus").isEmpty()
    assert nodes.select(cigar.reverse_complement(cigar.reverse_complement(F.col("sequence"))) == F.col("sequence")).first()[0]


def random_reads(rng, n_nodes, n_reads, deletions="D"):
    nodes, rows = [], []
    for node in range(n_nodes):
        ref = "".join(rng.choice("AC" if node % 2 else "ACGTN") for _ in range(rng.randint(6, 30)))  # repeats shift deletions
        nodes.append((node, len(ref), ref))
        for _ in range(n_reads):
            ops = [(rng.randint(1, 3), rng.choice("MMMMXI=SNPH" + deletions)) for _ in range(rng.randint(1, 8))]
            seq = "".join(rng.choice("AC" if node % 2 else "ACGTN") for _ in range(sum(n for n, o in ops if o in "MX=IS")))
            seq = seq[: len(seq) - rng.choice([0, 0, 0, 2])]
            if seq:
                rows.append((node, rng.randint(0, 6), seq, [rng.randint(0, 60) for _ in seq], "".join(f"{n}{o}" for n, o in ops), 60, rng.choice("++-")))
    return nodes, rows


def test_counts_by_sweep_equal_counts_of_states(spark, monkeypatch):
    monkeypatch.setattr(pileup, "COVERAGE_BLOCK", 5)
    nodes, rows = random_reads(random.Random(11), 40, 25, "DDDII")
    valid = pileup.materialize(pileup.valid_segments(segments(spark, rows), spark.createDataFrame(nodes, NODE)), "valid")
    found = pileup.candidate_counts(pileup.detect_variants(valid))
    columns = [*pileup.VARIANT, "alt_allele_count", "ref_allele_count_at_locus", "other_allele_count_at_locus", "coverage_at_locus", "alt_allele_frequency", F.round("mean_alt_allele_base_quality", 9)]
    got, wanted = (sorted((tuple(r) for r in df.select(*columns).collect()), key=str) for df in (pileup.allele_counts(found, valid), pileup.allele_summary(pileup.allele_states(found, valid))))
    assert got == wanted and {r[2] for r in got} == {"X", "I", "D"} and len(got) > 500


def test_sweep_is_linear_in_depth(spark):
    """100,000 segments on one node, each with a difference of its own: pairs with its candidates would be millions."""
    nodes = spark.createDataFrame([(1, 200, "ACGTACGTAC" * 20)], NODE)
    kinds = "element_at(array('8M', '4M1D4M', '3M1I4M', '8='), int(id % 4) + 1)"
    segs = spark.range(100_000).selectExpr("1L AS node_id", "id AS seg_order", "id % 150 AS offset", "concat(substring('ACGTACGT', 1, int(id % 8)), 'A', substring('ACGTACGT', 1, int(7 - id % 8))) AS seq", "array_repeat(int(id % 40), 8) AS bq", f"{kinds} AS cigar", "60 AS mapq", "'+' AS strand")
    valid = pileup.valid_segments(segs, nodes)
    counts = pileup.allele_counts(pileup.candidate_counts(pileup.detect_variants(valid)), valid)
    assert "seg_order" not in " ".join(line for line in counts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line or "Project" in line)
    assert counts.where("coverage_at_locus > 1000").count() > 500


def read_rows(seq: str, bq: np.ndarray, mapq: int, walk: list, begin: int, width: int = tensor.WIDTH) -> tuple[np.ndarray, bool]:
    """base, quality, mapq and CIGAR rows of one segment in a window; False if nothing of it is in there.

    Pads are 0, 0, -1 and 0; a deletion shows as ``*``. The walk stops when the read is used up, so a trailing deletion isn't drawn.
    """
    rows = np.zeros((4, width), np.int16)
    rows[2] = -1
    codes, hit = tensor.BASE_CODE[np.frombuffer(seq.encode(), np.uint8)], False
    for op in walk:
        kind, n, at, read = op["op"], op["n"], op["node_pos"], op["read_pos"]
        if read >= len(seq):
            break
        lo, hi = max(at, begin), min(at + n, begin + width)
        if kind in "MX=" and lo < hi:
            hi = min(hi, at + len(seq) - read)
            place, source = slice(lo - begin, hi - begin), slice(read + lo - at, read + hi - at)
            rows[0, place], rows[1, place] = codes[source], np.minimum(bq[source], 127)
        elif kind in "DN" and lo < hi:
            place = slice(lo - begin, hi - begin)
            rows[0, place] = tensor.BASES["*"]
        else:
            continue
        rows[2, place], rows[3, place] = max(0, min(127, mapq)), tensor.CIGARS[kind]
        hit = True
    return rows, hit


def draw(reads: pd.DataFrame, begin: int, width: int) -> tuple[np.ndarray, dict[tuple[int, str], list[tuple[int, int]]]]:
    """(rows, insertions): each read drawn once, [reads, 4, width]; (position, bases) -> reads with that insertion and its quality."""
    drawn, inserted = np.zeros((len(reads), 4, width), np.int16), {}
    for no, (seq, bq, mapq, walk) in enumerate(zip(reads["seq"], reads["bq"], reads["mapq"], reads["walk"], strict=True)):
        quality = np.asarray(bq, np.int16)
        drawn[no] = read_rows(seq, quality, int(mapq), walk, begin, width)[0]
        for op in walk:
            if op["op"] == "I" and op["read_pos"] < len(seq):
                own = slice(op["read_pos"], op["read_pos"] + op["n"])
                inserted.setdefault((op["node_pos"] - 1, seq[own]), []).append((no, min(127, round(float(quality[own].mean())))))
    return drawn, inserted


def window_begin(variant: dict, width: int = tensor.WIDTH) -> int:
    """The node position of a window's first column: an insertion's window is centred on the base behind it."""
    return int(variant["v_pos"]) + (variant["v_type"] == "I") - width // 2


def tensor_of(variant: dict, node_seq: str, drawn: np.ndarray, inserted: dict, first: int, rows: int, width: int) -> tuple[np.ndarray, int]:
    """A candidate's tensor from reads drawn from position ``first`` on; see ``build_tensor``."""
    out = np.zeros((tensor.CHANNELS, 1 + rows, width), np.int8)
    out[2] = out[3] = -1
    begin = window_begin(variant, width)
    at = int(variant["v_pos"]) - begin
    lo, hi = max(0, begin), min(len(node_seq), begin + width)
    if lo < hi:
        out[0, 0, lo - begin : hi - begin] = tensor.BASE_CODE[np.frombuffer(node_seq[lo:hi].encode(), np.uint8)]
    window = drawn[:, :, begin - first : begin - first + width]
    hit = (window[:, 3] > 0).any(1)
    borne = inserted.get((int(variant["v_pos"]), variant["v_alt"]), []) if variant["v_type"] == "I" else []
    if borne:
        window = window.copy()
        for no, quality in borne:
            window[no, 0, at], window[no, 1, at], hit[no] = tensor.INSERTED, quality, True
    chosen = np.flatnonzero(hit)[:rows]
    shown, used = window[chosen], len(chosen)
    both = (shown[:, 0] > 0) & (out[0, 0] > 0)
    differ = both & (shown[:, 0] != out[0, 0])
    out[0, 1 : used + 1], out[1, 1 : used + 1], out[3, 1 : used + 1], out[4, 1 : used + 1] = shown.transpose(1, 0, 2)
    out[2, 1 : used + 1] = np.where(both, differ, -1)
    if 0 <= at < width:
        out[2, 1 : used + 1, at][differ[:, at]] = 5
    return out, used


def build_tensor(variant: dict, node_seq: str, reads: pd.DataFrame, rows: int = tensor.ROWS, width: int = tensor.WIDTH) -> tuple[np.ndarray, int]:
    """int8 [5, 1 + rows, width]: base, quality, mismatch, mapq and CIGAR channels; row 0 has the reference's bases.

    Mismatches are 0 and 1 where read and reference both have a base, 5 for a mismatch at the variant, else -1. A read
    that bears the insertion shows it at the variant with its mean quality.
    """
    first = window_begin(variant, width)
    return tensor_of(variant, node_seq, *draw(reads, first, width), first, rows, width)


def test_tensor_model():
    walk = [{"n": 3, "op": "M", "node_pos": 0, "read_pos": 0}, {"n": 2, "op": "I", "node_pos": 3, "read_pos": 3}, {"n": 2, "op": "M", "node_pos": 3, "read_pos": 5}, {"n": 4, "op": "D", "node_pos": 5, "read_pos": 7}]
    reads = pd.DataFrame([{"seq": "ACTGGTA", "bq": [200, 2, 3, 10, 21, 6, 7], "mapq": 300, "walk": walk}])
    data, used = build_tensor({"v_pos": 2, "v_type": "I", "v_ref": "G", "v_alt": "GG"}, "ACGTACGT", reads)
    assert data.shape == (5, 201, 100) and used == 1
    at = 49  # node position 2 in a window around 3
    assert data[0, 0, at - 2 : at + 2].tolist() == [20, 30, 50, 70]
    assert data[0, 1, at - 2 : at + 3].tolist() == [20, 30, 90, 70, 20]
    assert data[1, 1, at - 2 : at + 1].tolist() == [127, 2, round(15.5)]
    assert data[2, 1, at - 2 : at + 3].tolist() == [0, 0, 5, 0, 0] and data[2, 0].tolist() == [-1] * 100
    assert set(data[3, 1].tolist()) == {-1, 127} and data[4, 1, at] == 10
    assert np.count_nonzero(data[0, 1]) == 5  # the trailing deletion isn't drawn


def test_tensors_by_arrays_equal_the_model(spark):
    rng = random.Random(12)
    nodes, rows = random_reads(rng, 8, 40, "DDII")
    long = "".join(rng.choice("ACGT") for _ in range(700))
    nodes.append((99, 700, long))
    for _ in range(150):
        at = rng.randint(0, 600)
        ops = [(rng.randint(5, 40), "M"), (rng.randint(1, 3), rng.choice("IDNX")), (rng.randint(5, 40), "M")]
        seq = "".join(rng.choice("ACGT") for _ in range(sum(n for n, o in ops if o in "MXI")))
        rows.append((99, at, seq, [rng.randint(0, 200) for _ in seq], "".join(f"{n}{o}" for n, o in ops), rng.choice([10, 60, 300]), "+"))
    ranked = pileup.materialize(pileup.rank_segments(pileup.valid_segments(segments(spark, rows), spark.createDataFrame(nodes, NODE))), "ranked")
    found = pileup.candidate_counts(pileup.detect_variants(ranked)).where("v_type <> 'X' OR node_id <> 99 OR v_pos % 9 = 0")
    for shown in (200, 7):
        got = {tuple(r[:5]): (r.n_rows, bytes(r.data)) for r in tensor.tensors(found, ranked, shown).collect()}
        reads = ranked.toPandas()
        wanted = {}
        for v in found.collect():
            own = reads[reads["node_id"] == v.node_id].sort_values("rank")
            data, used = build_tensor(v.asDict(), own["node_seq"].iloc[0], own, shown)
            wanted[tuple(v[:5])] = (used, data.tobytes())
        assert len(wanted) > 200 and {k for k in wanted if wanted[k][0]} <= set(got)
        assert all(wanted[k] == value for k, value in got.items())


def test_empty_tables(spark):
    nodes, segs = spark.createDataFrame([], NODE), spark.createDataFrame([], SEGMENT)
    assert pileup.candidate_summary(segs, nodes).count() == 0


def test_candidates_take_one_pass_over_the_segments(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, 10, "ACGTACGTAC")], NODE)
    segs = segments(spark, [(1, 0, "ACTTA", None, "5M", 60, "+")] * 3 + [(1, 2, "GTGGAC", None, "2M2I2M", 60, "+")] * 3 + [(1, 1, "CGAC", None, "2M1D2M", 60, "+")] * 3)
    plans, real = [], pileup.materialize
    seen = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(pileup, "materialize", lambda df, label, *by: seen(df) or real(df, label, *by))
    found = pileup.candidate_summary(segs, nodes)
    seen(found)
    read = [x for plan in plans for x in plan.splitlines() if any(k in x for k in ("LogicalRDD", "LocalRelation", "Relation [")) and any(k in x for k in ("cigar#", "walk#"))]
    assert len(read) == 1
    assert rows_of(found.select("v_pos", "v_type", "v_ref", "v_alt", "alt_allele_count", "coverage")) == [(2, "X", "G", "T", 3, 9), (3, "D", "T", "*", 3, 9), (3, "I", "T", "GG", 3, 9)]


def cells(begin, width, seq, walk):
    """A view's row, one cell after another."""
    out = []
    for p in range(begin, begin + width):
        over = next((w for w in walk if w.op in "MXD" and w.node_pos <= p < w.node_pos + w.n), None)
        out.append("." if over is None else "*" if over.op == "D" else seq[over.read_pos + p - over.node_pos :][:1])
    return "".join(out)


def test_view_rows_equal_cells_and_are_drawn_op_by_op(spark):
    rng = random.Random(5)
    nodes = spark.createDataFrame([(n, 40, "".join(rng.choices("ACGT", k=40))) for n in (1, 2)], NODE)
    made = []
    for _ in range(60):
        ops = [(rng.randint(1, 6), rng.choice("MMMMX=DINS")) for _ in range(rng.randint(1, 5))]
        read = "".join(rng.choices("ACGT", k=max(1, sum(n for n, op in ops if op in "MX=IS") - rng.choice((0, 0, 3)))))
        made.append((rng.choice((1, 2)), rng.randint(0, 25), read, None, "".join(f"{n}{op}" for n, op in ops), 60, "+"))
    valid = pileup.valid_segments(segments(spark, made), nodes)
    variants = spark.createDataFrame([(n, p, kind, "A", "C") for n in (1, 2) for p, kind in ((3, "X"), (20, "I"), (33, "D"))], "node_id long, v_pos int, v_type string, v_ref string, v_alt string")
    view = pileup.pileup_view(valid, variants, width=12, reads=7)
    assert "sequence(begin" not in view._jdf.queryExecution().optimizedPlan().toString()
    wanted = []
    for v in variants.collect():
        begin, rows = v.v_pos + (v.v_type == "I") - 6, sorted((s for s in valid.collect() if s.node_id == v.node_id), key=lambda s: s.seg_order)
        texts = [t for t in (cells(begin, 12, s.seq, s.walk) for s in rows) if t.strip(".")]
        wanted += [(v.node_id, v.v_pos, v.v_type, k, t) for k, t in enumerate(texts[:7], 1)]
    assert rows_of(view.select("node_id", "v_pos", "v_type", "row_no", "text")) == sorted(wanted)


def test_view_shows_all_candidates_and_all_reads_unless_told(spark):
    rng = random.Random(9)
    nodes = spark.createDataFrame([(1, 3_000, "".join(rng.choices("ACGT", k=3_000))), (2, 40, "ACGT" * 10)], NODE)
    border = pileup.VIEW_BLOCK
    made = [(2, rng.randint(0, 20), "".join(rng.choices("ACGT", k=10)), None, "10M", 60, "+") for _ in range(130)]
    for at in (border - 1, border, 2 * border, 700, 1_500):  # windows and reads on both sides of a block's end
        made += [(1, max(0, at + rng.randint(-70, 60)), "".join(rng.choices("ACGT", k=12)), None, rng.choice(["12M", "5M3D7M", "4M2I6M"]), 60, "+") for _ in range(60)]
    made.append((1, 100, "".join(rng.choices("ACGT", k=2_400)), None, "2400M", 60, "+"))
    valid = pileup.valid_segments(segments(spark, made), nodes)
    places = [(2, p) for p in range(30)] + [(1, b + p) for b in (0, border, 2 * border) for p in (-52, -51, -50, -1, 0, 1, 49, 50, 51) if b + p >= 0]
    variants = spark.createDataFrame([(n, p, "XID"[k % 3], "A", "C") for k, (n, p) in enumerate(places)], "node_id long, v_pos int, v_type string, v_ref string, v_alt string")
    wanted, reads = [], sorted(valid.collect(), key=lambda s: s.seg_order)
    for v in variants.collect():
        begin = v.v_pos + (v.v_type == "I") - 50
        texts = [t for t in (cells(begin, 100, s.seq, s.walk) for s in reads if s.node_id == v.node_id) if t.strip(".")]
        wanted += [(v.node_id, v.v_pos, v.v_type, k, t) for k, t in enumerate(texts, 1)]
    got = rows_of(pileup.pileup_view(valid, variants).select("node_id", "v_pos", "v_type", "row_no", "text"))
    assert got == sorted(wanted) and len({r[1] for r in got if r[0] == 2}) == 30 and max(r[3] for r in got) == 130


def test_tensors_of_many_nodes_are_scored_where_they_are_built(spark, monkeypatch):
    rng = random.Random(21)
    nodes, rows = random_reads(rng, 90, 12, "DDII")
    ranked = pileup.materialize(pileup.rank_segments(pileup.valid_segments(segments(spark, rows), spark.createDataFrame(nodes, NODE))), "ranked")
    found = pileup.materialize(pileup.candidate_counts(pileup.detect_variants(ranked)).select(*pileup.VARIANT), "found")
    mean, std = [10.0, 8.0, 0.0, 0.5, 0.0], [20.0, 15.0, 10.0, 1.0, 1.0]
    wanted = rows_of(dataset.batch_score(tensor.tensors(found, ranked, 7).select(*pileup.VARIANT, "data"), mean, std))
    scored = dataset.score_where_built(found, ranked, mean, std, rows=7)
    assert rows_of(scored) == wanted and len(wanted) > 500 and len({r[0] for r in wanted}) > tensor.NODES
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "data#" not in plan  # no tensor is a column of a table
    # 64 candidates at a time, or fewer where their cells are many
    asked, reads = found.orderBy(*pileup.VARIANT).toArrow(), ranked.withColumnRenamed("node_id", "of_node").orderBy("of_node", "rank").toArrow()
    whole = list(tensor.build_tensors(asked, reads, 7))
    monkeypatch.setattr(tensor, "CELLS", 400)
    parts = list(tensor.build_tensors(asked, reads, 7))
    assert sorted({p.num_rows for p in parts})[0] < max(p.num_rows for p in parts) < tensor.TOGETHER == whole[0].num_rows
    assert [r for p in parts for r in p.to_pylist()] == [r for p in whole for r in p.to_pylist()]


def test_no_tensor_of_the_scoring_query_leaves_its_task(spark):
    from strandloom import catalog

    plan = catalog.queries()["j7_batch_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" not in plan and "FlatMapCoGroupsInArrow" in plan
