"""Node pileups: valid segments, candidate variants, allele states and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.cigar import OP_PATTERN, cigar_ops, cigar_walk, non_m_weight, oriented_offset, reverse_complement, summed, variant_key
from strandloom.session import materialize

VARIANT = ["node_id", "v_pos", "v_type", "v_ref", "v_alt"]


def valid_segments(segments: DataFrame, nodes: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Segments turned to the node's forward strand, with their ops.

    Dropped: lower mapping quality, no CIGAR, sequence and qualities of unequal length, negative oriented offset.
    """
    rows = segments.where(F.col("mapq") >= min_mapq).where("length(seq) > 0 AND length(seq) = size(bq)").where(F.col("cigar").rlike(OP_PATTERN)).withColumn("ops", cigar_ops(F.col("cigar")))
    rows = rows.join(nodes.select("node_id", "length", F.upper("sequence").alias("node_seq")), "node_id")
    minus = F.col("strand") == "-"
    return rows.select(
        "node_id", "seg_order", "mapq", "strand", "node_seq", oriented_offset(F.col("offset"), F.col("strand"), F.col("length"), F.col("seq"), F.col("ops")).cast("int").alias("offset"),
        F.upper(F.when(minus, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).alias("seq"), F.when(minus, F.reverse("bq")).otherwise(F.col("bq")).alias("bq"),
        F.when(minus, F.reverse("ops")).otherwise(F.col("ops")).alias("ops"),
    ).where("offset >= 0").withColumn("walk", cigar_walk(F.col("ops"), F.col("offset")))


def rank_segments(segments: DataFrame, kind: str = "all", rows: int = 200) -> DataFrame:
    """Per node, by weighted non-match length; of nodes with more than ``rows`` segments the first ``2 * rows`` stay."""
    # a node of at most ``rows`` segments has no higher rank, so one bound does, which is applied before the shuffle too
    by = Window.partitionBy("node_id").orderBy(F.desc("weight"), "seg_order")
    ranked = segments.withColumn("weight", non_m_weight(F.col("ops"), kind)).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= 2 * rows)


_MISMATCHES = """filter(transform(sequence(0, greatest(least(w.n, length(seq) - w.read_pos, length(node_seq) - w.node_pos) - 1, 0)), i -> named_struct('v_pos', w.node_pos + i, 'v_type', 'X',
    'v_ref', substring(node_seq, w.node_pos + i + 1, 1), 'v_alt', substring(seq, w.read_pos + i + 1, 1))), v -> v.v_ref <> v.v_alt AND v.v_ref <> 'N' AND v.v_alt <> 'N' AND v.v_ref <> '' AND v.v_alt <> '')"""
_ANCHOR = "substring(node_seq, greatest(w.node_pos - 1, 0) + 1, 1)"
# an insertion takes what the read has left; beyond the node its anchor is ``*``
_INSERTION = f"""filter(array(named_struct('v_pos', greatest(w.node_pos - 1, 0), 'v_type', 'I', 'v_ref', if({_ANCHOR} = '', '*', {_ANCHOR}), 'v_alt', substring(seq, w.read_pos + 1, w.n))),
    v -> w.n <= {{m}} AND v.v_ref <> 'N' AND v.v_alt <> '' AND NOT contains(v.v_alt, 'N'))"""
_DELETION = """filter(array(named_struct('v_pos', w.node_pos, 'v_type', 'D', 'v_ref', substring(node_seq, w.node_pos + 1, w.n), 'v_alt', '*')),
    v -> w.n <= {m} AND w.node_pos + w.n <= length(node_seq) AND v.v_ref <> '' AND NOT contains(v.v_ref, 'N'))"""


def detect_variants(segments: DataFrame, kind: str = "all", max_indel: int = 50) -> DataFrame:
    """Each segment's variants: node_id, seg_order, v_pos, v_type, v_ref, v_alt. ``=`` ops yield none, nor do bases N."""
    found = f"""flatten(transform(walk, w -> CASE WHEN w.op IN ('M', 'X') THEN {_MISMATCHES} WHEN w.op = 'I' THEN {_INSERTION.format(m=max_indel)}
        WHEN w.op = 'D' THEN {_DELETION.format(m=max_indel)} END))"""
    rows = segments.select("node_id", "seg_order", F.explode(F.expr(found.replace("END))", "ELSE array() END))"))).alias("v")).select("node_id", "seg_order", "v.*")
    return rows.where({"snp": "v_type = 'X'", "indel": "v_type IN ('I', 'D')", "all": "true"}[kind])


_OVERRUN = """CASE WHEN w.op IN ('M', 'X', '=') THEN w.read_pos + w.n > length(seq) OR w.node_pos + w.n > length(node_seq) WHEN w.op = 'I' THEN w.read_pos + w.n > length(seq)
    WHEN w.op = 'D' THEN w.node_pos + w.n > length(node_seq) ELSE false END"""
_INSERTION_V1 = "filter(array(named_struct('v_pos', w.node_pos - 1, 'v_type', 'I', 'v_ref', '-', 'v_alt', substring(seq, w.read_pos + 1, w.n))), v -> w.read_pos + w.n <= length(seq))"
_DELETION_V1 = "filter(array(named_struct('v_pos', w.node_pos, 'v_type', 'D', 'v_ref', substring(node_seq, w.node_pos + 1, w.n), 'v_alt', '-')), v -> w.node_pos + w.n <= length(node_seq))"


def detect_variants_v1(segments: DataFrame) -> DataFrame:
    """The earlier rules: a read ends at the first op that runs over its or the node's end, ``-`` stands for a missing
    allele, an insertion's anchor is the last position before it, and indels have no longest length."""
    first_over = f"array_position(transform(walk, w -> {_OVERRUN}), true)"
    used = segments.withColumn("walk", F.expr(f"IF({first_over} = 0, walk, slice(walk, 1, int({first_over})))"))
    found = f"""flatten(transform(walk, w -> CASE WHEN w.op IN ('M', 'X') THEN {_MISMATCHES} WHEN w.op = 'I' THEN {_INSERTION_V1} WHEN w.op = 'D' THEN {_DELETION_V1} ELSE array() END))"""
    return used.select("node_id", "seg_order", F.explode(F.expr(found)).alias("v")).select("node_id", "seg_order", "v.*")


def candidate_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy(*VARIANT).agg(F.count(F.lit(1)).alias("supporting"))


_COVERS = "element_at(filter(walk, w -> w.op IN ('M', 'X', '=', 'D') AND w.node_pos <= v_pos AND v_pos < w.node_pos + w.n), 1)"
_LAST_BASE = "element_at(filter(walk, w -> w.op IN ('M', 'X', '=') AND w.node_pos + w.n <= over.node_pos), -1)"


def allele_states(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Each candidate and segment of a node that says something about it: ``state`` (alt, ref, other) and ``bq``.

    A deletion's quality is that of the last aligned base before it, 50 if there is none. An insertion other than the
    candidate's counts as ref if it equals the base before it; a deletion of that base comes before any insertion.
    """
    reach = F.col("offset") + summed(F.col("ops"), "MX=DN")
    spans = segments.select(F.col("node_id").alias("of_node"), "seg_order", "node_seq", "seq", "bq", "walk", (F.col("offset") - 1).alias("from_pos"), reach.alias("to_pos"))
    # only segments that reach the position, or the one behind it, meet a candidate; both sides are dealt by node
    near = (F.col("node_id") == F.col("of_node")) & (F.col("v_pos") >= F.col("from_pos")) & (F.col("v_pos") < F.col("to_pos"))
    rows = candidates.select(*VARIANT).join(spans, near).drop("of_node", "from_pos", "to_pos")
    rows = rows.withColumn("over", F.expr(f"try_element_at(filter(walk, w -> w.op IN ('M', 'X', '=', 'D') AND w.node_pos <= v_pos AND v_pos < w.node_pos + w.n), 1)"))
    rows = rows.withColumn("ins", F.expr("IF(v_type = 'I', try_element_at(filter(walk, w -> w.op = 'I' AND w.node_pos - 1 = v_pos), 1), NULL)"))
    rows = rows.withColumn("at", F.expr("over.read_pos + v_pos - over.node_pos"))
    rows = rows.withColumn("last", F.expr(_LAST_BASE.replace("element_at", "try_element_at")))
    deleted_bq = "coalesce(get(bq, last.read_pos + last.n - 1), 50)"
    inserted = "substring(seq, ins.read_pos + 1, ins.n)"
    aligned = "over.op IN ('M', 'X', '=')"
    state = f"""CASE WHEN v_type = 'X' AND {aligned} THEN CASE WHEN at >= length(seq) THEN NULL WHEN substring(seq, at + 1, 1) = v_alt THEN 'alt' WHEN substring(seq, at + 1, 1) = v_ref THEN 'ref' ELSE 'other' END
        WHEN v_type = 'X' AND over.op = 'D' THEN 'other'
        WHEN v_type = 'I' AND over.op = 'D' THEN 'other'
        WHEN v_type = 'I' AND ins IS NOT NULL THEN CASE WHEN ins.read_pos + ins.n > length(seq) THEN NULL WHEN {inserted} = v_alt THEN 'alt' WHEN {inserted} = v_ref THEN 'ref' ELSE 'other' END
        WHEN v_type = 'I' AND {aligned} THEN 'ref'
        WHEN v_type = 'D' AND over.op = 'D' THEN IF(over.node_pos + over.n <= length(node_seq) AND substring(node_seq, over.node_pos + 1, over.n) = v_ref, 'alt', 'other')
        WHEN v_type = 'D' AND {aligned} AND at < length(seq) THEN 'ref' END"""
    bq = f"""CASE WHEN over.op = 'D' THEN {deleted_bq} WHEN ins IS NOT NULL THEN aggregate(slice(bq, ins.read_pos + 1, ins.n), 0.0D, (s, q) -> s + q) / ins.n ELSE get(bq, at) END"""
    return rows.select(*VARIANT, "seg_order", F.expr(state).alias("state"), F.expr(bq).cast("double").alias("bq")).where("state IS NOT NULL")


def allele_summary(states: DataFrame) -> DataFrame:
    """Counts by state, frequency of the ALT allele and its mean quality; neither is rounded here."""
    alt = F.col("state") == "alt"
    return states.groupBy(*VARIANT).agg(
        F.count_if(alt).alias("alt_allele_count"), F.count_if(F.col("state") == "ref").alias("ref_allele_count_at_locus"), F.count_if(F.col("state") == "other").alias("other_allele_count_at_locus"),
        F.count(F.lit(1)).alias("coverage_at_locus"), (F.count_if(alt) / F.count(F.lit(1))).alias("alt_allele_frequency"), F.avg(F.when(alt, F.col("bq"))).alias("mean_alt_allele_base_quality"),
    )


#: the op before the i-th one of a walk that is of some kinds: the neighbour as a rule, else looked for
_BEFORE = """CASE WHEN i = 0 THEN NULL WHEN get(walk, i - 1).op IN {kinds} AND get(walk, i - 1).n > 0 THEN get(walk, i - 1)
    ELSE try_element_at(filter(slice(walk, 1, i), u -> u.op IN {kinds} AND u.n > 0), -1) END"""
_FIRST_INSERTION = """CASE WHEN i = 0 OR get(walk, i - 1).op IN ('M', 'X', '=', 'D', 'N') THEN true WHEN get(walk, i - 1).op = 'I' THEN false
    ELSE NOT exists(slice(walk, 1, i), u -> u.op = 'I' AND u.node_pos = w.node_pos) END"""
COVERAGE_BLOCK = 4_096


def site_coverage(sites: DataFrame, events: DataFrame) -> DataFrame:
    """(node_id, v_pos, aligned, read, deleted) of ``sites``: how many segments have an aligned op there, one whose base the read still has, a deletion.

    ``events`` have a step up where an op begins and a step down behind its end; steps of one position are folded, so that a node has
    at most as many as it has positions. They are summed up within blocks of positions, and blocks within nodes.
    """
    kinds = ("aligned", "read", "deleted")
    steps = events.where("role = 'S'").select("node_id", "pos", *kinds, F.lit(False).alias("site"))
    steps = steps.unionByName(sites.select("node_id", F.col("v_pos").alias("pos"), *(F.lit(0).cast("long").alias(k) for k in kinds), F.lit(True).alias("site")))
    steps = steps.groupBy("node_id", "pos").agg(*(F.sum(k).alias(k) for k in kinds), F.bool_or("site").alias("site")).withColumn("block", F.expr(f"pos div {COVERAGE_BLOCK}"))
    steps = materialize(steps, "coverage-steps")
    earlier = Window.partitionBy("node_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy("node_id", "block").agg(*(F.sum(k).alias(k) for k in kinds))
    blocks = blocks.select("node_id", "block", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in kinds))
    within = Window.partitionBy("node_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    here = steps.select("node_id", "block", "pos", "site", *(F.sum(k).over(within).alias(k) for k in kinds)).where("site")
    return here.join(blocks, ["node_id", "block"]).select("node_id", F.col("pos").alias("v_pos"), *((F.col(k) + F.col(f"{k}_before")).alias(k) for k in kinds))


def _event(pos: str, role: str, ref: str = "''", allele: str = "''", bq: str = "NULL", **numbers: str | int) -> str:
    fields = "".join(f", '{k}', {numbers.get(k, 0)}" for k in ("aligned", "read", "deleted", "seen"))
    return f"named_struct('pos', {pos}, 'role', '{role}', 'ref', {ref}, 'allele', {allele}, 'bq', CAST({bq} AS DOUBLE){fields})"


def segment_events(segments: DataFrame, max_indel: int = 50) -> DataFrame:
    """All that counting needs, in one pass over the segments: (node_id, pos, role, ref, allele, aligned, read, deleted, seen, n, bq_sum, bq_n).

    ``role`` is S for steps of coverage, X for a base other than the node's, I for an inserted text by its anchor, D for deleted bases by
    their start; i and d are insertions and deletions as ``detect_variants`` gives them, X is one ``seen`` times. An insertion behind a
    deletion is none; one that outruns its read has no allele and counts in ``aligned`` only, the insertions whose anchor is aligned.
    A deletion's quality is that of the last aligned base before it, 50 without one.
    """
    has, size = "greatest(least(w.n, length(seq) - w.read_pos), 0)", "greatest(least(w.n, length(seq) - w.read_pos, length(node_seq) - w.node_pos), 0)"
    up, whole = _event("w.node_pos", "S", aligned=1, read=1), _event("w.node_pos + w.n", "S", aligned=-1, read=-1)
    parts = f"array({up}, {_event('w.node_pos + w.n', 'S', aligned=-1)}, {_event(f'w.node_pos + {has}', 'S', read=-1)})"
    steps = f"IF(w.n > 0, IF({has} = w.n, array({up}, {whole}), {parts}), array())"
    read, node = "substring(seq, w.read_pos + k + 1, 1)", "substring(node_seq, w.node_pos + k + 1, 1)"
    other = _event("w.node_pos + k", "X", node, read, "get(bq, w.read_pos + k)", seen=f"IF(w.op <> '=' AND {node} <> 'N' AND {read} <> 'N', 1, 0)")
    differences = f"transform(filter(sequence(0, {size} - 1), k -> {read} <> {node}), k -> {other})"
    others = f"IF(substring(seq, w.read_pos + 1, {size}) = substring(node_seq, w.node_pos + 1, {size}), array(), {differences})"
    over = f"IF({_FIRST_INSERTION}, coalesce(({_BEFORE.format(kinds="('M', 'X', '=', 'D', 'N')")}).op, '-'), 'D')"
    text = "IF(w.read_pos + w.n <= length(seq), substring(seq, w.read_pos + 1, w.n), NULL)"
    mean = "try_divide(aggregate(slice(bq, w.read_pos + 1, w.n), 0.0D, (s, q) -> s + q), w.n)"
    inserted = f"transform(filter(array({over}), o -> o <> 'D'), o -> {_event('w.node_pos - 1', 'I', allele=text, bq=mean, aligned="IF(o IN ('M', 'X', '='), 1, 0)")})"
    insertion = f"transform({_INSERTION.format(m=max_indel)}, v -> {_event('v.v_pos', 'i', 'v.v_ref', 'v.v_alt', seen=1)})"
    last = f"({_BEFORE.format(kinds="('M', 'X', '=')")})"
    gone = _event("w.node_pos", "D", "substring(node_seq, w.node_pos + 1, w.n)", bq=f"coalesce(get(bq, {last}.read_pos + {last}.n - 1), 50)")
    ends = f"array({_event('w.node_pos', 'S', deleted=1)}, {_event('w.node_pos + w.n', 'S', deleted=-1)})"
    deleted = f"IF(w.n > 0, concat({ends}, IF(w.node_pos + w.n <= length(node_seq), array({gone}), array())), array())"
    deletion = f"transform({_DELETION.format(m=max_indel)}, v -> {_event('v.v_pos', 'd', 'v.v_ref', 'v.v_alt', seen=1)})"
    found = f"""flatten(transform(walk, (w, i) -> CASE WHEN w.op IN ('M', 'X', '=') THEN concat({steps}, {others})
        WHEN w.op = 'I' THEN concat({inserted}, {insertion}) WHEN w.op = 'D' THEN concat({deleted}, {deletion}) ELSE array() END))"""
    # one aligned op within its read, as most segments have, needs no look at each op; ``explode`` would make the array once more to see if it is empty
    only = f"size(walk) = 1 AND w.op IN ('M', 'X', '=') AND w.n > 0 AND {has} = w.n"
    one = f"IF({size} = 0 OR substring(seq, w.read_pos + 1, {size}) = substring(node_seq, w.node_pos + 1, {size}), array({up}, {whole}), concat(array({up}, {whole}), {differences}))"
    events = segments.withColumn("w", F.expr("get(walk, 0)")).withColumn("found", F.expr(f"IF({only}, {one}, {found})"))
    events = events.select("node_id", F.explode_outer("found").alias("v")).where("v IS NOT NULL").select("node_id", "v.*")
    sums = (F.sum(k).alias(k) for k in ("aligned", "read", "deleted", "seen"))
    return events.groupBy("node_id", "pos", "role", "ref", "allele").agg(*sums, F.count(F.lit(1)).alias("n"), F.sum("bq").alias("bq_sum"), F.count("bq").alias("bq_n"))


def event_candidates(events: DataFrame, kind: str = "all") -> DataFrame:
    """The ``candidate_counts`` of ``detect_variants``, from ``segment_events``."""
    roles = {"snp": "role = 'X'", "indel": "role IN ('i', 'd')", "all": "role IN ('X', 'i', 'd')"}[kind]
    rows = events.where(roles).where("seen > 0")
    return rows.select("node_id", F.col("pos").alias("v_pos"), F.upper("role").alias("v_type"), F.col("ref").alias("v_ref"), F.col("allele").alias("v_alt"), F.col("seen").alias("supporting"))


def event_counts(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """The ``allele_summary`` of candidates as ``detect_variants`` gives them, without a row for each candidate and segment.

    Coverage comes from a sweep over the ends of ops, alleles from the segments that bear them, and what bears none is the reference:
    work follows segments and their differences, at any depth.
    """
    sites = candidates.select("node_id", "v_pos").distinct()
    at = ["node_id", "v_pos", "v_type"]
    told = events.where("role IN ('X', 'I')").groupBy("node_id", F.col("pos").alias("v_pos"), F.col("role").alias("v_type"), "allele").agg(
        F.sum(F.when(F.col("allele").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.sum("bq_sum").alias("bq_sum"), F.sum("bq_n").alias("bq_n"), F.sum("aligned").alias("n_aligned")
    )
    totals = told.groupBy(*at).agg(F.sum("n").alias("told"), F.sum("n_aligned").alias("on_anchor"))
    alts = told.select(*at, F.col("allele").alias("v_alt"), F.col("n").alias("alt"), "bq_sum", "bq_n")
    refs = told.where("v_type = 'I'").select(*at, F.col("allele").alias("v_ref"), F.col("n").alias("as_ref"))
    gone = events.where("role = 'D'").select(F.col("node_id").alias("of_node"), F.col("pos").alias("start"), F.col("ref").alias("deleted"), "n", "bq_sum", "bq_n")
    whole = (F.col("of_node") == F.col("node_id")) & (F.col("deleted") == F.col("v_ref")) & (F.col("start") <= F.col("v_pos")) & (F.col("v_pos") < F.col("start") + F.length("deleted"))
    # the same bases may be deleted from up to their number of starts around a position
    dels = candidates.select(*VARIANT).where("v_type = 'D'").join(gone, whole).groupBy(*VARIANT).agg(F.sum("n").alias("del_alt"), F.sum("bq_sum").alias("del_sum"), F.sum("bq_n").alias("del_n"))
    rows = candidates.select(*VARIANT).join(site_coverage(sites, events), ["node_id", "v_pos"]).join(totals, at, "left").join(alts, [*at, "v_alt"], "left").join(refs, [*at, "v_ref"], "left").join(dels, VARIANT, "left")
    alt = "coalesce(IF(v_type = 'D', del_alt, alt), 0)"
    as_ref = "IF(v_ref = v_alt, 0, coalesce(as_ref, 0))"
    ref = f"CASE v_type WHEN 'X' THEN read - coalesce(told, 0) WHEN 'D' THEN read ELSE aligned - coalesce(on_anchor, 0) + {as_ref} END"
    other = f"deleted + CASE v_type WHEN 'X' THEN coalesce(told, 0) - alt_allele_count WHEN 'D' THEN -alt_allele_count ELSE coalesce(told, 0) - alt_allele_count - {as_ref} END"
    rows = rows.withColumn("alt_allele_count", F.expr(alt)).withColumn("ref_allele_count_at_locus", F.expr(ref)).withColumn("other_allele_count_at_locus", F.expr(other))
    rows = rows.withColumn("coverage_at_locus", F.expr("alt_allele_count + ref_allele_count_at_locus + other_allele_count_at_locus")).where("coverage_at_locus > 0")
    quality = F.expr("IF(alt_allele_count > 0, try_divide(IF(v_type = 'D', del_sum, bq_sum), IF(v_type = 'D', del_n, bq_n)), NULL)")
    return rows.select(*VARIANT, "alt_allele_count", "ref_allele_count_at_locus", "other_allele_count_at_locus", "coverage_at_locus", (F.col("alt_allele_count") / F.col("coverage_at_locus")).alias("alt_allele_frequency"), quality.alias("mean_alt_allele_base_quality"))


def allele_counts(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """``event_counts`` of candidates over segments."""
    return event_counts(candidates, materialize(segment_events(segments), "events"))


def variant_counts(segments: DataFrame, kind: str = "all") -> DataFrame:
    """Candidates of the segments with their counts, by one pass over the segments."""
    events = materialize(segment_events(segments), "events")
    return event_counts(event_candidates(events, kind), events)


def candidate_thresholds(summary: DataFrame, min_variants: int = 3, min_af: float = 0.05, min_bq: float = 10.0) -> DataFrame:
    return summary.where((F.col("alt_allele_count") >= min_variants) & (F.col("alt_allele_frequency") >= min_af) & (F.col("mean_alt_allele_base_quality") >= min_bq))


def dedupe_keys(variants: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per node and canonical key, the first in (v_pos, v_type, v_alt, v_ref) order."""
    anchor = F.expr("substring(upper(sequence), greatest(v_pos, 1), 1)")
    keyed = variants.join(nodes.select("node_id", "sequence"), "node_id").withColumn("variant_key", variant_key(F.col("v_pos"), F.col("v_type"), F.col("v_ref"), F.col("v_alt"), anchor)).drop("sequence")
    first = Window.partitionBy("node_id", "variant_key").orderBy("v_pos", "v_type", "v_alt", "v_ref")
    return keyed.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def candidate_summary(segments: DataFrame, nodes: DataFrame, kind: str = "all", min_mapq: int = 10, rows: int | None = 200, **thresholds: float) -> DataFrame:
    """The whole pileup: valid segments, ranking, and one pass that finds candidates and counts them, thresholds. Without ``rows`` no segment is cut."""
    valid = valid_segments(segments, nodes, min_mapq)
    ranked = valid if rows is None else rank_segments(valid, kind, rows)
    return candidate_thresholds(variant_counts(ranked, kind), **thresholds).withColumn("coverage", F.col("coverage_at_locus"))


def pool_segments(*stores: DataFrame) -> DataFrame:
    """Segments of several stores as one, ordered by store and then within it."""
    pooled = None
    for file_no, store in enumerate(stores):
        rows = store.withColumn("file_no", F.lit(file_no)).withColumn("seg_order", F.col("seg_order") + F.lit(file_no).cast("long") * F.lit(1 << 50))
        pooled = rows if pooled is None else pooled.unionByName(rows)
    return pooled


def supporting_rows(segments: DataFrame, variants: DataFrame) -> DataFrame:
    """Older pileup: only the segments that bear a candidate, with its window clipped to the node."""
    borne = variants.select("node_id", "seg_order", "v_pos", "v_type", "v_ref", "v_alt")
    return borne.join(segments.select("node_id", "seg_order", "offset", "seq", "bq", "walk", F.length("node_seq").alias("node_length")), ["node_id", "seg_order"]).withColumn(
        "window_begin", F.greatest(F.col("v_pos") - 50, F.lit(0))
    ).withColumn("window_end", F.least(F.col("v_pos") + 50, F.col("node_length")))


#: positions whose windows meet segments together
VIEW_BLOCK = 1_024


def pileup_view(segments: DataFrame, candidates: DataFrame, width: int = 100, variants_per_node: int | None = None, reads: int | None = None) -> DataFrame:
    """Text rows of segments over a window around each candidate: bases, ``*`` for deletions, ``.`` elsewhere.

    All candidates and all segments with something in the window are shown, or the first ones of a node and of a candidate as asked.
    """
    shown = candidates.select(*VARIANT)
    if variants_per_node is not None:
        shown = shown.withColumn("nth", F.row_number().over(Window.partitionBy("node_id").orderBy("v_pos", "v_type", "v_ref", "v_alt"))).where(F.col("nth") <= variants_per_node).drop("nth")
    shown = shown.withColumn("begin", F.expr(f"v_pos + IF(v_type = 'I', 1, 0) - {width // 2}"))
    end = "(element_at(walk, -1).node_pos + IF(element_at(walk, -1).op IN ('M', 'X', 'D', '=', 'N'), element_at(walk, -1).n, 0))"
    # windows by the block of their centre, segments by all blocks whose windows they reach: on short nodes a single one
    blocks = f"sequence(greatest(`offset` - {width - 1 - width // 2}, 0) div {VIEW_BLOCK}, greatest({end} - 1 + {width // 2}, 0) div {VIEW_BLOCK})"
    shown = shown.withColumn("block", F.expr(f"(begin + {width // 2}) div {VIEW_BLOCK}"))
    rows = shown.join(segments.select("node_id", "seg_order", "seq", "walk", "offset", F.explode(F.expr(blocks)).alias("block")), ["node_id", "block"])
    # the window is drawn op by op, and for the rows that stay only
    low, n = "greatest(begin, w.node_pos)", f"(least(begin + {width}, w.node_pos + w.n) - greatest(begin, w.node_pos))"
    bases = f"substring(seq, w.read_pos + {low} - w.node_pos + 1, {n})"
    seen = f"(w.op IN ('M', 'X', 'D') AND {n} > 0 AND (w.op = 'D' OR {bases} RLIKE '[^.]'))"
    drawn = f"CASE WHEN w.op NOT IN ('M', 'X', 'D', '=', 'N') OR {n} <= 0 THEN '' WHEN w.op = 'D' THEN repeat('*', {n}) WHEN w.op IN ('M', 'X') THEN {bases} ELSE repeat('.', {n}) END"
    first = lambda text: text.replace("w.", "get(walk, 0).")
    blank = lambda size: f"repeat('.', least(greatest({size}, 0), {width}))"
    rows = rows.where(f"offset < begin + {width} AND IF(size(walk) = 1, {first(seen)}, exists(walk, w -> {seen}))")
    nth = F.row_number().over(Window.partitionBy(*VARIANT).orderBy("seg_order"))
    rows = rows.withColumn("row_no", nth)
    if reads is not None:
        rows = rows.where(F.col("row_no") <= reads)
    body = f"IF(size(walk) = 1, {first(drawn)}, array_join(transform(walk, w -> {drawn}), ''))"
    return rows.select(*VARIANT, "row_no", F.expr(f"concat({blank('offset - begin')}, {body}, {blank(f'begin + {width} - {end}')})").alias("text"))


def view_header(candidates: DataFrame, nodes: DataFrame, width: int = 100) -> DataFrame:
    """The lines above a candidate's rows: ``reference``, the node's bases in its window with 0 beyond the node, and ``marker``, ^ at the variant."""
    rows = candidates.select(*VARIANT).join(nodes.select("node_id", F.upper("sequence").alias("node_seq")), "node_id").withColumn("begin", F.expr(f"v_pos + IF(v_type = 'I', 1, 0) - {width // 2}"))
    cell = "IF(p < 0 OR p >= length(node_seq), '0', substring(node_seq, p + 1, 1))"
    reference = F.expr(f"array_join(transform(sequence(begin, begin + {width - 1}), p -> {cell}), '')")
    marker = F.expr(f"concat(repeat(' ', v_pos - begin), '^', repeat(' ', {width - 1} - v_pos + begin))")
    return rows.select(*VARIANT, reference.alias("reference"), marker.alias("marker"))


def coded_rows(rows: DataFrame, width: int = 100) -> DataFrame:
    """Rows (begin, seq, bq, walk) with the older encoding's two channels over their windows: ``codes`` and ``qualities``.

    A, C, G, T, others are 0 to 4, a deletion 5, nothing 6; qualities are 0 but for bases. What follows a read's last base isn't coded.
    """
    over = "try_element_at(filter(walk, w -> w.op IN ('M', 'X', '=', 'D', 'N') AND w.node_pos <= p AND p < w.node_pos + w.n AND w.read_pos < length(seq)), 1)"
    base = "CASE upper(substring(seq, over.read_pos + p - over.node_pos + 1, 1)) WHEN '' THEN 6 WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END"
    code = f"CASE WHEN over IS NULL THEN 6 WHEN over.op IN ('D', 'N') THEN 5 ELSE {base} END"
    quality = "CASE WHEN over IS NULL OR over.op IN ('D', 'N') THEN 0 ELSE coalesce(get(bq, over.read_pos + p - over.node_pos), 0) END"
    cells = rows.withColumn("ops_over", F.expr(f"transform(sequence(begin, begin + {width - 1}), p -> {over})"))
    each = lambda value: F.expr(f"transform(ops_over, (over, i) -> {value})".replace(" p ", " (begin + i) "))
    return cells.withColumn("codes", each(code)).withColumn("qualities", each(quality)).drop("ops_over")
