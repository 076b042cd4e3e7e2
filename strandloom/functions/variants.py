"""Expressions on contigs, alleles, INFO fields and calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canon_chrom(chrom: Column) -> Column:
    """Without a leading ``chr``."""
    return F.regexp_replace(chrom, "(?i)^chr", "")


def contig_alias(chrom: Column) -> Column:
    """One name for a contig with and without ``chr``; M, MT, chrM and chrMT are one contig."""
    bare = canon_chrom(chrom)
    return F.when(F.upper(bare).isin("M", "MT"), "M").otherwise(bare)


def chrom_from_pattern(text: Column) -> Column:
    found = F.regexp_extract(text, r"(chr[0-9A-Za-z]+)", 1)
    return F.nullif(found, F.lit(""))


def info_map(info: Column) -> Column:
    """INFO text as a map; flags map to ``true``; ``.`` and empty are empty maps."""
    parts = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(parts, lambda x: F.substring_index(x, "=", 1))), lambda k: F.struct(k, F.element_at(F.transform(F.filter(parts, lambda x: F.substring_index(x, "=", 1) == k), _value), -1))))


def _value(part: Column) -> Column:
    return F.when(F.instr(part, "=") > 0, F.regexp_replace(part, "^[^=]*=", "")).otherwise("true")


def escape_info(value: Column) -> Column:
    """Space, comma, semicolon and equals sign are not allowed in a value."""
    for char, code in ((" ", "%20"), (",", "%2C"), (";", "%3B"), ("=", "%3D")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


def info_string(fields: dict[str, Column]) -> Column:
    """``KEY=value`` of the fields that aren't null, in order; ``.`` if there are none."""
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), escape_info(v.cast("string"))) for k, v in fields.items())))
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, ";"))


def vcf_pass(filters: Column, strict: bool = True) -> Column:
    """Strict: FILTER is exactly PASS; else empty, ``.`` or a list with PASS."""
    if strict:
        return F.coalesce((F.size(filters) == 1) & (F.get(filters, F.lit(0)) == "PASS"), F.lit(False))
    return F.coalesce((F.size(filters) <= 0) | F.array_contains(filters, "PASS") | F.array_contains(filters, "."), F.lit(True))


def vcf_kind(ref: Column, alts: Column) -> Column:
    """SNV, INDEL or OTHER; symbolic alleles are OTHER."""
    symbolic = F.exists(alts, lambda a: a.rlike(r"[<\[\]*.]"))
    snv = (F.length(ref) == 1) & F.forall(alts, lambda a: F.length(a) == 1)
    indel = F.exists(alts, lambda a: F.length(a) != F.length(ref))
    return F.when(symbolic, "OTHER").when(snv, "SNV").when(indel, "INDEL").otherwise("OTHER")


def variant_class4(ref: Column, alt: Column) -> Column:
    return (
        F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").when((F.length(alt) > F.length(ref)) & alt.startswith(ref), "INS").when((F.length(ref) > F.length(alt)) & ref.startswith(alt), "DEL").otherwise("COMPLEX")
    )


def min_depth(sample_dp: Column, site_dp: Column, least: int) -> Column:
    """Sample depth, else site depth, else keep."""
    return F.coalesce(F.coalesce(sample_dp, site_dp) >= least, F.lit(True))


def linear_position(start0: Column, offset: Column, length: Column, strand: Column) -> Column:
    """1-based position of a node offset; the node's strand turns the offset around."""
    return F.when(strand == "-", start0 + (length - 1 - offset) + 1).otherwise(start0 + offset + 1)


def sbs96_channel(left: Column, ref: Column, alt: Column, right: Column) -> Column:
    """``A[C>T]G``; purine references are written from the other strand."""
    turn = ref.isin("A", "G")
    other = lambda b: F.translate(b, "ACGT", "TGCA")
    l, m, a, r = F.when(turn, other(right)).otherwise(left), F.when(turn, other(ref)).otherwise(ref), F.when(turn, other(alt)).otherwise(alt), F.when(turn, other(left)).otherwise(right)  # noqa: E741
    return F.concat(l, F.lit("["), m, F.lit(">"), a, F.lit("]"), r)


def keep_decision(p_true: Column, is_true: Column, anchored: Column, p_keep: float = 0.5, p_unanchored: float = 0.2, p_refcall: float | None = None) -> Column:
    """PASS, RefCall or null (dropped). Unanchored calls pass by probability alone; a null probability drops."""
    passed = F.when(F.coalesce(anchored, F.lit(True)), is_true & (p_true >= p_keep)).otherwise(p_true >= p_unanchored)
    refcall = (p_true >= p_refcall) if p_refcall is not None else F.lit(False)
    return F.when(p_true.isNull(), None).when(passed, "PASS").when(refcall, "RefCall")


def keep_decision_simple(pred_class: Column, p_true: Column, threshold: float | None = None, p_refcall: float | None = None) -> Column:
    """The simpler rule: a true class passes if there is no threshold, no probability, or enough of it."""
    enough = p_true.isNull() | (p_true >= threshold) if threshold is not None else F.lit(True)
    refcall = F.coalesce(p_true >= p_refcall, F.lit(False)) if p_refcall is not None else F.lit(False)
    return F.when((F.lower(pred_class) == "true") & enough, "PASS").when(refcall, "RefCall")


def parse_annotation(text: Column) -> Column:
    """``contig:pos-ref-alt`` as struct<contig, pos, ref, alt, hap>; hap from the contig's name."""
    pattern = r"^(.+):(\d+)-([A-Za-z*]*)-([A-Za-z*]*)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    hap = F.when(part(1).rlike("(?i)hap1|#1#|_mat"), "hap1").when(part(1).rlike("(?i)hap2|#2#|_pat"), "hap2")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("contig"), part(2).try_cast("long").alias("pos"), part(3).alias("ref"), part(4).alias("alt"), hap.alias("hap")))


def parse_tensor_name(name: Column, folder: Column) -> Column:
    """``node_off_X_REF_ALT`` or ``off_X_REF_ALT`` (node from the folder) as struct<node_id, v_pos, v_type, v_ref, v_alt>."""
    five, four = r"^(\d+)_(-?\d+)_([XID])_([^_.]*)_([^_.]*)", r"^(-?\d+)_([XID])_([^_.]*)_([^_.]*)"
    long, short = (lambda k: F.regexp_extract(name, five, k)), (lambda k: F.regexp_extract(name, four, k))
    build = lambda node, f, at: F.struct(node.try_cast("long").alias("node_id"), f(at).try_cast("int").alias("v_pos"), f(at + 1).alias("v_type"), f(at + 2).alias("v_ref"), f(at + 3).alias("v_alt"))
    return F.when(name.rlike(five), build(long(1), long, 2)).when(name.rlike(four), build(folder, short, 1))
