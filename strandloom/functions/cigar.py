"""CIGAR and strand expressions on columns: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OP_PATTERN = r"([0-9]+[MIDNSHPX=])"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def cigar_ops(cigar: Column) -> Column:
    """CIGAR text as array<struct<n int, op string>>; ``*``, empty and null give an empty array."""
    text = F.coalesce(cigar, F.lit(""))
    op = lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op"))
    # a text of one op, as most are, needs no matches
    return F.when(text.rlike(f"^{OP_PATTERN}\\z"), F.array(op(text))).otherwise(F.transform(F.regexp_extract_all(text, F.lit(OP_PATTERN), F.lit(1)), op))


def cigar_walk(ops: Column, start: Column) -> Column:
    """Each op with the node and read position at which it begins: array<struct<n, op, node_pos, read_pos>>."""
    zero = F.struct(start.cast("int").alias("node_pos"), F.lit(0).alias("read_pos"), F.array().cast("array<struct<n:int,op:string,node_pos:int,read_pos:int>>").alias("walk"))

    def step(state: Column, x: Column) -> Column:
        on_node = F.when(x["op"].isin("M", "X", "=", "D", "N"), x["n"]).otherwise(0)
        on_read = F.when(x["op"].isin("M", "X", "=", "I", "S"), x["n"]).otherwise(0)
        here = F.struct(x["n"].alias("n"), x["op"].alias("op"), state["node_pos"].alias("node_pos"), state["read_pos"].alias("read_pos"))
        return F.struct((state["node_pos"] + on_node).cast("int").alias("node_pos"), (state["read_pos"] + on_read).cast("int").alias("read_pos"), F.concat(state["walk"], F.array(here)).alias("walk"))

    def placed(size: int) -> Column:
        """The walk of ``size`` ops, written out."""
        node_pos, read_pos, out = start.cast("int"), F.lit(0), []
        for x in (F.get(ops, F.lit(i)) for i in range(size)):
            out.append(F.struct(x["n"].alias("n"), x["op"].alias("op"), node_pos.alias("node_pos"), read_pos.alias("read_pos")))
            node_pos, read_pos = node_pos + F.when(x["op"].isin("M", "X", "=", "D", "N"), x["n"]).otherwise(0), read_pos + F.when(x["op"].isin("M", "X", "=", "I", "S"), x["n"]).otherwise(0)
        return F.array(*out)

    # most have one op, and most others three: an indel between two matches
    return F.when(F.size(ops) == 1, placed(1)).when(F.size(ops) == 3, placed(3)).otherwise(F.aggregate(ops, zero, step, lambda s: s["walk"]))


def summed(ops: Column, kinds: str) -> Column:
    """Total length of the ops whose letter is in ``kinds``."""
    one = F.get(ops, F.lit(0))
    total = F.aggregate(ops, F.lit(0), lambda s, x: s + F.when(x["op"].isin(*kinds), x["n"]).otherwise(0))
    return F.when(F.size(ops) == 1, F.when(one["op"].isin(*kinds), one["n"]).otherwise(0)).otherwise(total)


def oriented_offset(offset: Column, strand: Column, node_length: Column, seq: Column, ops: Column) -> Column:
    """Offset along the forward strand."""
    span = F.length(seq) - summed(ops, "I") + summed(ops, "D")
    return F.when(strand == "-", node_length - span - offset).otherwise(offset)


def non_m_weight(ops: Column, kind: str) -> Column:
    """Lengths of ops other than M, those of the wanted kind counted twice."""
    twice = {"snp": "X", "indel": "ID"}.get(kind, "")
    return summed(ops, "IDNSHPX=") + (summed(ops, twice) if twice else F.lit(0))


def edit_letter(edit: Column) -> Column:
    """One edit's operation: M, X, D, I, or null for one that is none of these."""
    plain = F.coalesce(F.length(edit["sequence"]), F.lit(0)) == 0
    same = edit["from_length"] == edit["to_length"]
    return F.when(same & plain, "M").when(same, "X").when(edit["to_length"] == 0, "D").when(edit["from_length"] == 0, "I")


def edits_to_cigar(edits: Column) -> Column:
    pieces = F.transform(edits, lambda e: F.concat(F.greatest(e["from_length"], e["to_length"]).cast("string"), edit_letter(e)))
    return F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "")


def mapping_is_perfect(edits: Column) -> Column:
    return F.forall(edits, lambda e: F.coalesce(edit_letter(e) == "M", F.lit(False)))


def variant_key(pos: Column, kind: Column, ref: Column, alt: Column, anchor: Column) -> Column:
    """Canonical text of a variant: I and D are written from the base before them, a D at position 0 without one."""
    insertion = F.concat_ws("_", pos.cast("string"), F.lit("I"), ref, F.concat(ref, alt))
    leading = F.concat_ws("_", F.lit("0"), F.lit("D"), ref, alt)
    deletion = F.concat_ws("_", (pos - 1).cast("string"), F.lit("D"), F.concat(anchor, ref), anchor)
    plain = F.concat_ws("_", pos.cast("string"), kind, ref, alt)
    return F.when(kind == "I", insertion).when((kind == "D") & (pos <= 0), leading).when(kind == "D", deletion).otherwise(plain)


def parse_variant_key(key: Column) -> Column:
    """struct<v_pos, v_type, v_ref, v_alt>, null where there are fewer than four parts or the offset is no integer."""
    parts = F.split(key, "_")
    pos = F.get(parts, F.lit(0)).try_cast("int")
    return F.when((F.size(parts) >= 4) & pos.isNotNull(), F.struct(pos.alias("v_pos"), F.get(parts, F.lit(1)).alias("v_type"), F.get(parts, F.lit(2)).alias("v_ref"), F.get(parts, F.lit(3)).alias("v_alt")))
