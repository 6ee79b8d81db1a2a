"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_bits(bits: Column) -> Column:
    """An array of 0/1, least significant first, as one number; only ones count."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b == 1, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def decode_bits(value: Column, size: Column | int) -> Column:
    """The lowest `size` bits of a number as an array of 0/1, least significant first."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.call_function("shiftright", value.cast("bigint"), i).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))


def set_bits(value: Column) -> Column:
    """Positions of the ones of a number (up to 62), ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("shiftright", value.cast("bigint"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def mask_of(index: Column) -> Column:
    """A number with one bit set; aggregate with bit_or."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), index.cast("int"))


def target_of(ref_name: Column) -> Column:
    """The part of a reference name before its last underscore; the whole when that is first or missing."""
    at = F.length(ref_name) - F.length(F.substring_index(ref_name, "_", -1))
    return F.when(F.instr(ref_name, "_") == 0, ref_name).when(at <= 1, ref_name).otherwise(F.substring(ref_name, F.lit(1), at - 1))


def haplotype_of(ref_name: Column) -> Column:
    """The part of a reference name after its last underscore; '' when that is first or missing."""
    at = F.length(ref_name) - F.length(F.substring_index(ref_name, "_", -1))
    return F.when(F.instr(ref_name, "_") == 0, "").when(at <= 1, "").otherwise(F.substring_index(ref_name, "_", -1))


def chromosome(name: Column) -> Column:
    """Number or letter of a chromosome name, null when it has none."""
    out = F.regexp_extract(F.trim(name), "(?i)^(CHR(OMOSOME)?)?([1-9][0-9]*|X|Y|MT?)", 3)
    return F.when(out != "", out)


def read_name(qname: Column) -> Column:
    """A query name up to its first space, unless that comes first."""
    return F.when(F.instr(qname, " ") > 1, F.substring_index(qname, " ", 1)).otherwise(qname)


def cell_of(qname: Column) -> Column:
    """The cell tag of a name whose fields are joined by three bars: field 14, counted from 0; null without."""
    return F.get(F.split(qname, "[|]{3}"), F.lit(14))


def virtual_offset(block: Column, within: Column) -> Column:
    return F.call_function("shiftleft", block.cast("bigint"), F.lit(16)).bitwiseOR(within.cast("bigint"))


def split_offset(offset: Column) -> Column:
    return F.struct(F.call_function("shiftright", offset.cast("bigint"), F.lit(16)).alias("block"), offset.cast("bigint").bitwiseAND(F.lit(65535).cast("bigint")).alias("within"))


def elapsed(seconds: Column) -> Column:
    """HH:MM:SS.ss"""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%05.2f", F.floor(whole / 3600), F.floor((whole % 3600) / 60), seconds - F.floor(seconds / 60) * 60)


def partition_bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Balanced contiguous ranges over `size` items, without empty ones."""
    base, longer = divmod(size, max(1, parts))
    out, at = [], 0
    for i in range(max(1, parts)):
        n = base + (i < longer)
        if n:
            out.append((at, at + n))
        at += n
    return out
