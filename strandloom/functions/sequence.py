"""Base-level functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def gc_fraction(seq: Column) -> Column:
    """Share of G and C, either case, among all characters; 0 for an empty read."""
    n = F.length(seq)
    return F.when(n > 0, F.length(F.regexp_replace(seq, "[^GCgc]", "")) / n).otherwise(F.lit(0.0))


def reverse_complement(seq: Column) -> Column:
    """Case kept, other characters unchanged."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def complement_base(base: Column) -> Column:
    """Complement of one base in upper case: U as T, anything else N."""
    b = F.upper(base)
    return F.when(b.isin("T", "U"), "A").when(b == "A", "T").when(b == "C", "G").when(b == "G", "C").otherwise("N")


def counting_base(base: Column, strand: Column) -> Column:
    return F.when(strand == "-", complement_base(base)).otherwise(F.upper(base))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence, in order."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def low_complexity(kmer: Column, k: int) -> Column:
    """A homopolymer, or for k of 4 or more a repeat of two bases."""
    half = F.repeat(F.substring(kmer, 1, 2), (k + 1) // 2)
    return (kmer == F.repeat(F.substring(kmer, 1, 1), k)) | (F.lit(k >= 4) & (kmer == F.substring(half, 1, k)))


def encode_kmer(kmer: str) -> int:
    code = 0
    for c in kmer:
        code = code * 4 + "ACGT".index(c)
    return code


def decode_kmer(code: int, k: int) -> str:
    return "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))
