"""Translation by the standard genetic code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard code with bases in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def amino_acid(codon: Column) -> Column:
    """One letter, * for a stop, X for a codon with other letters."""
    at = [F.instr(F.lit(BASES), F.substr(codon, F.lit(i), F.lit(1))) for i in (1, 2, 3)]
    known = codon.rlike("^[ACGT]{3}$")
    return F.when(known, F.substr(F.lit(AMINO_ACIDS), (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2], F.lit(1))).otherwise("X")


def protein(cds: Column) -> Column:
    """The amino acids of whole codons; a trailing part of a codon is left out."""
    n = F.floor(F.length(cds) / 3).cast("int")
    codes = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: amino_acid(F.substr(cds, i * 3 + 1, F.lit(3))))
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(codes, ""))


def shown(amino: Column) -> Column:
    """The letter that reports print: a stop is X."""
    return F.translate(amino, "*", "X")
