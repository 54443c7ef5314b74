"""Alphabets: which letters are valid, which are alike, and how words become numbers."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups in the order of their codes; letters of a group are alike, in both cases.
GROUPS = {
    "nt": "A C G TU",
    "aa": "K R E D Q N C G H I L V M F Y W P S T A",
    "aa11_diamond": "KREDQN C G H ILV M F Y W P STA",
    "aa12_mmseqs": "AST C DN EQ FY G H IV KR LM P W",
    "aa6_dayhoff": "STPAG NDEQ HRK MILV FYW C",
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass(frozen=True)
class Alphabet:
    """A name, its groups, and whether both strands of a sequence count as one."""

    name: str
    groups: tuple[str, ...]
    canonical: bool

    @property
    def bits(self) -> int:
        return ceil(log2(len(self.groups)))

    @property
    def max_k(self) -> int:
        return 64 // self.bits - 1

    @property
    def letters(self) -> str:
        return "".join(g + g.lower() for g in self.groups)

    @property
    def leads(self) -> str:
        """For each of ``letters``, the first letter of its group."""
        return "".join(g[0] * (2 * len(g)) for g in self.groups)

    @property
    def symbols(self) -> str:
        return "".join(g[0] for g in self.groups)

    def check_k(self, k: int) -> None:
        if not 1 <= k <= self.max_k:
            raise ValueError(f"k is {k}; for alphabet {self.name} it is from 1 to {self.max_k}")

    def mapped(self, seq: Column) -> Column:
        """Letters as their group's first letter; other symbols stay, and are invalid."""
        return F.translate(seq, self.letters, self.leads)

    def reverse_complement(self, word: Column) -> Column:
        return F.translate(F.reverse(word), self.symbols, self.symbols[::-1])

    def packed(self, word: Column) -> Column:
        """A word of symbols as a number: the code of each symbol in ``bits`` bits, first symbol highest."""
        return F.conv(F.translate(word, self.symbols, _DIGITS[: len(self.symbols)]), 2**self.bits, 10).cast("long")

    def unpacked(self, number: Column, k: int) -> Column:
        digits = F.lpad(F.conv(number.cast("string"), 10, 2**self.bits), k, "0")
        return F.translate(digits, _DIGITS[: len(self.symbols)], self.symbols)


def alphabet(name: str = "nt", preserve_strand: bool = False) -> Alphabet:
    """``nt`` counts both strands as one unless ``preserve_strand``; ``nt-preserve`` is short for that."""
    base = "nt" if name == "nt-preserve" else name
    if base not in GROUPS:
        raise ValueError(f"unknown alphabet {name!r}; there are {', '.join([*GROUPS, 'nt-preserve'])}")
    if preserve_strand and base != "nt":
        raise ValueError("preserve_strand only goes with alphabet nt")
    return Alphabet(base, tuple(GROUPS[base].split()), base == "nt" and name == "nt" and not preserve_strand)
