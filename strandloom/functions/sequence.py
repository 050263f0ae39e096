"""Sequence functions as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code in TCAG order, and the default start and stop codons.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
START_CODONS = ("ATG", "GTG", "TTG")
STOP_CODONS = ("TAA", "TGA", "TAG")

CODON_TABLE = dict(zip((a + b + c for a in BASES for b in BASES for c in BASES), AMINO_ACIDS))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression inside a lambda would run for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def dna(text: Column) -> Column:
    """Recode prose as DNA: letters A..Z stand for ACGT repeating; everything else goes."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def codons(seq: Column, frame: int = 0) -> Column:
    """The codons of one frame as an array. Built from a character array, as ``substring`` rescans from the start."""
    n = F.length(seq)
    at = F.when(n >= frame + 3, F.sequence(F.lit(frame), n - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return let(F.split(seq, ""), lambda chars: F.transform(at, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2))))


def _codon_letter(chars, i) -> Column:
    """One amino acid letter of three characters of an array; X if they are not three of ACGT."""
    at = [F.position(F.get(chars, i + k), F.lit(BASES)) for k in range(3)]
    whole = (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
    return F.when(whole, F.substr(F.lit(AMINO_ACIDS), (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2], F.lit(1))).otherwise("X")


def translate_full(seq: Column, frame: int = 0) -> Column:
    """Protein of one frame, reading over stops (*)."""
    at = F.when(F.length(seq) >= frame + 3, F.sequence(F.lit(frame), F.length(seq) - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return F.array_join(let(F.split(seq, ""), lambda chars: F.transform(at, lambda i: _codon_letter(chars, i))), "")


def translate_to_stop(seq: Column, frame: int = 0) -> Column:
    """Protein up to and with the first stop."""
    return F.regexp_extract(translate_full(seq, frame), r"^[^*]*\*?", 0)


def codon_positions(seq: Column, wanted=STOP_CODONS) -> Column:
    """All positions (from 0, overlapping) at which one of the codons starts."""
    at = F.when(F.length(seq) >= 3, F.sequence(F.lit(0), F.length(seq) - 3)).otherwise(F.array().cast("array<int>"))
    return let(F.split(seq, ""), lambda chars: F.filter(at, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)).isin(*wanted)))


def frame_mask(positions: Column) -> Column:
    """Three bits: the frames (position modulo 3) that occur."""
    frames = F.array_distinct(F.transform(positions, lambda p: p % 3))
    return F.aggregate(frames, F.lit(0), lambda a, f: a + F.when(f == 0, 1).when(f == 1, 2).otherwise(4))


def partial_masks(mask: Column) -> Column:
    """Nine bits: a 3-bit frame mask as seen from frames shifted by 0, 1 and 2."""
    bit = lambda f: F.shiftright(mask, f).bitwiseAND(F.lit(1))
    orders = ((0, 1, 2), (2, 0, 1), (1, 2, 0))
    return sum((bit(f) * (1 << (3 * g + k)) for g, order in enumerate(orders) for k, f in enumerate(order)), F.lit(0))


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers of a string as an array, in one pass of a look-ahead pattern.

    The pattern steps by UTF-16 units, so texts with characters beyond these are cut into characters instead."""
    fast = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)
    return F.when(seq.rlike(r"[\x{10000}-\x{10FFFF}]"), _kmers_of_characters(seq, k)).otherwise(fast)


def _kmers_of_characters(seq: Column, k: int) -> Column:
    at = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return let(F.split(seq, ""), lambda chars: F.transform(at, lambda i: F.array_join(F.slice(chars, i, F.lit(k)), "")))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def split_n(seq: Column) -> Column:
    """Pieces of a contig between runs of N."""
    return F.filter(F.split(F.upper(seq), "N+"), lambda x: x != "")


def isolate_name(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\.[^.]*$", "")


def gene_label(annotations: Column) -> Column:
    """Names joined by ~~~, keeping letters, digits, _, ~ and -; | becomes -."""
    joined = F.array_join(F.filter(annotations, lambda a: a != ""), "~~~")
    return F.replace(F.regexp_replace(joined, r"[^A-Za-z0-9_~|]", ""), F.lit("|"), F.lit("-"))


def qualifier(text: Column) -> Column:
    """A GFF3 attribute value without the characters that have a meaning there."""
    return F.translate(text, ";=,&%\t", "______")


def back_translate(aligned: Column, dna_seq: Column) -> Column:
    """Codon alignment of an aligned protein: gaps and X become ---, other residues take the next codon."""
    residues = F.split(aligned, "")
    step = F.aggregate(
        residues,
        F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda a, r: F.when(r.isin("-", "X"), F.struct((a["i"] + F.when(r == "X", 1).otherwise(0)).alias("i"), F.concat(a["out"], F.lit("---")).alias("out"))).otherwise(
            F.struct((a["i"] + 1).alias("i"), F.concat(a["out"], F.replace(F.substr(dna_seq, a["i"] * 3 + 1, F.lit(3)), F.lit("N"), F.lit("-"))).alias("out"))
        ),
    )
    return step["out"]


def best_frame(seq: Column, target: Column, k: int = 3) -> Column:
    """Of the six translations the one that shares most distinct k-mers with a protein (earlier frames win ties)."""
    shared = lambda p: F.size(F.array_intersect(kmers(p, k), kmers(target, k)))
    options = F.array(*[translate_full(s, f) for s in (seq, reverse_complement(seq)) for f in (0, 1, 2)])
    scored = F.transform(options, lambda p, i: F.struct(shared(p).alias("n"), (-i).alias("o"), p.alias("p")))
    return F.array_max(scored)["p"]


def reverse_path(nodes: Column) -> Column:
    """The same path read on the other strand."""
    return F.transform(F.reverse(nodes), lambda x: -x)


def path_string(nodes: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(F.transform(nodes, lambda x: x.cast("string")), ","), F.lit(","))


def encode(seq: Column, alphabet: str) -> Column:
    """The letters as numbers from 1 by their place in the alphabet, 0 for all others."""
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(alphabet)))


def median(values: Column) -> Column:
    """The middle of an array of numbers, the mean of the middle two if their count is even; null if there are none."""
    s, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def strip_unknown(seq: Column) -> Column:
    """Without the runs of N at both ends."""
    return F.regexp_replace(seq, "^N+|N+$", "")


def mask_beyond_gaps(protein: Column, gap: int = 20) -> Column:
    """A protein whose ends lie beyond a run of ``gap`` unknown residues or more has X there: what is cut off by such a
    run at either end is not part of the hit, but places stay as they are."""
    front = F.regexp_extract(protein, f"^[^X]*X{{{gap},}}", 0)
    rest = F.substr(protein, F.length(front) + 1)
    back = F.regexp_extract(rest, f"X{{{gap},}}[^X]*$", 0)
    return F.concat(F.repeat(F.lit("X"), F.length(front)), F.substr(rest, F.lit(1), F.length(rest) - F.length(back)), F.repeat(F.lit("X"), F.length(back)))
