"""Open reading frames."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from strandloom.functions.sequence import AMINO_ACIDS, BASES, START_CODONS, STOP_CODONS


def read_codons(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Start and stop codons of a JSON file {"codons": {"start": [...], "stop": [...]}}; what it lacks is the default."""
    rows = spark.read.schema("codons struct<start: array<string>, stop: array<string>>").json(path, multiLine=True).first()
    found = rows.codons if rows is not None and rows.codons is not None else None
    return tuple(found.start) if found is not None and found.start else START_CODONS, tuple(found.stop) if found is not None and found.stop else STOP_CODONS


def _places(chars: np.ndarray, codons) -> np.ndarray:
    """Where one of the codons begins."""
    found = np.zeros(max(len(chars) - 2, 0), bool)
    for x, y, z in (map(ord, c) for c in codons if len(c) == 3):
        found |= (chars[:-2] == x) & (chars[1:-1] == y) & (chars[2:] == z)
    return np.flatnonzero(found)


def _characters(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode(), np.uint8) if seq.isascii() else np.frombuffer(seq.encode("utf-32-le"), np.uint32)


def _pairs(begin: np.ndarray, stop: np.ndarray, min_len: int):
    """(frame, starts, stops) for each frame: every start with the first stop that is not before it."""
    for frame in range(3):
        b, s = begin[begin % 3 == frame], stop[stop % 3 == frame]
        at = np.searchsorted(s, b)
        b, at = b[at < len(s)], at[at < len(s)]
        long = s[at] + 3 - b >= min_len
        yield frame, b[long], s[at[long]]


#: Letters of codons, whose bases are numbered as in TCAG; what is not three of these is X.
_ACIDS = np.frombuffer(AMINO_ACIDS.encode() + b"X", np.uint8)
_BASES = np.array([BASES.find(chr(c)) if chr(c) in BASES else 64 for c in range(256)])


def _translated(chars: np.ndarray, frame: int) -> str:
    """A frame as protein, reading over stops."""
    n = max(len(chars) - frame, 0) // 3
    x = _BASES[np.minimum(chars[frame : frame + 3 * n], 255)].reshape(n, 3)
    return _ACIDS[np.minimum(16 * x[:, 0] + 4 * x[:, 1] + x[:, 2], 64)].tobytes().decode()


#: Prose as DNA byte by byte, as ``functions.sequence.dna`` recodes it: letters stand for ACGT repeating, the rest goes.
_LETTERS = bytes(b"ACGT"[(c & 31) - 1 & 3] if chr(c).isalpha() and c < 128 else 0 for c in range(256))
_OTHERS = bytes(c for c in range(256) if not _LETTERS[c])


def orf_pairs(seqs: DataFrame, id_col: str, seq_col: str, min_len: int = 90, starts=START_CODONS, stops=STOP_CODONS, with_dna: bool = False, prose: bool = False, with_protein: bool = False) -> DataFrame:
    """Every start codon with the next stop codon in its frame, forward strand.

    Arrow batches: a sequence is compared with the codons as an array, and starts look up their stops among the sorted
    ones of their frame: no window, no shuffle, and long sequences stay linear. Positions count bases from 0; ``len``
    includes the stop codon. Null and short sequences give no row. ``with_dna`` adds the ORF's sequence as ``dna``. With
    ``prose`` the column is text that is recoded as ``dna`` does on the way. ``with_protein`` adds ``protein``, up to and
    with the first stop of the genetic code: a frame is translated once and cut.
    """
    rows = seqs.where(F.length(seq_col) >= 6).select(F.col(id_col).alias("id"), F.col(seq_col).alias("_seq"))
    kinds = [StructField(c, IntegerType(), False) for c in ("frame", "start", "stop", "len")] + [StructField("dna", StringType(), False)] * with_dna + [StructField("protein", StringType(), False)] * with_protein
    schema = StructType([StructField("id", rows.schema["id"].dataType), *kinds])

    def scan(batches):
        for batch in batches:
            of, found, dna, protein = [], [], [], []
            for i, seq in enumerate(batch.column(1)):
                seq = seq.as_py()
                if prose:
                    seq = seq.encode().translate(_LETTERS, _OTHERS).decode()
                if len(seq) < 6:
                    continue
                chars = _characters(seq)
                for frame, b, s in _pairs(_places(chars, starts), _places(chars, stops), min_len):
                    if len(b):
                        of.append(np.full(len(b), i))
                        found.append(np.stack([np.full(len(b), frame), b, s, s + 3 - b]).astype(np.int32))
                        if with_dna:
                            dna += [seq[x : y + 3] for x, y in zip(b.tolist(), s.tolist())]
                        if with_protein:
                            whole = _translated(chars, frame)
                            each = (whole[x // 3 : y // 3 + 1] for x, y in zip(b.tolist(), s.tolist()))
                            protein += [p if (end := p.find("*")) < 0 else p[: end + 1] for p in each]
            if of:
                ids = batch.column(0).take(pa.array(np.concatenate(of)))
                texts = [pa.array(dna, pa.string())] * with_dna + [pa.array(protein, pa.string())] * with_protein
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, np.concatenate(found, axis=1)), *texts], schema.names)

    return rows.mapInArrow(scan, schema)


_OPPOSITE = str.maketrans("ACGT", "TGCA")


def both_strands(contigs: DataFrame, keys: list[str], seq: str, min_len: int = 90, starts=START_CODONS, stops=STOP_CODONS, partial: bool = True) -> DataFrame:
    """(keys, strand, frame, start, end, stop, len, dna, partial5, partial3): ORFs of both strands of each contig.

    start and end are places on the forward strand, from 0 and exclusive, so that ORFs of both strands share
    coordinates; ``stop`` is where the stop codon begins, read along the ORF's own strand. With ``partial``, what a
    contig's end cuts off counts too: a frame open at the beginning has an ORF from its first whole codon to its first
    stop (partial5), and one without a stop before the end has its starts' ORFs up to the last whole codon (partial3).
    """
    rows = contigs.where(F.length(seq) >= 3).select(F.struct(*keys).alias("k"), F.upper(F.col(seq)).alias("_seq"))
    ints = [StructField(c, IntegerType()) for c in ("strand", "frame", "start", "end", "stop", "len")]
    schema = StructType([StructField("k", rows.schema["k"].dataType), *ints, StructField("dna", StringType()), StructField("partial5", BooleanType()), StructField("partial3", BooleanType())])

    def orfs(seq: str):
        """(frame, start, stop or None, len, partial5, partial3) along this strand."""
        chars = _characters(seq)
        begin, stop = _places(chars, starts), _places(chars, stops)
        for frame, b, s in _pairs(begin, stop, min_len) if len(seq) >= 6 else ():
            yield from ((frame, x, y, y + 3 - x, False, False) for x, y in zip(b.tolist(), s.tolist()))
        for frame in range(3) if partial else ():
            n = (len(seq) - frame) // 3
            if n < 1:
                continue
            b, s = begin[begin % 3 == frame].tolist(), stop[stop % 3 == frame].tolist()
            if not b or b[0] != frame:  # open at the beginning: to the first stop, or to the end if there is none
                length = s[0] + 3 - frame if s else 3 * n
                if length >= min_len:
                    yield frame, frame, s[0] if s else None, length, True, not s
            for x in b[bisect_right(b, s[-1]) if s else 0 :]:
                if frame + 3 * n - x >= min_len:
                    yield frame, x, None, frame + 3 * n - x, False, True

    def scan(batches):
        for batch in batches:
            of, cols = [], [[] for _ in range(9)]
            for i, one in enumerate(batch.column(1)):
                forward = one.as_py()
                for strand, text in ((1, forward), (-1, forward.translate(_OPPOSITE)[::-1])):
                    for frame, at, stop, length, five, three in orfs(text):
                        low = at if strand > 0 else len(text) - at - length
                        of.append(i)
                        for col, value in zip(cols, (strand, frame, low, low + length, stop, length, text[at : at + length], five, three)):
                            col.append(value)
            if of:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 6 + [pa.string(), pa.bool_(), pa.bool_()]))], schema.names)

    return rows.mapInArrow(scan, schema).select(*[F.col(f"k.{c}").alias(c) for c in keys], *schema.names[1:])


def stop_frequency(contigs: DataFrame, seq: str, stops=STOP_CODONS) -> float:
    """Stop codons per place of three bases, both strands and all frames, of all contigs; 0 without such places.

    A stop of the other strand is its reverse complement on this one, so each sequence is compared as an array once."""
    back = [c.translate(_OPPOSITE)[::-1] for c in stops]

    def count(batches):
        for batch in batches:
            found = of = 0
            for one in batch.column(0):
                chars = _characters(one.as_py())
                found, of = found + len(_places(chars, stops)) + len(_places(chars, back)), of + 2 * max(len(chars) - 2, 0)
            yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([of])], ["found", "of"])

    found, of = contigs.where(F.col(seq).isNotNull()).select(seq).mapInArrow(count, "found long, of long").agg(F.sum("found"), F.sum("of")).first()
    return found / of if of else 0.0


@F.pandas_udf(StringType())
def protein_to_stop(dna: pd.Series) -> pd.Series:
    """``translate_to_stop`` in Arrow batches, for columns of many whole ORFs."""

    def read(seq):
        protein = _translated(_characters(seq or ""), 0)
        end = protein.find("*")
        return protein if end < 0 else protein[: end + 1]

    return dna.map(read)
