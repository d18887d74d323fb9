"""Column functions for headers, dates, labels and letter sequences. All but the letter-by-letter comparison run inside the JVM; NULL in, NULL out unless said."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The standard genetic code, bases in the order T C A G, and the null tokens of label files.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
NULL_TOKENS = ("", "nan", "none", "na", "n/a", "not assigned", "unassigned")
#: Segment names as headers write them.
SEGMENTS = {"HA": ("HA", "4", "ha", "Seg4", "4_HA"), "NA": ("NA", "6", "na", "Seg6", "6_NA")}
#: Inclusive length limits of a good sequence, and the largest share of N.
LENGTHS = {"HA": (1650, 1800), "NA": (1200, 1600)}
MAX_N = 0.01


def header_field(header: Column, i: int) -> Column:
    """Field ``i`` of a header split at ``|``, trimmed; NULL if the header has fewer than five fields."""
    parts = F.split(header, r"\|")
    return F.when(F.size(parts) >= 5, F.trim(F.get(parts, F.lit(i))))


def segment_name(c: Column) -> Column:
    """HA or NA for any of their spellings, NULL for other segments."""
    out = F.lit(None).cast("string")
    for name, spellings in SEGMENTS.items():
        out = F.when(c.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def subtype(c: Column) -> Column:
    """``HxNy`` where the value contains one, else the value itself."""
    h, n = (F.regexp_extract(c, r"(?i)H(\d+)N(\d+)", i) for i in (1, 2))
    return F.when(h != "", F.concat(F.lit("H"), h, F.lit("N"), n)).otherwise(c)


def date_part(c: Column, part: str) -> Column:
    """year, month or day of a full date; of a bare year June 15 (see ``date_imputed``); NULL without a year. No calendar check."""
    full = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    exact = F.regexp_extract(c, full, {"year": 1, "month": 2, "day": 3}[part])
    year = F.regexp_extract(c, r"^(\d{4})", 1)
    fallback = {"year": F.when(year != "", year.cast("int")), "month": F.when(year != "", F.lit(6)), "day": F.when(year != "", F.lit(15))}[part]
    return F.when(exact != "", exact.cast("int")).otherwise(fallback)


def date_imputed(c: Column) -> Column:
    return (F.regexp_extract(c, r"^(\d{4})-(\d{1,2})-(\d{1,2})", 1) == "") & (F.regexp_extract(c, r"^(\d{4})", 1) != "")


def name_year(c: Column) -> Column:
    """Year at the end of a strain name: four digits, or two (up to 30: 20xx, else 19xx); else a year between separators."""
    four, two = F.regexp_extract(c, r"/((?:19|20)\d{2})$", 1), F.regexp_extract(c, r"/(\d{2})$", 1)
    anywhere = F.regexp_extract(c, r"[|/\s]((?:19|20)\d{2})[|/\s]", 1)
    short = two.cast("int")
    return F.when(four != "", four.cast("int")).when(two != "", F.when(short <= 30, short + 2000).otherwise(short + 1900)).when(anywhere != "", anywhere.cast("int"))


def strain_key(c: Column) -> Column:
    """Name for pairing: upper case, no white space, no trailing HxNy, no parentheses, in this order."""
    s = F.regexp_replace(F.upper(c), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(s, r"H\d+N\d+$", ""), r"[()]", "")


def accession_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), r"^([A-Za-z_]+)(\d+)$", 1), F.lit(""))


def accession_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), r"^([A-Za-z_]+)(\d+)$", 2), F.lit("")).try_cast("bigint")


def clean_label(c: Column) -> Column:
    """The trimmed label; NULL for the null tokens."""
    return F.when(~F.lower(F.trim(c)).isin(*NULL_TOKENS), F.trim(c))


def major_label(major: Column, label: Column) -> Column:
    """The explicit major label, else the first two dot components of the label."""
    return F.coalesce(clean_label(major), F.substring_index(clean_label(label), ".", 2))


def month_index(year: Column, month: Column, clip: bool = True, first: int = 0) -> Column:
    """Months since year 0, the month clipped to 1..12 (or not); NULL if either is. ``first``: the number of January of year 0."""
    inside = F.greatest(F.lit(1), F.least(F.lit(12), month)) if clip else month
    return F.when(month.isNotNull(), year * 12 + inside - 1 + first)


def month_label(index: Column) -> Column:
    return F.when(index.isNotNull(), F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int")))


def canonical(c: Column) -> Column:
    """Upper case, ASCII only."""
    return F.upper(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


def letter_share(c: Column, letter: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))) / F.nullif(F.length(c), F.lit(0))


def good_sequence(c: Column, segment: str) -> Column:
    """Length within limits, only A T C G N, at most 1 % N; NULL is not good."""
    low, high = LENGTHS[segment]
    return F.coalesce(F.length(c).between(low, high) & c.rlike("^[ATCGN]+$") & (letter_share(c, "N") <= MAX_N), F.lit(False))


_BASE = np.full(128, 4, np.int64)
_BASE[[ord(c) for c in BASES]] = range(4)
_ACIDS = np.array([ord(c) for c in AMINO_ACIDS], np.uint8)


@F.pandas_udf(T.StringType())
def _protein(s: pd.Series) -> pd.Series:
    """Whole codons looked up as arrays: a lambda per codon would be interpreted."""

    def one(t):
        if not isinstance(t, str):
            return None
        letters = np.frombuffer(t[: len(t) // 3 * 3].encode("utf-32-le", "surrogatepass"), np.uint32)
        a, b, c = _BASE[np.where(letters < 128, letters, 0)].reshape(-1, 3).T if len(letters) else np.empty((3, 0), np.int64)
        known = (a < 4) & (b < 4) & (c < 4)
        return np.where(known, _ACIDS[np.where(known, 16 * a + 4 * b + c, 0)], ord("X")).astype(np.uint8).tobytes().decode("ascii")

    return pd.Series([one(t) for t in s], dtype=object)


def translated(c: Column, stop: bool = False) -> Column:
    """Amino acids of the whole codons in frame 0, ``X`` for unknown codons. ``stop``: N reads as A, and the protein ends before the first stop."""
    s = F.replace(F.upper(c), F.lit("N"), F.lit("A")) if stop else F.upper(c)
    protein = F.when(c.isNotNull(), _protein(s))
    return F.substring_index(protein, "*", 1) if stop else protein


def content_key(*columns: Column, bits: int = 1) -> Column:
    """sha1 (or sha2 of ``bits``) of the columns joined by ``|``; NULL counts as empty."""
    text = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in columns))
    return F.sha1(text) if bits == 1 else F.sha2(text, bits)


def kmers(c: Column, k: int) -> Column:
    """All k-letter substrings, by position; an empty array for shorter texts."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def joined_segments(a: Column, b: Column, k: int) -> Column:
    """Both segments with k letters N between them, so that no k-mer is made of both ends only."""
    return F.concat(F.upper(a), F.lit("N" * k), F.upper(b))


@F.pandas_udf(T.IntegerType())
def _differing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Compared as arrays of code points: a lambda per letter would be interpreted, two orders of magnitude slower."""
    out = np.zeros(len(a), np.int32)
    for i, (s, t) in enumerate(zip(a, b)):
        if isinstance(s, str) and isinstance(t, str):
            n = min(len(s), len(t))
            out[i] = np.count_nonzero(np.frombuffer(s[:n].encode("utf-32-le"), np.uint32) != np.frombuffer(t[:n].encode("utf-32-le"), np.uint32))
    return pd.Series(out)


def mismatches(a: Column, b: Column) -> Column:
    """Differing letters over the shorter length; NULL if that is 0."""
    return F.when(a.isNotNull() & b.isNotNull() & (F.least(F.length(a), F.length(b)) > 0), _differing(a, b))


def hamming(a: Column, b: Column, tolerance: float | None = 0.05) -> Column:
    """Mismatches over the shorter length, divided by it. NULL for empty texts, and for lengths that differ by more than ``tolerance`` of the longer."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    fits = F.lit(True) if tolerance is None else (high - low) / F.nullif(high, F.lit(0)) <= tolerance
    return F.when(a.isNotNull() & b.isNotNull() & (low > 0) & fits, mismatches(a, b) / low)


def weighted_hamming(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Two-segment distance, each segment weighted by its compared length; NULL if either is."""
    w1, w2 = F.least(F.length(a1), F.length(b1)), F.least(F.length(a2), F.length(b2))
    return (hamming(a1, b1) * w1 + hamming(a2, b2) * w2) / F.nullif(w1 + w2, F.lit(0))


def position_codes(c: Column, length: int, letters: str = "ARNDCQEGHILKMFPSTWYV") -> Column:
    """The first ``length`` letters as codes: 0.. for known letters, their number + 1 for others, padded with code 0."""
    unknown = len(letters) + 1
    code = lambda x: F.when(F.instr(F.lit(letters), x) > 0, F.instr(F.lit(letters), x) - 1).otherwise(unknown)
    return F.transform(F.split(F.rpad(F.left(c, F.lit(length)), length, letters[0]), ""), code)


def contains_run(sequence: Column, run: Column) -> Column:
    """Whether one array occurs in the other as a contiguous part; an empty run always does."""
    wrap = lambda x: F.concat(F.lit(","), F.array_join(x, ","), F.lit(","))
    return (F.size(run) == 0) | F.contains(wrap(sequence), wrap(run))
