"""Letter tokens of a two-segment record: encoding, decoding, padding and a length budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids of the letters (N also stands for unknown ones), of the structural tokens and of the subtypes.
LETTERS = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
UNK, PAD, SEP, EOS, HA, NA = 4, 5, 6, 7, 8, 9
SUBTYPES = ["<H1N1>", "<H3N2>", "<H5N6>", "<H7N9>", "<H9N2>", "<H5N1>", "<H10N3>", "<H1N2>", "<H3N8>", "<H6N1>", "<H2N2>", "<H10N8>", "<H10N5>", "<H5N8>", "<H7N4>"]
SUBTYPE_IDS = {name: 10 + i for i, name in enumerate(SUBTYPES)}


def _ids(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def encoded_letters(c: Column) -> Column:
    """One id per letter; unknown letters are ``UNK``; NULL or empty text gives an empty array."""
    known = _ids(LETTERS)
    return F.when(F.length(c) > 0, F.transform(F.split(F.upper(c), ""), lambda x: F.coalesce(known[x], F.lit(UNK)))).otherwise(F.array().cast("array<int>"))


def encoded_record(ha: Column, na: Column, subtype_token: Column | None = None) -> Column:
    """[subtype,] HA mark, HA letters, separator, NA mark, NA letters, end. An unknown subtype is ``UNK``."""
    lead = [] if subtype_token is None else [F.coalesce(_ids(SUBTYPE_IDS)[subtype_token], F.lit(UNK))]
    return F.concat(F.array(*lead, F.lit(HA)), encoded_letters(ha), F.array(F.lit(SEP), F.lit(NA)), encoded_letters(na), F.array(F.lit(EOS)))


def decoded(ids: Column) -> Column:
    """The letters of the ids, structural tokens left out."""
    letter = _ids({v: k for k, v in LETTERS.items()})
    return F.array_join(F.filter(F.transform(ids, lambda i: letter[i]), lambda x: x.isNotNull()), "")


def padded(ids: Column, length: int, left: bool = False) -> Column:
    """Exactly ``length`` ids: cut at the end, or filled with ``PAD`` on the right (or left)."""
    cut = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(PAD), F.lit(length) - F.size(cut))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def mask(ids: Column) -> Column:
    """1 for each id, 0 for padding."""
    return F.transform(ids, lambda i: (i != PAD).cast("int"))


def batched(rows: DataFrame, ids: str = "ids", length: int | None = None, left: bool = False) -> DataFrame:
    """``rows`` with ``ids`` padded (or cut) to ``length``, the longest of all rows if None, and their ``attention_mask``. NULL ids stay NULL."""
    if length is None:
        length = rows.agg(F.max(F.size(ids))).first()[0] or 0
    same = F.when(F.col(ids).isNotNull(), padded(F.col(ids), length, left))
    return rows.withColumn(ids, same).withColumn("attention_mask", mask(F.col(ids)))


def budgeted(ha: Column, na: Column, budget: int, ha_share: float = 0.55, structural: int = 5) -> tuple[Column, Column]:
    """Prefixes of both segments that fit the budget: whole if they do, else 55 % of the free places to HA and the rest to NA."""
    free = budget - structural
    whole = F.length(ha) + F.length(na) <= free
    keep = int(free * ha_share)
    return F.when(whole, ha).otherwise(F.left(ha, F.lit(keep))), F.when(whole, na).otherwise(F.left(na, F.lit(free - keep)))
