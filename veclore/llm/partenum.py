"""Near-duplicate records with small edits, by PartEnum signatures (problem 5).

A record is the set of its distinct k-letter substrings. The feature domain is partitioned by hash into ``PARTS`` parts;
the smallest hash a set has in each part represents it, so every record becomes a set of the same size, and two records
agree on a part with a probability equal to their similarity. The parts are put into groups of ``SPAN``, and every
subset that leaves one part of a group out is a signature, together with the record's size band: bands are ``FACTOR`` times
as wide as the last, and a record near the upper end of its band belongs to the next one too. Two records that disagree on fewer than two parts of some group
share one: surely so if at most ``2 * PARTS / SPAN - 1`` parts differ, and with 99.8 % at a similarity of 0.6, over
99.99 % from 0.65 on (the measured recall is in the README). Records that share a signature are filtered by their sizes and all their
parts (two bits each) and then decided exactly on their whole substring sets.

Records with the same text are one while pairs are sought. Signatures are joined, never collected into groups, so that
AQE can split a hot one.

Defined cases: NULL or short segments give no substrings, and a record with none is in no pair; rows without a key are
none; repeated rows of a key count once (the fullest); letters are compared in upper case without blanks and hyphens;
texts of any length are used whole; empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclore.operators.graph import connected_components
from veclore.runtime import written

PARTS, SPAN = 144, 6
#: Records hashed at once in a task: a few million letters.
SLICE = 256
#: Size bands: sets of up to ``FIRST`` substrings, then ``FACTOR`` times as many per band.
FIRST, FACTOR = 16, 8
#: Signatures of one task of their join.
TASK_SIGNATURES = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def clean(segment: str | None) -> str:
    return re.sub(r"[\s-]+", "", segment).upper() if isinstance(segment, str) else ""


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def kmer_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every k-letter substring of every text; windows of doubling length build the hash."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(letters) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, width, factor, done, total = letters + np.uint64(1), 1, int(_ODD), 0, None
    while width <= k:  # k as a sum of powers of two, from the left
        if k & width:
            n = len(letters) - done - width + 1
            part = h[done : done + n]
            total = part if total is None else total[: len(part)] * np.uint64(factor) + part[: len(total)]
            done += width
        h = h[:-width] * np.uint64(factor) + h[width:] if len(h) > width else h[:0]
        factor, width = factor * factor % 2**64, width * 2
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))
    inside = left[: len(total)] >= k
    return owner[: len(total)][inside], _mix(total[inside])


def parts(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, PARTS): 16 bits of the smallest hash in each part of the domain; an empty part borrows from the next one."""
    part = ((hashes >> np.uint64(40)) * np.uint64(PARTS)) >> np.uint64(24)
    low = np.full(n * PARTS, 1 << 40, np.int64)
    np.minimum.at(low, owner * PARTS + part.astype(np.int64), (hashes & np.uint64((1 << 40) - 1)).astype(np.int64))
    low = low.reshape(n, PARTS)
    for step in range(1, PARTS):
        empty = low == 1 << 40
        if not empty.any() or step > 64:
            break
        low = np.where(empty, np.roll(low, -1, axis=1), low)
    return (_mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def bands(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(band of each set size, whether the set belongs to the next band too). Similar sets differ in size by the threshold at
    most, so the larger of two that fall into different bands finds the smaller one at the upper end of its band."""
    factor = max(FACTOR, 2 / threshold)
    band = np.maximum(np.ceil(np.log(np.maximum(n, 1) / FIRST) / np.log(factor)), 0).astype(np.int64)
    return band, n >= threshold * FIRST * factor**band * (1 - 1e-9)


def signatures(sketch: np.ndarray, band: np.ndarray) -> np.ndarray:
    """(n, PARTS): per group and part, the hash of the band and the group's other parts."""
    at = np.arange(PARTS, dtype=np.uint64)
    each = _mix((sketch.astype(np.uint64) + np.uint64(1)) * _ODD + at * np.uint64(0xD6E8FEB86659FD93))
    whole = each.reshape(len(sketch), -1, SPAN).sum(axis=2, dtype=np.uint64).repeat(SPAN, axis=1)
    return _mix(whole - each + at * _ODD + band.astype(np.uint64)[:, None] * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def _two_bits(sketch: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.packbits(np.unpackbits((sketch & 3).astype(np.uint8)[:, :, None], axis=2)[:, :, 6:].reshape(len(sketch), -1), axis=1)]


def sketches(records: DataFrame, k: int) -> DataFrame:
    """(uid, key, text, n, sketch, bits): a row per row of records with substrings; ``text`` identifies the cleaned text."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for s in range(0, len(b), SLICE):
                p = b.iloc[s : s + SLICE]
                first, second = [clean(t) for t in p.first_text], [clean(t) for t in p.second_text]
                owner, hashes = kmer_hashes(first + second, k)
                owner %= len(p)
                count = np.bincount(owner, minlength=len(p))
                sk = parts(owner, hashes, len(p))
                text = [int.from_bytes(hashlib.blake2b(f"{a}|{z}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for a, z in zip(first, second)]
                out = pd.DataFrame({"uid": uid + np.arange(len(p)), "key": p.key.to_numpy(), "text": text, "n": count, "sketch": [r.tobytes() for r in sk], "bits": _two_bits(sk)})
                uid += len(p)
                yield out[count > 0]

    rows = records.where("key is not null and (first_text is not null or second_text is not null)").select("key", "first_text", "second_text")
    return written(rows.mapInPandas(sketch, "uid bigint, key bigint, text bigint, n bigint, sketch binary, bits binary"), "sketches")


def _alike(threshold: float, slack: float = 4.0):
    """Keep a pair unless its parts put it ``slack`` standard deviations under the threshold."""
    expected = threshold + (1 - threshold) / 4
    least = expected - slack * (expected * (1 - expected) / PARTS) ** 0.5

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.unpackbits(np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1), axis=1).reshape(len(s), PARTS, 2) for s in (a, b))
        return pd.Series((x == y).all(axis=2).mean(axis=1) >= least)

    return alike


def _shared(k: int):
    @F.pandas_udf("struct<shared bigint, total bigint>")
    def shared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, np.ndarray] = {}

        def kmers(packed: bytes) -> np.ndarray:
            if packed not in kept:
                if len(kept) > 1500:  # 25 kB each, of records as long as these
                    kept.clear()
                kept[packed] = np.unique(kmer_hashes(zlib.decompress(packed).decode("utf-8", "surrogatepass").split("|"), k)[1])
            return kept[packed]

        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                x, y = kmers(x), kmers(y)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs: merged
                s = int((both[1:] == both[:-1]).sum())
                out.append((s, len(both) - s))
            yield pd.DataFrame(out, columns=["shared", "total"])

    return shared


def similar(records: DataFrame, threshold: float = 0.6, k: int = 16) -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, shared, total between representatives with a < b; members: key, rep) of records (key bigint, first_text, second_text).

    Records with the same text have one representative, the smallest key. Similarity is shared / total of the substrings.
    """
    sk = sketches(records, k)
    # narrow rows decide which row stands for a key and for a text; the wide ones move once
    keys = sk.groupBy("key").agg(F.max(F.struct("n", "text", "uid")).alias("r")).select("key", "r.text", "r.uid")
    reps = keys.groupBy("text").agg(F.min(F.struct("key", "uid")).alias("r")).select("text", F.col("r.key").alias("rep"), F.col("r.uid").alias("uid"))
    members = written(keys.select("key", "text").join(reps, "text").select("key", "rep", "uid"), "members")
    lead = written(sk.join(members.where("key = rep").select("uid"), "uid", "left_semi").select("key", "n", "sketch", "bits"), "lead")
    members = members.select("key", "rep")

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 2000):
                p = b.iloc[s : s + 2000]
                sk, key = np.frombuffer(b"".join(p.sketch), np.uint16).reshape(len(p), PARTS), p.key.to_numpy()
                band, upper = bands(p.n.to_numpy(), threshold)
                yield pd.DataFrame({"key": key, "signature": list(signatures(sk, band))})
                if upper.any():
                    yield pd.DataFrame({"key": key[upper], "signature": list(signatures(sk[upper], band[upper] + 1))})

    sig = lead.select("key", "n", "sketch").mapInPandas(signed, "key bigint, signature array<bigint>").select("key", F.explode("signature").alias("signature"))
    sig = sig.repartition(max(8, -(-lead.count() * PARTS // TASK_SIGNATURES)), "signature")  # tasks keep their size as records grow
    one, two = sig.select(F.col("key").alias("a"), "signature"), sig.select(F.col("key").alias("b"), "signature")
    candidates = one.join(two, "signature").where("a < b").groupBy("a", "b").agg(F.count("*").alias("signatures")).select("a", "b")
    for side in ("a", "b"):
        candidates = candidates.join(lead.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    candidates = candidates.where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9)
    candidates = written(candidates.where(_alike(threshold)("bits_a", "bits_b")).select("a", "b"), "candidates")

    @F.pandas_udf("binary")
    def packed(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(f"{clean(a)}|{clean(b)}".encode("utf-8", "surrogatepass"), 1) for a, b in zip(first, second)], dtype=object)

    asked = written(candidates.select(F.col("a").alias("key")).union(candidates.select("b")).distinct(), "asked")
    # not deterministic for the optimizer, which would else move the texts first and pack them afterwards
    texts = records.select("key", packed.asNondeterministic()("first_text", "second_text").alias("packed")).join(asked, "key", "left_semi")
    texts = texts.groupBy("key").agg(F.max_by("packed", F.length("packed")).alias("packed"))
    pairs = candidates
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("key").alias(side), F.col("packed").alias(f"text_{side}")), side)
    pairs = pairs.select("a", "b", _shared(k)("text_a", "text_b").alias("s")).select("a", "b", "s.shared", "s.total")
    return written(pairs.where(F.col("shared") >= threshold * F.col("total") - 1e-9), "pairs"), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of all keys: the pairs of representatives spread over the keys with the same text, and those among themselves."""
    of_a, of_b = members.select(F.col("rep").alias("a"), F.col("key").alias("key_a")), members.select(F.col("rep").alias("b"), F.col("key").alias("key_b"))
    across = pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
    within = of_a.join(of_b.withColumnRenamed("b", "a"), "a").where("key_a < key_b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return across.unionByName(within)


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, group_id, links): every record with its group, the smallest key it is connected to, and its number of similar records."""
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    component = connected_components(pairs.select("a", "b")).withColumnRenamed("node", "rep")
    out = members.join(copies, "rep").join(linked, "rep", "left").join(component, "rep", "left")
    return out.select("key", F.coalesce("component", "rep").alias("group_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
