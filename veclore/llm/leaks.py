"""Evaluation texts leaking into a corpus: a prefix-filtered set join on word shingles (problem 6).

A page leaks an item if both have at least ``window`` consecutive words in common. Words are runs of letters and digits
after NFKC, case folding and removal of invisible characters. An item window of 12 words has eight 5-word shingles, and a
page that contains the window contains all of them, so one necessary shingle per window, its rarest in the corpus, is
enough to find every candidate (the prefix of a set join for full containment has length 1). Candidates are bounded by
position (page and item positions must lie on one diagonal that starts inside the page) and verified: at least eight
consecutive shingles on the diagonal must agree.

The corpus is read once; of its shingles only those that occur in an item are kept. Shingles are compared by 64-bit
hashes, and a leak needs eight consecutive ones to agree.

Defined cases: NULL or empty texts have no words and match nothing; items shorter than the window are never found; a text
is read whole however long it is; repeated items and pages are each reported; repeated words and shingles inside a text
are all positions of their own.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.runtime import broadcast_if_small, written

SHINGLE = 5
WINDOW = 12
#: Signs without a width of their own: soft hyphen, joiners, direction marks, variation selectors, byte order mark.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The comparable words of a text."""
    if not isinstance(text, str) or not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        text = unicodedata.normalize("NFKC", text.casefold())
    return WORD.findall(text.casefold())


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def shingle_hashes(text: str | None, size: int, cache: dict[str, int]) -> np.ndarray:
    """A hash for each run of ``size`` words, by position."""
    w = words(text)
    if len(w) < size:
        return np.empty(0, np.int64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n, out = len(w) - size + 1, np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def shingles(texts: DataFrame, key: str, size: int = SHINGLE) -> DataFrame:
    """(key, version, pos, shingle) for every run of ``size`` words of ``text``; ``version`` tells texts of one key apart."""

    @F.pandas_udf("array<bigint>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _WordHash()
        for batch in batches:
            yield pd.Series([shingle_hashes(t, size, cache) for t in batch], dtype=object)

    full = texts.where("text is not null and text != ''").select(key, F.xxhash64("text").alias("version"), hashes("text").alias("all"))
    return full.select(key, "version", F.posexplode("all").alias("pos", "shingle"))


def leaks(pages: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, words): pages (doc_id, text) that share at least ``window`` consecutive words with an item
    (item_id, text), and the longest run shared."""
    per_window = window - size + 1
    parts = written(shingles(items, "item_id", size).distinct(), "items")
    vocabulary = broadcast_if_small(parts.select("shingle").distinct(), 2_000_000)
    hits = written(shingles(pages, "doc_id", size).join(vocabulary, "shingle", "left_semi"), "hits")

    # rarity over the whole corpus; a window with a shingle that no page has cannot leak
    rarity = hits.groupBy("shingle").agg(F.approx_count_distinct("doc_id", 0.02).alias("pages"))
    ahead = Window.partitionBy("item_id", "version").orderBy("pos").rowsBetween(0, per_window - 1)
    ranked = parts.join(rarity, "shingle", "left")
    ranked = ranked.withColumn("least", F.min(F.struct("pages", "shingle", "pos")).over(ahead)).withColumn("there", F.count("pages").over(ahead))
    anchors = ranked.where(F.col("there") == per_window).select(
        "item_id", F.col("version").alias("item_version"), F.col("pos").alias("start"), F.col("least.shingle").alias("shingle"), F.col("least.pos").alias("anchor")
    )
    anchors = broadcast_if_small(written(anchors, "anchors"), 2_000_000)

    # a page position and an item position make a diagonal; hits meet an item's parts on the shingle, never each other, so
    # that a page that repeats a word costs its hits times the item's repeats of it
    line = ["doc_id", "version", "item_id", "item_version", "diagonal"]
    found = hits.join(anchors, "shingle").where(F.col("pos") - F.col("anchor") + F.col("start") >= 0)
    candidates = written(found.select("doc_id", "version", "item_id", "item_version", (F.col("pos") - F.col("anchor")).alias("diagonal")).distinct(), "candidates")
    pages = broadcast_if_small(candidates.select("doc_id", "version").distinct(), 1_000_000)
    items = broadcast_if_small(parts.select("item_id", F.col("version").alias("item_version"), F.col("pos").alias("at"), "shingle"), 2_000_000)
    aligned = hits.join(pages, ["doc_id", "version"], "left_semi").join(items, "shingle").select("doc_id", "version", "item_id", "item_version", (F.col("pos") - F.col("at")).alias("diagonal"), F.col("at").alias("pos"))
    agree = aligned.join(candidates, line, "left_semi").distinct()
    along = Window.partitionBy(*line).orderBy("pos")
    runs = agree.withColumn("run", F.col("pos") - F.row_number().over(along)).groupBy(*line, "run").agg(F.count("*").alias("n"))
    return runs.where(F.col("n") >= per_window).groupBy("doc_id", "item_id").agg((F.max("n") + size - 1).cast("int").alias("words"))
