"""k-mer term vectors: TF-IDF, cosine neighbours of a query set, reranking, random projection.

Terms are counted inside tasks, text by text, and never become rows of their own: only a group's vocabulary, one row per term,
is aggregated. Where it fits ``MAX_TERMS`` it goes to the tasks, which make matrices of the texts they compare; else terms
are joined (``tfidf``, ``cosine_neighbors``), with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.functions.sequences import kmers
from veclore.operators.knn import exact_neighbors

#: Terms of all groups together that are sent to the tasks: at most 24 bytes each.
MAX_TERMS = 500_000
#: Texts of a block: a task holds their term matrix.
TEXT_BLOCK = 2_000


def term_codes(text: str | None, k: int) -> np.ndarray:
    """A number for each k-letter substring, by position: ASCII letters are packed (k up to 9), others hashed."""
    if not isinstance(text, str) or len(text) < k:
        return np.empty(0, np.int64)
    if text.isascii() and k <= 9:
        letters = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.int64)
        n, out = len(letters) - k + 1, np.zeros(len(letters) - k + 1, np.int64)
        for i in range(k):
            out = (out << 7) | letters[i : i + n]
        return out
    return np.array([_term_code(text[i : i + k]) for i in range(len(text) - k + 1)], np.int64)


def _term_code(term: str) -> int:
    """Of one term, as ``term_codes`` numbers it."""
    if term.isascii() and len(term) <= 9:
        return int("".join(f"{ord(c):07b}" for c in term), 2)
    return -1 - (int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1)


def term_statistics(rows: DataFrame, text: Column, k: int, group: str = "grp") -> DataFrame:
    """(group, term, df, tf, docs): in how many texts of the group a term occurs, how often, and the texts with terms. A task
    adds up its batches per group before anything is shuffled. NULL and short texts have no terms."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, p in b.groupby("grp"):
                found, names = [], {}
                for t in p.t:
                    codes, at, n = np.unique(term_codes(t, k), return_index=True, return_counts=True)
                    if len(codes):
                        found.append((codes, n))
                        names.update((c, t[i : i + k]) for c, i in zip(codes.tolist(), at.tolist()) if c not in names)
                if found:
                    codes, back, df = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True, return_counts=True)
                    tf = np.bincount(back, weights=np.concatenate([n for _, n in found])).astype(np.int64)
                    yield pd.DataFrame({"grp": g, "term": [names[c] for c in codes.tolist()], "df": df, "tf": tf})
                    yield pd.DataFrame({"grp": [g], "term": [None], "df": [len(found)], "tf": [0]})  # the texts

    held = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), text.alias("t")).where("t is not null")
    sums = held.mapInPandas(counted, "grp string, term string, df bigint, tf bigint").groupBy("grp", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    docs = sums.where("term is null").select("grp", F.col("df").alias("docs"))
    return sums.where("term is not null").join(F.broadcast(docs) if docs.limit(10_001).count() <= 10_000 else docs, "grp").select(F.col("grp").alias(group), "term", "df", "tf", "docs")


def weighted(statistics: DataFrame, k: int, signs: int | None = None) -> Callable[[pd.Series, str], np.ndarray] | None:
    """A function from texts of a group to their TF-IDF matrix, rows of unit length: tf * (ln((1 + docs) / (1 + df)) + 1). With
    ``signs`` the columns are added up with hashed signs to so many dimensions. None where the vocabulary is over ``MAX_TERMS``."""
    rows = statistics.select("grp", "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")).limit(MAX_TERMS + 1).toPandas()
    if len(rows) > MAX_TERMS:
        return None
    known = {}
    for g, p in rows.groupby("grp"):
        codes = np.array([_term_code(t) for t in p.term], np.int64)
        order = np.argsort(codes)
        known[g] = codes[order], p.idf.to_numpy()[order]

    def features(texts: pd.Series, g: str) -> np.ndarray:
        codes, idf = known.get(g, (np.empty(0, np.int64), np.empty(0)))
        out = np.zeros((len(texts), max(1, len(codes))))
        for i, t in enumerate(texts):
            c, n = np.unique(term_codes(t, k), return_counts=True)
            at = np.searchsorted(codes, c)
            out[i, at] = n * idf[at] if len(c) else 0.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(norm > 0, norm, 1.0)
        if signs is None:
            return out
        h = (codes.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, signs + 1, dtype=np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out = out[:, : len(codes)] @ np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)

    return features


def term_neighbors(rows: DataFrame, text: Column, k: int, most: int, signs: int | None = None, group: str = "grp", key: str = "id", asks: str = "asks") -> DataFrame:
    """(group, query_id, rank, neighbor_id, distance): the ``most`` rows of the group nearest to each row that asks, by cosine of
    their TF-IDF terms, or with ``signs`` by Euclidean distance of their random projections. Texts travel, not terms. Rows without terms are none."""
    held = rows.select(group, key, asks, text.alias("__text")).where(F.length("__text") >= k)
    features = weighted(term_statistics(held, F.col("__text"), k, group), k, signs)
    if features is None:
        terms = tfidf(term_counts(held, F.col("__text"), k, group, key), group, key)
        if signs is not None:
            return exact_neighbors(random_projection(terms, signs, group=group, key=key).join(held.select(key, asks), key), most, group, key)
        return cosine_neighbors(terms, held.where(asks), most, group, key).withColumn("distance", F.round(1 - F.col("similarity"), 9)).drop("similarity")
    return exact_neighbors(held, most, group, key, "__text", asks, metric="cosine" if signs is None else "euclidean", features=features, row_block=TEXT_BLOCK, digits=9)


def term_counts(rows: DataFrame, text: Column, k: int, group: str = "grp", key: str = "id") -> DataFrame:
    """(group, id, term, tf). NULL and short texts have no terms."""
    return rows.select(group, key, F.explode(kmers(text, k)).alias("term")).groupBy(group, key, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, group: str = "grp", key: str = "id") -> DataFrame:
    """(group, id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), unit length per row. Statistics are those of the group."""
    n = counts.select(group, key).distinct().groupBy(group).agg(F.count("*").alias("__n"))
    df = counts.groupBy(group, "term").agg(F.count("*").alias("__df"))
    idf = df.join(n, group).select(group, "term", (F.log((1 + F.col("__n")) / (1 + F.col("__df"))) + 1).alias("__idf"))
    raw = counts.join(idf, [group, "term"]).withColumn("__w", F.col("tf") * F.col("__idf"))
    norms = raw.groupBy(group, key).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    return raw.join(norms, [group, key]).select(group, key, "term", (F.col("__w") / F.col("__norm")).alias("weight"))


def cosine_neighbors(weights: DataFrame, asks: DataFrame, k: int, group: str = "grp", key: str = "id") -> DataFrame:
    """(group, query_id, rank, neighbor_id, similarity): the k rows of the group with the largest cosine to each row of ``asks`` (id).

    A query's terms are joined with all rows on the term; sums are combined per (query, row) before the shuffle.
    """
    q = weights.join(asks.select(key).distinct(), key, "left_semi").select(group, F.col(key).alias("query_id"), "term", F.col("weight").alias("__q"))
    hits = weights.join(q, [group, "term"]).where(F.col(key) != F.col("query_id"))
    scored = hits.groupBy(group, "query_id", F.col(key).alias("neighbor_id")).agg(F.sum(F.col("weight") * F.col("__q")).alias("similarity"))
    scored = scored.withColumn("similarity", F.round("similarity", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reranked(candidates: DataFrame, distance: Column, k: int, group: str = "grp") -> DataFrame:
    """The candidates (with columns for ``distance``) in the order of the exact distance, NULL last, ties by id; the best k."""
    order = Window.partitionBy("query_id").orderBy(F.col("distance").isNull(), "distance", "neighbor_id")
    return candidates.withColumn("distance", distance).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(group, "query_id", "rank", "neighbor_id", "distance")


def random_projection(weights: DataFrame, dims: int, seed: int = 0, group: str = "grp", key: str = "id") -> DataFrame:
    """(group, id, vector): each term adds its weight with a hashed sign to a hashed dimension per row; unit length."""
    h = F.xxhash64("term", F.lit(seed))
    signed = weights.select(group, key, F.pmod(h, F.lit(dims)).cast("int").alias("pos"), F.when(F.shiftright(h, 40) % 2 == 0, F.col("weight")).otherwise(-F.col("weight")).alias("w"))
    sums = signed.groupBy(group, key, "pos").agg(F.sum("w").alias("w"))
    out = sums.groupBy(group, key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "w"))).alias("m"))  # at most ``dims`` entries
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return out.select(group, key, F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(x)).alias("vector"))
