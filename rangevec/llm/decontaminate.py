"""Benchmark decontamination with spaced seeds.

A spaced seed hashes the tokens at a mask's ones and ignores those at its
zeros, so a substituted token under a zero still leaves a hit. Hashes of the
benchmark's windows are joined with those of every document window (a bit map
first, then a search in the sorted hashes), and each hit's diagonal is verified
by the longest stretch of document and item tokens of which at least the share
s are equal. Items shorter than every mask are their own seed, with all words.

The benchmark is a query set: it is taken in blocks of bounded size, each held
against all documents, so neither side is shuffled. Hits are few and written to
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangevec.llm.common import python_rows, real_ids, short_batches, table
from rangevec.sources.scratch import materialize

MASKS = ("111111", "1110111", "11011011", "1100110011")
SIMILARITY = 0.8
MIN_TOKENS = 12
BLOCK_BYTES = 16 << 20
_MAP_BITS = 22
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_SEPARATE = bytes(b if b in _KEEP else 0x20 for b in range(256))
_FACTORS = [int(x) | 1 for x in np.random.default_rng(7).integers(1, 2**63, 64)]


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's words: runs of digits, lower-cased ASCII letters and characters beyond ASCII."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATE).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def seeds(tok: np.ndarray, mask: str, no: int) -> np.ndarray:
    """The hash of each window under a mask."""
    n = len(tok) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(no + 1))
    for k, bit in enumerate(mask):
        if bit == "1":
            out += tok[k : k + n] * np.uint64(_FACTORS[k])
    return (out ^ (out >> np.uint64(31))) * np.uint64(_FACTORS[-1])


def best_stretch(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """Start and end of the longest stretch with at least the share ``similarity`` of matches, the first of such."""
    run = np.concatenate([[0.0], np.cumsum(same - similarity)])
    later = np.maximum.accumulate(run[::-1])  # best sum from the end back to each place
    ends = len(run) - 1 - np.searchsorted(later, run - 1e-9)
    start = int(np.argmax(ends - np.arange(len(run))))
    return start, int(ends[start])


class Block:
    """Items of one block with the hashes of their windows."""

    def __init__(self, ids: list, texts: list[str], masks: tuple[str, ...]) -> None:
        self.ids = ids
        self.toks = [tokens(t or "") for t in texts]
        least = min(map(len, masks))
        short = sorted({len(tok) for tok in self.toks if 0 < len(tok) < least})
        self.masks = masks + tuple("1" * n for n in short)
        keys, item, pos = [], [], []
        for i, tok in enumerate(self.toks):
            for no, mask in enumerate(self.masks):
                if no >= len(masks) and len(tok) != len(mask):
                    continue
                found = seeds(tok, mask, no)
                keys.append(found)
                item.append(np.full(len(found), i))
                pos.append(np.arange(len(found)))
        keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *item])[order]
        self.pos = np.concatenate([np.zeros(0, np.int64), *pos])[order]
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[self.keys >> np.uint64(64 - _MAP_BITS)] = True

    def overlaps(self, tok: np.ndarray, similarity: float, min_tokens: int) -> list[tuple]:
        """(item_id, start, length, equal) of verified overlaps, the longest of each diagonal."""
        lines = set()
        for no, mask in enumerate(self.masks):
            own = seeds(tok, mask, no)
            at = np.flatnonzero(self.map[own >> np.uint64(64 - _MAP_BITS)])
            if not len(at):
                continue
            lo, hi = (np.searchsorted(self.keys, own[at], side) for side in ("left", "right"))
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                lines.update(zip(self.item[a:b].tolist(), (p - self.pos[a:b]).tolist()))
        found = []
        for i, line in lines:
            item = self.toks[i]
            a, b = max(0, -line), min(len(item), len(tok) - line)
            same = (item[a:b] == tok[a + line : b + line]).astype(float)
            s, e = best_stretch(same, similarity)
            if e - s >= min(min_tokens, len(item)):
                found.append((self.ids[i], line + a + s, e - s, int(same[s:e].sum())))
        return found


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, length, equal): verified overlaps, in words of the document.

    An overlap has at least ``min_tokens`` words (or the whole item, if shorter)
    of which the share ``similarity`` or more is equal and in place, and at least
    one window on its diagonal agrees under a mask. Items shorter than every
    mask have to be there word for word.
    """
    spark = docs.sparkSession
    short_batches(spark)
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).where("item_id IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    base = python_rows(docs, id_col, text_col)
    schema = "doc_id long, item_id long, start long, length long, equal long"
    parts = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").toPandas()
        block = spark.sparkContext.broadcast(Block(rows["item_id"].tolist(), rows["text"].tolist(), masks))

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(doc, *x) for doc, text in zip(b["doc_id"], b["text"]) for x in block.value.overlaps(tokens(text), similarity, min_tokens)]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "length", "equal"])

        parts.append(base.mapInPandas(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(real_ids(out), "overlaps")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted, comma-joined), longest (words).

    Null and empty texts and items overlap nothing. Rows that share an id, null
    included, share one verdict. Equal items are all listed. Other columns are
    not read. Without items, or without documents, nothing is contaminated.
    """
    found = overlaps(docs, items, id_col=id_col, **options)
    said = found.groupBy(F.col("doc_id").alias("hit_id")).agg(
        F.array_sort(F.collect_set("item_id")).alias("ids"), F.max("length").alias("longest")
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return rows.join(said, rows["doc_id"].eqNullSafe(said["hit_id"]), "left").select(
        "doc_id",
        F.col("longest").isNotNull().alias("contaminated"),
        F.coalesce(F.size("ids").cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"),
        F.coalesce("longest", F.lit(0).cast("long")).alias("longest"),
    )


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
