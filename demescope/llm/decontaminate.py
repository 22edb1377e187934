"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from demescope.llm.common import PUNCTUATION, shingle_hashes, word_hashes

MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)

LEAK = StructType([StructField("item_id", LongType()), StructField("coverage", DoubleType()), StructField("tiles", IntegerType()), StructField("longest", IntegerType())])
_ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())]))


class Items:
    """A block of benchmark items: words, and each item's different seeds (runs of ``min_match`` words) sorted by hash."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        self.ids = [r[0] for r in rows]
        words, counts = [], []
        for _, w, c in word_hashes(pa.array([r[1] for r in rows], pa.string()), PUNCTUATION):
            words.append(w)
            counts.append(c)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])
        seeds, owner, _ = shingle_hashes(self.words, self.sizes, min_match)
        order = np.lexsort((owner, seeds))
        seeds, owner = seeds[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(seeds) != 0) | (np.diff(owner) != 0)])) if len(seeds) else np.zeros(0, np.int64)
        self.seeds, self.owner = seeds[new], owner[new]
        self.times = np.diff(np.concatenate([new, [len(seeds)]]))
        order = np.argsort(self.owner, kind="stable")
        self.own_seeds = self.seeds[order]
        self.own_firsts = np.searchsorted(self.owner[order], np.arange(len(self.ids) + 1))
        self.sieve = np.zeros(1 << FILTER_BITS, bool)
        self.sieve[self.seeds >> np.uint64(64 - FILTER_BITS)] = True


class _Runs:
    """Hashes of all runs of any length of a word sequence, from sums that are formed once; and its marked words."""

    def __init__(self, words: np.ndarray, marked: np.ndarray):
        self.words, self.marked = words, marked
        ahead, self.back = np.full(len(words), BASE, np.uint64), np.full(len(words), INVERSE, np.uint64)
        ahead[:1] = self.back[:1] = 1
        self.back = np.cumprod(self.back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(ahead))])

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the runs of ``n`` words without a marked one."""
        before = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(before[n:] == before[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int, barred: np.ndarray | None = None) -> tuple[int, int, int]:
    """(item words covered, tiles, longest) of the greedy tiling of an item's word hashes by a document's.

    The longest equal run without a marked word on either side is marked, of equally long ones the first in
    the item, then in the document, until none of at least ``min_match`` words is left. The greatest length
    is sought by halving (where a run of n words is met, so is one of n - 1) over Karp-Rabin hashes of all free
    runs of a length; then all runs of that length are taken in order. Memory follows the words, not the
    pairs of equal words, so one word repeated on both sides costs no more than any other text.
    ``barred`` words of the document are never marked. A run counts only if its words are equal one by one.
    """
    mine, other = _Runs(item, np.zeros(len(item), bool)), _Runs(doc, np.zeros(len(doc), bool) if barred is None else barred.copy())
    covered, count, longest = 0, 0, 0
    top = min(len(item), len(doc))
    while top >= min_match:
        low, high = min_match - 1, top
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(mine.free(n)[1], other.free(n)[1]).any():
                low = n
            else:
                high = n - 1
        n, top = low, low - 1
        if n < min_match:
            break
        starts, hashes = mine.free(n)
        places, keys = other.free(n)
        met = np.isin(keys, hashes)
        places, keys = places[met], keys[met]
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        first, last = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        ahead: dict[int, int] = {}
        for a, lo, hi in zip(starts[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
            if mine.marked[a : a + n].any():
                continue
            k = ahead.get(lo, lo)
            while k < hi and other.marked[places[k] : places[k] + n].any():
                k += 1
            ahead[lo] = k
            for b in places[k:hi]:
                if not other.marked[b : b + n].any() and (item[a : a + n] == doc[b : b + n]).all():
                    mine.marked[a : a + n] = other.marked[b : b + n] = True
                    covered, count, longest = covered + n, count + 1, max(longest, n)
                    break
    return covered, count, longest


def _part(words: np.ndarray, at: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, barred): the words of the seeds that begin at the sorted places ``at``, a barred one in each gap."""
    keep = np.zeros(int(at[-1] - at[0]) + min_match, bool)
    for k in range(min_match):
        keep[at - at[0] + k] = True
    held = np.flatnonzero(keep)
    gaps = np.flatnonzero(np.diff(held) > 1) + 1
    return np.insert(words[held + at[0]], gaps, 0), np.insert(np.zeros(len(held), bool), gaps, True)


def _matches(items: Items, column: pa.Array, min_match: int, coverage: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for first, words, counts in word_hashes(column, PUNCTUATION):
        seeds, rows, at = shingle_hashes(words, counts, min_match)
        maybe = np.flatnonzero(items.sieve[seeds >> np.uint64(64 - FILTER_BITS)])
        seeds, rows, at = seeds[maybe], rows[maybe], at[maybe]
        for a, b in zip(*(np.searchsorted(rows, [u + k for u in np.unique(rows)]) for k in (0, 1)), strict=True):
            mine, places = seeds[a:b], at[a:b]
            different = np.unique(mine)
            lo, hi = np.searchsorted(items.seeds, different, "left"), np.searchsorted(items.seeds, different, "right")
            n = hi - lo
            met = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            # Each seed adds one word to the first one's, so few seeds can't cover enough.
            owners, back = np.unique(items.owner[met], return_inverse=True)
            held = np.bincount(back, items.times[met], len(owners))
            for owner in owners[held * min_match >= coverage * items.sizes[owners]].tolist():
                size = int(items.sizes[owner])
                wanted = items.own_seeds[items.own_firsts[owner] : items.own_firsts[owner + 1]]
                doc, barred = _part(words, places[np.isin(mine, wanted)], min_match)
                item = items.words[items.firsts[owner] : items.firsts[owner + 1]]
                covered, count, longest = tiles(item, doc, min_match, barred)
                if covered >= coverage * size:
                    out[first + int(rows[a])].append({"item_id": items.ids[owner], "coverage": covered / size, "tiles": count, "longest": longest})
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, columns: list[str], coverage: float = COVERAGE, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``columns`` of every document and ``leaks``: array of item_id, coverage, tiles, longest.

    Words are runs between white space and ASCII punctuation, A-Z lower-cased. An item leaks where the
    greedy tiling of its words by matches of at least ``min_match`` words covers the share ``coverage`` of
    them, in whatever order the document has them. Items of fewer words than ``min_match`` never match.

    The benchmark goes to the tasks in blocks of about ``block_bytes`` of text: with a larger benchmark the
    documents are passed once a block, so what a task holds has a bound. Null text is empty, null or blank
    items are skipped, repeated items are reported each; an empty benchmark gives empty lists. A column
    named leaks is replaced; a text of any length is hashed in pieces.
    """
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_bytes))
    source = docs.select(*[c for c in columns if c not in ("leaks", "text")], "text").withColumn("leaks", F.array().cast(ArrayType(LEAK)))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = Items(sent.value, min_match)
            for batch in batches:
                old = batch.column("leaks")
                got = _matches(held, batch.column("text"), min_match, coverage)
                leaks = pa.array([(a or []) + b for a, b in zip(old.to_pylist(), got, strict=True)], _ARROW_LEAK)
                yield pa.RecordBatch.from_arrays([leaks if n == "leaks" else batch.column(n) for n in batch.schema.names if n in names], [n for n in batch.schema.names if n in names])

        last = block == blocks - 1
        names = [n for n in source.columns if n != "text" or not last or "text" in columns]
        schema = StructType([f for f in source.schema.fields if f.name in names])
        source = source.mapInArrow(search, schema)
    return source


def leaked_items(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest: one row for each item that a document leaks."""
    found = with_leaks(docs, benchmark, ["doc_id"], **options)
    return found.select("doc_id", F.inline("leaks"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a leaked item, with their columns."""
    spare = "leaks_" + uuid.uuid4().hex
    named = docs.withColumnsRenamed({"leaks": spare})
    clean = with_leaks(named, benchmark, named.columns, **options).filter(F.size("leaks") == 0)
    return clean.drop("leaks").withColumnsRenamed({spare: "leaks"}).select(docs.columns)
