"""What several corpus operators share: text batches, word hashes, group look-up, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.session import cut_lineage

WHITE = r"[\x20\x09-\x0D]"
PIECE_BYTES = 1 << 18

# Fixed 64-bit odd constants of the word hash; any others would do, but they have to be the same everywhere.
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, dtype=np.uint64))])


_UP = _powers(_BASE, PIECE_BYTES + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), PIECE_BYTES + 1)


#: Also parts words at ASCII punctuation.
PUNCTUATION = _SPACE | np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _hash_piece(data: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one piece of bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    white = gaps[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = (_UP, _DOWN) if n <= PIECE_BYTES else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[data]] * up[:n], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix64(value ^ (ends - starts).astype(np.uint64)), starts


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def word_hashes(column: pa.Array, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word counts of consecutive rows) of a string column, some rows at a time.

    A word is a run of bytes other than ``gaps`` (space and \\x09-\\x0D), with A-Z lower-cased. Whole rows are dealt
    out until about a quarter of a megabyte of text is reached; a longer row is cut at white space while it is hashed,
    so the memory beyond the hashes themselves stays bounded.
    """
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1)
        last = min(last, rows)
        a, b = int(offsets[row]), int(offsets[last])
        if last == row + 1 and b - a > PIECE_BYTES:
            parts, at = [], a
            while at < b:
                to = min(b, at + PIECE_BYTES)
                while to < b and not gaps[data[to]]:
                    to += 1
                parts.append(_hash_piece(data[at:to], gaps)[0])
                at = to
            hashes = np.concatenate(parts)
            yield row, hashes, np.array([len(hashes)])
        else:
            # A separator byte between rows keeps the last word of one from joining the first of the next.
            lengths = np.diff(offsets[row : last + 1])
            keep = np.arange(b - a) + np.repeat(np.arange(last - row), lengths)
            spaced = np.full(b - a + last - row, 32, np.uint8)
            spaced[keep] = data[a:b]
            parts, firsts, at, n = [], [], 0, len(spaced)
            while at < n:
                to = min(n, at + PIECE_BYTES)
                while to < n and not gaps[spaced[to]]:
                    to += 1
                h, s = _hash_piece(spaced[at:to], gaps)
                parts.append(h)
                firsts.append(s + at)
                at = to
            hashes, starts = np.concatenate(parts), np.concatenate(firsts)
            bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
            yield row, hashes, np.diff(np.searchsorted(starts, bounds))
        row = last


def text_of(df: DataFrame, text: str = "text") -> DataFrame:
    """The text with null as empty."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


HOT_GROUPS = 1000
EDGES_PER_TASK = 500_000


def look_up(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Rows (left) with the columns of their group; ``groups`` has one row a key and its number of rows in ``size``.

    A key with more than a thousandth of all rows is hot. There are at most 1,000 of those whatever the
    input, so they are broadcast; the others meet in an ordinary join, where no key has many rows.
    """
    bound = groups.agg(F.ceil(F.coalesce(F.sum(size), F.lit(0)) / HOT_GROUPS).alias("_most")).first()["_most"]
    hot, rest = groups.filter(F.col(size) > bound), groups.filter(F.col(size) <= bound)
    extra = [c for c in groups.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    in_hot = marked.filter(F.col("_hot")).drop("_hot")
    others = marked.filter(F.col("_hot").isNull()).drop("_hot", *extra).join(rest, keys, "inner")
    return in_hot.unionByName(others.select(in_hot.columns))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that each node of the edges reaches.

    Alternates the star steps of Kiveris et al. (2014): every node hangs its larger neighbours, then
    itself and its smaller ones, below its smallest neighbour. Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder, so neither plan nor lineage grows.
    """
    x, y = F.col(a), F.col(b)
    now = cut_lineage(edges.filter(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct())
    # The steps never have more rows than these edges and as many nodes, so their tasks follow this count.
    parts = 1 + now.count() // EDGES_PER_TASK
    while True:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("m", "hi").alias("m"))
        large = (
            both.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
            .join(least, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        large = cut_lineage(large.coalesce(parts))
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        paired = large.join(small_least, "hi")
        small = (
            paired.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo")
            .union(small_least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        small = cut_lineage(small.coalesce(parts))
        # Done when every node hangs below one other, and none of those below another.
        hung = small.groupBy("hi").agg(F.count("*").alias("n"))
        tops = small.select(F.col("lo").alias("hi")).distinct().withColumn("top", F.lit(True))
        if hung.join(tops, "hi", "left").filter((F.col("n") > 1) | F.col("top")).coalesce(parts).isEmpty():
            break
        now = small
    return small.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(
        small.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of ``n`` words that lies in one row."""
    total = len(words)
    rows = np.repeat(np.arange(len(counts)), counts)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = words[: total - n + 1].copy()
    for k in range(1, n):
        value = mix64(value) + words[k : total - n + 1 + k]
    at = np.flatnonzero(rows[: total - n + 1] == rows[n - 1 :])
    return mix64(value[at]), rows[at], at
