"""Byte-level BPE by ranks: texts to token ids and back, many pieces at a time in padded matrices.

The pieces a pattern finds in a text are bucketed by length and laid out as rows of a matrix, one byte's token a
cell. Each round every row merges its leftmost pair of smallest rank; pairs are looked up in a hash table held in
numpy arrays, the merged cell closes up and finished rows leave the matrix.

Ids travel as binary, unsigned 32-bit little-endian, so a document's ids are one value of four bytes each.
Null and empty texts give no ids; every row of the input gives one row; other columns are left alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from demescope.llm.common import mix64

NONE = np.iinfo(np.int32).max
#: Cells of one matrix, and the longest piece that is laid out in one; longer ones are merged alone.
CELLS, LONGEST = 1 << 18, 512
#: Characters of text whose pieces are gathered before they are encoded, and pieces of a long text at a time.
GATHER, PIECES = 1 << 20, 1 << 18
#: Bytes of pieces and ids remembered within a task.
REMEMBERED = 24 << 20
_ENTRY = 160  # bytes of a dictionary entry with its two objects, besides their contents


class Ranks:
    """A vocabulary by ranks and its pair table: (left id, right id) to the id of their joined bytes."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ids = tokens
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.single = np.full(256, NONE, np.int32)
        for b in range(256):
            self.single[b] = tokens[bytes([b])]
        left, right, joined = [], [], []
        for token, i in tokens.items():
            for cut in range(1, len(token)):
                a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(i)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self._fill(keys, np.array(joined, np.int32))

    @staticmethod
    def read(path: str) -> Ranks:
        """From lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear steps; the table is at most half full."""
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        at = self._home(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.values[at[todo]] == NONE
            slots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair joins to, NONE where it joins to none or one side is NONE."""
        shape = left.shape
        keys = (left.ravel().astype(np.uint64) << np.uint64(32)) | right.ravel().astype(np.uint64)
        at = self._home(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            value = self.values[slot]
            found = self.keys[slot] == keys[todo]
            out[todo[found]] = value[found]
            todo = todo[~found & (value != NONE)]
            at[todo] = (at[todo] + 1) & self.mask
        return out.reshape(shape)


@lru_cache(maxsize=1)
def ranks_of(path: str) -> Ranks:
    """The vocabulary of a file; a worker keeps the one it used last."""
    return Ranks.read(path)


# --- merging ------------------------------------------------------------------------------


def merge_rows(ranks: Ranks, cells: np.ndarray) -> np.ndarray:
    """Rows of byte tokens, padded with NONE at the end, to rows of final tokens, padded alike."""
    done = np.full_like(cells, NONE)
    rows = np.arange(len(cells))
    pairs = ranks.joined(cells[:, :-1], cells[:, 1:]) if cells.shape[1] > 1 else np.full((len(cells), 0), NONE, np.int32)
    while len(rows):
        if not pairs.shape[1]:
            done[rows, : cells.shape[1]] = cells
            break
        at = pairs.argmin(axis=1)
        line = np.arange(len(rows))
        best = pairs[line, at]
        over = best == NONE
        if over.any():
            done[rows[over], : cells.shape[1]] = cells[over]
            stay = ~over
            rows, cells, pairs, at, best = rows[stay], cells[stay], pairs[stay], at[stay], best[stay]
            line = np.arange(len(rows))
            if not len(rows):
                break
        # Close up: what lies right of the merged cell moves one to the left, and the last column is free.
        width = cells.shape[1]
        column = np.arange(width - 1)
        moved = cells[line[:, None], column + (column > at[:, None])]
        moved[line, at] = best
        column = np.arange(width - 2)
        kept = pairs[line[:, None], column + (column > at[:, None])]
        before = np.flatnonzero(at > 0)
        kept[before, at[before] - 1] = ranks.joined(moved[before, at[before] - 1], best[before])
        after = np.flatnonzero(at < width - 2)
        kept[after, at[after]] = ranks.joined(best[after], moved[after, at[after] + 1])
        cells, pairs = moved, kept
    return done


def merge_alone(ranks: Ranks, cells: np.ndarray) -> np.ndarray:
    """One long piece. A round merges every place of the smallest rank from the left on, unless a merge makes a pair
    of smaller rank beside it: there the round ends, as that pair comes first."""
    pairs = ranks.joined(cells[:-1], cells[1:])
    while len(pairs):
        low = pairs.min()
        if low == NONE:
            break
        at = np.flatnonzero(pairs == low)
        # Of places that overlap (a run of one token) every other one is merged.
        start = np.concatenate([[True], np.diff(at) > 1])
        run = np.flatnonzero(start)[np.cumsum(start) - 1]
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        behind = np.full(len(at), NONE, np.int32)
        has = at + 2 < len(cells)
        behind[has] = cells[at[has] + 2]
        ahead = np.full(len(at), NONE, np.int32)
        has = at > 0
        ahead[has] = cells[at[has] - 1]
        ahead[1:][np.diff(at) == 2] = low
        lower = np.minimum(ranks.joined(ahead, np.full_like(ahead, low)), ranks.joined(np.full_like(behind, low), behind)) < low
        if lower.any():
            at = at[: int(lower.argmax()) + 1]
        keep = np.ones(len(cells), bool)
        keep[at + 1] = False
        cells = cells.copy()
        cells[at] = low
        places = np.flatnonzero(keep)
        cells = cells[places]
        # A pair is as before unless one of its sides was merged just now.
        fresh = np.zeros(len(keep), bool)
        fresh[at] = True
        fresh = fresh[places]
        pairs = pairs[np.minimum(places[:-1], len(pairs) - 1)]
        changed = np.flatnonzero(fresh[:-1] | fresh[1:])
        pairs[changed] = ranks.joined(cells[changed], cells[changed + 1])
    return cells


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[bytes]:
    """The ids of each piece, as bytes of unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = ranks.ids.get(piece)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif piece:
            buckets.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
    for width, members in buckets.items():
        if width > LONGEST:
            for i in members:
                cells = ranks.single[np.frombuffer(pieces[i], np.uint8)]
                out[i] = merge_alone(ranks, cells).astype("<u4").tobytes()
            continue
        for first in range(0, len(members), CELLS // width):
            part = members[first : first + CELLS // width]
            lengths = np.array([len(pieces[i]) for i in part])
            filled = np.arange(width) < lengths[:, None]
            cells = np.full((len(part), width), NONE, np.int32)
            cells[filled] = ranks.single[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            cells = merge_rows(ranks, cells)
            counts = (cells != NONE).sum(axis=1)
            flat = cells[cells != NONE].astype("<u4").tobytes()
            ends = 4 * np.cumsum(counts)
            for i, a, b in zip(part, (ends - 4 * counts).tolist(), ends.tolist()):
                out[i] = flat[a:b]
    return out


class Encoder:
    """Encodes texts and remembers the ids of pieces up to a number of bytes."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: set[str]) -> None:
        new = sorted(pieces - self.known.keys())
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
            new = sorted(pieces)
        for piece, ids in zip(new, encode_pieces(self.ranks, [p.encode() for p in new])):
            self.known[piece] = ids
            self.held += _ENTRY + len(piece) + len(ids)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of ordinary length, whose new pieces are encoded together."""
        split = [self.pattern.findall(t) for t in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def long_text(self, text: str) -> bytes:
        """Ids of one long text, some pieces at a time."""
        found = (m.group() for m in self.pattern.finditer(text))
        parts = []
        while pieces := list(islice(found, PIECES)):
            self._learn(set(pieces))
            parts.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(parts)


# --- tables -------------------------------------------------------------------------------


def _with_column(df: DataFrame, name: str, make) -> DataFrame:
    """The table with a binary column made of each Arrow batch; one of that name is replaced."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, batch, values in make(batches):
            part = batch.slice(start, len(values))
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], names=[*kept, name])

    return df.mapInArrow(run, schema)


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The table with the token ids of each row's whole text, as binary of unsigned 32-bit integers.

    ``path`` is a file of base64 tokens and ranks, ``pattern`` finds the pieces that are merged each for itself. A
    column named ``ids`` is replaced, other columns stay.
    """

    def make(batches):
        encoder = Encoder(ranks_of(path), pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            start, held, size = 0, [], 0
            for row in range(len(texts)):
                value = texts[row].as_py() or ""
                if len(value) > GATHER:
                    if held:
                        yield start, batch, encoder.texts(held)
                    yield row, batch, [encoder.long_text(value)]
                    start, held, size = row + 1, [], 0
                    continue
                held.append(value)
                size += len(value)
                if size >= GATHER:
                    yield start, batch, encoder.texts(held)
                    start, held, size = row + 1, [], 0
            if held:
                yield start, batch, encoder.texts(held)

    return _with_column(df, ids, make)


def decoded(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The table with the bytes that each row's ids stand for. Null ids give no bytes; an unknown id is an error."""

    def make(batches):
        bytes_of = ranks_of(path).bytes_of
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            start, held, size = 0, [], 0
            for row in range(len(column)):
                raw = column[row].as_py() or b""
                parts = (np.frombuffer(raw[a : a + 4 * PIECES], "<u4").tolist() for a in range(0, len(raw), 4 * PIECES))
                held.append(b"".join(b"".join(map(bytes_of.__getitem__, part)) for part in parts))
                size += len(held[-1])
                if size >= 16 * GATHER:
                    yield start, batch, held
                    start, held, size = row + 1, [], 0
            if held:
                yield start, batch, held

    return _with_column(df, to, make)
