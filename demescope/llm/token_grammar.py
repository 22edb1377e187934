"""Token ids written as grammar-compressed shards (Re-Pair) and read back."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from string import ascii_letters, punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 2
BLOCK_TOKENS = 1 << 20
HASH_BITS = 19
PAIRS_PER_ROUND = 4096

_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def repair(tokens: np.ndarray, ends: np.ndarray, rounds: int = 12, least: int = 16, gain: float = 0.01) -> dict[str, np.ndarray]:
    """The grammar of a token sequence whose documents end before the positions in ``ends``.

    Every round replaces the most frequent adjacent pairs by new symbols, numbered from the largest token
    on; a pair never crosses two documents. Rounds go on while pairs occur ``least`` times and shorten the
    sequence by the share ``gain``, at most ``rounds`` of them. Returns the symbols, each document's symbol
    end, the rules' two sides and expansion lengths, and where each round's rules begin.
    """
    seq = tokens.astype(np.int32)
    base = int(seq.max()) + 1 if len(seq) else 1
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    left, right, starts = [], [], []
    symbols = base
    for _ in range(rounds):
        if len(seq) < 2:
            break
        plain = seq.view(np.uint32)
        slot = ((plain[:-1] * _ODD[0] + plain[1:] * _ODD[1]) >> np.uint32(32 - HASH_BITS)).view(np.int32)
        slot[last[:-1]] = 1 << HASH_BITS
        seen = np.bincount(slot, minlength=(1 << HASH_BITS) + 1)
        seen[-1] = 0
        frequent = max(least, int(np.partition(seen, -PAIRS_PER_ROUND)[-PAIRS_PER_ROUND]))
        at = np.flatnonzero((seen >= frequent)[slot])
        if not len(at):
            break
        # A slot stands for the pair met last in it; another frequent pair of the slot waits for its round.
        keys, slots = (seq[at].astype(np.int64) << 32) | seq[at + 1], slot[at]
        stands = np.zeros(1 << HASH_BITS, np.int64)
        stands[slots] = keys
        same = stands[slots] == keys
        at, slots = at[same], slots[same]
        counts = np.bincount(slots, minlength=1 << HASH_BITS)
        chosen = np.flatnonzero(counts >= least)
        if not len(chosen):
            break
        number = np.full(1 << HASH_BITS, -1)
        number[chosen] = np.arange(len(chosen))
        rule = number[slots]
        at, rule = at[rule >= 0], rule[rule >= 0]
        pairs = stands[chosen]
        # Of overlapping occurrences every second one of a run is replaced.
        fresh = np.concatenate([[True], np.diff(at) > 1])
        order = np.arange(len(at))
        taken = (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0
        at, rule = at[taken], rule[taken]
        if len(at) < gain * len(seq):
            break
        starts.append(symbols)
        left.append(pairs >> 32)
        right.append(pairs & 0xFFFFFFFF)
        seq[at] = symbols + rule
        last[at] = last[at + 1]
        symbols += len(chosen)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    lefts = np.concatenate(left) if left else np.zeros(0, np.int64)
    rights = np.concatenate(right) if right else np.zeros(0, np.int64)
    lengths = np.ones(symbols, np.int64)
    for k, first in enumerate(starts):
        to = starts[k + 1] if k + 1 < len(starts) else symbols
        lengths[first:to] = lengths[lefts[first - base : to - base]] + lengths[rights[first - base : to - base]]
    through = np.cumsum(lengths[seq]) if len(seq) else np.zeros(0, np.int64)
    symbol_ends = np.searchsorted(through, ends, side="left") + 1
    symbol_ends = np.where(ends == 0, 0, symbol_ends)
    return {
        "base": np.array([base]),
        "symbols": seq,
        "symbol_ends": symbol_ends,
        "left": lefts,
        "right": rights,
        "lengths": lengths[base:],
        "starts": np.array(starts, np.int64),
    }


def expand(g: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The tokens below the symbols from ``first`` to before ``last``, round by round from the latest rules."""
    seq = g["symbols"][first:last].astype(np.int64)
    base = int(g["base"][0])
    for start in g["starts"][::-1]:
        at = np.flatnonzero(seq >= start)
        if len(at):
            rule = seq[at] - base
            place = np.arange(len(seq))
            grown = np.zeros(len(seq), np.int64)
            grown[at] = 1
            place += np.cumsum(grown) - grown
            out = np.empty(len(seq) + len(at), np.int64)
            out[place] = seq
            out[place[at]] = g["left"][rule]
            out[place[at] + 1] = g["right"][rule]
            seq = out
    return seq


def token_range(g: dict[str, np.ndarray], document: int, first: int, last: int) -> np.ndarray:
    """Tokens ``first`` to before ``last`` of one document, expanding only the symbols that hold them."""
    a = int(g["symbol_ends"][document - 1]) if document else 0
    b = int(g["symbol_ends"][document])
    base = int(g["base"][0])
    part = g["symbols"][a:b].astype(np.int64)
    sizes = np.where(part >= base, g["lengths"][np.maximum(part - base, 0)] if len(g["lengths"]) else 1, 1)
    through = np.concatenate([[0], np.cumsum(sizes)])
    lo = int(np.searchsorted(through, first, side="right")) - 1
    hi = int(np.searchsorted(through, last, side="left"))
    return expand(g, a + lo, a + hi)[first - through[lo] : last - through[lo]]


_FIELDS = ("base", "symbol_ends", "left", "right", "lengths", "starts")


def to_bytes(g: dict[str, np.ndarray]) -> dict[str, bytes]:
    """The grammar's arrays as little-endian bytes; symbols as a plane of low words and one of high bytes."""
    return {k: g[k].astype("<u4").tobytes() for k in _FIELDS} | {
        "low": (g["symbols"] & 0xFFFF).astype("<u2").tobytes(),
        "high": (g["symbols"] >> 16).astype("u1").tobytes(),
    }


def from_bytes(row: dict[str, bytes]) -> dict[str, np.ndarray]:
    g = {k: np.frombuffer(row[k], "<u4").astype(np.int64) for k in _FIELDS}
    g["symbols"] = np.frombuffer(row["low"], "<u2").astype(np.int64) | (np.frombuffer(row["high"], "u1").astype(np.int64) << 16)
    return g


#: How byte-level models spell a space and a line feed, and the bytes from 0x80 on that they don't spell as Latin-1 does.
SPACE, LINE = "\u0120", "\u010a"
HIGH = {b: 0x122 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 0x143}
#: ASCII punctuation but the apostrophe, after which the pre-tokeniser looks for contractions.
SIGNS = punctuation.replace("'", "")


class Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts with a byte-level BPE file, looking each distinct piece between spaces up once.

    The pre-tokeniser cuts before every space and around every line feed that stands alone between other
    characters, so such pieces are encoded apart. A text with two white-space characters in a row, or one
    at an end, or with an added token's content is encoded as a whole. Pieces of letters and ``SIGNS`` after a space
    go to the library's model cut between the two, which is what the pre-tokeniser does with them.
    """

    #: Pieces a worker keeps, at some 150 bytes each; beyond that the more used half of them stays.
    PIECES = 250_000

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Split

        self.model = Tokenizer.from_file(path)
        self.words, cut = None, self.model.pre_tokenizer
        self.line = self.model.token_to_id(LINE)
        if isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.model.normalizer is None and self.line is not None:
            self.words = Tokenizer(self.model.model)
            self.words.pre_tokenizer = Split(Regex(f"{LINE}|[{re.escape(SIGNS)}]+"), "isolated")
        self.plain, self.other = set(ascii_letters + SIGNS), set()
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.spaced = any(re.search(r"\s", t) for t in self.added)  # then joined pieces might make one
        self.gap = self.model.encode("\n\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.codes = Numbers()
        self.flat = np.zeros(0, np.int32)
        self.starts, self.sizes, self.marks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the half of ``PIECES`` looked up most; older uses count half."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.PIECES // 2])
        names = list(self.codes)
        self.codes = Numbers(zip(map(names.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        starts, self.sizes, self.marks, self.uses = self.starts[kept], self.sizes[kept], self.marks[kept], self.uses[kept] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = self.flat[np.arange(self.sizes.sum()) + np.repeat(starts - self.starts, self.sizes)]

    def is_plain(self, piece: str) -> bool:
        """Whether the piece is letters, with its space one pre-token, and then runs of letters and of ``SIGNS``, one each."""
        if self.words is None or not piece or piece[0] in SIGNS:
            return False
        if self.plain.issuperset(piece):
            return True
        for c in set(piece).difference(self.plain, self.other):
            letter = c.isalpha() and c not in (SPACE, LINE) and len(self.model.pre_tokenizer.pre_tokenize_str(f" a{c}a")) == 1
            (self.plain if letter else self.other).add(c)
        return self.plain.issuperset(piece)

    def spelled(self, text: str) -> str:
        """The text with every character but ``SPACE`` and ``LINE`` as the model spells its bytes."""
        return re.sub(f"[^\x00-\x7f{SPACE}{LINE}]+", lambda m: m[0].encode().decode("latin-1").translate(HIGH), text)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Adds pieces, in this order. Those that follow a space are encoded many at a time, parted by empty lines or,
        if they are plain, by the sign that stands for a line feed.

        The mark of a piece is 1 if it begins a text, 0 elsewhere, and 2 if white space stands where the
        pre-tokeniser may not cut. So the marks of a text that can be encoded by pieces add up to 1.
        """
        starts, sizes, marks = (np.zeros(len(new), np.int64) for _ in range(3))
        words, spaced, others, parts, end = [], [], [], [], len(self.flat)
        for k, p in enumerate(new):
            body = p[1:] if p[:1] in ("\n", "\t") else p
            if body is p and self.is_plain(p):
                words.append(k)
            elif not body or (not body.isalnum() and " ".join(body.split()) != re.sub(r"\s", " ", body)):
                marks[k] = 2
            elif body is p and len(self.gap) == 1:
                spaced.append(k)
            else:
                others.append(k)
                marks[k] = p[0] == "\t"
        groups = [spaced[i : i + 500] for i in range(0, len(spaced), 500)]
        found = [(g, got, self.gap[0]) for g, got in zip(groups, self.whole([" " + "\n\n ".join([new[k] for k in g]) for g in groups]), strict=True)]
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        if groups:
            lines = [self.spelled(LINE.join([SPACE + new[k] for k in g])) for g in groups]
            found += [(g, np.array(e.ids, np.int32), self.line) for g, e in zip(groups, self.words.encode_batch_fast(lines, add_special_tokens=False), strict=True)]
        for group, got, gap in found:
            cuts = np.flatnonzero(got == gap)
            if len(cuts) != len(group) - 1:
                others += group
                continue
            begins = np.concatenate([[0], cuts + 1])
            starts[group], sizes[group] = end + begins, np.concatenate([cuts, [len(got)]]) - begins
            parts.append(got)
            end += len(got)
        for k, got in zip(others, self.whole([p[1:] if p[0] == "\t" else p if p[0] == "\n" else " " + p for p in (new[k] for k in others)]), strict=True):
            starts[k], sizes[k] = end, len(got)
            parts.append(got)
            end += len(got)
        self.starts, self.sizes, self.marks = (np.concatenate(x) for x in ((self.starts, starts), (self.sizes, sizes), (self.marks, marks)))
        self.flat = np.concatenate([self.flat, *parts])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        pieces, bounds, plain = [], [0], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.int32)
            elif "  " in t or "\n\n" in t or self.spaced or any(a in t for a in self.added):
                out[i] = self.whole([t])[0]
            else:
                plain.append(i)
                pieces += ("\t" + t).replace("\n", " \n").split(" ")
                bounds.append(len(pieces))
        if not plain:
            return out
        if len(self.codes) > self.PIECES:
            self.forget()
        known = len(self.codes)
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        if len(self.codes) > known:
            self.learn(list(islice(self.codes, known, None)))
        self.uses = np.bincount(codes, minlength=len(self.codes)) + np.pad(self.uses, (0, len(self.codes) - known))
        sizes = self.sizes[codes]
        through = np.concatenate([[0], np.cumsum(sizes)])
        marks = np.add.reduceat(self.marks[codes], bounds[:-1])
        ids = self.flat[np.arange(through[-1]) + np.repeat(self.starts[codes] - through[:-1], sizes)]
        for i, a, b, mark in zip(plain, bounds, bounds[1:], marks, strict=False):
            out[i] = ids[through[a] : through[b]] if mark == 1 else self.whole([texts[i]])[0]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, so its pieces are kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


SHARD_DDL = "shard int, block int, doc_ids array<bigint>, tokens bigint, low binary, high binary, " + ", ".join(f"{k} binary" for k in _FIELDS)
TEXT_BYTES = 4 << 20


def write_shards(docs: DataFrame, tokenizer: str, path: str, shards: int | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the token ids of all texts, each followed by id 2, as Re-Pair shards in ascending doc_id order.

    A shard is a range of doc_ids; in it, blocks of about ``block_tokens`` have a grammar each (a longer
    document has a block of its own). The files are Parquet: one row a block with doc_ids, symbols, rules,
    expansion lengths and symbol offsets of the documents, so one document or a range of its tokens can be
    decoded alone. Null text is empty; a null doc_id comes first; rows with equal doc_id follow their text.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = ranged.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        shard, block = TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            g = to_bytes(repair(tokens, np.cumsum([len(p) for p in parts])))
            columns = {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "tokens": pa.array([len(tokens)], pa.int64())}
            return pa.RecordBatch.from_pydict(columns | {k: pa.array([g[k]], pa.binary()) for k in ("low", "high", *_FIELDS)})

        for batch in batches:
            keys, column, row = batch.column(0).to_pylist(), batch.column(1), 0
            while row < len(keys):
                texts, chars = [], 0
                while row + len(texts) < len(keys) and (not texts or chars < TEXT_BYTES):
                    texts.append(column[row + len(texts)].as_py())
                    chars += len(texts[-1])
                for key, got in zip(keys[row:], encode(texts), strict=False):
                    if parts and size + len(got) + 1 > block_tokens:
                        yield flush()
                        block, ids, parts, size = block + 1, [], [], 0
                    ids.append(key)
                    parts.append(np.append(got, END_ID).astype(np.int32))
                    size += len(got) + 1
                row += len(texts)
        if parts:
            yield flush()

    ranged.mapInArrow(pack, SHARD_DDL).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards, decoded from their grammars."""
    files = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = expand(g := from_bytes(row)).astype("<u4")
                base = int(g["base"][0])
                sizes = np.ones(len(g["symbols"]), np.int64)
                big = g["symbols"] >= base
                sizes[big] = g["lengths"][g["symbols"][big] - base]
                ends = np.concatenate([[0], np.cumsum(sizes)])[g["symbol_ends"]]
                begins = np.concatenate([[0], ends[:-1]])
                data = tokens.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                        "block": pa.array([row["block"]] * len(ends), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "inner": pa.array(begins, pa.int64()),
                        "n_tokens": pa.array(ends - begins, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                    }
                )

    documents = files.mapInArrow(decode, "shard int, block int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    blocks = files.select("shard", "block", "tokens")
    # One row a shard meets in one task; blocks are numbered inside their shard.
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("t"))
    shards = shards.select("shard", F.coalesce(F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "block", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("block_start")).join(shards, "shard")
    return documents.join(offsets, ["shard", "block"]).select(
        "doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
