"""Roles of the lines of raw transcripts by a hidden Markov model, and canonical turns from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demescope.session import cut_lineage

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # of each role: its first line, a further line
PARTS_PER_BLOCK = 64

# Fixed patterns of speaker markers at the start of a line; {} stands for a speaker's names.
MARKERS = [r"^\s*\**({})\**\s*:\**\s*", r"^\s*#+\s*({})\s*:?\s*", r"^\s*<\|({})\|>\s*", r"^\s*\[({})\]\s*"]
SPEAKERS = {"system": "system|sys|context", "user": "user|human|u|q|customer|me", "assistant": "assistant|ai|bot|a|agent|gpt"}
LENGTHS = (1, 20, 60, 120, 240, 480, 960)


def marker_pattern(role: str) -> str:
    return "(?i)" + "|".join(m.format(SPEAKERS[role]) for m in MARKERS)


def line_feature(line: Column) -> Column:
    """One number for a line: which speaker's marker it starts with, its length class, and a question mark at its end."""
    mark = F.lit(0)
    for k, role in enumerate(ROLES):
        mark = F.when(line.rlike(marker_pattern(role)), k + 1).otherwise(mark)
    size = sum((F.char_length(line) >= n).cast("int") for n in LENGTHS)
    return ((mark * (len(LENGTHS) + 1) + size) * 2 + F.rtrim(line).endswith("?").cast("int")).cast("int")


FEATURES = (len(ROLES) + 1) * (len(LENGTHS) + 1) * 2


def _features(text: str = "text") -> Column:
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line_feature)


@dataclass
class Model:
    """Log probabilities of the first state, of transitions and of features by state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def fit(turns: DataFrame, key: str = "conv_id", order: str = "turn", smooth: float = 0.5) -> Model:
    """Counts states, transitions and features over all lines of turns with known ``role``.

    Each turn follows the one before by a join on ``order - 1``, so a long conversation is no group. Turns of
    other or null roles are left out. The driver gets the counts: at most states x features rows.
    """
    known = turns.filter(F.lower("role").isin(*ROLES) & F.col(order).isNotNull())
    number = sum(F.when(F.lower("role") == r, k).otherwise(0) for k, r in enumerate(ROLES))
    rows = known.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("at"), number.alias("role"), _features().alias("f"))
    emitted = rows.select("role", F.posexplode("f").alias("pos", "feature"))
    emitted = emitted.groupBy((F.col("role") * 2 + (F.col("pos") > 0).cast("int")).alias("state"), "feature").agg(F.count("*").alias("n"))
    lines = rows.groupBy("role").agg(F.sum(F.size("f") - 1).alias("further"), F.count_if(F.size("f") > 1).alias("longer"))
    ends = rows.select("key", "at", (F.col("role") * 2 + (F.size("f") > 1).cast("int")).alias("last"))
    follows = rows.select("key", (F.col("at") - 1).alias("at"), "role").join(ends, ["key", "at"], "left")
    crossed = follows.groupBy("last", "role").agg(F.count("*").alias("n"))
    start, step, emit = np.full(STATES, 1e-9), np.full((STATES, STATES), 1e-9), np.full((STATES, FEATURES), smooth)
    start[::2] = smooth
    for r in crossed.collect():
        if r["last"] is None:
            start[2 * r["role"]] += r["n"]
        else:
            step[r["last"], 2 * r["role"]] += r["n"]
    for r in lines.collect():
        first, further = 2 * r["role"], 2 * r["role"] + 1
        step[first, further] += r["longer"]
        step[further, further] += r["further"] - r["longer"]
    for k in range(STATES):
        step[k, ::2] += smooth
        step[k, k | 1] += smooth
    for r in emitted.collect():
        emit[r["state"], r["feature"]] += r["n"]
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(norm(start), norm(step), norm(emit))


def viterbi(model: Model, features: np.ndarray, first: int | None, last: int | None) -> np.ndarray:
    """The best states of consecutive lines between fixed ones: ``first`` stands before them, ``last`` ends them.

    Without ``first`` they start a transcript. Of equal paths the one with smaller states, from the back.
    """
    score = (model.start if first is None else model.step[first]) + model.emit[:, features[0]]
    back = np.zeros((len(features), STATES), np.int8)
    for t in range(1, len(features)):
        ways = score[:, None] + model.step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + model.emit[:, features[t]]
    states = np.zeros(len(features), np.int8)
    states[-1] = score.argmax() if last is None else last
    for t in range(len(features) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def _block_scores(model: Model, features: np.ndarray) -> np.ndarray:
    """Best score into each last state of a block's lines, from each state before it and (last row) from the start."""
    score = np.concatenate([model.step, model.start[None]]) + model.emit[:, features[0]]
    for f in features[1:]:
        score = (score[:, :, None] + model.step[None]).max(axis=1) + model.emit[:, f]
    return score


def _streamed(rows: DataFrame, order: list[Column], step, schema: str) -> DataFrame:
    """``step(state, row) -> (state, row out)`` along each transcript's sorted rows; one state is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = ("",), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["key"],) != key:
                    key, state = (row["key"],), None
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, schema)


def line_states(parts: DataFrame, model: Model, parts_per_block: int = PARTS_PER_BLOCK) -> DataFrame:
    """key, at, states: the best path's state of every line of every part of the transcripts.

    ``parts``: key, at (the order) and features. Blocks of consecutive parts are solved in three steps, so a
    transcript of any length is no group: each block's best scores from every state to every state (42
    numbers); along a transcript's blocks the scores so far, and from the last block back the state in which
    each one ends; then every block's path between its fixed ends.
    """
    sent = parts.sparkSession.sparkContext.broadcast(model)
    blocked = parts.withColumn("block", F.floor(F.col("at") / parts_per_block))
    dealt = blocked.repartition("key", "block").sortWithinPartitions("key", "block", "at")
    dealt = dealt.select("key", "block", "at", "features")

    def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["key"], held[0]["block"]) != (row["key"], row["block"]):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_block(batches):
            score = _block_scores(sent.value, np.concatenate([r["features"] for r in rows]))
            yield pa.RecordBatch.from_pydict({"key": pa.array([rows[0]["key"]], pa.string()), "block": pa.array([rows[0]["block"]], pa.int64()), "score": [score.ravel().tolist()]})

    blocks = cut_lineage(dealt.mapInArrow(summarise, "key string, block bigint, score array<double>"))

    def forward(state, row):
        score = np.array(row["score"]).reshape(STATES + 1, STATES)
        now = score[-1] if state is None else (state[:, None] + score[:-1]).max(axis=0)
        made = {"key": row["key"], "block": row["block"], "score": row["score"], "before": None if state is None else state.tolist(), "after": now.tolist()}
        return now, made

    schema = "key string, block bigint, score array<double>, before array<double>, after array<double>"
    scored = cut_lineage(_streamed(blocks, [F.col("block")], forward, schema))

    def backward(state, row):
        last = int(np.argmax(row["after"])) if state is None else state
        score = np.array(row["score"]).reshape(STATES + 1, STATES)
        first = None if row["before"] is None else int(np.argmax(np.array(row["before"]) + score[:-1, last]))
        return first, {"key": row["key"], "block": row["block"], "first": -1 if first is None else first, "last": last}

    ends = cut_lineage(_streamed(scored, [F.col("block").desc()], backward, "key string, block bigint, first bigint, last bigint"))
    joined = blocked.join(ends, ["key", "block"]).repartition("key", "block").sortWithinPartitions("key", "block", "at")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_block(batches):
            first = None if rows[0]["first"] < 0 else rows[0]["first"]
            states = viterbi(sent.value, np.concatenate([r["features"] for r in rows]), first, rows[0]["last"])
            cuts = np.cumsum([0] + [len(r["features"]) for r in rows])
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array([r["key"] for r in rows], pa.string()), "at": pa.array([r["at"] for r in rows], pa.int64()), "states": pa.array([states[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(pa.int8()))}
            )

    return joined.select("key", "block", "at", "features", "first", "last").mapInArrow(solve, "key string, at bigint, states array<tinyint>")


def rendered(parts: DataFrame, model: Model, key: str = "conv_id", order: str = "part") -> DataFrame:
    """key, order, roles (of the part's lines) and text: the canonical form of each part of the transcripts.

    A transcript is the parts of one key in their order, cut anywhere between lines; parts carry no roles.
    A line in a state of first lines opens a turn: ``<|im_start|>role``, on a line of its own, and before it
    ``<|im_end|>`` for the turn that ends; the last part closes its turn. Speaker markers are taken off the
    lines that open turns. So the texts of a key, joined by line feeds in their order, are its canonical
    turns, and a turn may run on over any number of parts.

    Every part gives one row. A null text is an empty line; each part with a null key is a transcript of its
    own; parts without order come last in their transcript; parts that share key and order follow one another
    by a hash of the text, then by the text; other columns are ignored.
    """
    rows = parts.select(F.col(key).alias("given"), F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("given_at"), F.coalesce("text", F.lit("")).alias("text"))
    # Places ascend over the range partitions, so a transcript of any length is no group; the hash parts those of one order.
    by = ["key", F.col("given_at").asc_nulls_last(), "tie"]
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, *by).sortWithinPartitions(*by, "text")
    placed = dealt.withColumn("at", F.monotonically_increasing_id())
    # A letter before the key keeps given keys and those made for null keys apart.
    made = F.when(F.col("key").isNull(), F.concat(F.lit("n"), F.col("at").cast("string"))).otherwise(F.concat(F.lit("k"), "key"))
    grouped = cut_lineage(placed.select("given", "given_at", made.alias("key"), "at", "text", _features().alias("features")))
    states = line_states(grouped.select("key", "at", "features"), model)
    bounds = grouped.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    role_of = F.array(*[F.lit(r) for r in ROLES])
    marker = "(?i)" + "|".join(marker_pattern(r).removeprefix("(?i)") for r in ROLES)
    stripped = lambda line: F.regexp_replace(line, marker, "")

    def one(line: Column, state: Column, at: Column) -> Column:
        opens = (state % 2 == 0) | ((F.col("at") == F.col("lo")) & (at == 0))
        close = F.when((F.col("at") == F.col("lo")) & (at == 0), "").otherwise("<|im_end|>\n")
        return F.when(opens, F.concat(close, F.lit("<|im_start|>"), role_of[(state / 2).cast("int")], F.lit("\n"), stripped(line))).otherwise(line)

    joined = grouped.join(states, ["key", "at"]).join(bounds, "key")
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), F.col("states").alias("state"))
    body = F.array_join(F.transform(lines, lambda x, k: one(x["line"], x["state"], k)), "\n")
    text = F.concat(body, F.when(F.col("at") == F.col("hi"), "\n<|im_end|>").otherwise(""))
    roles = F.transform("states", lambda s: role_of[(s / 2).cast("int")])
    return joined.select(F.col("given").alias(key), F.col("given_at").alias(order), roles.alias("roles"), F.size(F.filter("states", lambda s: s % 2 == 0)).alias("opened"), text.alias("text"))


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, part, text: the turns of ``conversations`` with speaker markers in place of roles.

    A hash of the conversation picks its style: ``User:``, ``### Human``, ``<|user|>``, ``[Q]``; in one
    turn of eight, and in one conversation of five for all of them, the marker is missing.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    names = {"system": ("System", "System", "system", "Sys"), "user": ("User", "Human", "user", "Q"), "assistant": ("Assistant", "AI", "assistant", "A")}
    name = F.lit("")
    for role, shown in names.items():
        name = F.when(F.lower("role") == role, F.array(*[F.lit(x) for x in shown])[F.least(style, F.lit(3)).cast("int")]).otherwise(name)
    mark = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(" ")))
    mark = mark.when(style == 2, F.concat(F.lit("<|"), name, F.lit("|> "))).when(style == 3, F.concat(F.lit("["), name, F.lit("] "))).otherwise("")
    mark = F.when((name == "") | (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0), "").otherwise(mark)
    return turns.select("conv_id", F.col("turn").alias("part"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))
