"""N-best segmentation into the pieces of a SentencePiece model, and decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.llm.common import column_bytes
from demescope.session import cut_lineage

MARK = "▁"  # how pieces write a space
FALLBACK = 10.0  # a byte's score lies this far below the lowest piece's
SMOOTHING = 0.5  # added to the count of every piece
ROUNDS = 1  # re-estimations from the best segmentations
CHUNK_BYTES = 1 << 20
TOGETHER = 64  # units of at most so many characters are searched in step with others
STEP_UNITS = 5_000
SLOT_BITS = 18


class Trie:
    """The pieces as a table of transitions, so that the edges of many units are found at once."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        letters = sorted({c for p in scores for c in p})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        code = {c: k for k, c in enumerate(letters)}
        self.width = len(letters) + 1
        nodes: dict[int, int] = {}
        score, piece = [-np.inf], [-1]
        for p, s in scores.items():
            node = 0
            for c in p:
                key = node * self.width + code[c]
                if (node := nodes.get(key, -1)) < 0:
                    node = nodes[key] = len(score)
                    score.append(-np.inf)
                    piece.append(-1)
            score[node], piece[node] = s, ids[p]
        keys, to = np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))
        slot = self.slots(keys)
        order = np.argsort(slot, kind="stable")
        # Keys by slot, each slot's run followed by the next one's; a key lies among the ``run`` first of its slot.
        self.keys, self.to = np.append(keys[order], -1), np.append(to[order], 0)
        self.first = np.searchsorted(slot[order], np.arange(1 << SLOT_BITS)).astype(np.int32)
        self.run = int(np.bincount(slot, minlength=1).max()) if len(slot) else 0
        self.score, self.piece = np.array(score), np.array(piece)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys stand in the table, or an entry with another key."""
        at = self.first[self.slots(keys)]
        off = np.flatnonzero(self.keys[at] != keys)
        for _ in range(self.run - 1):
            at[off] = np.minimum(at[off] + 1, len(self.keys) - 1)
            off = off[self.keys[at[off]] != keys[off]]
        return at

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Letter codes of code points; one that no piece has gets the code after the last."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at, len(self.letters))

    def edges(self, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, score, id) of every piece in the flat codes; ``stop`` is the end of each place's unit."""
        begin, node, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
        at = begin
        while len(begin):
            key = node * self.width + code[at]
            k = self.place(key)
            on = self.keys[k] == key
            begin, at, node = begin[on], at[on] + 1, self.to[k[on]]
            whole = self.piece[node] >= 0
            found.append((begin[whole], at[whole], self.score[node[whole]], self.piece[node[whole]]))
            inside = at < stop[begin]
            begin, at, node = begin[inside], at[inside], node[inside]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Pieces:
    """A model's pieces and scores, and the segmentations of the units met so far.

    A text is segmented with a space put before it and every space written as ``MARK``. No piece has a MARK
    after another character or a line feed beside another one (checked on loading), so the lattice falls
    apart into units: a run of marks with what follows it, cut before line feeds too. The N best
    segmentations of a text follow exactly from those of its units.

    ``logs`` has a score for every id; without it the model's own scores count, which are log-probabilities in
    a unigram model only (a BPE model has merge ranks there).
    """

    #: Bytes of units and their segmentations that a worker keeps (beyond that the more used half stays), and what a unit takes besides its arrays.
    HELD, ENTRY = 64 << 20, 150

    def __init__(self, path: str, best: int, logs: np.ndarray | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in normal}
        self.scores = {p: model.get_score(i) if logs is None else float(logs[i]) for p, i in self.ids.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.reach: dict[str, int] = {}  # the longest piece that starts with two given characters
        for p in self.ids:
            self.reach[p[:2]] = max(len(p), self.reach.get(p[:2], 0))
        for p in self.ids:
            if MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1):
                raise ValueError(f"piece {p!r} spans units")
        self.low = min(self.scores.values()) - FALLBACK
        text = [b""] * size
        for p, i in self.ids.items():
            text[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            text[i] = bytes([b])
        self.text_sizes = np.array(list(map(len, text)))
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.trie = Trie(self.scores, self.ids)
        self.best = best
        self.clear()

    def held(self) -> int:
        """Bytes of the units met so far."""
        return self.ENTRY * len(self.codes) + sum(x.nbytes for x in (self.flat, self.begins, self.counts, self.score, self.gaps, self.uses))

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begins, self.counts = np.zeros((0, self.best), np.int64), np.zeros((0, self.best), np.int64)
        self.score = np.zeros(0)
        self.gaps = np.zeros((0, self.best))
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the units met most often, up to half of ``HELD``; older uses count half."""
        order = np.argsort(-self.uses, kind="stable")
        size = self.held() / max(len(order), 1) + 4 * (self.counts[order].sum(axis=1) - len(self.flat) / max(len(order), 1))
        kept = np.sort(order[: int(np.searchsorted(np.cumsum(size), self.HELD // 2))])
        names = list(self.codes)
        self.codes = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        begins, self.counts, self.score, self.gaps, self.uses = self.begins[kept], self.counts[kept], self.score[kept], self.gaps[kept], self.uses[kept] // 2
        n = self.counts.ravel()
        self.begins = (np.cumsum(n) - n).reshape(begins.shape)
        self.flat = self.flat[np.arange(n.sum()) + np.repeat((begins - self.begins).ravel(), n)]

    @property
    def starts(self) -> np.ndarray:
        """Where the ids of each unit's best segmentation begin in ``flat``."""
        return self.begins[:, 0]

    @property
    def sizes(self) -> np.ndarray:
        return self.counts[:, 0]

    def edges(self, unit: str) -> tuple[list[float], list[list[tuple[float, int]]]]:
        """Viterbi scores from the front, and for each end its edges: (best score up to the end, begin)."""
        n, get, reach = len(unit), self.scores.get, self.reach.get
        front, ends = [0.0] * (n + 1), [[] for _ in range(n + 1)]
        for b in range(n):
            if b:
                front[b] = max(ends[b])[0]
            at = front[b]
            one = get(unit[b])
            if one is None:  # no piece: its bytes
                one = self.low * len(unit[b].encode())
            ends[b + 1].append((at + one, b))
            for e in range(b + 2, min(n, b + reach(unit[b : b + 2], 1)) + 1):
                s = get(unit[b:e])
                if s is not None:
                    ends[e].append((at + s, b))
        front[n] = max(ends[n])[0]
        return front, ends

    def segmentations(self, unit: str, best: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The ``best`` segmentations of a unit, highest score first.

        Viterbi scores from the front are the exact rest costs of an A* search from the back, so every
        entry it finishes is the next best. An entry is the k-th best edge into a place with what follows
        it; taken from the agenda, it gives way to the next edge there and goes on at its edge's begin.
        Equal scores come in the order of the search, which is fixed.
        """
        best = best or self.best
        front, ends = self.edges(unit)
        ordered: set[int] = set()
        agenda: list = [(-front[-1], 0, len(unit), 0, 0.0, None)]
        made, out = 0, []
        while agenda and len(out) < best:
            _, _, e, k, back, suffix = heapq.heappop(agenda)
            if e not in ordered:
                ends[e].sort(reverse=True)
                ordered.add(e)
            into = ends[e]
            if k + 1 < len(into):
                made += 1
                heapq.heappush(agenda, (-(back + into[k + 1][0]), made, e, k + 1, back, suffix))
            total, b = into[k]
            suffix = (b, e, suffix)
            if b == 0:
                score, ids = back + total, []
                while suffix:
                    b, e, suffix = suffix
                    i = self.ids.get(unit[b:e])
                    ids.extend([i] if i is not None else [self.byte[x] for x in unit[b:e].encode()])
                out.append((score, tuple(ids)))
            else:
                made += 1
                heapq.heappush(agenda, (-(back + total), made, b, 0, back + total - front[b], suffix))
        return out

    def together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many units the ids of the ``best`` segmentations, flat and counted, and their scores (-inf beyond the last).

        The search of ``segmentations``, one step of all units at a time: the agenda is a row a unit in the
        order of its entries' making, of which equal scores leave the first one first.
        """
        count = len(units)
        sizes = np.fromiter(map(len, units), np.int64, count)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(count), sizes)
        begin, end, score, piece = self.trie.edges(self.trie.coded(points), ends[owner])
        alone = np.ones(len(points), bool)
        alone[begin[end == begin + 1]] = False
        if len(b := np.flatnonzero(alone)):  # no piece: its bytes
            width = 1 + (points[b] > 0x7F).astype(np.int64) + (points[b] > 0x7FF) + (points[b] > 0xFFFF)
            begin, end = np.concatenate([b, begin]), np.concatenate([b + 1, end])
            score, piece = np.concatenate([self.low * width, score]), np.concatenate([np.full(len(b), -1), piece])

        # Viterbi from the front, by offset of the end in its unit; edges into an end stay in the order of length. Places count one more a unit, for its end.
        unit = owner[begin]
        offset = end - starts[unit]
        order = np.lexsort((end, offset))
        begin, end, score, piece, unit, offset = (x[order] for x in (begin, end, score, piece, unit, offset))
        front = np.zeros(len(points) + count)
        source, target = begin + unit, end + unit
        total = np.empty(len(begin))
        bounds = np.searchsorted(offset, np.arange(1, offset[-1] + 2))
        for a, z in zip(bounds, bounds[1:], strict=False):
            total[a:z] = front[source[a:z]] + score[a:z]
            into = target[a:z]
            first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
            front[into[first]] = np.maximum.reduceat(total[a:z], first)

        # Edges by end, best first; of equal ones the shorter first.
        firsts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        degree = np.diff(np.concatenate([firsts, [len(target)]]))
        first_edge, last_edge = np.zeros(len(front), np.int64), np.zeros(len(front), np.int64)
        first_edge[target[firsts]], last_edge[target[firsts]] = firsts, firsts + degree
        rank, follow = np.zeros(len(target), np.int64), last_edge[target] - np.arange(len(target))
        near = np.arange(len(target))
        for ahead in range(1, int(degree.max())):
            near = near[follow[near] > ahead]
            better = total[near] >= total[near + ahead]
            rank[near + ahead] += better
            rank[near] += ~better
        order = np.empty(len(target), np.int64)
        order[first_edge[target] + rank] = np.arange(len(target))
        source, total, piece = source[order], total[order], piece[order]
        tops = ends + np.arange(count)
        bottoms = starts + np.arange(count)

        scores = np.full((count, self.best), -np.inf)
        done = np.zeros(count, np.int64)
        room = 64
        agenda = np.full((count, room), -np.inf)
        edge, back, after = np.empty((count, room), np.int64), np.empty((count, room)), np.empty((count, room), np.int64)
        agenda[:, 0], edge[:, 0], back[:, 0], after[:, 0] = front[tops], first_edge[tops], 0.0, -1
        made = np.ones(count, np.int64)
        live = np.arange(count)
        taken_edge, taken_after, nodes = [], [], 0
        goal = np.full((count, self.best), -1)
        while len(live):
            most = int(made[live].max())
            slot = agenda[live, :most].argmax(axis=1)
            some = agenda[live, slot] > -np.inf
            live, slot = live[some], slot[some]
            if not len(live):
                break
            if most + 2 > agenda.shape[1]:
                agenda, edge, back, after = (np.concatenate([x, np.full((count, room), -np.inf if x is agenda else 0, x.dtype)], axis=1) for x in (agenda, edge, back, after))
            e, so_far, suffix = edge[live, slot], back[live, slot], after[live, slot]
            agenda[live, slot] = -np.inf
            more = e + 1 < last_edge[target[e]]
            u, x = live[more], e[more] + 1
            agenda[u, made[u]], edge[u, made[u]], back[u, made[u]], after[u, made[u]] = so_far[more] + total[x], x, so_far[more], suffix[more]
            made[u] += 1
            node = nodes + np.arange(len(live))
            taken_edge.append(e)
            taken_after.append(suffix)
            nodes += len(live)
            b = source[e]
            full = b == bottoms[live]
            u = live[full]
            scores[u, done[u]] = so_far[full] + total[e[full]]
            goal[u, done[u]] = node[full]
            done[u] += 1
            on = ~full
            u, x, reached = live[on], e[on], b[on]
            now = so_far[on] + total[x]
            agenda[u, made[u]], edge[u, made[u]], back[u, made[u]], after[u, made[u]] = now, first_edge[reached], now - front[reached], node[on]
            made[u] += 1
            live = live[done[live] < self.best]

        taken_edge, taken_after = np.concatenate(taken_edge), np.concatenate(taken_after)
        # A row is one segmentation: unit times ``best`` plus rank.
        steps, row = [], np.flatnonzero(goal.ravel() >= 0)
        node = goal.ravel()[row]
        while len(row):
            steps.append((row, taken_edge[node]))
            node = taken_after[node]
            row, node = row[node >= 0], node[node >= 0]
        row, e = (np.concatenate(c) for c in zip(*steps, strict=True))
        e = e[np.argsort(row, kind="stable")]
        sizes = np.bincount(row, minlength=count * self.best)
        cuts = np.cumsum(sizes)
        ids = piece[e]
        if len(odd := np.flatnonzero(ids < 0)):
            chars = points[source[e[odd]] - np.repeat(np.arange(count * self.best) // self.best, sizes)[odd]].tolist()
            spelled = [[self.byte[x] for x in chr(c).encode()] for c in chars]
            width = np.ones(len(ids), np.int64)
            width[odd] = list(map(len, spelled))
            ids = np.repeat(ids, width)
            ids[ids < 0] = [x for w in spelled for x in w]
            sizes = np.diff(np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], cuts])])
        return ids, sizes.reshape(count, self.best), scores

    def units(self, text: str) -> list[str]:
        """A text without MARK, cut into units; the first has the space that is put before."""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [u for run in re.findall(f"{MARK}*[^{MARK}]*", MARK + text.replace(" ", MARK)) for u in re.split("(?=\n)", run) if u]
        return [u if u[:1] == "\n" else MARK + u for u in text.replace("\n", " \n").split(" ")]

    def learn(self, new: list[str]) -> None:
        """Adds units: short ones many at a time, others one by one."""
        short = sorted((u for u in new if len(u) <= TOGETHER), key=len)
        long = [u for u in new if len(u) > TOGETHER]
        flat, sizes, scores = [self.flat], [], []
        for k in range(0, len(short), STEP_UNITS):
            i, n, s = self.together(short[k : k + STEP_UNITS])
            flat.append(i.astype(np.int32))
            sizes.append(n)
            scores.append(s)
        for u in long:
            found = self.segmentations(u)
            flat += [np.array(ids, np.int32) for _, ids in found]
            sizes.append(np.array([[len(ids) for _, ids in found] + [0] * (self.best - len(found))]))
            scores.append(np.array([[s for s, _ in found] + [-np.inf] * (self.best - len(found))]))
        size, score = np.concatenate(sizes), np.concatenate(scores)
        self.codes.update(zip(short + long, range(len(self.score), len(self.score) + len(new)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + (np.cumsum(size) - size.ravel()).reshape(size.shape)])
        self.counts = np.concatenate([self.counts, size])
        self.flat = np.concatenate(flat)
        self.score = np.concatenate([self.score, score[:, 0]])
        self.gaps = np.concatenate([self.gaps, score[:, :1] - score])

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float, list[float]]]:
        """Of each text the ids of its best segmentation, their score, and the scores of the N best."""
        for ranked in self.ranked(texts):
            yield ranked[0][1], ranked[0][0], [s for s, _ in ranked]

    def ranked(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """Of each text the score and ids of its N best segmentations, highest score first."""
        if self.held() > self.HELD:
            self.forget()
        pieces, bounds = [], [0]
        for t in texts:
            if MARK in t:  # a literal mark is three bytes, so that decoding gives it back
                parts = t.split(MARK)
                for k, part in enumerate(parts):
                    units = self.units(part) if part else []
                    if k:
                        pieces.append("\0" + MARK)
                        if units:
                            units[0] = units[0][1:]
                    elif not part:
                        units = [MARK]
                    pieces += [u for u in units if u]
            elif t:
                pieces += self.units(t)
            bounds.append(len(pieces))
        if new := list(set(pieces).difference(self.codes)):
            literal = "\0" + MARK
            if plain := [u for u in new if u != literal]:
                self.learn(plain)
            if literal in new:
                self.codes[literal] = len(self.score)
                ids = np.array([self.byte[x] for x in MARK.encode()], np.int32)
                self.begins = np.concatenate([self.begins, np.full((1, self.best), len(self.flat))])
                self.counts = np.concatenate([self.counts, [[3] + [0] * (self.best - 1)]])
                self.flat, self.score = np.concatenate([self.flat, ids]), np.append(self.score, 3 * self.low)
                self.gaps = np.concatenate([self.gaps, [[0.0] + [np.inf] * (self.best - 1)]])
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        self.uses = np.bincount(codes, minlength=len(self.score)) + np.pad(self.uses, (0, len(self.score) - len(self.uses)))
        sizes = self.sizes[codes]
        through = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(through[-1]) + np.repeat(self.starts[codes] - through[:-1], sizes)]
        totals = np.concatenate([[0], np.cumsum(self.score[codes])])
        for a, b in zip(bounds, bounds[1:], strict=False):
            score = float(totals[b] - totals[a])
            out = []
            for gap, changes in self.least_sums(codes[a:b]):
                parts, at = [], through[a]
                for k, rank in sorted(changes):
                    begin, count = self.begins[codes[a + k], rank], self.counts[codes[a + k], rank]
                    parts += [ids[at : through[a + k]], self.flat[begin : begin + count]]
                    at = through[a + k + 1]
                rest = ids[at : through[b]]
                out.append((score - gap, np.concatenate([*parts, rest]) if parts else rest))
            yield out

    def least_sums(self, codes: np.ndarray) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The N least sums of one gap per unit, each with the (place, rank) of the units that don't take their best.

        Only the units with the least second gaps can be among these.
        """
        if self.best == 1 or not len(codes):
            return [(0.0, ())]
        second = self.gaps[codes, 1]
        near = np.argpartition(second, self.best - 2)[: self.best - 1] if len(codes) > self.best - 1 else np.arange(len(codes))
        sums: list = [(0.0, ())]
        for k, row in zip(near.tolist(), self.gaps[codes[near]].tolist(), strict=True):
            ways = [(gap, ((k, rank),) if rank else ()) for rank, gap in enumerate(row) if gap < np.inf]
            sums = sorted(((a + b, x + y) for a, x in sums for b, y in ways), key=lambda s: s[0])[: self.best]
        return sums

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes, without the space that was put before it."""
        n = self.text_sizes[ids]
        at = np.arange(n.sum()) + np.repeat(self.text_starts[ids] - np.cumsum(n) + n, n)
        return self.text[at].tobytes()[1:]


_LOADED: dict[tuple[str, int, int], Pieces] = {}


def pieces(path: str, best: int, logs: np.ndarray) -> Pieces:
    """One model per worker process, so its units are kept between tasks; other scores take its place."""
    key = path, best, zlib.crc32(logs.tobytes())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(path, best, logs)
    return _LOADED[key]


def unit_counts(docs: DataFrame) -> DataFrame:
    """unit, n: the different units of all texts, spaces written as such, and how often they come.

    Marks that stand in a text are bytes, not pieces, and are left out here.
    """
    text = F.concat(F.lit(" "), F.replace("text", F.lit(MARK), F.lit("")))
    units = docs.where(F.length("text") > 0).select(F.explode(F.split(text, "(?<! )(?= )|(?=\n)")).alias("unit"))
    return units.groupBy("unit").agg(F.count("*").alias("n"))


def smoothed_logs(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of counts with ``SMOOTHING`` added to each."""
    more = counts + SMOOTHING
    return np.log(more / more.sum())


def piece_logs(docs: DataFrame, model: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities of the model's pieces, by id, estimated on all texts.

    The first estimate counts the pieces of the library's own segmentation of every different unit, by how often
    the unit comes; each of the ``rounds`` counts those of the best segmentation under the estimate before it
    (expectation maximisation by Viterbi paths). Counts are whole numbers, so neither order nor partitions change
    them. Pieces never met have the count ``SMOOTHING``; without any text all are alike. The driver sees one sum
    per piece.
    """
    from sentencepiece import SentencePieceProcessor

    units = cut_lineage(unit_counts(docs))
    size = SentencePieceProcessor(model_file=model).get_piece_size()

    def summed(logs: np.ndarray | None) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            coder = Pieces(model, 1, logs)
            for batch in batches:
                names, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                offsets = column_bytes(batch.column(0))[1]
                row = 0
                while row < len(names):
                    to = min(len(names), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1))
                    marked = [u.replace(" ", MARK) for u in names[row:to]]
                    if logs is None:  # the library puts a mark before a text; of a unit without one it goes again
                        ids = coder.model.encode([u.removeprefix(MARK) for u in marked])
                        ids = [[coder.ids[MARK]] if u == MARK else x if u[0] == MARK else x[1:] for u, x in zip(marked, ids, strict=True)]
                        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
                    else:
                        coder.clear()
                        coder.learn(marked)
                        codes = np.fromiter(map(coder.codes.__getitem__, marked), np.int64, len(marked))
                        sizes = coder.sizes[codes]
                        flat = coder.flat[np.arange(sizes.sum()) + np.repeat(coder.starts[codes] - np.cumsum(sizes) + sizes, sizes)]
                    np.add.at(total, flat, np.repeat(times[row:to], sizes))
                    row = to
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"id": pa.array(met, pa.int32()), "n": pa.array(total[met], pa.int64())})

        total = np.zeros(size)
        for row in units.mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
            total[row["id"]] = row["n"]
        return smoothed_logs(total)

    logs = summed(None)
    for _ in range(rounds):
        logs = summed(logs)
    return logs


def encoded(docs: DataFrame, model: str, best: int = 3, ids: bool = True, logs: np.ndarray | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, score, nbest_scores, round_trip, nbest of every row.

    A piece's score is its log-probability ``logs``, by default estimated on these texts (``piece_logs``); a character
    without a piece costs ``FALLBACK`` more than the rarest piece for each of its bytes.
    ids are those of the best segmentation by summed piece scores, ids_crc32 the checksum of them as
    little-endian 32-bit integers, nbest_scores the scores of the ``best`` segmentations (fewer if there are
    fewer), highest first; round_trip says that decoding the ids gives back the text. nbest has score, ids,
    n_tokens, ids_crc32 and round_trip of each of the ``best`` segmentations in that order. Whole texts are
    segmented, whatever their length. Null and empty texts have no tokens and score 0; repeated rows give
    repeated results; other columns are ignored. ``ids=False`` leaves the ids out, also those in nbest.
    """

    logs = piece_logs(docs, model) if logs is None else logs

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model, best, logs)
        for batch in batches:
            offsets = column_bytes(batch.column(1))[1]
            row = 0
            while row < batch.num_rows:
                to = min(batch.num_rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1))
                texts = [t or "" for t in batch.column(1).slice(row, to - row).to_pylist()]
                got = list(coder.ranked(texts))
                firsts = np.concatenate([[0], np.cumsum([len(g) for g in got])])
                found = [(score, x, t) for g, t in zip(got, map(str.encode, texts), strict=True) for score, x in g]
                each = {
                    "score": pa.array([score for score, _, _ in found], pa.float64()),
                    "ids": pa.array([x for _, x, _ in found], pa.list_(pa.int32())) if ids else None,
                    "n_tokens": pa.array([len(x) for _, x, _ in found], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x, _ in found], pa.int64()),
                    "round_trip": pa.array([coder.decode(x) == t for _, x, t in found], pa.bool_()),
                }
                each = {k: v for k, v in each.items() if v is not None}
                best_of = {k: v.take(pa.array(firsts[:-1])) for k, v in each.items()}
                offsets_of = pa.array(firsts, pa.int32())
                columns = {
                    "doc_id": batch.column(0).slice(row, to - row),
                    "ids": best_of.get("ids"),
                    "n_tokens": best_of["n_tokens"],
                    "ids_crc32": best_of["ids_crc32"],
                    "score": best_of["score"],
                    "nbest_scores": pa.ListArray.from_arrays(offsets_of, each["score"]),
                    "round_trip": best_of["round_trip"],
                    "nbest": pa.ListArray.from_arrays(offsets_of, pa.StructArray.from_arrays(list(each.values()), list(each))),
                }
                yield pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if v is not None})
                row = to

    kept = "ids array<int>, " if ids else ""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        encode,
        f"doc_id bigint, {kept}n_tokens bigint, ids_crc32 bigint, score double, nbest_scores array<double>, round_trip boolean, "
        f"nbest array<struct<score:double, {kept.replace(' ', ':', 1)}n_tokens:bigint, ids_crc32:bigint, round_trip:boolean>>",
    )
