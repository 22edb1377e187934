"""Ranked search of many items at once, by shared parts of their sums.

A document's score for an item is a sum over the item's terms, so what items have in common is summed once. Terms
that occur in the same items form a *set*; each set has one partial sum a document. An item is the chain of its
sets, those of most items first, and chains that begin alike share their steps: the steps are the nodes of a graph
in which a node adds one set to the sum of the node before. Tasks go through the graph level by level over blocks
of documents; each passes on the best documents of every item alone.

Terms are told apart by 64-bit hashes. Rows of one ``item_id`` (null included) are one item with the terms of all
of them; an item without a term gives no rows, as does a document without one. Every document row is ranked for
itself, so equal rows take ranks of their own; rows of null ids come last among equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demescope.llm.common import PUNCTUATION, word_hashes
from demescope.session import cut_lineage

#: Terms of items, with repeats over items, whose graph is held at once; more are ranked in as many passes.
TERMS_AT_ONCE = 1 << 20
#: Numbers of a block of partial sums (documents by sets or nodes), 8 bytes each.
SUMS = 1 << 21
#: Parts in which the best of the tasks are merged before all are.
PARTS = 256


def term_counts(df: DataFrame, key: str, text: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """``key, n, terms, counts``: all terms of each row's whole text with repeats, and its distinct terms with counts.

    With ``terms``, sorted hashes, only those are listed, as their places in it; ``n`` counts all the same.
    """
    kind = "bigint" if terms is None else "int"
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, n bigint, terms array<{kind}>, counts array<int>"
    dtype = np.int64 if terms is None else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, hashes, counts in word_hashes(batch.column(1), PUNCTUATION):
                row = np.repeat(np.arange(len(counts)), counts)
                if terms is None:
                    ids = hashes.view(np.int64)
                else:
                    at = np.searchsorted(terms, hashes)
                    at[at == len(terms)] = 0
                    known = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
                    ids, row = at[known].astype(np.int32), row[known]
                order = np.lexsort((ids, row))
                ids, row = ids[order], row[order]
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(ids))).astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[starts], minlength=len(counts)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(first, len(counts)),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(ids[starts].astype(dtype))),
                        pa.ListArray.from_arrays(ends, pa.array(times)),
                    ],
                    names=["key", "n", "terms", "counts"],
                )

    return narrow.mapInArrow(run, schema)


# --- the graph of shared sums -------------------------------------------------------------


def shared_sets(item_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, set_id`` and ``item, set_id, items``: terms of the same items are one set, named by its least term.

    The items of a term are compared by their number and two independent 64-bit sums, so no list of them is made.
    """
    mark = [F.expr("bit_xor(xxhash64(item, 1))").alias("x"), F.expr("bit_xor(xxhash64('y', item))").alias("y")]
    signed = item_terms.groupBy("term").agg(F.count("*").alias("items"), *mark)
    names = signed.groupBy("items", "x", "y").agg(F.min("term").alias("set_id"))
    sets = cut_lineage(signed.join(names, ["items", "x", "y"]).select("term", "set_id", "items"))
    chains = item_terms.join(sets.filter(F.col("term") == F.col("set_id")), "term").select("item", "set_id", "items")
    return sets.select("term", "set_id"), chains


def sharing_graph(chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps ``depth, node, parent, set_id, items`` and ends ``item, depth, node`` of the items' chains.

    A node is a beginning that chains have in common: its depth and an order-free mark of the sets in it, which
    tells beginnings apart since every chain is in the same order of sets.
    """
    chain = Window.partitionBy("item").orderBy(F.desc("items"), "set_id")
    so_far = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.expr("bit_xor(xxhash64(set_id, 7))").over(so_far)
    other = F.expr("bit_xor(xxhash64('z', set_id))").over(so_far)
    steps = chains.select("item", "set_id", "items", F.row_number().over(chain).alias("depth"), F.struct(mark, other).alias("node"))
    before = F.lag("node").over(Window.partitionBy("item").orderBy("depth"))
    steps = cut_lineage(steps.withColumn("parent", before))
    nodes = steps.groupBy("depth", "node").agg(F.first("parent").alias("parent"), F.first("set_id").alias("set_id"), F.count("*").alias("items"))
    ends = steps.groupBy("item").agg(F.max_by(F.struct("depth", "node"), "depth").alias("end")).select("item", "end.*")
    return nodes, ends


@dataclass
class Graph:
    """A block of items as arrays: sorted term hashes and their sets, per level each node's parent and set, and ends."""

    terms: np.ndarray
    set_of: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    ends: list[tuple[np.ndarray, np.ndarray]]
    items: int


def _gathered(item_terms: DataFrame) -> tuple[Graph, list]:
    """The graph of one block of items; its size is bounded by the block's terms."""
    sets, chains = shared_sets(item_terms)
    nodes, ends = sharing_graph(cut_lineage(chains))
    table = sets.toPandas()
    hashes = table["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    names, set_of = np.unique(table["set_id"].to_numpy(np.int64), return_inverse=True)
    place: dict = {}
    levels: list[list] = []
    for r in sorted(nodes.collect(), key=lambda r: (r["depth"], r["node"])):
        if r["depth"] > len(levels):
            levels.append([])
        levels[-1].append((place[r["depth"] - 1, r["parent"]] if r["depth"] > 1 else 0, r["set_id"]))
        place[r["depth"], r["node"]] = len(levels[-1]) - 1
    found = [([], []) for _ in levels]
    ids = []
    for r in ends.orderBy("item").collect():
        found[r["depth"] - 1][0].append(place[r["depth"], r["node"]])
        found[r["depth"] - 1][1].append(len(ids))
        ids.append(r["item"])
    arrays = [(np.array([p for p, _ in x]), np.searchsorted(names, [s for _, s in x])) for x in levels]
    at = [(np.array(n, np.int64), np.array(i, np.int64)) for n, i in found]
    return Graph(hashes[order], set_of[order], arrays, at, len(ids)), ids


# --- scores -------------------------------------------------------------------------------


def block_scores(graph: Graph, gains: np.ndarray, term: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Scores of a block of documents, items by documents, from the gain of each of their terms."""
    sums = np.zeros((int(graph.set_of.max()) + 1, docs), np.int64)
    np.add.at(sums.reshape(-1), graph.set_of[term] * docs + doc, gains)
    out = np.zeros((graph.items, docs), np.int64)
    level = np.zeros((1, docs), np.int64)
    for (parents, sets), (nodes, items) in zip(graph.levels, graph.ends):
        level = level[parents] + sums[sets]
        out[items] = level[nodes]
    return out


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best: highest score, then smallest id, null ids last."""
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    start = np.concatenate([[True], item[1:] != item[:-1]])
    first = np.flatnonzero(start)[np.cumsum(start) - 1]
    return order[np.arange(len(item)) - first < k]


def _task_best(postings: DataFrame, graph: Graph, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, score, key``: per task the k best documents of every item."""
    widest = max([1, len(np.unique(graph.set_of)), graph.items, *(len(p) for p, _ in graph.levels)])
    docs_at_once = max(1, SUMS // widest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        least = np.ones(graph.items, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, docs_at_once):
                part = batch.slice(first, docs_at_once)
                keys, n, terms, counts = (part.column(i) for i in range(4))
                size = np.diff(terms.offsets.to_numpy())
                doc = np.repeat(np.arange(len(size)), size)
                term, tf = (x.flatten().to_numpy().astype(np.int64) for x in (terms, counts))
                m = 10 + (90 * n.to_numpy() * n_docs) // n_terms
                gains = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                scores = block_scores(graph, gains, term, doc, len(size))
                item, at = np.nonzero(scores >= least[:, None])
                if not len(item):
                    continue
                null = keys.is_null().to_numpy(zero_copy_only=False)
                ids = keys.fill_null(0).to_numpy()
                best = [np.concatenate(x) for x in zip(best, (item, scores[item, at], ids[at], null[at]))]
                keep = _best(*best, k)
                best = [x[keep] for x in best]
                # An item with k documents takes no lower score from now on.
                full = np.flatnonzero(np.bincount(best[0], minlength=graph.items) >= k)
                lowest = np.full(graph.items, np.iinfo(np.int64).max)
                np.minimum.at(lowest, best[0], best[1])
                least[full] = lowest[full]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0]), pa.array(best[1]), pa.array(best[2], mask=best[3])], names=["item", "score", "key"]
        )

    return postings.mapInArrow(run, "item bigint, score bigint, key bigint")


def _ranked_block(docs: DataFrame, item_terms: DataFrame, key: str, text: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    graph, ids = _gathered(item_terms)
    postings = cut_lineage(term_counts(docs, key, text, graph.terms))
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    table = held.select("term", weight.alias("w")).toPandas()
    weights = np.zeros(len(graph.terms), np.int64)
    weights[table["term"].to_numpy(np.int64)] = table["w"].to_numpy(np.int64)
    found = _task_best(postings.filter(F.size("terms") > 0), graph, weights, n_docs, n_terms, k)
    order = [F.desc("score"), F.asc_nulls_last("key")]
    parts = found.withColumn("part", F.spark_partition_id() % PARTS)
    for by in (["item", "part"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        parts = parts.withColumn("rank", place).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {item_terms.schema['item'].dataType.simpleString()}")
    return parts.join(names, "item").select("item_id", "rank", F.col("key").alias(key), "score")


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """``item_id, rank, <key>, score``: each item's ``k`` documents of highest score above 0, over all documents.

    Terms are the runs of letters, digits and bytes beyond ASCII of the whole text, A-Z lower-cased. ``key`` is a long.
    """
    listed = term_counts(items, item, text).select(F.col("key").alias("item"), F.explode("terms").alias("term")).distinct()
    listed = cut_lineage(listed)
    blocks = max(1, -(-listed.count() // TERMS_AT_ONCE))
    out = None
    for b in range(blocks):
        some = listed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        found = _ranked_block(docs, some, key, text, k)
        out = found if out is None else out.unionByName(found)
    return out
