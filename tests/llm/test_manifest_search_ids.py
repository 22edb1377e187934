"""Manifest, ranked search and byte-level BPE against plain versions, and on nulls, ties, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demescope.llm import byte_pairs, lexical, merkle
from demescope.llm.queries import RANKS, tokenizer_file

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- manifest -----------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(level):
    return [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]


def siblings(levels, at):
    """Per level the siblings before and after the node at ``at`` of the lowest level."""
    out = []
    for level in levels[:-1]:
        first = at // 3 * 3
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return out


def tower(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, path digest, folded root) of (doc_id, text, lang, source, n_chars) rows."""

    def leaf(i, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    towers = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        towers[s] = tower([leaf(*r) for r in groups[s]])
    forest = tower([towers[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for k, r in enumerate(groups[s]):
            path = siblings(towers[s], k) + siblings(forest, g)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(r[0], text, *r[2:])
            for b, a in path:
                now = sha(b + now + a)
            out.append((r[0], leaf(*r), towers[s][-1][0], forest[-1][0], sha("".join(b + a for b, a in path)), now))
    return sorted(out, key=str)


def spark_manifest(df):
    own = ["doc_id", "source", "lang", "n_chars"]
    leaf = merkle.digest_of(merkle.leaf_text(*own, "text"))
    cut = merkle.digest_of(merkle.leaf_text(*own, F.replace("text", F.lit("\n"), F.lit(""))))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, cut).otherwise(leaf)
    rows = merkle.manifest(df, "source", "doc_id", leaf, {"doc_id": F.col("doc_id"), "claimed": claimed})
    found = rows.select("doc_id", "leaf", "subroot", "root", merkle.path_digest().alias("p"), merkle.folded(F.lower(F.hex("claimed"))).alias("f"))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses_fill_the_tree(levels):
    at = np.concatenate([merkle.address(levels, d, np.arange(3**d)) for d in range(levels)])
    assert sorted(at.tolist()) == list(range((3**levels - 1) // 2))


def test_addresses_keep_parts_together():
    # Seven levels are split as three above four: the part below the first node of depth three follows the top.
    assert merkle.address(7, 3, np.arange(2)).tolist() == [13, 13 + 40]
    assert sorted(merkle.address(7, 6, np.arange(27)).tolist())[-1] < 13 + 40


def test_manifest_equals_a_plain_one(spark):
    rng = random.Random(4)
    rows = []
    for source, n in ((None, 5), ("a", 1), ("b", 2201), ("ä", 3), ("Z", 28), ("", 10)):
        for _ in range(n):
            i = rng.choice([None, *range(3000)])
            rows.append((i, rng.choice([None, "", "x\ny", "plain", "é\n" * 40]), rng.choice([None, "en"]), source, rng.choice([None, 7])))
    rows += rows[:9] + rows[100:110]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as tree", "2 as slot", "3 as digest", "4 as `key`", "5 as n", "'q' as `before`", "6 as root")
    assert spark_manifest(df.repartition(5)) == plain_manifest(rows)


def test_manifest_of_groups_over_a_block(spark):
    rows = [(k, f"t{k}\n", "en", f"s{k // 2}", 1) for k in range(1600)]  # 800 groups: two blocks of roots
    assert spark_manifest(spark.createDataFrame(rows, DOC)) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(4, "a" * 300_000, None, None, None)]
    got = spark_manifest(spark.createDataFrame(one, DOC))
    assert got == plain_manifest(one) and got[0][1] == got[0][2] == got[0][3] == got[0][5]
    assert spark_manifest(spark.createDataFrame([], DOC)) == []


def test_a_changed_text_is_found(spark):
    rows = [(k, "a\nb" if k % 3 else "ab", "en", "s", 3) for k in range(60)]
    for i, _, _, root, _, folded in spark_manifest(spark.createDataFrame(rows, DOC)):
        assert (folded == root) == (zlib.crc32(str(i).encode()) % 2 != 0 or i % 3 == 0)


# --- ranked search ------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranking(docs, items, k=10):
    texts = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in docs]
    full = [w for _, w in texts if w]
    n_docs, n_terms = len(full), sum(map(len, full))
    df = {}
    for w in full:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(WORD.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, w in texts:
            m = 10 + (90 * len(w) * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m))
                for t in terms & set(w)
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as `key`", "2 as n", "'x' as terms", "0 as score", "'y' as item")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as item", "2 as term", "3 as doc_id")
    return sorted((tuple(r) for r in lexical.ranked(d.repartition(3), i, **more).collect()), key=str)


@pytest.mark.parametrize("at_once,sums", [(1 << 20, 1 << 21), (40, 500)])
def test_search_equals_a_plain_ranking(spark, monkeypatch, at_once, sums):
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "SUMS", sums)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "über", "A1", "漢字", "\x7f", "_", "it's"]
    base = [rng.choice(vocabulary) for _ in range(30)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for k in range(150)]
    docs += [(200 + k, "w1 W2 w3") for k in range(30)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, None), (7, ""), (8, "..."), (9, "w3 " * 50_000)]
    items = [(k, " ".join(base[:10] + rng.sample(vocabulary, 5))) for k in range(12)]
    items += [(20, "w1 W1 w2"), (20, "w3"), (21, None), (22, "!!"), (None, "w1 w2"), (23, "absent"), (24, " ".join(base)), (24, "ÉÜ")]
    assert search(spark, docs, items) == plain_ranking(docs, items)


def test_search_cuts_and_counts_ties(spark):
    docs = [(k, "same words here") for k in range(40, 0, -1)] + [(None, "same words here")] * 3 + [(99, "other")]
    items = [(1, "same"), (2, "here same")]
    assert search(spark, docs, items, k=3) == plain_ranking(docs, items, 3)
    few = [(1, "same"), (None, "same"), (0, "same"), (4, "other"), (5, "x"), (6, "y")]
    assert search(spark, few, items) == plain_ranking(few, items)


def test_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == search(spark, [(1, "a")], []) == search(spark, [(1, None)], [(1, "a")]) == []


def test_shared_sets_and_beginnings_are_summed_once(spark):
    items = {1: "abcd", 2: "abce", 3: "abf", 4: "abf"}
    rows = [(i, ord(t)) for i, terms in items.items() for t in terms]
    sets, chains = lexical.shared_sets(spark.createDataFrame(rows, "item bigint, term bigint"))
    assert {chr(r.term): chr(r.set_id) for r in sets.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f"}
    nodes, ends = lexical.sharing_graph(chains)
    assert sorted((r.depth, chr(r.set_id), r["items"]) for r in nodes.collect()) == [
        (1, "a", 4), (2, "c", 2), (2, "f", 2), (3, "d", 1), (3, "e", 1),
    ]
    assert {r.item: r.depth for r in ends.collect()} == {1: 3, 2: 3, 3: 2, 4: 2}


# --- byte-level BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = byte_pairs.ranks_of(tokenizer_file(RANKS))
    return ranks, PATTERN, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_ids_equal_the_library_on_every_code_point(library):
    ranks, pattern, theirs = library
    texts = [f"a{c}b 1{c}2 !{c}?  {c} {c}" for c in map(chr, range(0x3400)) if not 0xD800 <= ord(c) <= 0xDFFF]
    texts += [f"a{chr(c)} {chr(c)}{chr(c)}" for c in range(0xE000, 0x32000, 7)]
    got = byte_pairs.Encoder(ranks, pattern).texts(texts)
    assert [ids_of(x) for x in got] == [theirs.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_ids_equal_the_library(library, texts):
    ranks, pattern, theirs = library
    assert [ids_of(x) for x in byte_pairs.Encoder(ranks, pattern).texts(texts)] == [theirs.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "theinrout", "漢字かな"])
@pytest.mark.parametrize("n", [1, 2, 500, 511, 512, 513, 5000])
def test_long_pieces_equal_the_library(library, letters, n):
    ranks, pattern, theirs = library
    text = "".join(random.Random(n).choice(letters) for _ in range(n))
    assert ids_of(byte_pairs.Encoder(ranks, pattern).texts([text])[0]) == theirs.encode_ordinary(text)
    cells = ranks.single[np.frombuffer(text.encode(), np.uint8)]
    row = byte_pairs.merge_rows(ranks, cells[None, :700])[0] if n <= 500 else None
    if row is not None:
        assert row[row != byte_pairs.NONE].tolist() == byte_pairs.merge_alone(ranks, cells[:700]).tolist()


def test_forgetting_changes_nothing(library, monkeypatch):
    ranks, pattern, theirs = library
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 500)
    monkeypatch.setattr(byte_pairs, "PIECES", 7)
    encoder, rng = byte_pairs.Encoder(ranks, pattern), random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gammadelta", "δ", "\n\n"]) + str(rng.randrange(50)) for _ in range(30)) for _ in range(40)]
    for t in texts:
        assert ids_of(encoder.texts([t])[0]) == ids_of(encoder.long_text(t)) == theirs.encode_ordinary(t)


def test_tables_round_trip(spark, docs, library):
    ranks, pattern, theirs = library
    texts = ["", None, "Hello  world\n", "x" * 3000, "word é漢 " * 250_000, "<|endoftext|>", "a", "a"]
    df = docs([(k, t) for k, t in enumerate(texts)] + [(None, "null id")]).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    path = tokenizer_file(RANKS)
    back = byte_pairs.decoded(byte_pairs.encoded(df, path, pattern), path)
    assert set(back.columns) == set(df.columns)
    got = sorted(((r.doc_id, r.text, ids_of(r.ids), bytes(r.decoded)) for r in back.collect()), key=lambda r: (r[0] is None, r[0]))
    assert [(r[0], r[1]) for r in got] == [*enumerate(texts), (None, "null id")]
    for _, text, ids, plain in got:
        assert ids == theirs.encode_ordinary(text or "") and plain == (text or "").encode()
    none = byte_pairs.decoded(byte_pairs.encoded(docs([]), path, pattern), path)
    assert none.collect() == []
