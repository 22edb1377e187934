"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import gzip
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from demescope.llm import decontaminate, jaccard_join, line_dedup, sentence_pieces, token_grammar, toxicity, transcripts, url_filter, warc
from demescope.llm.common import components, word_hashes
from demescope.llm.exact_dedup import exact_duplicates
from demescope.llm.queries import TOKENIZER, tokenizer_file
from demescope.session import scratch_path

LONG = "word " * 300_000


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "label"))
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 130)}}


def brute_jaccard(texts, n, num, den):
    sets = []
    for t in texts.values():
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    ids, group = list(texts), dict(zip(texts, texts))
    links = dict.fromkeys(ids, 0)
    for a, b in itertools.combinations(range(len(ids)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            links[ids[a]] += 1
            links[ids[b]] += 1
            lo, hi = sorted((group[ids[a]], group[ids[b]]))
            group = {k: lo if v == hi else v for k, v in group.items()}
    return sorted((i, len(s), group[i], links[i]) for i, s in zip(ids, sets))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, docs, monkeypatch, n, num):
    rng = random.Random(3)
    base = [words(rng, 120).split() for _ in range(5)]
    texts = {}
    for k in range(90):
        w = list(base[k % 5])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts[k] = " ".join(w)
    texts |= {200: None, 201: "", 202: " \n\t", 203: "one", 204: "ONE", 205: "one two", 206: LONG, 207: texts[0], 208: texts[0]}
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 7)
    df = docs(texts.items())
    got = rows(jaccard_join.similar_documents(df, n, num, 100), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == brute_jaccard(texts, n, num, 100)
    kept = jaccard_join.one_of_each_group(df, n, num)
    assert kept.columns == df.columns
    assert [r[0] for r in rows(kept, "doc_id")] == [i for i, _, c, _ in got if i == c]


def test_jaccard_join_of_nothing_and_of_null_ids(docs):
    assert jaccard_join.similar_documents(docs([])).count() == 0
    got = jaccard_join.similar_documents(docs([(None, "a b c d e f"), (1, "a b c d e f")]))
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got.collect()} == {(None, None, 0), (1, 1, 0)}


def test_derived_overlaps_equal_direct_ones():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = jaccard_join.similar_pairs(sets, 60, 100)
    want = [[a != b and 100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y)) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    assert (got == np.array(want)).all()


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_token_shards_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path, model = tokenizer(), Tokenizer.from_file(tokenizer())
    rng = random.Random(5)
    texts = {k: words(rng, 80, 30) for k in range(40)} | {50: None, 51: "", 52: "a  b\n\nc ", 53: "été 12,5\nit's", 54: LONG[:50_000]}
    out = scratch_path(spark, "shards")
    token_grammar.write_shards(docs(texts.items()), path, out, shards=3, block_tokens=2_000)
    want, start = [], 0
    for k, t in sorted(texts.items()):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_grammar.read_shards(spark, out), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_grammar_expands_whole_and_in_part():
    rng = np.random.default_rng(2)
    parts = [np.tile(rng.integers(0, 9, 12), 40) for _ in range(6)] + [np.zeros(0, int), np.full(101, 4)]
    tokens, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    g = token_grammar.repair(tokens, ends)
    assert len(g["symbols"]) < len(tokens) / 4 and (token_grammar.expand(g) == tokens).all()
    g = token_grammar.from_bytes(token_grammar.to_bytes(g))
    for k, p in enumerate(parts):
        assert (token_grammar.token_range(g, k, 0, len(p)) == p).all()
        if len(p) > 50:
            assert (token_grammar.token_range(g, k, 13, 47) == p[13:47]).all()


def test_string_tiling_finds_whole_and_reordered_passages(spark, docs):
    rng = random.Random(8)
    item = [f"q{k}" for k in range(40)]
    noise = words(rng, 300)
    texts = {
        1: noise + " " + " ".join(item) + " " + noise,
        2: " ".join(item[20:]).upper() + "; " + noise + ", " + " ".join(item[:20]),
        3: noise + " " + " ".join(item[:12]),
        4: noise,
        5: None,
        6: "",
        7: LONG + " ".join(item),
    }
    bench = spark.createDataFrame([(9, " ".join(item)), (10, "too short"), (11, None), (12, " ".join(item))], "item_id bigint, text string")
    df = docs([*texts.items(), (1, texts[1])])
    for block in (1 << 20, 100):
        got = rows(decontaminate.leaked_items(df, bench, block_bytes=block), "doc_id", "item_id", "coverage", "tiles")
        assert got == sorted((d, i, 1.0, t) for i in (9, 12) for d, t in ((1, 1), (1, 1), (2, 2), (7, 1)))
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns and [r[0] for r in rows(kept, "doc_id")] == [3, 4, 5, 6]
    assert decontaminate.leaked_items(docs([]), bench).count() == 0
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == df.count()


def test_tiles_against_a_plain_greedy_search():
    rng = random.Random(4)
    for _ in range(40):
        item = [rng.randrange(6) for _ in range(30)]
        doc = [rng.randrange(6) for _ in range(60)]
        seeds = [(i, j) for i in range(28) for j in range(58) if item[i : i + 3] == doc[j : j + 3]]
        if not seeds:
            continue
        marks, taken, lengths = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i, j in seeds:
                n = 0
                while i + n < 30 and j + n < 60 and item[i + n] == doc[j + n] and i + n not in marks and j + n not in taken:
                    n += 1
                best = max(best, (n, -i, -j))
            if best[0] < 3:
                break
            n, i, j = best[0], -best[1], -best[2]
            marks |= set(range(i, i + n))
            taken |= set(range(j, j + n))
            lengths.append(n)
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert got == (len(marks), len(lengths), max(lengths))


def test_tiling_of_one_repeated_word_in_bounded_memory():
    n = 1_000_000
    texts = pa.array(["same " * n, "same " * 300 + "other " + "same " * 500, "left right " * (n // 2), "one two three four"])
    items = decontaminate.Items([(1, "same " * 400), (2, "left right " * 50), (3, "same " * 200 + "gap " + "same " * 199)], 5)
    tracemalloc.start()
    got = decontaminate._matches(items, texts, 5, 0.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = [[(g["item_id"], g["tiles"], g["longest"], round(g["coverage"], 4)) for g in one] for one in got]
    assert found == [[(1, 1, 400, 1.0), (3, 2, 200, 0.9975)], [(1, 1, 400, 1.0), (3, 2, 200, 0.9975)], [(2, 1, 100, 1.0)], []]
    assert peak < 400 << 20


def test_url_rules_and_models(spark):
    urls = ["https://A.Example.org/es/1", "http://example.org/en/1x", "http://x.org/", "x.org/", None, "", "ftp://com/fr/?q", "http://a.com/de/#x", "://h", "http://notexample.org/es/"]
    urls += [f"http://good{k}.net/news/{k}" for k in range(30)] + [f"http://a.com/fr/news/{k}" for k in range(30)] + [f"http://b.com/de/spam-{k}-casino" for k in range(30)] + ["http://z.net/spam-1-casino"] * 3
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'h' as host", "1 as n", "2 as w")
    got = {r["page_id"]: r for r in url_filter.judged_urls(df).collect()}
    assert len(got) == len(urls)
    first = [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(10)]
    assert first == [
        ("a.example.org", "/es/1", "example.org/es/"),
        ("example.org", "/en/1x", "example.org/en/1"),
        ("x.org", "/", "org/"),
        ("", "", None),
        ("", "", None),
        ("", "", None),
        ("com", "/fr/", "com/fr/"),
        ("a.com", "/de/", "com/de/"),
        ("h", "", None),
        ("notexample.org", "/es/", "org/"),
    ]
    assert [got[k]["verdict"] for k in (0, 1, 2, 6, 7)] == ["block", "block", "allow", "allow", "block"]
    good, spam = [got[10 + k]["score"] for k in range(30)], got[len(urls) - 1]
    assert min(good) > 0 > spam["score"] and spam["verdict"] == "block"
    assert url_filter.judged_urls(df.limit(0)).count() == 0


def test_exact_duplicates(docs):
    texts = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\n\nb "), (5, None), (6, " \t"), (7, ""), (8, "é b"), (9, LONG), (10, LONG), (0, "x b")]
    got = rows(exact_duplicates(docs(texts)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    assert got == want and exact_duplicates(docs([])).count() == 0


def test_exactly_one_row_of_equal_texts_stays(docs):
    texts = [(None, "x y"), (1, "xy"), (2, "x y"), (6, "a b"), (6, "ab"), (None, None), (None, ""), (None, "z"), (7, "q"), (7, "q"), (7, "q")]
    got = rows(exact_duplicates(docs(texts).repartition(3)), "text_sha256", "keep_id", "group_size", "kept")
    by = {}
    for sha, keep, size, kept in got:
        by.setdefault(sha, []).append((keep, size, kept))
    name = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("xy", "ab", "", "z", "q")}
    assert all(sum(k for _, _, k in group) == 1 and {s for _, s, _ in group} == {len(group)} for group in by.values())
    assert {t: by[name[t]][0][0] for t in name} == {"xy": 2, "ab": 6, "": None, "z": None, "q": 7}


def turns_of(spark, n=60):
    rng = random.Random(6)
    data = []
    for c in range(n):
        for t in range(rng.randrange(2, 9)):
            role = "user" if t % 2 == 0 else "assistant"
            text = words(rng, 8) + "?" if role == "user" else "\n".join(words(rng, 60) for _ in range(3))
            data.append((c, t, role, text))
    return spark.createDataFrame([*data, (None, 0, "user", None), (n, 0, None, "x")], "conv_id bigint, turn bigint, role string, text string")


def test_transcript_roles(spark):
    turns = turns_of(spark)
    raw = transcripts.raw_transcripts(turns)
    model = transcripts.fit(raw.join(turns.selectExpr("conv_id", "turn as part", "role"), ["conv_id", "part"]), order="part")
    got = transcripts.rendered(raw.selectExpr("*", "1 as at", "2 as block"), model)
    assert got.count() == turns.count()
    joined = got.join(turns.selectExpr("conv_id", "turn as part", "role"), ["conv_id", "part"]).collect()
    right = [x == r["role"] for r in joined if r["role"] for x in r["roles"]]
    assert sum(right) / len(right) > 0.95
    first = next(r for r in joined if r["conv_id"] == 3 and r["part"] == 0)
    assert first["text"].startswith("<|im_start|>user\n")
    assert transcripts.rendered(raw.limit(0), model).count() == 0


def test_blocks_give_the_viterbi_path(spark):
    rng = np.random.default_rng(3)
    lp = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), s[:-1]))
    model = transcripts.Model(lp(transcripts.STATES), lp(transcripts.STATES, transcripts.STATES), lp(transcripts.STATES, transcripts.FEATURES))
    parts = [(k, at, rng.integers(0, transcripts.FEATURES, rng.integers(1, 4)).tolist()) for k in "ab" for at in range(23)]
    df = spark.createDataFrame(parts, "key string, at bigint, features array<int>")
    got = {(r["key"], r["at"]): list(r["states"]) for r in transcripts.line_states(df, model, parts_per_block=4).collect()}
    for k in "ab":
        features = np.concatenate([f for key, _, f in parts if key == k])
        assert [s for at in range(23) for s in got[k, at]] == transcripts.viterbi(model, features, None, None).tolist()


def test_toxicity_learns_and_holds_out(spark, docs):
    rng = random.Random(7)
    texts, labels = [], []
    for k in range(400):
        w = words(rng, rng.randrange(5, 150), 60).split()
        if k % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty"]))
        texts.append((k, " ".join(w)))
        labels.append((k, int(k % 3 == 0)))
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    df = docs([*texts, (900, None), (901, ""), (902, LONG[:200_000] + "vile nasty vile")])
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, marks).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [got[k]["predicted"] == y for k, y in labels if got[k]["held_out"]]
    assert sum(held) / len(held) > 0.9 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["score"] == got[901]["score"] and got[902]["predicted"] == 1
    kept = toxicity.without_toxic(df, marks)
    assert kept.columns == df.columns and {r[0] for r in rows(kept, "doc_id")} == {k for k, r in got.items() if r["score"] < 0.5}
    assert {r["score"] for r in toxicity.toxicity(df, marks.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs([]), marks).count() == 0


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.arange(3, dtype=np.uint64), 1)
    x = rng.normal(size=(6, 4, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    mask = np.ones((6, 4), np.float32)
    mask[4:, 1] = 0
    y = np.array([0, 1, 1, 0], np.float32)
    g, d_x = net.gradients(x, mask, y)

    def loss():
        logit = net.logits(x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"], mask).astype(float)
        return np.mean(np.log1p(np.exp((1 - 2 * y) * logit)))

    for value, grad in [(net.p[k], g[k]) for k in ("Wf", "Ub", "Vf", "A", "v", "o", "cb")] + [(x, d_x)]:
        at = tuple(0 for _ in value.shape)
        old = value[at]
        value[at] = old + 1e-2
        up = loss()
        value[at] = old - 1e-2
        down = loss()
        value[at] = old
        assert np.reshape(grad, value.shape)[at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=2e-5)


def test_windows_cover_every_word():
    row, begin, length = toxicity.windows_of(np.array([0, 5, 32, 33, 100]))
    covered = {k for b, n in zip(begin, length, strict=True) for k in range(b, b + n)}
    assert covered == set(range(170)) and set(row.tolist()) == {1, 2, 3, 4}


def test_lines_by_site(spark, docs):
    pages = [(k, f"page {k}\nshared\n\nown {k}") for k in range(8)] + [(20, None), (21, ""), (22, "shared"), (23, "copy\ncopy"), (24, "copy\ncopy"), (25, LONG)]
    df = docs(pages).union(docs([(40, "shared\nother")], source=None))
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.without_boilerplate(df, ratio=0.3).collect()}
    assert len(got) == len(pages) + 1
    assert got[3] == ("page 3\n\nown 3", 1) and got[22] == ("", 1) and got[23] == ("copy\ncopy", 0)
    assert got[20] == ("", 0) and got[25] == (LONG, 0) and got[40] == ("shared\nother", 0)
    assert line_dedup.without_boilerplate(docs([])).count() == 0


def test_lines_of_a_small_site_and_of_tables_with_clashing_names(docs):
    df = docs([(k, f"own {k}\nshared") for k in range(4)] + [(9, "lone\nlone")])
    for name in ("key", "joint", "drop", "lines", "kept", "_key", "_k", "_drop", "_lines", "_kept", "host", "line", "page"):
        df = df.selectExpr("*", f"'{name}' as {name}")
    got = {r["doc_id"]: (r["text"], r["kept"], r["_drop"]) for r in line_dedup.without_boilerplate(df).collect()}
    assert got == {**{k: (f"own {k}", "kept", "_drop") for k in range(4)}, 9: ("lone\nlone", "kept", "_drop")}


def test_pages_through_both_archives(spark):
    big = "<p>é" + "x" * 1000
    pages = [(1, "http://a/1", big), (2, "http://a 2", big), (3, None, big), (4, "http://b", "same"), (5, "http://b", "same"), (6, "", None), (7, "http://c", "a\r\n\r\nWARC/1.1\r\nb" + big), (None, "http://d", "y")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 as bytes", "'z' as uri")
    got = {r["page_id"]: r for r in warc.archived_pages(df).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        raw = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3)}
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_arc_versions_and_damage():
    one = b"filedesc://x 0.0.0.0 20200101000000 text/plain 76\n1 0 me\nURL IP-address Archive-date Content-type Archive-length\n"
    about = b"1 0 me\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://x 0.0.0.0 20200101000000 text/plain %d\n" % len(about) + about + b"\n"
    body = b"HTTP/1.1 200 OK\r\n\r\nhi\nthere"
    one += b"http://h/a b 1.2.3.4 20200102030405 text/html %d\n" % len(body) + body + b"\n"
    (record,) = warc.parse_arc(gzip.compress(one))
    assert (record["uri"], record["version"], record["body"]) == ("http://h/a b", 1, body)
    about = b"2 0 me\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://x 0.0.0.0 20200101000000 text/plain 200 - - 0 x %d\n" % len(about) + about + b"\n"
    two += b"http://h/ 1.2.3.4 20200102030405 text/html 200 - - 99 x 2\nhi\n"
    (record,) = warc.parse_arc(two)
    assert (record["version"], record["mime"], record["body"]) == (2, "text/html", b"hi")
    with pytest.raises(ValueError):
        list(warc.parse_arc(one.replace(b" %d\nHTTP" % len(body), b" 999\nHTTP")))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"no archive\n"))


def piece_model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_best_segmentations_equal_dynamic_programming():
    coder = sentence_pieces.Pieces(piece_model(), 4)

    def plain(text):
        full = sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK)
        best = [[0.0]]
        for e in range(1, len(full) + 1):
            sums = []
            for b in range(max(0, e - 20), e):
                p = full[b:e]
                s = coder.scores.get(p, coder.low * len(p.encode()) if e == b + 1 else None)
                if s is not None:
                    sums += [x + s for x in best[b]]
            best.append(sorted(sums, reverse=True)[:4])
        return best[-1]

    for text in ["hello world", "a  b", " lead", "tail ", "x\ny z", "\n\nx", " ", "日本 é", "aaaaaaaa", "a \n b", "\t"]:
        ((ids, score, best),) = coder([text])
        assert best == plain(text) and score == best[0] and coder.decode(ids).decode() == text
    ranked = coder.segmentations("▁unbelievable", 6)
    assert len({ids for _, ids in ranked}) == 6 and [s for s, _ in ranked] == sorted((s for s, _ in ranked), reverse=True)


def test_searches_in_step_equal_single_ones():
    coder, rng = sentence_pieces.Pieces(piece_model(), 3), random.Random(5)
    units = ["▁", "▁▁▁▁", "▁日本語😀x", "😀", "\n", "ÿþ", "a" * 40, "▁" * 60, "▁" + "ab" * 40, "x" * 300]
    units += sorted({"▁" + "".join(rng.choices("aeiounrst,.é", k=rng.randrange(1, 14))) for _ in range(400)})
    coder.learn(units)
    for u in units:
        (score, ids), *others = coder.segmentations(u)
        at = coder.codes[u]
        assert tuple(coder.flat[coder.starts[at] :][: coder.sizes[at]].tolist()) == ids and coder.score[at] == score
        assert coder.gaps[at].tolist() == [0.0, *(score - s for s, _ in others), *[np.inf] * (2 - len(others))]


def test_encoding_round_trips(docs):
    texts = {1: None, 2: "", 3: "▁ x▁y", 4: "a\nb", 5: LONG[:300_000], 6: "a\nb", 7: "\u0000 nul"}
    got = {r["doc_id"]: r for r in sentence_pieces.encoded(docs(texts.items()), piece_model()).collect()}
    assert all(r["round_trip"] for r in got.values()) and len(got) == 7
    assert got[1]["n_tokens"] == 0 and got[4]["ids"] == got[6]["ids"]
    assert got[4]["ids_crc32"] == zlib.crc32(np.array(got[4]["ids"], "<u4").tobytes())
    assert sentence_pieces.encoded(docs([]), piece_model()).count() == 0


def test_encoder_equals_the_library_around_white_space():
    encode = token_grammar.Encoder(tokenizer_file(TOKENIZER))
    texts = ["a  b", "a \n b", "\n", "\t", "\ta b", "a\tb c", "a \tb", " x y", "x y z", " a", "a ", "a\n", "\na", "a\nb", "a\n\nb", "a\r\nb", "a b, c.\nd", "　", "a \x1cb", "a\n\tb", "a \t", "", "<|endoftext|> a"]
    for _ in range(2):  # pieces met before and pieces that are new
        for text, got in zip(texts, encode(texts), strict=True):
            assert got.tolist() == encode.model.encode(text, add_special_tokens=False).ids, repr(text)


PROSE = ["hello the internationalization of the world", "the world of the hello", "say hello\n  to the world ", "international standards", "x▁y\n\nworld 日本"]


def test_piece_logs_equal_counts_by_hand(docs):
    rows = [(k, t) for k, t in enumerate([*PROSE, None, "", *PROSE[:2]])]
    coder = sentence_pieces.Pieces(piece_model(), 1)
    texts = [t.replace("▁", "") for _, t in rows if t]
    size = coder.model.get_piece_size()
    library = np.bincount([i for t in texts for i in coder.model.encode(t)], minlength=size)
    first = sentence_pieces.smoothed_logs(library)
    assert np.array_equal(sentence_pieces.piece_logs(docs(rows), piece_model(), rounds=0), first)
    second = sentence_pieces.Pieces(piece_model(), 1, first)
    again = np.bincount([i for t in texts for i in second([t]).__next__()[0]], minlength=size)
    logs = sentence_pieces.piece_logs(docs(rows), piece_model())
    assert np.array_equal(logs, sentence_pieces.smoothed_logs(again))
    assert np.array_equal(logs, sentence_pieces.piece_logs(docs(rows).repartition(5), piece_model()))
    assert len(set(sentence_pieces.piece_logs(docs([(1, None), (2, "")]), piece_model()))) == 1
    best = sentence_pieces.Pieces(piece_model(), 1, logs)
    for word in {w for t in texts for w in t.split()}:
        ((ids, _, _),) = best([word])
        assert len(ids) <= len(coder.model.encode(word)), word
    assert [best.model.id_to_piece(int(i)) for i in next(best(["the hello"]))[0]] == ["▁the", "▁hell", "o"]


def test_every_segmentation_of_the_best_comes_out(docs):
    rng = random.Random(9)
    logs = sentence_pieces.piece_logs(docs(enumerate(PROSE)), piece_model()) - np.random.default_rng(3).random(32_000)  # no ties
    coder = sentence_pieces.Pieces(piece_model(), 3, logs)
    units = ["▁", "▁日本語😀x", "▁" * 60, "▁" + "ab" * 40] + sorted({"▁" + "".join(rng.choices("aeinrst.é", k=rng.randrange(1, 12))) for _ in range(200)})
    coder.learn(units)
    for u in units:
        at = coder.codes[u]
        got = [tuple(coder.flat[b : b + n].tolist()) for b, n in zip(coder.begins[at], coder.counts[at], strict=True) if n]
        assert got == [ids for _, ids in coder.segmentations(u)]

    def plain(text):
        full = sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK)
        best = [[(0.0, ())]]
        for e in range(1, len(full) + 1):
            ways = []
            for b in range(max(0, e - 20), e):
                p = full[b:e]
                own = p in coder.scores
                if own or e == b + 1:
                    s, i = (coder.scores[p], (coder.ids[p],)) if own else (coder.low * len(p.encode()), tuple(coder.byte[x] for x in p.encode()))
                    ways += [(x + s, ids + i) for x, ids in best[b]]
            best.append(sorted(ways, reverse=True)[:8])
        return best[-1]

    texts = dict(enumerate(["hello world", "a  b", " lead", "x\ny z", "日本 é", "aaaaaaaa bbb unbelievable", "", None, "k"]))
    got = {r["doc_id"]: r for r in sentence_pieces.encoded(docs(texts.items()), piece_model(), logs=logs).collect()}
    for k, text in texts.items():
        want = {ids: s for s, ids in plain(text)} if text else {(): 0.0}
        nbest = got[k]["nbest"]
        assert [n["score"] for n in nbest] == got[k]["nbest_scores"] == pytest.approx(sorted(want.values(), reverse=True)[:3])
        assert nbest[0]["ids"] == got[k]["ids"] and len({tuple(n["ids"]) for n in nbest}) == len(nbest)
        for n in nbest:
            assert n["score"] == pytest.approx(want[tuple(n["ids"])]) and n["round_trip"] and n["n_tokens"] == len(n["ids"])
            assert n["ids_crc32"] == zlib.crc32(np.array(n["ids"], "<u4").tobytes())
    assert len(got[0]["nbest"]) == 3
    brief = sentence_pieces.encoded(docs(texts.items()), piece_model(), ids=False, logs=logs)
    assert {r["doc_id"]: [n["ids_crc32"] for n in r["nbest"]] for r in brief.collect()} == {k: [n["ids_crc32"] for n in r["nbest"]] for k, r in got.items()}


def test_every_part_of_a_transcript_comes_out(spark):
    turns = turns_of(spark)
    raw = transcripts.raw_transcripts(turns)
    model = transcripts.fit(raw.join(turns.selectExpr("conv_id", "turn as part", "role"), ["conv_id", "part"]), order="part")
    parts = [("a", 1, "Assistant: one"), ("a", 1, "Assistant: another, longer one"), ("a", 0, "User: why?"), ("a", None, "last"), ("a", 2, "same"), ("a", 2, "same")]
    parts += [(None, k % 2, f"User: lone {k}?") for k in range(9)] + [(None, None, "User: lone?"), (None, 0, "User: lone 0?"), ("null", 0, "User: named null?"), ("null", 1, None)]
    got = transcripts.rendered(spark.createDataFrame(parts, "conv_id string, part bigint, text string"), model).collect()
    order = lambda x: (x[0] or "", x[0] is None, x[1] is None, x[1] or 0)
    assert sorted(((r["conv_id"], r["part"]) for r in got), key=order) == sorted((p[:2] for p in parts), key=order)
    bare = lambda t: re.sub(r"<\|im_(start\|>\w+|end\|>)\n?", "", t).strip("\n")
    said = lambda t: (t or "").removeprefix("User: ").removeprefix("Assistant: ")
    assert sorted(bare(r["text"]) for r in got) == sorted(said(t) for _, _, t in parts)
    for r in got:
        if r["conv_id"] is None:
            assert r["text"].startswith("<|im_start|>") and r["text"].endswith("<|im_end|>") and r["text"].count("<|im_") == 2
    named = [r for r in got if r["conv_id"] == "a"]
    assert [bare(r["text"]) for r in named if r["text"].endswith("\n<|im_end|>")] == ["last"]
    assert sum(r["text"].startswith("<|im_start|>") for r in named) == 1


def test_encoder_equals_the_library_at_added_tokens():
    from tokenizers import Tokenizer

    encode, library = token_grammar.Encoder(tokenizer_file(TOKENIZER)), Tokenizer.from_file(tokenizer_file(TOKENIZER))
    texts = ["x <|endoftext|> a", "<|endoftext|>", "a<|endoftext|>b c", "a <|endoftext|>\nb", "<|endoftext|><|endoftext|> x", "a <|endoftext| b", "a b\nc d", "x  y <|endoftext|>"]
    assert encode(texts[:1])[0].tolist() == [87, 220, 50256, 257]
    for _ in range(2):
        for text, got in zip(texts, encode(texts), strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("first", [None, 3])
def test_archives_of_two_partitions_that_start_alike(spark, first):
    same, other = "s" * 2000, "o" * 2000
    parts = [[(first, "http://a", same), (8, "http://b", "x")], [(first, "http://a", other), (9, "http://c", same)], [(first, "http://a", same)]]
    dealt = spark.sparkContext.parallelize(parts, 3).flatMap(lambda p: p)
    df = spark.createDataFrame(dealt, "page_id bigint, url string, html string")
    names = [r["name"] for r in warc.arc_archives(df).collect()]
    assert len(names) == len(set(names)) == 3
    got = [tuple(r) for r in warc.archived_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(first, 2000, sha(same), "revisit", 9)] * 2 + [(first, 2000, sha(other), "response", None), (8, 1, sha("x"), "response", None), (9, 2000, sha(same), "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_full_encoder_keeps_the_pieces_used_most():
    encode = token_grammar.Encoder(tokenizer_file(TOKENIZER))
    encode.PIECES = 200
    encode.learn = lambda new, learn=encode.learn: (met.update(new), learn(new))
    met: set[str] = set()
    for k in range(20):
        texts = ["first often,used words " * 5 + " ".join(f"rare{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)) + " end"]
        met.clear()
        assert [x.tolist() for x in encode(texts)] == [x.tolist() for x in encode.whole(texts)]
        assert k == 0 or not {"words", "often,used", "\tfirst"} & met
        assert len(encode.codes) < 400


def test_encoder_equals_the_library_on_letters_and_signs():
    encode = token_grammar.Encoder(tokenizer_file(TOKENIZER))
    dealt = random.Random(5)
    odd = [chr(c) for c in (*range(0xA1, 0x250), 0x3B1, 0x416, 0x5D0, 0x4E2D, 0x301, 0x120, 0x10A, 0xAD, 0x1F600, 0x2028)]
    word = lambda: "".join(dealt.choice("as,.'-7|Ġ" * 9 + "".join(odd)) for _ in range(dealt.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(dealt.randrange(1, 9))) for _ in range(3000)]
    assert [x.tolist() for x in encode(texts)] == [x.tolist() for x in encode.whole(texts)]


def test_full_segmenter_keeps_the_units_met_most():
    path = tokenizer_file("piece_bpe_32k.model")
    small, large = sentence_pieces.Pieces(path, 3), sentence_pieces.Pieces(path, 3)
    small.HELD = 60_000
    small.learn = lambda new, learn=small.learn: (met.update(new), learn(new))
    met: set[str] = set()
    for k in range(12):
        texts = ["often used words " * 5 + " ".join(f"rare{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)), "a▁b often", ""]
        met.clear()
        got, want = ([[(s, x.tolist()) for s, x in r] for r in p.ranked(texts)] for p in (small, large))
        assert got == want
        assert k == 0 or not {"▁often", "▁used", "▁words"} & met
    assert len(small.codes) < len(large.codes) / 2


def test_word_hashes_take_little_memory_at_a_time():
    words = [f"word{i % 997}" for i in range(400_000)]
    column = pa.array([" ".join(words[i : i + 200]) for i in range(0, len(words), 200)] + [" ".join(words[:150_000])])
    one = {w: word_hashes(pa.array([w])) for w in words[:997]}
    one = {w: int(next(h)[1][0]) for w, h in one.items()}
    rows, got, most = 0, [], 0
    tracemalloc.start()
    for _, hashes, counts in word_hashes(column):
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.reset_peak()
        rows += len(counts)
        got.append(hashes[:: max(1, len(hashes) // 50)])
        last = hashes
    tracemalloc.stop()
    assert rows == len(column) and last.tolist() == [one[w] for w in words[:150_000]]
    assert set(np.concatenate(got).tolist()) <= set(one.values())
    assert most < 30e6
