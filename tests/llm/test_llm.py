import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from strandweave.llm import exchange, gif, jaccard, katz, language, mergedrop, packing, quality, substrings, tokencount, warc
from strandweave.llm.textscan import Scan, slices, text_of

SCHEMA = "doc_id long, text string, lang string, source string, uid long, row string, n_words long"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, 1, "x", 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with the operators' own names."""
    rng = random.Random(5)
    words = ["w%d" % rng.randint(0, 400) for _ in range(3000)]
    passage = " ".join("p%d" % i for i in range(60))
    texts = [None, "", "   ", "a b", "A B", " ".join(words), " ".join(words), " ".join(words[:1500] + ["new"] + words[1500:]), passage + " x y", "q " + passage, "!!! 123", "é ü x1c\x1cy " * 40, "z " * 200]
    return docs(spark, [*texts, "a b"], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, 3])


def words_of(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def test_scan_finds_words():
    texts = ["a  b\tc\n", "", "é\x1cx y", "  "]
    s = Scan(pa.array(texts))
    got = [[bytes(s.data[a:b]) for a, b in zip(s.starts[s.first[i] : s.first[i + 1]], s.ends[s.first[i] : s.first[i + 1]], strict=True)] for i in range(4)]
    assert got == [words_of(t) for t in texts]


def test_packing(spark):
    df = odd(spark)
    out = packing.pack_documents(df, capacity=64).collect()
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.sequence_id].append((r.offset, r.length))
    for places in by_doc.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 64
    tokenizer = packing.WordEncoder(packing.public_tokenizer("word_bpe_49k.json")).tokenizer
    long = next(r.text for r in df.collect() if r.doc_id == 11)
    ids = np.array([*tokenizer.encode(long, add_special_tokens=False).ids, 1], "<u4").tobytes()
    first = min((r for r in out if r.doc_id == 11), key=lambda r: r.piece)
    assert first.ids_crc32 == zlib.crc32(ids[: 4 * 64])
    assert sum(r.length for r in out if r.doc_id == 0) == 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    counts = collections.Counter(rng.randint(1, 4096) for _ in range(3000))
    plan = packing.plan(counts)
    bins = max(p[3] + (p[2] - p[1] - 1) // p[4] + 1 for p in plan)
    assert sum(p[2] - p[1] for p in plan) == 3000
    assert bins <= 1.02 * sum(n * c for n, c in counts.items()) / 4096 + 1


def test_jaccard(spark):
    df = odd(spark)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.classes_and_components(df, ["doc_id"], "doc_id").collect()}
    sets = []
    for r in df.collect():
        w = words_of(r.text, True)
        sets.append((r.doc_id, frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])))
    reach = {k: {k} for k in range(len(sets))}
    for _ in sets:
        for a in reach:
            for b in range(len(sets)):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    reach[a] |= reach[b]
    for k, (i, s) in enumerate(sets):
        assert got[i, len(s)] == min((sets[m][0] for m in reach[k] if sets[m][0] is not None), default=None), i
    assert jaccard.classes_and_components(df.limit(0), ["doc_id"], "doc_id").count() == 0


def test_partenum_signatures_meet():
    rng = np.random.default_rng(4)
    for n in (7, 12, 39, 40, 41, 150, 900):
        for _ in range(20):
            base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            k = jaccard.differences(2 * len(base), 85) // 2
            other = np.unique(np.concatenate((base[k:], rng.integers(0, 2**63, k).astype(np.uint64))))
            if jaccard.linked(base >> np.uint64(24), other >> np.uint64(24), 85):
                bounds = jaccard.bands(85, 4096)
                assert len(np.intersect1d(jaccard.signatures(base, 85, bounds), jaccard.signatures(other, 85, bounds))) or k == 0


def test_substrings(spark):
    df = odd(spark)
    rows = df.collect()
    count = collections.Counter(tuple(w[i : i + 35]) for r in rows for w in [words_of(r.text)] for i in range(len(w) - 34))
    want = collections.Counter()
    for r in rows:
        w = words_of(r.text)
        bad = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                bad[i : i + 35] = [True] * 35
        want[r.doc_id, len(w), sum(bad), hashlib.sha256(b" ".join(x for x, b in zip(w, bad, strict=True) if not b)).hexdigest()] += 1
    out = substrings.cut_repeats(df, ["doc_id"], with_text=True).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert substrings.cut_repeats(df.limit(0), ["doc_id"]).count() == 0


def test_katz(spark):
    df = odd(spark)
    out = katz.score(df).collect()
    assert len(out) == 14 and len({r.train_tokens for r in out}) == 1
    train = [r for r in df.collect() if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c = collections.Counter(x for r in train for x in [*words_of(r.text, True), None])
    total, types = sum(c.values()), len(c)
    assert out[0].train_tokens == total
    for r in out:
        t = next(d.text for d in df.collect() if d.doc_id == r.doc_id)
        tokens = [*words_of(t, True), None]
        assert r.n_tokens == len(tokens) and r.n_known == sum(c[x] > 0 for x in tokens)
        assert abs(r.base_score - sum(np.log10((c[x] + 1) / (total + types + 1)) for x in tokens)) < 1e-6
        assert r.score < 0
    assert katz.score(df.limit(0)).count() == 0


def katz_by_hand(train, tokens):
    """log10 of P(tokens): START is 0, an end None."""
    words, pairs = collections.Counter(), collections.Counter()
    for t in train:
        words.update(t)
        pairs.update(zip([0, *t[:-1]], t, strict=True))

    def factors(counts):
        n = collections.Counter(counts.values())
        return katz.discounts([0, *(n[r] for r in range(1, katz.CUT + 2))])

    cut = lambda c, d: d[c] * c if c <= katz.CUT else c - katz.LARGE
    d, dp, total = factors(words), factors(pairs), sum(words.values())
    p = {w: cut(c, d) / total for w, c in words.items()}
    left = 1 - sum(p.values())
    out = 0
    for v, w in zip([0, *tokens[:-1]], tokens, strict=True):
        after = {b: c for (a, b), c in pairs.items() if a == v and (a is not None)}
        n = sum(after.values())
        x = p.get(w, left)
        if w in after:
            x = cut(after[w], dp) / n
        elif after:
            x *= (1 - sum(cut(c, dp) for c in after.values()) / n) / (1 - sum(p[b] for b in after))
        out += np.log10(x)
    return out


def test_katz_keeps_every_word_apart(spark):
    rng = random.Random(11)
    texts = [" ".join("w%d" % min(int(rng.paretovariate(0.7)), 60 + i) for _ in range(rng.randint(0, 30))) for i in range(60)]
    df = docs(spark, texts)
    tokens = {i: [*words_of(t, True), None] for i, t in enumerate(texts)}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 0 < len(train) < len(texts)
    want = {i: katz_by_hand(train, t) for i, t in tokens.items()}
    for vocabulary in (0, 5, 60_000):
        out = katz.score(df, vocabulary=vocabulary).collect()
        assert len(out) == len(texts)
        for r in out:
            assert abs(r.score - want[r.doc_id]) < 1e-6, (vocabulary, r.doc_id)


def test_katz_tables_sum_to_one_and_score_alike(spark):
    rng = random.Random(12)
    texts = [" ".join("w%d" % min(int(rng.paretovariate(0.9)), 40 + i) for _ in range(rng.randint(0, 25))) for i in range(40)] + ["", None]
    df = docs(spark, texts)
    for vocabulary in (0, 4, 60_000):
        model, scores = katz.fit_and_score(df, vocabulary=vocabulary)
        words = {r.w: r.c for r in model.words.collect()}
        u = model.unigrams
        p = {w: float(u.p_word(np.array([c]))[0]) for w, c in words.items()}
        assert abs(sum(p.values()) + u.unseen - 1) < 1e-9
        pairs = collections.defaultdict(dict)
        for r in model.pairs().collect():
            assert r.word not in pairs[r.context]
            pairs[r.context][r.word] = 10**r.log10_c
        contexts = {r.context: r for r in model.contexts().collect()}
        assert set(contexts) == set(pairs) and sum(r.n for r in contexts.values()) == u.total
        for v, after in pairs.items():
            rest = sum(x for w, x in p.items() if w not in after) + u.unseen
            assert abs(sum(after.values()) / contexts[v].n + 10 ** contexts[v].log10_weight * rest - 1) < 1e-9
        again = {r.doc_id: (r.n_tokens, r.score) for r in model.evaluate(df).collect()}
        for r in scores.collect():
            assert again[r.doc_id][0] == r.n_tokens and abs(again[r.doc_id][1] - r.score) < 1e-9
        other = model.evaluate(docs(spark, ["never seen w1 w2", None])).collect()
        assert sorted(r.n_tokens for r in other) == [1, 5] and all(r.score < 0 for r in other)


def test_language(spark):
    rng = random.Random(1)
    vocab = {"en": ["the", "with", "and", "thing"], "de": ["der", "mit", "und", "schön"], "fr": ["le", "avec", "et", "où"]}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(30)), x) for i in range(300) for x in [rng.choice(list(vocab))]]
    rows += [(900, None, "en"), (901, "12 34", "en"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(out[i].lang_pred == x for i, _, x in rows if i < 300)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert all(r.lang_pred == "und" for r in language.identify(df.limit(0).union(df.where("lang is null"))).collect())
    codes = language.codewords(20)
    assert min((codes[a] != codes[b]).sum() for a in range(20) for b in range(a)) >= 5


def test_quality(spark):
    out = {(r.doc_id, r.n_words): r for r in quality.judge(odd(spark)).collect()}
    assert out[0, 0].base_failed and not out[0, 0].kept
    assert out[None, 200].n_repeat_words == 200 and out[None, 200].base_failed
    r = quality.judge(docs(spark, ["x y\n\nx y\nz #*\nx y"])).first()
    assert (r.n_dup_lines, r.n_symbols, r.n_words, r.word_chars) == (2, 2, 8, 9)
    assert quality.judge(odd(spark).limit(0)).count() == 0
    assert quality.keep_good(odd(spark)).columns == odd(spark).columns


def test_merge_dropout():
    path = packing.public_tokenizer("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, drop = mergedrop.MergeDropEncoder(path, 0.0), mergedrop.MergeDropEncoder(path, 0.3)
    for t in ("", "Hello  world, the rest", "日本 x\n\ny", " lead and trail  "):
        assert np.frombuffer(plain.encode(t), "<u4").tolist() == sp.encode(t)
    for t in ("Hello world " * 20, "a▁b ▁", "ǘ "):
        assert drop.decode(drop.encode(t, 5)) == t
        assert drop.encode(t, 5) == mergedrop.MergeDropEncoder(path, 0.3).encode(t, 5)
    assert drop.encode("Hello world " * 20, 5) != drop.encode("Hello world " * 20, 6)
    rng = random.Random(8)
    letters = "aeinrst" * 6 + "éß日\n▁ǘ☃😀\x01"
    units = [(v, "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))) for v in range(4) for _ in range(150)]
    for e in (plain, drop):
        assert e.ids_of_many(units) == [e.ids_of(u, v) for v, u in units]
    texts = ["", *(" ".join(u for _, u in units[i : i + 20]) for i in range(0, 600, 20)), ""]
    assert [drop.decode(x) for x in drop.encode_many(texts, list(range(len(texts))))] == texts
    assert drop.encode_many([], []) == []


def test_merge_dropout_draws_by_occurrence():
    path = packing.public_tokenizer("piece_bpe_32k.model")
    plain, drop = mergedrop.MergeDropEncoder(path, 0.0), mergedrop.MergeDropEncoder(path, 0.1)
    whole = plain.encode("a")
    assert len(whole) == 4
    n = 20_000
    one = drop.encode(" ".join(["a"] * n), 3)  # a merge each; one skipped leaves two pieces
    assert abs(len(one) // 4 / n - 1.1) < 0.01
    many = drop.encode_many(["a"] * n, list(range(n)))
    assert abs(sum(x != whole for x in many) / n - 0.1) < 0.01
    assert len(set(drop.encode_many(["international"] * 500, list(range(500))))) > 10
    texts = ["international thing\u2581 of a", "x" * 150 + " é\n日 the"]
    for k, t in enumerate(texts):
        units, keys = drop._units(t, k)
        by_agenda = [drop.literal if not u else drop.ids_of(u, x) for u, x in zip(units, np.concatenate(keys).tolist(), strict=True)]
        assert drop.encode(t, k) == b"".join(by_agenda)


def test_token_attribution(spark):
    owner, crossing = tokencount.attribute(np.array([3, 7, 8]), np.array([0, 4, 5]), 8)
    assert owner.tolist() == [0, 2, 2] and crossing == 1
    assert tokencount.attribute(np.array([4]), np.array([0, 2]), 4)[0].tolist() == [0]
    path = packing.public_tokenizer("byte_bpe_50k.tiktoken")
    for r in tokencount.count_sections(odd(spark), path).collect():
        assert sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections
    r = tokencount.count_fields(spark.createDataFrame([(1, "ab cd", None)], "k long, a string, b string"), ["a", "b"], path, "k").first()
    assert sum(r.section_tokens) == r.n_tokens


def test_gif_round_trip_and_rules(spark):
    rng = random.Random(9)
    for n in (64, 6400, 64 * 300):
        for data in (bytes(n), bytes(rng.randrange(256) for _ in range(n))):
            frames = list(gif.decode(gif.encode(data)))
            assert b"".join(f.indices.tobytes() for f in frames) == data
            assert sum(frames[0].histogram) == 3 * min(n, 64 * gif.MAX_ROWS)
    # 2 x 1 canvas, two colours; the second frame is transparent at index 0 and restores what was before
    head = b"GIF89a" + bytes((2, 0, 1, 0, 0x80, 0, 0)) + bytes((255, 0, 0, 0, 0, 255))
    image = lambda left, w, px: bytes((0x2C, left, 0, 0, 0, w, 0, 1, 0, 0, 2)) + gif._blocks(gif.lzw_encode(px, 2))
    control = lambda disposal, clear: bytes((0x21, 0xF9, 4, disposal << 2 | clear, 7, 0, 0, 0))
    data = head + control(1, 0) + image(0, 2, b"\0\1") + control(3, 1) + image(0, 2, b"\1\0") + image(1, 1, b"\0") + b"\x3b"
    a, b, c = gif.decode(data, canvases=True)
    assert a.canvas[0, :, 0].tolist() == [255, 0] and b.canvas[0, :, 2].tolist() == [255, 255] and c.canvas[0, :, 0].tolist() == [255, 255]
    assert (b.start_ms, c.start_ms) == (70, 140)
    rows = gif.frame_rows(spark.createDataFrame([(1, data), (2, b"junk"), (3, None)], "id long, body binary"), "id", "body").collect()
    assert [r.id for r in rows] == [1, 1, 1]
    out = {r.doc_id: r for r in gif.store_texts(docs(spark, [None, "x" * 64, "y" * 65])).collect()}
    assert [out[i].payload_bytes for i in range(3)] == [64, 64, 128]


def test_warc_splits(spark, tmp_path):
    rng = random.Random(3)
    bodies = [None, "", "same", "same", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 3000))) for _ in range(60))]
    pages = spark.createDataFrame([(i, f"http://x/{i}" if i % 4 else None, b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    archives = warc.write(pages, folder)
    want = {i: warc.digest((b or "").encode()) for i, b in enumerate(bodies)}
    for step in (200, 5000, 1 << 22):
        got = {r.page_id: r for r in warc.read(spark, archives, folder, step=step).collect()}
        assert {i: r.payload_digest for i, r in got.items()} == want
        assert (got[1].record_type, got[1].refers_to, got[3].refers_to, got[2].record_type) == ("revisit", 0, 2, "response")
    assert warc.write(pages.limit(0), str(tmp_path / "none")) == []


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_a_slice_of_text_takes_little_memory():
    rng = random.Random(3)
    texts = [" ".join("w%d" % rng.randint(0, 5000) for _ in range(400)) for _ in range(2000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    model = language.fit(texts[:40], ["en", "de"] * 20)

    def scan(work, *limit):
        for b in slices([batch], "text", *limit):
            work(text_of(b, "text"))

    assert sum(b.num_rows for b in slices([batch], "text")) == len(texts)
    assert peak_mb(lambda: scan(lambda x: jaccard.shingle_sets(Scan(x, lower=True), 5))) < 40
    assert peak_mb(lambda: scan(quality.text_stats)) < 40
    assert peak_mb(lambda: scan(lambda x: [model.predict(language.ngram_counts(Scan(x.slice(i, language.ROWS), lower=True))) for i in range(0, len(x), language.ROWS)], language.SLICE)) < 40


def test_pieces_of_a_range_let_go_of_its_blobs():
    rng = np.random.default_rng(4)
    made = [(np.sort(rng.integers(0, 3000, 1000)).astype(np.uint64), rng.integers(0, 9, 1000).astype(np.int32)) for _ in range(8)]
    blobs = [b for key, x in made for batch in exchange.blobs(key, [x], 1) for b in batch.column(1).to_pylist()]
    found = []
    for columns in exchange.pieces(blobs, 500, list(range(8))):
        assert not any(isinstance(b, bytes) for b in blobs)
        found.append(columns)
    keys = [c[0] for c in found]
    assert len(found) > 8 and all(set(a).isdisjoint(b) for a, b in zip(keys, keys[1:]))
    got = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found))))
    assert got == sorted((int(k), int(v), i) for i, (key, x) in enumerate(made) for k, v in zip(key, x))
