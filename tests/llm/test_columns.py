"""The queries' columns against plain versions of what they are to hold."""

import collections
import hashlib
import base64
import random
import zlib

import numpy as np
import pytest

from strandweave.llm import gif, language, mergedrop, packing, tokencount, warc
from tests.llm.test_llm import SCHEMA, odd


def table(spark, tmp_path, name, df):
    df.coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_packing_every_column(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    rng = random.Random(4)
    df = odd(spark).union(spark.createDataFrame([(100 + i, " ".join(rng.choice(("alpha", "beta", "x9", "don't")) for _ in range(rng.randint(0, 6000))), None, None, 1, "", 2) for i in range(12)], SCHEMA))
    out = packing.op1_best_fit_packing(spark, table(spark, tmp_path, "documents", df)).collect()
    want = collections.Counter()
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for i, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, i, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
        assert sum(n > 4096 // 3 for _, n in places) <= 2
    total = sum(k[3] * n for k, n in want.items())
    large = sum(n for k, n in want.items() if k[3] > 2048)
    assert len(sequences) <= max(-(-total // 4096), large) + 1
    assert packing.op1_best_fit_packing(spark, table(spark, tmp_path / "none", "documents", df.limit(0))).count() == 0


def test_merge_dropout_every_column(spark, tmp_path):
    df = odd(spark).drop("row")
    path = packing.public_tokenizer("piece_bpe_32k.model")
    encoder = mergedrop.MergeDropEncoder(path, mergedrop.DROPOUT)
    got = collections.Counter((r.doc_id, r.n_ids, r.ids_crc32, r.decoded_sha256, r.lossless) for r in mergedrop.op5_merge_dropout(spark, table(spark, tmp_path, "documents", df)).collect())
    want = collections.Counter()
    for r in df.collect():
        t = r.text or ""
        key = r.doc_id if r.doc_id is not None else __import__("xxhash").xxh64_intdigest("None")
        units, keys = encoder._units(t, key)  # each unit through its own agenda, one after the other
        ids = b"".join(encoder.literal if not u else encoder.ids_of(u, x) for u, x in zip(units, np.concatenate(keys).tolist() if len(keys) else [], strict=True))
        want[r.doc_id, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(t.encode()).hexdigest(), True] += 1
    assert got == want
    assert mergedrop.op5_merge_dropout(spark, table(spark, tmp_path / "none", "documents", df.limit(0))).count() == 0


def by_hand(sizes, bounds, rule):
    """Owner of each token, by looking at every byte."""
    section = [s for s, (a, b) in enumerate(zip(bounds, bounds[1:])) for _ in range(b - a)]
    out, at, crossing = [], 0, 0
    for n in sizes:
        held = collections.Counter(section[at : at + n])
        crossing += len(held) > 1
        out.append(section[at] if rule == "first" else min(held, key=lambda s: (-held[s], s)))
        at += n
    return out, crossing


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts_every_column(spark, tmp_path, rule):
    path = packing.public_tokenizer("byte_bpe_50k.tiktoken")
    encoder, sizes = tokencount.encoding(path)
    df = odd(spark).union(spark.createDataFrame([(50, "one\n\n\n two\n  three\nfour \n", None, None, 1, "", 2), (51, "\n\n", None, None, 1, "", 2)], SCHEMA))
    got = {(r.doc_id, r.n_tokens, r.n_sections, r.n_crossing, tuple(r.section_tokens)) for r in tokencount.count_sections(df, path, rule=rule).collect()}
    want, digests = set(), collections.Counter()
    for r in df.collect():
        body = (r.text or "").encode()
        ids = encoder.encode_ordinary(r.text or "")
        lines = [x for x in body.split(b"\n")]
        ends = np.cumsum([len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] else []), dtype=int).tolist()
        bounds = [0, *ends]
        owner, crossing = by_hand([int(sizes[i]) for i in ids], bounds, rule)
        each = [owner.count(s) for s in range(len(bounds) - 1)] if ids else []
        want.add((r.doc_id, len(ids), len(each), crossing, tuple(each)))
        digests[r.doc_id, len(ids), len(each), crossing, max(each, default=0), zlib.crc32(",".join(map(str, each)).encode())] += 1
    assert got == want
    if rule == "largest":
        folder = table(spark, tmp_path, "documents", df)
        assert collections.Counter(rows_of(tokencount.op8_token_counts(spark, folder))) == digests
        assert tokencount.op8_token_counts(spark, table(spark, tmp_path / "none", "documents", df.limit(0))).count() == 0


def test_fields_are_attributed_by_hand(spark):
    path = packing.public_tokenizer("byte_bpe_50k.tiktoken")
    encoder, sizes = tokencount.encoding(path)
    rows = [(1, "ab cd", None, "x"), (2, "", "", ""), (3, None, "é", "  y  "), (3, None, "é", "  y  ")]
    got = sorted((r.k, r.n_tokens, r.n_crossing, tuple(r.section_tokens)) for r in tokencount.count_fields(spark.createDataFrame(rows, "k long, a string, b string, c string"), ["a", "b", "c"], path, "k").collect())
    want = []
    for k, *fields in rows:
        text = "\n".join(f or "" for f in fields)
        n = [len((f or "").encode()) + 1 for f in fields]
        n[-1] -= 1
        ids = encoder.encode_ordinary(text)
        owner, crossing = by_hand([int(sizes[i]) for i in ids], [0, *np.cumsum(n).tolist()], "largest")
        want.append((k, len(ids), crossing, tuple(owner.count(s) for s in range(3))))
    assert got == sorted(want)


def shown(payload, rows):
    """What the frames of a payload show: palettes in turn, disposal 1, 2, 3 in turn, odd frames see-through at their first sample."""
    frames = [payload[i : i + 64 * rows] for i in range(0, len(payload), 64 * rows)]
    one = [((i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85) for i in range(256)]
    canvas = [None] * len(frames[0])
    sums = np.zeros(12, int)
    for k, f in enumerate(frames):
        before = list(canvas)
        for i, x in enumerate(f):
            if not (k % 2 and x == f[0]):
                r, g, b = one[x]
                canvas[i] = (g, b, r) if k % 2 else (r, g, b)
        for c in canvas:
            if c is not None:
                for channel, v in enumerate(c):
                    sums[4 * channel + (v >> 6)] += 1
        if k % 3 == 1:
            canvas[: len(f)] = [None] * len(f)
        elif k % 3 == 2:
            canvas = before
    return "gif:" + ",".join(map(str, sums))


def test_media_every_column(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    df = odd(spark).union(spark.createDataFrame([(70, "".join(rng.choice("abcdefgh \n") for _ in range(64 * 1024 * 4 + 77)), None, None, 1, "", 2), (71, "q" * 64, None, None, 1, "", 2)], SCHEMA))
    out = collections.Counter(tuple(r)[:8] for r in gif.op9_gif_media(spark, table(spark, tmp_path, "documents", df)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "frames", "duration_ms").collect())
    want = collections.Counter()
    for r in df.collect():
        body = (r.text or "").encode()
        payload = body + bytes(-len(body) % 64 if body else 64)
        frames = -(-len(payload) // (64 * gif.MAX_ROWS))
        want[r.doc_id, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), shown(payload, gif.MAX_ROWS), frames, 100 * frames] += 1
    assert out == want
    stored = {r.doc_id: r for r in gif.store_texts(df).collect()}
    assert stored[5].media_sha256 == stored[6].media_sha256 == hashlib.sha256(gif.encode(next(r.text for r in df.collect() if r.doc_id == 5).encode() + bytes(-len(next(r.text for r in df.collect() if r.doc_id == 5).encode()) % 64))).hexdigest()
    small = bytes(rng.randrange(7) for _ in range(64 * 30))
    assert sum(np.array(f.histogram) for f in gif.decode(gif.encode(small, rows=4))).tolist() == [int(x) for x in shown(small, 4)[4:].split(",")]
    assert gif.op9_gif_media(spark, table(spark, tmp_path / "none", "documents", df.limit(0))).count() == 0


def test_interlaced_gif():
    rows = [bytes([y] * 3) for y in range(11)]
    order = [*range(0, 11, 8), *range(4, 11, 8), *range(2, 11, 4), *range(1, 11, 2)]
    head = b"GIF89a" + bytes((3, 0, 11, 0, 0xB3, 0, 0)) + bytes(range(48))
    data = head + bytes((0x2C, 0, 0, 0, 0, 3, 0, 11, 0, 0x40, 4)) + gif._blocks(gif.lzw_encode(b"".join(rows[y] for y in order), 4)) + b"\x3b"
    assert next(gif.decode(data)).indices[:, 0].tolist() == list(range(11))


def test_warc_every_column(spark, tmp_path):
    rng = random.Random(6)
    bodies = [None, "", "same", "same", "é" * 40, "same", *("".join(rng.choice("ab\r\n") for _ in range(rng.randint(1, 400))) for _ in range(30))]
    pages = spark.createDataFrame([(i, f"http://x/{i}" if i % 4 else None, b, "extra", 1) for i, b in enumerate(bodies)], "page_id long, url string, html string, record_type string, k long")
    got = collections.Counter(rows_of(warc.op10_warc(spark, table(spark, tmp_path, "pages", pages))))
    first = {}
    for i, b in enumerate(bodies):
        first.setdefault(b or "", i)
    want = collections.Counter()
    for i, b in enumerate(bodies):
        body = (b or "").encode()
        own = first[b or ""] == i
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first[b or ""]] += 1
    assert got == want
    assert warc.op10_warc(spark, table(spark, tmp_path / "none", "pages", pages.limit(0))).count() == 0


def test_warc_null_and_repeated_keys_do_not_depend_on_tasks(spark, tmp_path):
    rows = [(None, "x"), (None, "x"), (None, "y"), (7, "y"), (7, "y"), (8, "y"), (3, "z"), (3, "z")]
    seen = []
    for n in (1, 5):
        pages = spark.createDataFrame([(k, None, h) for k, h in rows], "page_id long, url string, html string").repartition(n)
        folder = str(tmp_path / f"w{n}")
        back = warc.read(spark, warc.write(pages, folder), folder).collect()
        seen.append(sorted((str(r.page_id), r.payload_digest, r.record_type, r.refers_to) for r in back))
    assert seen[0] == seen[1]
    kinds = collections.Counter((r[0], r[2], r[3]) for r in seen[0])
    assert kinds == {("None", "response", None): 2, ("None", "revisit", 7): 1, ("7", "response", None): 2, ("8", "revisit", 7): 1, ("3", "response", None): 2}


def test_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "w")
    (path, size), *_ = warc.write(pages, folder)
    whole = warc.read(spark, [(path, size)], folder).collect()
    places = sorted(r.position for r in whole)
    data = bytearray(open(path, "rb").read())
    data[places[6] - 6] ^= 0xFF  # the checksum of a member
    data[places[9] : places[9] + 4] = b"junk"  # no member any more
    data = data[: places[31] - 9]  # the end is missing
    open(path, "wb").write(data)
    lost = {r.page_id for r in whole if r.position in (places[5], places[9]) or r.position >= places[30]}
    for step in (100, 1 << 20):
        kept = warc.read(spark, [(path, len(data))], folder, step=step, errors="keep").collect()
        good = [r for r in kept if r.error is None]
        assert {r.page_id for r in good} == set(range(40)) - lost and len(good) == 40 - len(lost)
        assert {r.position for r in kept if r.error} == {places[5], places[30]}
        assert warc.read(spark, [(path, len(data))], folder, step=step).count() == len(good)
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, [(path, len(data))], folder, errors="fail").collect()


def test_language_on_held_out_rows(spark):
    out = language.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    told = [r for r in out if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(told) > 100 and sum(r.lang == r.lang_pred for r in told) / len(told) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)


def test_language_of_odd_tables(spark):
    df = odd(spark).withColumnRenamed("row", "lang_pred").withColumnRenamed("n_words", "score").withColumnRenamed("uid", "h")
    got = language.identify(df).collect()
    assert len(got) == 14 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    model = language.fit_table(df, "doc_id", "text", "lang")
    assert language.predict(df, model, df.columns).columns == [*df.columns, "lang_pred", "score", "ambiguous"]
    assert language.identify(df.limit(0)).count() == 0
    one = [(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (5, 6)]
    assert one[0][1:] == one[1][1:]


@pytest.mark.parametrize("nearest,slab", [(1, 4), (8, 2048)])
def test_links_at_the_bound_in_large_groups(spark, monkeypatch, nearest, slab):
    """Copies with so many changes that some pairs are just linked and others just not; rounds, slabs and groups that lie in each other lose none."""
    from strandweave.llm import jaccard

    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    monkeypatch.setattr(jaccard, "SLAB", slab)
    rng = random.Random(21)
    texts = []
    for size in (60, 300, 900):  # sketches of several lengths
        base = ["w%d" % rng.randint(0, 5000) for _ in range(size)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(2, size // 40))):
                w[rng.randrange(size)] = "n%d" % rng.randint(0, 10**6)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [frozenset(tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)) for t in texts]
    least = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = least[a], least[b]
                least = [min(x, y) if v in (x, y) else v for v in least]
    assert 3 < len(set(least)) < 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.classes_and_components(df, ["doc_id"], "doc_id").collect()}
    assert [got[i] for i in range(len(sets))] == least
    for a, b in rng.sample([(a, b) for a in range(len(sets)) for b in range(a)], 300):
        x, y = (np.unique(np.array([hash(g) & (2**64 - 1) for g in sets[i]], np.uint64)) for i in (a, b))
        s, t = jaccard.sketch(x), jaccard.sketch(y)
        words = min(len(s), len(t))
        assert jaccard.apart(jaccard.folded(s, words), jaccard.folded(t, words)) <= len(np.setxor1d(x, y))
