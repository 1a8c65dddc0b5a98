import random

import corpus_pipeline


def test_stages_keep_columns_and_pack(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join("w%d" % rng.randint(0, 5000) for _ in range(120))
    base, passage = text(), " ".join("p%d" % i for i in range(60))
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), text() + " " + passage, passage + " " + text(), "short one", None, "12 34 " * 60, text(), "a b c " * 40]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[8])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids, now = [], docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        ids.append(sorted(r.doc_id for r in now.collect()))
    assert ids == [[0, 1, 2, 3, 4, 5, 8, 8, 9], [0, 1, 2, 3, 4, 8, 8], [0, 3, 4, 8], [0, 3, 4, 8]]
    left = {r.doc_id: r.text for r in now.collect()}
    assert "p30" not in left[3] + left[4] and left[0] == base and len(left[3].split()) == 120
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in packed) == [0, 3, 4, 8]


def kept_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near(spark, docs, "").collect())


def test_near_copies_share_four_fifths_of_five_word_shingles(spark):
    words = ["w%d" % i for i in range(200)]
    near, far = list(words), list(words)
    for i in (30, 70, 110, 150):
        near[i] = "new%d" % i
    for i in (30, 60, 90, 120, 150):  # 171 of 221
        far[i] = "other%d" % i
    texts = [" ".join(w) for w in (words, near, far)]
    assert kept_of(spark, list(enumerate(texts))) == [(0, texts[0]), (2, texts[2])]


def test_unrelated_texts_with_one_id_both_stay(spark):
    a, b = (" ".join(c + str(i) for i in range(50)) for c in "ab")
    assert kept_of(spark, [(7, a), (7, b), (8, b), (9, a)]) == [(7, a), (7, b)]


def plain_stages(rows):
    """What the first four stages keep of (doc_id, text, source), by looking at everything: rows that fail go, one of each near group stays, repeated windows are cut."""
    import collections

    def words(t):
        return (t or "").encode().split()

    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]

    def failed(t):
        w = words(t)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        bad = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(w) < 50 or 100 * len(bad) > 50 * len(w)

    hosts = collections.defaultdict(list)
    for r in kept:
        if r[2] is not None:
            hosts[r[2]].append(failed(r[1]))
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = min(max(sum(rates) / len(rates), 1e-6), 1 - 1e-6)
    spread = sum((x - sum(rates) / len(rates)) ** 2 for x in rates) / (len(rates) - 1)
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1000.0) if spread > 0 else 1000.0
    bad_hosts = {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) > 0.6}
    kept = [r for r in kept if not failed(r[1]) and r[2] not in bad_hosts]

    sets = []
    for r in kept:
        w = [x.lower() for x in words(r[1])]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    firsts = {}
    for r, g in zip(kept, group, strict=True):
        order = (r[0] is not None, r[0] or 0)  # a null id comes first
        if g not in firsts or order < firsts[g][0]:
            firsts[g] = (order, r)
    kept = [r for _, r in firsts.values()]

    count = collections.Counter(tuple(w[i : i + 35]) for r in kept for w in [words(r[1])] for i in range(len(w) - 34))
    out = []
    for r in kept:
        w = words(r[1])
        cut = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((r[0], b" ".join(x for j, x in enumerate(w) if j not in cut).decode()))
    return sorted(out, key=str)


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = random.Random(17)
    text = lambda n: ["w%d" % rng.randint(0, 3000) for _ in range(n)]
    passage = text(70)
    rows = []
    for i in range(70):
        w = text(rng.randint(60, 160))
        if i % 5 == 0 and rows:  # a copy with some words changed
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice((0, 1, 2, 3, 6))):
                w[rng.randrange(len(w))] = "new%d" % rng.randint(0, 99)
        if i % 7 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        rows.append((i if i != 33 else None, " ".join(w), "h%d" % (i % 4)))
    rows += [(100 + i, "too short", "bad") for i in range(9)] + [(120, " ".join(text(80)), "bad"), (121, None, "h0"), (122, "", None), (123, "1 2 3 " * 60, "h1"), (124, " ".join(text(80)), None)]
    frame = [(k, t, "en", h, len(t or ""), 1, "x", 2.5, "y") for k, t, h in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, uid long, cls string, score double, c1 string"
    docs = spark.createDataFrame(frame, kinds)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, str(tmp_path))
        assert now.schema.names == docs.schema.names
    got = now.collect()
    assert all((r.uid, r.cls, r.score, r.c1) == (1, "x", 2.5, "y") and r.n_chars == len(r.text) for r in got)
    assert sorted(((r.doc_id, " ".join(r.text.split())) for r in got), key=str) == plain_stages(rows)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(r.doc_id) for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
