"""Self-join of documents on the Jaccard similarity of their word shingles, by PartEnum signatures. Exact.

Documents with equal shingle sets are one class. Classes are put into bands of set sizes such that linked sets lie in the same or
in adjacent bands, so every class takes part in two groups of bands. Within a group, linked sets differ in at most
k shingles. The shingle domain is split by hash into n1 parts of ``SECOND`` cells; then at least one
part holds at most ``SLACK`` of the differences, and all cells of the part but that many agree. A signature is
the content of one choice of ``SECOND - SLACK`` cells of one part, so linked sets share one. Parts where a choice
is empty say nothing; n1 has a part to spare for them, and sets with more of them emit the empty choices too.

Classes with a common signature are compared in two steps:

1. every class with the hub of each of its signatures (a row per member, not per pair);
2. where a signature still holds several components, the classes of different components, in blocks inside a task. Each class
   passes on its nearest ``NEAREST`` partners only; a group where some class has more comes again, with the next ones,
   and pairs that have come into one component meanwhile are left out. So no step emits more than a constant number of rows per member, and no pair is dropped.
   A pair that meets in several groups is taken up in the largest that both its classes name among their ``TOP`` largest ones.
   Groups of more than ``SLAB`` classes are dealt to tasks as pairs of slabs.

Both steps look at parity sketches first: of a set of n shingles 2n cells or more, so their distance never exceeds the number of
differences and seldom falls far below. What passes is checked on whole sets of 64-bit hashes; components are those of the links that hold. No link between
different components can be missed: any linked pair shares a signature, and was compared or was connected already.

Classes are named by 64-bit hashes of their sets. Null and empty texts have no set and no link. Repeated rows are copies; ties in size or distance are
decided by the name of the class, and don't change components. Other columns of the input are not read, so their names may be any.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import exchange as X
from strandweave.llm.frames import lean, load, small_batches
from strandweave.llm.textscan import Scan, factors, mix, slices, text_of, window_hash
from strandweave.operators.components import connected_components
from strandweave.plans.staging import cut, stage

SHINGLE = 4
PERCENT = 85
SECOND = 3
SLACK = 1
SPARE = 1
SMALL = 40
CELLS = 512
ROW_WORDS = 64
STRETCH = 1_000_000
NEAREST = 8
TOP = 6
SLAB = 2048
_U = np.uint64
_CHOICES = list(itertools.combinations(range(SECOND), SECOND - SLACK))


def bands(percent: int, top: int) -> list[int]:
    """Least size of each band, up to sets of ``top``."""
    out = [1]
    while out[-1] <= top:
        out.append(100 * out[-1] // percent + 1)
    return [*out, 100 * out[-1] // percent + 1]


def differences(size: int, percent: int) -> int:
    """Most shingles in which linked sets of together ``size`` shingles differ."""
    return (100 - percent) * size // (100 + percent)


def shingle_sets(s: Scan, width: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each document."""
    words = s.word_hash()
    at, doc = s.windows(width)
    key = window_hash(words, at, width, 5)
    order = np.argsort(key)
    if len(s.off) < 1 << 16:
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    out = np.split(key, np.searchsorted(doc, np.arange(1, len(s.off) - 1)))
    for i in np.flatnonzero((s.n_words > 0) & (s.n_words < width)):
        n, a = int(s.n_words[i]), int(s.first[i])
        with np.errstate(over="ignore"):
            out[i] = mix(window_hash(words, np.array([a]), n, 5) + _U(n))
    return out


def class_of(x: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(x ^ _U(0xA5A5A5A55A5A5A5A)).sum(dtype=_U) + _U(len(x)))[()].astype(np.int64))


def signatures(x: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    n = len(x)
    band = int(np.searchsorted(bounds, n, "right")) - 1
    out = []
    for group in (band - 1, band):
        if group < 0:
            continue
        most = bounds[group + 2] - 1
        k = differences(2 * most, percent)
        if k == 0:
            continue  # only equal sets
        spare = SPARE if n >= SMALL else 0
        parts = k // (SLACK + 1) + 1 + (SPARE if bounds[group] >= SMALL else 0)
        spare = spare if bounds[group] >= SMALL else 0
        with np.errstate(over="ignore"):
            y = mix(x + _U(group + 1) * _U(0x9E3779B97F4A7C15))
            cell = ((y >> _U(32)) * _U(parts * SECOND) >> _U(32)).astype(np.int64)
            total, filled = np.zeros(parts * SECOND, _U), np.zeros(parts * SECOND, np.int64)
            np.add.at(total, cell, mix(y))
            np.add.at(filled, cell, 1)
            total, filled = total.reshape(parts, SECOND), filled.reshape(parts, SECOND)
            place = factors(parts, 1000 + group)
            keys, empty = [], []
            for j, choice in enumerate(_CHOICES):
                v = place.copy()
                for c in choice:
                    v = mix(v + total[:, c] * _U(2 * c + 3) + _U(j))
                keys.append(v)
                empty.append(filled[:, choice].sum(1) == 0)
            keys, empty = np.array(keys), np.array(empty)
        if empty.any(0).sum() <= spare:
            keys = keys[~empty]
        out.append(keys.ravel())
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def sketch(x: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of at least 2n cells, a power of two, as 64-bit words."""
    cells = max(CELLS, 1 << (2 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((mix(x) & _U(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).view(_U)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (in the last dimension) of ``words`` words, as if taken with so few cells."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of sketches, row by row."""
    return np.bitwise_count(a ^ b).sum(-1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _pass(docs: DataFrame, text: str, keep: list[str], shingle: int, percent: int) -> DataFrame:
    """One scan: a row per document (row, n, cls, sketch), and a row per group of classes and member of it (gid, cls, n, hub).

    A group is the classes that share a signature; groups of the same classes have the same gid.
    """
    buckets = X.buckets_of(docs)
    row = T.StructField("row", docs.select(F.struct(*keep).alias("row")).schema[0].dataType, True)
    sent_kind = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType()), row, *(T.StructField(c, T.LongType()) for c in ("n", "cls")), T.StructField("sketch", T.BinaryType())])
    found_kind = T.StructType([row, *(T.StructField(c, T.LongType()) for c in ("n", "cls")), T.StructField("sketch", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("gid", "hub"))])

    def run(batches):
        held, n, bounds, seen = [], 0, bands(percent, 1 << 12), {}

        def flush():
            key, owner = (np.concatenate(c) for c in zip(*held, strict=True))
            table = np.array(list(seen), np.int64), np.array(list(seen.values()), np.int32)
            for b in X.blobs(key, [], buckets, owner, table):
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, t) for t in kinds)], names=sent_kind.names)

        for batch in slices(batches, "__text"):
            rows = batch.column(0)
            kinds = (rows.type, pa.int64(), pa.int64(), pa.binary())
            sizes, names, sketches = [], [], []
            for x in shingle_sets(Scan(text_of(batch, "__text"), lower=True), shingle):
                sizes.append(len(x))
                names.append(class_of(x) if len(x) else None)
                if not len(x) or names[-1] in seen:  # nothing, or a copy within this stretch
                    sketches.append(None)
                    continue
                sketches.append(sketch(x).tobytes())
                if len(x) >= bounds[-2]:
                    bounds = bands(percent, 2 * len(x))
                s = signatures(x, percent, bounds)
                held.append((s, np.full(len(s), len(seen))))
                seen[names[-1]] = len(x)
                n += len(s)
            places = (np.arange(len(sizes)) + len(held)) % buckets
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.nulls(len(sizes), pa.binary()), rows, pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())], names=sent_kind.names)
            if n >= STRETCH:
                yield from flush()
                held, n, seen = [], 0, {}
        if n:
            yield from flush()

    def groups(columns: list[np.ndarray]) -> list[np.ndarray]:
        key, cls, n = columns
        order = np.lexsort((cls, key))
        key, cls, n = key[order], cls[order], n[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, n = key[keep], cls[keep], n[keep]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((first, [len(key)])))
        with np.errstate(over="ignore"):
            gid = mix(np.add.reduceat(mix(cls.view(_U)), first) + size.astype(_U)).view(np.int64)
        own = np.zeros(len(first), bool)  # one of the groups of the same classes, if there are several
        own[np.unique(gid, return_index=True)[1]] = True
        own &= size > 1
        some = np.repeat(own, size)
        return [np.repeat(gid[own], size[own]), cls[some], n[some].astype(np.int64), np.repeat(cls[first[own]], size[own])]

    def work(batches):
        held, at, kind = [], None, None

        def flush():
            for columns in X.pieces(held):
                gid, cls, n, hub = groups(columns)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(gid), kind), pa.array(n), pa.array(cls), pa.nulls(len(gid), pa.binary()), pa.array(gid), pa.array(hub)], names=found_kind.names)

        for batch in batches:
            kind = batch.column(2).type
            own = batch.filter(batch.column(1).is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([*own.columns[2:], pa.nulls(own.num_rows, pa.int64()), pa.nulls(own.num_rows, pa.int64())], names=found_kind.names)
            rest = batch.filter(batch.column(1).is_valid())
            for b, blob in zip(rest.column(0).to_pylist(), rest.column(1).to_pylist(), strict=True):
                if b != at and held:
                    yield from flush()
                    held = []
                at = b
                held.append(blob)
        if held:
            yield from flush()

    sent = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("__text")).mapInArrow(lean(run), sent_kind)
    return X.dealt(sent).mapInArrow(lean(work), found_kind)


def _sets(docs: DataFrame, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(cls, members) of the classes whose documents ``wanted`` names, and perhaps of a few more; a class may come more than once."""
    at = docs.sparkSession.sparkContext.broadcast(X.Membership.of(wanted, "uid"))

    def run(batches):
        held = at.value
        seen: set[int] = set()
        for batch in slices(batches, "__text"):
            batch = batch.filter(pa.array(held.has(np.asarray(batch.column(0)))))
            rows = []
            if not batch.num_rows:
                continue
            for x in shingle_sets(Scan(text_of(batch, "__text"), lower=True), shingle):
                if len(x) and (c := class_of(x)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    rows.append((c, x.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["cls", "members"])

    return docs.select("__uid", F.col(text).alias("__text")).mapInArrow(lean(run), "cls long, members binary")


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches don't rule them out."""
    a = sketches.select(F.col("cls").alias("a_"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    b = sketches.select(F.col("cls").alias("b_"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    slim = pairs.join(a.drop("sa"), F.col("a") == F.col("a_")).join(b.drop("sb"), F.col("b") == F.col("b_")).where(sizes).select("a", "b", "na", "nb")
    joined = slim.join(a.drop("na"), F.col("a") == F.col("a_")).join(b.drop("nb"), F.col("b") == F.col("b_")).select("a", "b", "sa", "sb", "na", "nb")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                words = min(len(x), len(y))
                ok.append(bool(apart(folded(x, words), folded(y, words)) <= differences(n + m, percent)))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return joined.mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked; whole sets are compared. Each pair carries one set, to where the other is."""
    a = sets.select(F.col("cls").alias("a_"), F.col("members").alias("ma"))
    b = sets.select(F.col("cls").alias("b_"), F.col("members").alias("mb"))
    joined = pairs.join(b, F.col("b") == F.col("b_")).select("a", "b", "mb").join(a, F.col("a") == F.col("a_")).select("a", "b", "ma", "mb")

    def run(batches):
        for batch in batches:
            ok = [linked(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return joined.mapInArrow(lean(run), "a long, b long").distinct()


def _links(hashed: DataFrame, text: str, shingle: int, percent: int, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The links among (a, b) pairs of classes."""
    near = cut(_near(pairs, sketches, percent))
    if near.isEmpty():
        return near
    ids = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = stage(_sets(hashed, text, shingle, sketches.join(ids, "cls", "left_semi")), "sets")
    return cut(_verified(near, sets.dropDuplicates(["cls"]), percent))


def candidates(rows: dict[str, np.ndarray], bits: list[bytes], gid: int, one: int, two: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers x, y and distance of the pairs of a unit that sketches don't rule out and that are taken up here.

    A unit is a group (one == two == 0 if it is whole), or two of its slabs.
    """
    cls, n, comp, top, slab = (rows[c] for c in ("cls", "n", "comp", "top", "slab"))
    words = np.array([len(b) // 8 for b in bits])
    found = []
    for w in np.unique(words):
        a_rows = np.flatnonzero(words == w)
        a_rows = a_rows[np.argsort(n[a_rows], kind="stable")]
        a_bits = np.frombuffer(b"".join(bits[i] for i in a_rows), _U).reshape(len(a_rows), w)
        for v in np.unique(words[words >= w]):
            b_rows = np.flatnonzero(words == v)
            b_rows = b_rows[np.argsort(n[b_rows], kind="stable")]
            if 100 * n[a_rows[-1]] < percent * n[b_rows[0]]:
                break
            b_bits = a_bits if v == w else folded(np.frombuffer(b"".join(bits[i] for i in b_rows), _U).reshape(len(b_rows), v), w)
            step = 4096 // min(int(w), ROW_WORDS)
            for i in range(0, len(a_rows), step):
                for j in range(i if v == w else 0, len(b_rows), step):
                    a, b = a_rows[i : i + step], b_rows[j : j + step]
                    if 100 * n[a[-1]] < percent * n[b[0]]:
                        break  # sorted by size
                    na, nb = n[a][:, None], n[b][None]
                    ok = (comp[a][:, None] != comp[b][None]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                    if one != two:
                        ok &= slab[a][:, None] != slab[b][None]
                    if v == w and i == j:
                        ok = np.triu(ok, 1)
                    x, y = np.nonzero(ok)
                    d = apart(a_bits[i + x], b_bits[j + y])
                    keep = d <= (100 - percent) * (n[a[x]] + n[b[y]]) // (100 + percent)
                    x, y, d = a[x[keep]], b[y[keep]], d[keep]
                    both = (top[x][:, :, None] == top[y][:, None, :]).any(2) & (top[x] != 0)
                    here = ~both.any(1) | (top[x, both.argmax(1)] == gid)
                    found.append((x[here], y[here], d[here]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
    swap = cls[x] > cls[y]
    return np.where(swap, y, x), np.where(swap, x, y), d


def _across(units: DataFrame, percent: int, least: int, most: int) -> DataFrame:
    """(gid, one, two, a, b): of each class of a unit the partners from place ``least`` to ``most`` in order of distance.

    Rows without a and b name units where some class has more partners. Partners are ranked by the first components (``comp``), so their places stay; those that are
    in one component by now (``now``) are left out.
    """
    kinds = pa.schema([("gid", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def found(table: pa.Table):
        gid, one, two = (table.column(i)[0].as_py() for i in range(3))
        rows = {c: np.asarray(table.column(c)) for c in ("cls", "n", "comp", "now", "slab")}
        rows["top"] = np.stack([np.asarray(table.column(f"top{i}")) for i in range(TOP)], 1)
        x, y, d = candidates(rows, table.column("sketch").to_pylist(), gid, one, two, percent)
        if not len(x):
            return
        cls, now = rows["cls"], rows["now"]
        order = np.lexsort((cls[y], d, cls[x]))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        size = np.diff(np.concatenate((first, [len(x)])))
        place = np.arange(len(x)) - np.repeat(first, size)
        more = ((now[x] != now[y]) & (place >= most)).any()
        own = (place >= least) & (place < most) & (now[x] != now[y])
        a, b = cls[x[own]], cls[y[own]]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), gid)), pa.array(np.full(len(a), one, np.int32)), pa.array(np.full(len(a), two, np.int32)), pa.array(a), pa.array(b)], schema=kinds)
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([one], pa.int32()), pa.array([two], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=kinds)

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[i])
                if held and key != last:
                    yield from found(pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = key
                held.append(batch.slice(int(i), int(j - i)))
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    return units.mapInArrow(lean(run), "gid long, one int, two int, a long, b long")


def _units(named: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows (gid, one, two, cls, n, comp, slab, top0.., sketch) of groups with several components, of (gid, cls, n, comp), by unit.

    A group all of whose classes have the same other largest group lies within that one, and goes.
    """
    groups = cut(named.groupBy(F.col("gid").alias("g")).agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g", "size"))
    rows = cut(named.join(groups, F.col("gid") == F.col("g")).select("gid", "cls", "n", "comp", "size"))
    tops = rows.groupBy(F.col("cls").alias("c")).agg(F.sort_array(F.collect_list(F.struct("size", "gid")), asc=False).alias("t"))  # as many as a set has signatures at most
    tops = tops.select("c", *[F.coalesce(F.try_element_at("t", F.lit(i + 1))["gid"], F.lit(0).cast("long")).alias(f"top{i}") for i in range(TOP)])
    rows = rows.join(tops, F.col("cls") == F.col("c")).drop("c")
    inner = rows.groupBy(F.col("gid").alias("g")).agg(F.min("top0").alias("x"), F.max("top0").alias("y")).where("x = y and x <> g").select("g")
    rows = rows.join(inner, F.col("gid") == F.col("g"), "left_anti")
    parts = F.ceil(F.col("size") / SLAB).cast("int")
    rows = rows.withColumn("slab", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    # in slab s of p: the units (s, t) for t >= s and (t, s) for t < s; slabs alone come as (s, s)
    dealt = F.transform(F.sequence(F.lit(0), parts - 1), lambda t: F.struct(F.least("slab", t).alias("one"), F.greatest("slab", t).alias("two")))
    rows = rows.withColumn("u", F.explode(dealt)).select("gid", "u.one", "u.two", "cls", "n", "comp", "slab", *[f"top{i}" for i in range(TOP)])

    def shrink(batches):
        for batch in batches:
            bits = [folded(np.frombuffer(b, _U), ROW_WORDS).tobytes() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["c", "sketch"])

    small = sketches.select(F.col("cls").alias("c"), "sketch").mapInArrow(lean(shrink), "c long, sketch binary")
    return rows.join(small, F.col("cls") == F.col("c")).drop("c")


def classes_and_components(docs: DataFrame, keep: list[str], key: str, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The columns ``keep`` with n_shingles, cls (null without a set), comp (the component's own label) and component_id, the smallest key reachable by links."""
    small_batches(docs.sparkSession)
    hashed = docs.select(*dict.fromkeys([*keep, key, text]), F.xxhash64(key, text).alias("__uid"))
    held = list(dict.fromkeys([*keep, key, "__uid"]))
    found = stage(_pass(hashed, text, held, shingle, percent), "shingles")
    all_docs = found.where("gid is null").select(*[F.col(f"row.{c}").alias(c) for c in dict.fromkeys([*keep, key])], F.col("n").alias("n_shingles"), "cls")
    of_docs = found.where("gid is null and cls is not null")
    classes = cut(of_docs.groupBy("cls").agg(F.min(f"row.{key}").alias("least"), F.min("row.__uid").alias("uid"), F.first("n").alias("n"), F.max("sketch").alias("sketch")))
    shared = cut(found.where("gid is not null").select("gid", "cls", "n", "hub").distinct())
    several = shared.select("cls").distinct()
    sketches = cut(classes.join(several, "cls", "left_semi").select("cls", "n", "sketch", "uid"))
    star = shared.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    links = _links(hashed, text, shingle, percent, star, sketches)
    found = cut(connected_components(links, "a", "b"))

    def labelled(rows: DataFrame, name: str = "comp") -> DataFrame:
        return rows.join(found, F.col("cls") == F.col("node"), "left").withColumn(name, F.coalesce("component", "cls")).drop("node", "component")

    units = stage(_units(labelled(shared.select("gid", "cls", "n")), sketches), "units")
    least, most = 0, NEAREST
    while True:
        now = units.withColumn("now", F.col("comp")) if least == 0 else labelled(units, "now")
        rows = now.repartition("gid", "one", "two").sortWithinPartitions("gid", "one", "two")
        across = cut(_across(rows, percent, least, most))
        more = _links(hashed, text, shingle, percent, across.where("a is not null").select("a", "b").distinct(), sketches)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = cut(connected_components(links, "a", "b"))
        left = across.where("a is null").select("gid", "one", "two").distinct()
        if left.isEmpty():
            break
        units = stage(units.join(left, ["gid", "one", "two"], "left_semi"), "units")
        least, most = most, 8 * most

    comps = labelled(classes.select("cls", "least"))
    least = comps.groupBy("comp").agg(F.min("least").alias("component_id")).withColumnRenamed("comp", "of")
    by_class = comps.join(least, F.col("comp") == F.col("of"), "left").select(F.col("cls").alias("c"), "comp", "component_id")
    out = all_docs.join(by_class, F.col("cls") == F.col("c"), "left")
    return out.withColumn("component_id", F.coalesce("component_id", F.when(F.col("cls").isNull(), F.col(key)))).select(*keep, "n_shingles", "cls", "comp", "component_id")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_and_components(load(spark, sf_dir, "documents"), ["doc_id"], "doc_id").select("doc_id", "n_shingles", "component_id")
