"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda, best score first and leftmost among equals. A candidate
that comes up is skipped if a keyed hash of it (seed, document key, occurrence of the unit, place, piece) falls under the
dropout rate, so one seed always gives one segmentation, on any number of tasks, and every occurrence draws for
itself. Occurrences whose draws skip nothing look up what their unit becomes without dropout; all
others go through an agenda of their own. Those of a batch go through their agendas in
step, as rows of arrays; long ones, and those with characters that only longer pieces hold, one by one with the same result.

Characters outside the vocabulary become byte pieces, a literal U+2581 too, so decoding gives back the text,
whatever was skipped. With dropout 0 the ids are those of the SentencePiece library. A null text is an empty one, without ids. Rows that repeat a key and a text draw alike; a null
key draws by its name. Of equal scores the leftmost merge comes first. Long texts are encoded whole, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.frames import lean, load
from strandweave.llm.packing import public_tokenizer
from strandweave.llm.textscan import mix, slices, text_of

SPACE = "▁"
DROPOUT = 0.1
SEED = 20
CACHE_UNITS = 800_000
LOCKSTEP = 64
SLICE = 4 << 20  # the more units a slice holds, the more go through their agendas in step
DRAWS = 1 << 17
_NONE = np.iinfo(np.int32).max
_ALL = 2**64 - 1
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _drawn(key: int, place: int, piece: int) -> int:
    """32 bits for a candidate: its occurrence's key, its place in the unit and the piece it would make."""
    x = key ^ (place << 32 | piece)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return (x ^ x >> 31) >> 32


def _drawn_many(key: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return mix(key ^ (place.astype(np.uint64) << np.uint64(32) | piece.astype(np.uint64))) >> np.uint64(32)


class MergeDropEncoder:
    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        byte = {i for i in range(n) if sp.is_byte(i)}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in byte}
        self.score = {p: -sp.get_score(i) for p, i in self.id.items()}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in byte}
        self.bytes = [bytes((int(p[3:5], 16),)) if i in byte else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.seed = seed
        self.limit = int(dropout * 2**32)
        self.known: dict[str, tuple[bytes, bytes]] = {}  # without dropout: ids, and the candidates that come up
        self.literal = np.array([self.byte_id[b] for b in SPACE.encode()], "<u4").tobytes()
        self._tables(n)

    def _tables(self, n: int) -> None:
        """Arrays for many units at once: ids of characters, and what two adjacent pieces merge to."""
        self.char_id = -2 - np.arange(0x110000, dtype=np.int32)  # of characters outside the vocabulary: what they are
        self.char_id[[ord(c) for c in {c for p in self.id for c in p}.difference(self.id)]] = -1  # only within longer pieces
        for p, i in self.id.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs = sorted((self.id[p[:k]] << 32 | self.id[p[k:]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id)
        self.pair_key, self.pair_into = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.pair_into = self.pair_into.astype(np.int32)
        scores, place = np.unique([self.score[p] for p in self.id], return_inverse=True)
        self.rank = np.full(n + 1, _NONE, np.int32)  # by piece; the last one is that of no merge
        self.rank[list(self.id.values())] = place
        self.of_byte = np.array([self.byte_id[b] for b in range(256)], "<u4")

    def _into(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b merge to, -1 for none; negative numbers merge with nothing."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_into[at], -1)

    def segment(self, unit: str, key: int, taken: list[int] | None = None) -> list[str]:
        """The agenda over one unit; with ``taken`` nothing is skipped and the candidates are added to it."""
        part = list(unit)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score, agenda = self.score, []
        for i in range(n - 1):
            s = score.get(part[i] + part[i + 1])
            if s is not None:
                agenda.append((s, i, i + 1, part[i] + part[i + 1]))
        heapq.heapify(agenda)
        limit = self.limit if taken is None else 0
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if not part[i] or right[i] != j or len(part[i]) + len(part[j]) != len(both):
                continue
            if limit and _drawn(key, i, self.id[both]) < limit:
                continue
            if taken is not None:
                taken.append(i << 32 | self.id[both])
            part[i], part[j] = both, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                s = score.get(both + part[k])
                if s is not None:
                    heapq.heappush(agenda, (s, i, k, both + part[k]))
            h = left[i]
            if h >= 0:
                s = score.get(part[h] + both)
                if s is not None:
                    heapq.heappush(agenda, (s, h, i, part[h] + both))
        return [p for p in part if p]

    def ids_of(self, unit: str, key: int, taken: list[int] | None = None) -> bytes:
        out = []
        for p in self.segment(unit, key, taken):
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte_id[b] for b in p.encode()]
        return np.array(out, "<u4").tobytes()

    def _agendas(self, chars: np.ndarray, key: np.ndarray, taken: list | None = None) -> np.ndarray:
        """The agendas of many units, a step of each at a time; ``chars`` has a unit per row, filled up with -1.

        An agenda is a row of ranks, by the place where a candidate begins; gives the pieces, -1 between them.
        With ``taken`` nothing is skipped and the candidates of each step are added to it.
        """
        m, width = chars.shape
        sym = np.full((m, width + 1), -1, np.int32)
        sym[:, :-1] = chars
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (m, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (m, 1))
        into = np.full((m, width), -1, np.int32)
        row, at = np.nonzero(sym[:, 1:] != -1)
        into[row, at] = self._into(sym[row, at], sym[row, at + 1])
        rank = self.rank[into]
        live = np.arange(m)
        while True:
            i = rank[live].argmin(1)
            some = rank[live, i] != _NONE
            live, i = live[some], i[some]
            if not len(live):
                return sym[:, :-1]
            both = into[live, i]
            go, a = live, i
            if taken is not None:
                taken.append((live, i.astype(np.uint64) << np.uint64(32) | both.astype(np.uint64)))
            elif self.limit:
                skipped = _drawn_many(key[live], i, both) < self.limit
                rank[live[skipped], i[skipped]] = _NONE
                go, a, both = live[~skipped], i[~skipped], both[~skipped]
            j = after[go, a]
            k = after[go, j]
            sym[go, a], sym[go, j] = both, -1
            after[go, a] = k
            inside = k <= width
            before[go[inside], k[inside]] = a[inside]
            rank[go, np.minimum(j, width - 1)] = _NONE
            nxt = sym[go, np.minimum(k, width)]
            found = self._into(both, nxt)
            into[go, a], rank[go, a] = found, self.rank[found]
            h = before[go, a]
            has = h >= 0
            go, h, both = go[has], h[has], both[has]
            found = self._into(sym[go, h], both)
            into[go, h], rank[go, h] = found, self.rank[found]

    def ids_of_many(self, wanted: list[tuple[int, str]], taken: list[bytes] | None = None) -> list[bytes]:
        """``ids_of`` of each (key, unit); a list ``taken`` of the same length gets the candidates of each, none skipped."""
        out: list[bytes] = [b""] * len(wanted)
        size = np.fromiter((len(u) for _, u in wanted), np.int64, len(wanted))
        start = np.cumsum(size) - size
        chars = self.char_id[np.frombuffer("".join([u for _, u in wanted]).encode("utf-32-le"), "<u4")]
        plain = np.logical_and.reduceat(chars != -1, start)
        lone = ~plain | (size > LOCKSTEP)
        for i in np.flatnonzero(lone).tolist():
            own_taken = None if taken is None else []
            out[i] = self.ids_of(wanted[i][1], wanted[i][0], own_taken)
            if taken is not None:
                taken[i] = np.array(own_taken, np.uint64).tobytes()
        rest = np.flatnonzero(~lone)
        rest = rest[np.argsort(size[rest], kind="stable")]
        edges = np.searchsorted(size[rest], [0, 4, 6, 8, 10, 13, 18, 32, LOCKSTEP], "right")
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for at in range(lo, hi, 1 << 14):
                own = rest[at : min(at + (1 << 14), hi)]
                width = int(size[own[-1]])
                place = np.arange(width)
                inside = place < size[own][:, None]
                rows = np.where(inside, chars[np.where(inside, start[own][:, None] + place, 0)], -1)
                key = np.array([wanted[i][0] for i in own.tolist()], np.uint64)
                steps = None if taken is None else [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                pieces = self._agendas(rows, key, steps)
                if taken is not None:
                    of, candidate = (np.concatenate(c) for c in zip(*steps, strict=True))
                    listed = candidate[np.argsort(of, kind="stable")].tobytes()
                    cuts = (8 * np.cumsum(np.bincount(of, minlength=len(own)))).tolist()
                    for i, a, b in zip(own.tolist(), [0, *cuts], cuts):
                        taken[i] = listed[a:b]
                own_row, _ = held = np.nonzero(pieces != -1)
                ids = pieces[held]
                count = np.ones(len(ids), np.int64)
                absent = np.flatnonzero(ids < 0)
                if len(absent):
                    code = -2 - ids[absent]
                    count[absent] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
                    ids = np.repeat(ids, count)
                    ids[ids < 0] = self.of_byte[np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)]
                n = np.cumsum(np.bincount(own_row, count, len(own)).astype(np.int64) * 4).tolist()
                body = ids.astype("<u4").tobytes()
                for i, a, b in zip(own.tolist(), [0, *n], n):
                    out[i] = body[a:b]
        return out

    def _units(self, text: str, key: int) -> tuple[list[str], list[np.ndarray]]:
        """Units in turn, the empty one for a literal U+2581, and the keys of these occurrences."""
        units, drawn = [], []
        for k, stretch in enumerate(text.split(SPACE) if text else ()):
            if k:
                units.append("")
                drawn.append(np.zeros(1, np.uint64))
            own = _UNIT.findall(stretch.replace(" ", SPACE) if k else SPACE + stretch.replace(" ", SPACE))
            with np.errstate(over="ignore"):
                draw = mix(np.arange(len(own), dtype=np.uint64) + mix(np.uint64(key & 2**64 - 1) ^ np.uint64(self.seed + 1000 * k)))
            units += own
            drawn.append(mix(draw))
        return units, drawn

    def _skipping(self, code: np.ndarray, key: np.ndarray, candidates: list[bytes]) -> np.ndarray:
        """The occurrences that skip one or more of the candidates that come up without dropout."""
        table = np.frombuffer(b"".join(candidates), np.uint64)
        size = np.fromiter(map(len, candidates), np.int64, len(candidates)) // 8
        start = np.cumsum(size) - size
        out = [np.zeros(0, np.int64)]
        n = np.cumsum(size[code])
        at = 0
        while at < len(code):
            to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + DRAWS, "right")))
            own = code[at:to]
            each = np.repeat(np.arange(to - at), size[own])
            before = np.cumsum(size[own]) - size[own]
            candidate = table[np.arange(len(each)) + np.repeat(start[own] - before, size[own])]
            under = mix(key[at:to][each] ^ candidate) >> np.uint64(32) < self.limit
            out.append(at + np.unique(each[under]))
            at = to
        return np.concatenate(out)

    def encode_many(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes; a key is that of the document."""
        flat, drawn, ends = [], [np.zeros(0, np.uint64)], [0]
        for t, k in zip(texts, keys, strict=True):
            own, draw = self._units(t, k)
            flat += own
            drawn += draw
            ends.append(len(flat))
        named = pa.array(flat, pa.string()).dictionary_encode()
        names = named.dictionary.to_pylist()
        code, key = np.asarray(named.indices, np.int64).copy(), np.concatenate(drawn)
        known = self.known
        new = [u for u in names if u not in known and u]
        if len(known) + len(new) > CACHE_UNITS:
            known.clear()
            new = [u for u in names if u]
        known[""] = self.literal, b""
        if new:
            taken = [b""] * len(new)
            known.update(zip(new, zip(self.ids_of_many([(0, u) for u in new], taken), taken, strict=True), strict=True))
        found, candidates = (list(c) for c in zip(*(known[u] for u in names), strict=True)) if names else ([], [])
        for u in new:
            if len(u) >= 100:
                del known[u]
        if self.limit:
            differ = self._skipping(code, key, candidates)
            code[differ] = len(names) + np.arange(len(differ))
            if len(differ):
                found += self.ids_of_many([(k, flat[i]) for i, k in zip(differ.tolist(), key[differ].tolist(), strict=True)])
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        to = np.cumsum(size[code])
        size, start = size[code], (np.cumsum(size) - size)[code]
        body = ids[np.arange(int(size.sum())) + np.repeat(start - (to - size), size)].tobytes()
        at = (4 * np.concatenate(([0], to))[ends]).tolist()
        return [body[a:b] for a, b in zip(at, at[1:])]

    def encode(self, text: str, key: int = 0) -> bytes:
        return self.encode_many([text], [key])[0]

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        body = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return body[1:].decode()


_ENCODERS: dict[tuple, MergeDropEncoder] = {}


def encode_documents(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: ids (as binary, if wanted), their number and crc32, and the sha256 of the text decoded from them."""

    def run(batches):
        if (model, dropout, seed) not in _ENCODERS:
            _ENCODERS[model, dropout, seed] = MergeDropEncoder(model, dropout, seed)
        encoder = _ENCODERS[model, dropout, seed]
        for batch in slices(batches, text, SLICE):
            rows = []
            names, texts = batch.column(0).to_pylist(), text_of(batch, text).to_pylist()
            keys = [k if isinstance(k, int) else xxhash.xxh64_intdigest(str(k)) for k in names]
            for ids, t in zip(encoder.encode_many(texts, keys), texts, strict=True):
                back = encoder.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == t, ids))
            n, crc, sha, same, ids = zip(*rows, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=kinds.names)

    kinds = docs.select(key).schema.add("n_ids", "long").add("ids_crc32", "long").add("decoded_sha256", "string").add("lossless", "boolean")
    if with_ids:
        kinds = kinds.add("ids", "binary")
    return docs.select(key, text).mapInArrow(lean(run), kinds)


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), with_ids=False)
