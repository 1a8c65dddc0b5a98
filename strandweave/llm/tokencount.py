"""Token counts attributed to the sections of a document.

A document is encoded once, as a whole, so tokens are those a model would see. Token spans follow
from the byte lengths of the tokens; an interval join of the sorted spans with the sorted sections attributes
every token to exactly one section. A token that crosses a bound goes by the rule:

``largest``  to the section that holds most of its bytes, to the earlier one of equals (the default);
``first``    to the section that holds its first byte.

Sections tile the text. By default they are lines, each with its line feed; ``count_fields`` makes them the
fields of a row. A null or empty text has no tokens and no sections. Repeated rows are rows of their own, long texts are encoded whole, an empty table gives no rows, and
other columns are not read, so their names may be any.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.frames import lean, load
from strandweave.llm.packing import public_tokenizer
from strandweave.llm.textscan import slices, text_of

RULES = ("largest", "first")
_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str):
    """The encoder of a rank file and the byte length of each of its ids."""
    if path not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            sizes[v] = len(k)
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODINGS[path]


def line_starts(text: bytes) -> np.ndarray:
    """First byte of each line; a line ends with its line feed."""
    after = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate(([0], after[after < len(text)])) if text else np.zeros(0, np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str = "largest") -> tuple[np.ndarray, int]:
    """Section of each token, and how many tokens cross a bound.

    Token i is [ends[i - 1], ends[i]); section j is [starts[j], starts[j + 1]), the last one up to ``size``.
    """
    begins = np.concatenate(([0], ends[:-1]))
    lo = np.searchsorted(starts, begins, "right") - 1
    hi = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(hi > lo)
    if rule == "largest":
        bounds = np.concatenate((starts, [size]))
        for i in crossing:
            j = np.arange(lo[i], hi[i] + 1)
            lo[i] = j[np.argmax(np.minimum(bounds[j + 1], ends[i]) - np.maximum(bounds[j], begins[i]))]
    return lo, len(crossing)


def count_sections(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", rule: str = "largest", sections: Callable[[bytes], np.ndarray] = line_starts) -> DataFrame:
    """Per document: tokens, sections, crossing tokens and the tokens of each section in turn."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        encoder, sizes = encoding(tokenizer)
        for batch in slices(batches, text):
            rows = []
            for t in text_of(batch, text).to_pylist():
                body = t.encode()
                ids = np.array(encoder.encode_ordinary(t), np.int64)
                starts = sections(body)
                if not len(ids):
                    rows.append((0, 0, 0, []))
                    continue
                owner, crossing = attribute(np.cumsum(sizes[ids]), starts, len(body), rule)
                rows.append((len(ids), len(starts), crossing, np.bincount(owner, minlength=len(starts)).tolist()))
            n, s, c, each = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, s, c)), pa.array(each, pa.list_(pa.int64()))], names=kinds.names)

    from pyspark.sql import types as T

    kinds = docs.select(key).schema.add("n_tokens", "long").add("n_sections", "long").add("n_crossing", "long").add("section_tokens", T.ArrayType(T.LongType()))
    return docs.select(key, text).mapInArrow(lean(run), kinds)


def count_fields(rows: DataFrame, fields: list[str], tokenizer: str, key: str, joint: str = "\n", rule: str = "largest") -> DataFrame:
    """Tokens of each field of a row, encoded as one text with ``joint`` between fields; a joint counts to the field before it.

    Null fields are empty. ``section_tokens`` has a number for each field.
    """
    lengths = F.array(*[F.octet_length(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    one = rows.select(F.col(key), F.concat_ws(joint, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("__text"), lengths.alias("__n"))
    gap = len(joint.encode())

    def run(batches):
        encoder, sizes = encoding(tokenizer)
        for batch in slices(batches, "__text"):
            out = []
            for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.array(encoder.encode_ordinary(t), np.int64)
                starts = np.cumsum([0, *(x + gap for x in n[:-1])])
                if len(ids):
                    owner, crossing = attribute(np.cumsum(sizes[ids]), starts, len(t.encode()), rule)
                    out.append((len(ids), len(n), crossing, np.bincount(owner, minlength=len(n)).tolist()))
                else:
                    out.append((0, len(n), 0, [0] * len(n)))
            a, b, c, each = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(each, pa.list_(pa.int64()))], names=kinds.names)

    from pyspark.sql import types as T

    kinds = rows.select(key).schema.add("n_tokens", "long").add("n_sections", "long").add("n_crossing", "long").add("section_tokens", T.ArrayType(T.LongType()))
    return one.mapInArrow(lean(run), kinds)


def section_digest(tokens: list[int]) -> int:
    """crc32 of the counts as text, joined by commas."""
    return zlib.crc32(",".join(map(str, tokens)).encode())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_sections(load(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.tiktoken"))
    each = F.col("section_tokens")
    digest = F.crc32(F.array_join(F.transform(each, lambda x: x.cast("string")), ",").cast("binary"))
    return counted.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.coalesce(F.array_max(each), F.lit(0)).alias("max_section_tokens"), digest.alias("section_crc32"))
