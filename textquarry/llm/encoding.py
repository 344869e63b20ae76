"""Encoding of a corpus with a public byte-level BPE vocabulary.

Ordinary texts are encoded as they stand. A long text is cut into parts that different tasks can
encode: between pre-tokens where the pattern allows it, and inside a single huge pre-token (a long
run without blanks) wherever the half lies. The parts of such a run are put together by tree
concatenation: a window around each join is encoded again and grows until both of its ends agree
with the tokens already there. A sequence of byte-pair tokens is the encoding of its bytes exactly if
each neighbouring pair is, so one shared token on either side makes the join exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.tokens import PATTERN, TOKENIZERS, encoder
from textquarry.session import shuffle_width

LONG_TEXT = 20_000
SEGMENT_CHARS = 8_192
RUN_CHARS = 4_096


def _piece(enc, data: bytes) -> list[int]:
    return list(enc._encode_single_piece(data)) if data else []


def join_runs(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of two neighbouring parts of one pre-token, from the encodings of the parts."""
    if not left or not right:
        return left + right
    k = 2
    while True:
        l, r = min(k, len(left)), min(k, len(right))
        window = _piece(enc, enc.decode_bytes(left[-l:] + right[:r]))
        fits_left = l == len(left) or window[0] == left[-l]
        fits_right = r == len(right) or window[-1] == right[r - 1]
        if fits_left and fits_right and len(window) > 1 or (l == len(left) and r == len(right)):
            return left[: len(left) - l] + window + right[r:]
        k *= 2


def join_tree(enc, parts: list[list[int]]) -> list[int]:
    """Join the parts of one run pairwise, level by level."""
    while len(parts) > 1:
        parts = [join_runs(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def halves(text: str, most: int = RUN_CHARS) -> list[str]:
    """Halve a text until no part is longer than ``most``."""
    if len(text) <= most:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], most) + halves(text[mid:], most)


def segments(text: str, segment_chars: int = SEGMENT_CHARS, run_chars: int = RUN_CHARS) -> Iterator[tuple[int, str]]:
    """Cut a long text into (run, part): run 0 is encoded by itself, parts of the same run > 0 are one pre-token.

    A part of run 0 begins at a pre-token and ends in a character other than white space, so that
    the pattern splits it alone just as it does in the whole text. Pre-tokens that would break this,
    and those longer than ``run_chars``, become runs of their own.
    """
    import regex

    start, run, held = 0, 0, []

    def flush(upto: int) -> Iterator[tuple[int, str]]:
        nonlocal run
        cut, tail = upto, []
        while held and text[held[-1][1] - 1].isspace():
            a, b = held.pop()
            tail.append(text[a:b])
            cut = a
        if cut > start:
            yield 0, text[start:cut]
        for white in reversed(tail):
            run += 1
            yield run, white

    for m in regex.finditer(PATTERN, text):
        a, b = m.span()
        if b - a > run_chars:
            yield from flush(a)
            run += 1
            for part in halves(text[a:b], run_chars):
                yield run, part
            start, held = b, []
        else:
            if a - start >= segment_chars and held and not text[a - 1].isspace():
                yield 0, text[start:a]
                start, held = a, []
            held.append((a, b))
    yield from flush(len(text))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = TOKENIZERS,
    name: str = "byte_bpe_50k",
    long_text: int = LONG_TEXT,
    segment_chars: int = SEGMENT_CHARS,
    run_chars: int = RUN_CHARS,
) -> DataFrame:
    """(id_col, ids): one row per input row; null and empty texts give an empty list.

    No text is trimmed or normalised, and texts that look like special tokens are plain text. Only
    texts of at least ``long_text`` characters take a shuffle, in parts; the sizes decide where work
    is cut, never what comes out. Repeated rows and null ids are kept as they are, other columns are
    ignored, an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, none = encoder(folder, name), frozenset()
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [enc.encode_to_numpy(t, allowed_special=none, disallowed_special=none) if t else np.zeros(0, np.uint32) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], ["id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = list(segments(text, segment_chars, run_chars))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + row] * n, pa.int64()),
                        pa.array([i] * n, b.schema.field(0).type),
                        pa.array(range(n), pa.int32()),
                        pa.array([p[0] for p in parts], pa.int32()),
                        pa.array([p[1] for p in parts], pa.string()),
                    ],
                    ["key", "id", "seq", "run", "part"],
                )
                row += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, none = encoder(folder, name), frozenset()
        for b in batches:
            ids = [
                np.asarray(_piece(enc, p.encode()) if run else enc.encode_to_numpy(p, allowed_special=none, disallowed_special=none))
                for run, p in zip(b.column(3).to_pylist(), b.column(4).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _lists(ids)], ["key", "id", "seq", "run", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                whole: list[int] = []
                parts, k = sorted(parts, key=lambda p: p["seq"]), 0
                while k < len(parts):
                    e = k + 1
                    while parts[k]["run"] and e < len(parts) and parts[e]["run"] == parts[k]["run"]:
                        e += 1
                    whole += join_tree(enc, [p["ids"] for p in parts[k:e]])
                    k = e
                out.append(np.asarray(whole, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(out)], ["id", "ids"])

    is_long = F.coalesce(F.length("text") >= long_text, F.lit(False))
    plain = docs.where(~is_long).mapInArrow(short, f"id {id_type}, ids array<int>")
    parts = docs.where(is_long).mapInArrow(cut, f"key bigint, id {id_type}, seq int, run int, part string")
    width = shuffle_width(docs.sparkSession)
    encoded = parts.repartition(width, "key", "seq").mapInArrow(encode, f"key bigint, id {id_type}, seq int, run int, ids array<int>")
    whole = (
        encoded.groupBy("key")
        .agg(F.first("id").alias("id"), F.collect_list(F.struct("seq", "run", "ids")).alias("parts"))
        .select("id", "parts")
        .mapInArrow(join, f"id {id_type}, ids array<int>")
    )
    return plain.unionByName(whole).withColumnRenamed("id", id_col)
