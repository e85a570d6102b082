"""Token counts of whole texts by a given tokenizer, encoded in Arrow batches that return lengths only.

Each task streams Arrow batches (Spark bounds them by rows and bytes). A text longer than a piece is
split at safe boundaries: a single space between two ASCII letters or digits. The model has no piece
with a character other than a space before a space (checked when it is loaded), and it puts a space
before a text, so the pieces' counts add up to the text's. Pieces are encoded in groups of equal
bytes, so memory doesn't depend on the rows in a batch, nor on a text's length as long as it has safe
boundaries; a text or stretch without one (script without spaces, one long run of letters) is encoded
whole, since nothing says where it may be cut.

Defined results: a null text counts as empty (0 bytes, 0 tokens); ids may be null or repeat, every
row gives a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
PIECE_CHARS = 1 << 14
GROUP_CHARS = 1 << 19

_loaded: dict = {}


def load(name: str):
    """The sentencepiece model of that name or path, once in each Python worker."""
    if name not in _loaded:
        import os

        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=name if os.path.isabs(name) else public_tokenizers.path(name))
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        splits = not any("▁" in p.lstrip("▁") for p in pieces)
        one = model.encode("a", out_type=str) == model.encode(" a", out_type=str)[-1:]
        _loaded[name] = model, splits and one
    return _loaded[name]


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text cut at the last safe boundary within every `most` characters; the spaces there go.

    A stretch without one stays whole.
    """
    if len(text) <= most:
        return [text]
    out, start, last = [], 0, -1
    for m in SAFE.finditer(text):
        if m.start() - start > most:
            cut = last if last > start else m.start()
            out.append(text[start:cut])
            start = cut + 1
        last = m.start()
    if len(text) - start > most and last > start:
        out.append(text[start:last])
        start = last + 1
    out.append(text[start:])
    return out


def count_batch(model, splits: bool, texts: list[str | None]) -> np.ndarray:
    counts = np.zeros(len(texts), np.int64)
    group: list[str] = []
    owner: list[int] = []
    held = 0

    def encode() -> None:
        for i, ids in zip(owner, model.encode(group, num_threads=1), strict=True):
            counts[i] += len(ids)

    for i, text in enumerate(texts):
        for p in pieces(text or "", PIECE_CHARS) if splits else [text or ""]:
            group.append(p)
            owner.append(i)
            held += len(p)
            if held >= GROUP_CHARS:
                encode()
                group, owner, held = [], [], 0
    if group:
        encode()
    return counts


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, splits = load(model)
        for b in batches:
            n = count_batch(sp, splits, b.column(1).to_pylist())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), size, pa.array(n), pa.array(n > limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    out = rows.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
