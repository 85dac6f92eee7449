"""Operator 13: token counts of whole texts by public tokenizers, lengths only."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, quoted, segment_sums, slices, table

#: Bytes of text that are encoded at once, and bytes from which on a text is split.
BATCH_BYTES, PIECE_BYTES = 256 << 10, 64 << 10
#: Tokens beyond which a document is marked.
LIMIT = 1024
#: No token reaches over the place between a visible character and the space or line feed after it.
_SAFE = re.compile(r"(?<=\S)[ \n]")
#: The same with one space between visible characters, which goes: the model sets one before each text of its own.
_SAFE_PIECES = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


# ---------------------------------------------------------------- encoders


@lru_cache(maxsize=4)
def _encoder(kind: str, vocabulary: bytes):
    """A function from a list of strings to the list of their token counts; kept by the worker between tasks."""
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_buffer(vocabulary)
        model.no_truncation()
        model.no_padding()
        encode = getattr(model, "encode_batch_fast", model.encode_batch)
        return lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if kind == ".tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(ids) for ids in model.encode_ordinary_batch(texts, num_threads=1)]
    raise ValueError(f"no tokenizer is known for {kind!r} files")


def pieces(text: str, kind: str, size: int = PIECE_BYTES) -> list[str]:
    """A text in pieces of some ``size`` characters, cut only where no token can reach over: before a space or line
    feed that follows a visible character (for ``.model`` files at one space between visible characters, which goes).
    A stretch without such a place stays whole, however long."""
    safe = _SAFE_PIECES if kind == ".model" else _SAFE
    out, start = [], 0
    while len(text) - start > size:
        found = safe.search(text, start + size)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.end() if kind == ".model" else found.start()
    out.append(text[start:])
    return out


# ---------------------------------------------------------------- operator


def _counts(kind: str, vocabulary: bytes):
    """Batches whose last column is the text; in its stead come its bytes and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(kind, vocabulary)
        for batch in batches:
            sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in slices(batch.column(batch.num_columns - 1), BATCH_BYTES):
                raw = data.tobytes()
                held, parts = np.zeros(len(offsets), np.int64), []
                for i in range(len(offsets) - 1):
                    text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                    parts += pieces(text, kind) if len(text) > PIECE_BYTES else [text]
                    held[i + 1] = len(parts)
                # a long text is alone in its slice and encoded a few pieces at a time
                lengths = [n for at in range(0, len(parts), 1024) for n in _bounded(encode, parts[at : at + 1024])]
                sizes.append(np.diff(offsets))
                tokens.append(segment_sums(np.asarray(lengths, np.int64), held))
            others = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "n_bytes", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens))], names=names)

    return run


def _bounded(encode, parts: list[str]) -> Iterator[int]:
    """Lengths of the parts, encoded in runs of some BATCH_BYTES, so that what the library holds at a time is bounded."""
    run, held = [], 0
    for part in parts:
        if run and held + len(part) > BATCH_BYTES:
            yield from encode(run)
            run, held = [], 0
        run.append(part)
        held += len(part)
    yield from encode(run) if run else ()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, by the tokenizer in the file ``vocabulary``.

    ``.json`` files are read by tokenizers, ``.model`` files by sentencepiece, ``.tiktoken`` files by tiktoken. Nothing is
    added before or after a text, no text is cut or filled up, and the strings of special tokens inside texts are taken as the library
    does by default. The file (some MB) is read once on the driver and sent with the tasks. There is no shuffle: ids and
    texts go to Arrow batches, which are encoded in runs of BATCH_BYTES; a text over PIECE_BYTES is split at places that no
    token reaches over, and its lengths are added up. Only lengths come back.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Bytes that are no UTF-8 count as themselves in n_bytes and
    are encoded as replacement characters. Rows that repeat, or share an id, or have none, keep a row each; other columns are not
    read, whatever their names; an empty table gives an empty table.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(_counts(os.path.splitext(vocabulary)[1], content), schema)
    name = free_name(id_col, ["n_bytes", "n_tokens", "over_limit"])
    return counted.select(F.col("id").alias(name), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE_SQL: dict[str, str] = {}
