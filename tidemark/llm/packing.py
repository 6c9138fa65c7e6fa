"""Operator 9, best-fit packing: sum-of-squares packing of token pieces into sequences.

A document's ids, its end id included, are cut into pieces only if they are more than a sequence holds; then the first
piece takes what is over and all others are full. Full pieces are sequences of their own. The rest are dealt evenly to
shards of about ``SHARD`` pieces, whatever their keys are, and each shard packs its pieces from long to short: a piece
goes to the open sequence for which the sum, over all residual gaps, of the squared number of open sequences with that
gap becomes smallest; it opens a new one only where it fits into none. Each shard leaves a few sequences open at most.

Texts stay where they are: only lengths and checksums move, token ids just where a caller asks for them.

Ids are those of the ``tokenizers`` vocabulary. The same merges in ``tiktoken`` give the same ids several times faster
(the tests compare both for every character), so that encoder is used wherever no special token's text occurs and no run
of white space is so long that its regular expressions would run out of stack.

Null text is empty: one piece with the end id alone. Repeated rows and ids are pieces of their own. An empty table gives
an empty one. Columns that ``parts`` has keep their names; a new one of the same name gets an underscore more.
"""

from __future__ import annotations

import base64
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from .arrow import fresh, prepare, table
from .scratch import Scratch

CAPACITY, END = 1024, 2
#: Pieces that one shard packs.
SHARD = 4096
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: White space of which the fast encoder, which backtracks over it, is given less.
LONG_BLANK = 10_000
_BLANKS = re.compile(rf"\s{{{LONG_BLANK}}}")


class Encoder:
    """Ids of texts by a byte-level vocabulary; loaded once a worker."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        if vocabulary not in cls._loaded:
            cls._loaded[vocabulary] = cls(vocabulary)
        return cls._loaded[vocabulary]

    def ids(self, text: str | None) -> list[int]:
        text = text or ""
        slow = SPECIAL in text or (len(text) >= LONG_BLANK and _BLANKS.search(text))
        return self.exact.encode(text, add_special_tokens=False).ids if slow else self.fast.encode_ordinary(text)


def pieces(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of each piece; all but the first are full."""
    first = len(ids) % capacity or min(len(ids), capacity)
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each piece, sequences numbered from 0; no length is above ``capacity``."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        fits = np.flatnonzero(count[s:capacity])
        if len(fits):
            # what the sum of squares changes by, less what is the same for all; a full sequence is open no more
            change = -2 * count[s + fits] + np.where(fits > 0, 2 * count[fits] + 1, 0)
            left = int(fits[change.argmin()])
            gap = s + left
            count[gap] -= 1
            k = stacks[gap].pop()
        else:
            gap, k = capacity, opened
            left = capacity - s
            opened += 1
        sequence[i], offset[i] = k, capacity - gap
        if left:
            count[left] += 1
            stacks[left].append(k)
    return sequence, offset


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32)`` of every piece, and its ``ids`` if asked for."""
    prepare(docs.sparkSession)
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField(*f) for f in fields])))
    def cut(texts: pd.Series) -> pd.Series:
        encode, out = Encoder.of(vocabulary).ids, []
        for text in texts:
            ids, rows = np.array([*encode(text), end], "<u4"), []
            for k, (a, n) in enumerate(pieces(ids, capacity)):
                part = ids[a : a + n]
                rows.append({"piece": k, "start": a, "length": n, "ids_crc32": zlib.crc32(part.tobytes())} | ({"ids": part.tolist()} if with_ids else {}))
            out.append(rows)
        return pd.Series(out)

    return docs.select(id_col, F.explode(cut(text_col)).alias("_p")).select(id_col, *[f"_p.{name}" for name, _ in fields])


def pack(parts: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """``parts``, which have a ``length`` of 1 to ``capacity``, with ``sequence_id`` and ``offset`` more."""
    # the row's place in a written table: it deals pieces out evenly even if all keys are equal
    row, shard, sequence_id, offset = (fresh(parts, c) for c in ("_row", "_shard", "sequence_id", "offset"))
    numbered = scratch.cut(parts.withColumn(row, F.monotonically_increasing_id()))
    full, short = numbered.where(F.col("length") == capacity), numbered.where(F.col("length") < capacity)
    shards = max(1, math.ceil(short.count() / SHARD))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, ignore_index=True)
        sequence, at = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(**{sequence_id: (key[0] << 32) + sequence, offset: at}).drop(columns=[row, shard])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + f", `{sequence_id}` long, `{offset}` long"
    dealt = short.withColumn(shard, F.pmod(F.xxhash64(row), F.lit(shards)))
    whole = full.select(*parts.columns, (-1 - F.col(row)).alias(sequence_id), F.lit(0).cast("long").alias(offset))
    return whole.unionByName(dealt.groupBy(shard).applyInPandas(place, schema))


def pack_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return pack(tokenized_pieces(docs), scratch)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
