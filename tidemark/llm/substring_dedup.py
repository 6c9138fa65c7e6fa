"""Operator 10, substring dedup: count-min prefilter, then exact groups of the windows that it lets through.

A window is ``WIDTH`` consecutive words. Each word that lies in a window whose word sequence also starts in a document
with a smaller id goes.

0. Rows are packed into batches of some megabytes of text, compressed and written once; all later steps read these, and
   name a row by its batch and its number there.
1. Each batch sketches its own windows (each once a document) and sends, per segment of the sketch, the sorted cells it
   hit as byte planes of their gaps: about a byte a window and sketch row. Segments merge by key, and each answers every
   batch with a bit for each of that batch's cells: counted twice or more. So neither a task nor the driver ever holds
   the whole sketch, which has ``CELLS`` cells a window and row however large the corpus is. A sketch only overestimates.
2. Windows with all bits set are grouped exactly, by a 96-bit hash. A batch first groups its own: only its smallest
   document with a window needs to be known elsewhere, so a passage of a third of all documents sends one entry a batch,
   and the others are already known to go. Entries travel sorted by hash in packed columns, a shard of the hash range each,
   about 13 bytes an entry instead of a row of 36.
3. Positions to remove travel packed in the same way back to their batches, where the words are cut.

Null text has no words. A null id has no order: its text neither loses words nor takes them from others. Rows of one id
do not remove each other's words; each keeps its own positions. Repeated windows within one document stay. An empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrow import prepare, table
from .scratch import Scratch
from .words import WORD, spans

WIDTH = 13
ROWS = 2
#: Sketch cells per window and row; windows of one shard.
CELLS, SHARD_WINDOWS = 4, 1 << 21
#: Cells of a segment, and bytes of text of a batch: at least and at most. Both grow with the corpus in between.
SEGMENTS, BATCHES = (1 << 22, 1 << 27), (4 << 20, 32 << 20)
#: Bytes of text per window that the sketch is planned for.
BYTES_A_WINDOW = 8


def window_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """128 bits of each window of a whole text in UTF-8, in order: two columns of unsigned longs."""
    joined, starts, ends = spans(text)
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[i:j]) for i, j in zip(starts.tolist(), ends[width - 1 :].tolist())]), "<u8").reshape(-1, 2)


def cells(hashes: np.ndarray, width: int) -> np.ndarray:
    """The cells of windows, one in each row of the sketch, numbered over all rows: first those of row 0."""
    return np.concatenate([(hashes[:, row] % np.uint64(width)).astype(np.int64) + row * width for row in range(ROWS)])


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, lowest first, packed: higher planes hold few different bytes."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes())


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def runs(values: np.ndarray):
    """``(first, last + 1)`` of each run of equal values."""
    cuts = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(values)]) if len(values) else ()


def pack_rows(ids: list[int | None], texts: list[bytes | None]) -> bytes:
    """The rows of a batch as one value."""
    size = np.array([-1 if t is None else len(t) for t in texts], "<i8")
    known = np.array([i is not None for i in ids], np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(ids)], "<i8").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), size.tobytes(), *filter(None, texts)]))


def unpack_rows(data: bytes) -> tuple[list[int | None], list[bytes | None]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, known, size = np.frombuffer(raw, "<i8", n, 8).tolist(), np.frombuffer(raw, np.uint8, n, 8 + 8 * n).tolist(), np.frombuffer(raw, "<i8", n, 8 + 9 * n)
    ends = 8 + 17 * n + np.maximum(size, 0).cumsum()
    texts = [None if k < 0 else raw[e - k : e] for k, e in zip(size.tolist(), ends.tolist())]
    return [i if k else None for i, k in zip(ids, known)], texts


def _packer(batch_bytes: int):
    def pack(pdfs):
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        for pdf in pdfs:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(None if text is None else text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1] or b"") + 16
                if size >= batch_bytes:
                    yield pd.DataFrame({"batch": [first + made], "data": [pack_rows(ids, texts)]})
                    made, ids, texts, size = made + 1, [], [], 0
        if ids:
            yield pd.DataFrame({"batch": [first + made], "data": [pack_rows(ids, texts)]})

    return pack


def _ordered(data: bytes):
    """Number, id and text of a batch's rows that have both."""
    ids, texts = unpack_rows(data)
    return [(k, i, t) for k, (i, t) in enumerate(zip(ids, texts)) if i is not None and t]


def _sketcher(width: int, segment: int):
    def sketch(pdfs):
        for pdf in pdfs:
            for batch, data in zip(pdf["batch"], pdf["data"]):
                held, out = [np.zeros(0, np.int64)], []
                for _, _, text in _ordered(bytes(data)):
                    h = window_hashes(text)
                    held.append(cells(h[np.unique(h[:, 0], return_index=True)[1]], width))
                at, count = np.unique(np.concatenate(held), return_counts=True)
                for a, b in runs(at // segment):
                    out.append((at[a] // segment, batch, planes(np.diff(at[a:b] % segment, prepend=0).astype("<u4")), np.packbits(count[a:b] > 1).tobytes()))
                yield pd.DataFrame(out, columns=["segment", "batch", "gaps", "twice"])

    return sketch


def _answerer(segment: int):
    def answer(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        """For every batch that hit a segment, in the order of its cells, whether a cell is counted twice or more."""
        once, more = np.zeros(segment, bool), np.zeros(segment, bool)
        for gaps, twice in zip(parts["gaps"], parts["twice"]):
            at = from_planes(gaps, "<u4").cumsum(dtype=np.int64)
            more[at] |= once[at] | np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)).astype(bool)
            once[at] = True
        bits = [np.packbits(more[from_planes(gaps, "<u4").cumsum(dtype=np.int64)]).tobytes() for gaps in parts["gaps"]]
        return pd.DataFrame({"batch": parts["batch"], "segment": parts["segment"], "bits": bits})

    return answer


def _hits(hashes: np.ndarray, width: int, segment: int, answers: dict[int, bytes]) -> np.ndarray:
    """Which windows' cells are all counted twice or more."""
    at, place = np.unique(cells(hashes, width), return_inverse=True)
    yes = np.zeros(len(at), bool)
    for a, b in runs(at // segment):
        yes[a:b] = np.unpackbits(np.frombuffer(answers[int(at[a] // segment)], np.uint8), count=b - a)
    return yes[place].reshape(ROWS, -1).all(0)


_ENTRY = "shard int, batch long, gone boolean, hashes binary, checks binary, row binary, pos binary, docs binary"


def _candidates(width: int, segment: int, shards: int):
    def candidates(key: tuple, packed: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        batch, out = key[0], []
        answers = dict(zip(said["segment"].tolist(), map(bytes, said["bits"])))
        rows = _ordered(bytes(packed["data"].iat[0])) if len(packed) else []
        h = [window_hashes(text) for _, _, text in rows]
        many = [len(x) for x in h]
        row = np.repeat(np.arange(len(rows), dtype="<u4"), many)
        pos = np.concatenate([*(np.arange(n, dtype="<u4") for n in many), np.zeros(0, "<u4")])
        h = np.concatenate([*h, np.zeros((0, 2), "<u8")])
        hit = _hits(h, width, segment, answers)
        h, g, row, pos = h[hit, 0], (h[hit, 1] >> np.uint64(32)).astype("<u4"), row[hit], pos[hit]
        docs, number = np.array([i for _, i, _ in rows], "<i8"), np.array([k for k, _, _ in rows], "<u4")
        order = np.lexsort((docs[row], g, h))
        h, g, row, pos = h[order], g[order], row[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = docs[row] == docs[row[np.flatnonzero(new)[new.cumsum() - 1]]]
        shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
        for a, b in runs(shard[first]):
            own = row[first][a:b]
            out.append((shard[first][a], batch, False, planes(np.diff(h[first][a:b], prepend=np.uint64(0))), g[first][a:b].tobytes(), planes(number[own]), planes(pos[first][a:b]), planes(docs[own])))
        if not first.all():
            out.append((batch % shards, batch, True, b"", b"", planes(number[row[~first]]), planes(pos[~first]), b""))
        return pd.DataFrame(out, columns=["shard", "batch", "gone", "hashes", "checks", "row", "pos", "docs"])

    return candidates


_STARTS = "batch long, row binary, pos binary"


def repeated_starts(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """Of a shard's entries, the window starts to remove, by batch: those whose window has a smaller document."""
    out = [(p.batch, p.row, p.pos) for p in parts[parts["gone"]].itertuples()]
    parts = parts[~parts["gone"]]
    if len(parts):
        columns = [(from_planes(p.hashes, "<u8").cumsum(dtype=np.uint64), np.frombuffer(p.checks, "<u4"), from_planes(p.docs, "<i8"), from_planes(p.row, "<u4"), from_planes(p.pos, "<u4")) for p in parts.itertuples()]
        batch = np.repeat(parts["batch"].to_numpy(), [len(c[0]) for c in columns])
        h, g, doc, row, pos = map(np.concatenate, zip(*columns))
        order = np.lexsort((doc, g, h))
        h, g, doc = h[order], g[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        later = order[doc > doc[np.flatnonzero(new)[new.cumsum() - 1]]]
        later = later[np.lexsort((pos[later], row[later], batch[later]))]
        out += [(batch[later[a]], planes(row[later[a:b]]), planes(pos[later[a:b]])) for a, b in runs(batch[later])]
    return pd.DataFrame(out, columns=["batch", "row", "pos"])


def cut_words(text: bytes | None, starts: np.ndarray, width: int = WIDTH) -> tuple[int, int, str]:
    """Words, words removed, and the kept ones joined by one space, if the windows at ``starts`` go."""
    words = WORD.findall(text or b"")
    if not len(starts):
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.asarray(starts, np.int64))
    edge[at] += 1
    edge[at + width] -= 1
    keep = edge[:-1].cumsum() == 0
    return len(words), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode("utf-8", "surrogatepass")


def cut_batch(key: tuple, packed: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    """The rows of a batch without the words of the windows that go."""
    ids, texts = unpack_rows(bytes(packed["data"].iat[0]))
    row, pos = (np.concatenate([*(from_planes(x, "<u4") for x in gone[c]), np.zeros(0, "<u4")]) for c in ("row", "pos"))
    order = np.argsort(row, kind="stable")
    starts = np.split(pos[order], np.searchsorted(row[order], np.arange(1, len(ids))))
    out = pd.DataFrame([cut_words(t, s) for t, s in zip(texts, starts)], columns=["n_words", "n_removed", "kept"])
    return out.assign(doc_id=pd.array(ids, dtype="Int64"))


def _between(value: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], value))


def dedup_substrings(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", cells_a_window: int = CELLS, batches: tuple[int, int] = BATCHES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``(id_col, n_words, n_removed, kept)`` of every row; ids are integers."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    packed = scratch.cut(rows.mapInPandas(_packer(_between(size >> 20, batches)), "batch long, data binary"))
    windows = size // BYTES_A_WINDOW
    width = max(1024, cells_a_window * windows)
    segment = _between(1 << (ROWS * width >> 12).bit_length(), SEGMENTS)
    shards = min(windows // shard_windows + 1, 1 << 31 - 1)
    parts = packed.mapInPandas(_sketcher(width, segment), "segment long, batch long, gaps binary, twice binary")
    answers = parts.groupBy("segment").applyInPandas(_answerer(segment), "batch long, segment long, bits binary")
    by_batch = packed.groupBy("batch")
    entries = by_batch.cogroup(answers.groupBy("batch")).applyInPandas(_candidates(width, segment, shards), _ENTRY)
    gone = entries.groupBy("shard").applyInPandas(repeated_starts, _STARTS)
    cut = by_batch.cogroup(gone.groupBy("batch")).applyInPandas(cut_batch, "doc_id long, n_words long, n_removed long, kept string")
    return cut.withColumnRenamed("doc_id", id_col)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE = {
    "op10_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL),
g AS (SELECT k, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM s),
f AS (SELECT s, min(doc_id) AS smallest FROM g GROUP BY s),
r AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (s) WHERE smallest < doc_id),
p AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
q AS (SELECT k, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM p ANTI JOIN r USING (k, j) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN q USING (k)
"""
}
