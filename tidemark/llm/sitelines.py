"""Lines repeated across the documents of one source (problem 6).

Every line is brought to its *form* (lower case, no 0-9, white space collapsed), and the form's bytes are cut into
content-defined chunks: a cut stands where a 16-byte rolling gear hash hits a mask, restarted at each line, so equal
forms give equal chunks wherever they stand. Distinct documents are counted per (source, chunk); a line can only be
repeated excessively if all its chunks are, so lines with a rare chunk are ruled out without ever moving their text.
Only narrow keys of lines ever move: a line is looked up by its first and its last chunk among those of its source, which
spreads a large source over all its chunks. The lines left are confirmed: distinct documents per (source, form), forms by
128 bits of hash.

Defined results: null or blank contents, null sources and lines with an empty form have no rows; copies of a row count
once (documents are distinct ids); other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map
from tidemark.llm.rolling import Rolling, byte_table
from tidemark.session import cut_lineage

#: Bytes of the rolling window, which are also the least size of a chunk.
WINDOW = 16
#: A cut about every 2**CUT_BITS bytes beyond the window.
CUT_BITS = 6
MIN_IDS = 3
MIN_SHARE = 0.05
#: Excessive chunks are broadcast up to this many rows (about 50 bytes each).
BROADCAST_ROWS = 200_000

_SPACES = [c for c in map(chr, [*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_RUN = re.compile(" {2,}")


GEAR = byte_table(b"gear", np.uint32)


def forms(text: str) -> list[str]:
    """The form of each line of ``text``; lines are the pieces between newlines."""
    s = text.lower()
    for d in "0123456789":
        s = s.replace(d, "")
    for c in _SPACES:
        if c in s:
            s = s.replace(c, " ")
    if "  " in s:
        s = _RUN.sub(" ", s)
    return [x.strip(" ") for x in s.split("\n")]


def chunk_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each content-defined chunk of ``lines`` and the index of its line; empty lines have none."""
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([len(x) for x in raw], np.int64)
    keep = np.flatnonzero(size)
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    n = len(buf)
    h = GEAR[buf]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    ends = np.cumsum(size)[keep]
    starts = ends - size[keep]
    line_of = np.repeat(keep, size[keep])
    inside = np.arange(n) - np.repeat(starts, size[keep])
    left = np.repeat(ends, size[keep]) - np.arange(n)
    cut = ((h >> np.uint32(32 - CUT_BITS)) == 0) & (inside >= WINDOW) & (left >= WINDOW)
    at = np.flatnonzero(cut)
    begin = np.union1d(starts, at)
    end = np.append(begin[1:], n)
    return Rolling(buf).of(begin, end), line_of[begin]


def chunk_rows(articles: DataFrame) -> DataFrame:
    """(source_uri, id_hash, chunk): the distinct chunks of each document."""
    src = articles.where("source_uri is not null and content is not null and id is not null").select(F.xxhash64("id").alias("h"), "source_uri", "content")

    def run(b: pa.RecordBatch):
        flat, owner = [], []
        for i, t in enumerate(b["content"].to_pylist()):
            lines = forms(t)
            flat += lines
            owner.append(np.full(len(lines), i))
        chunks, line = chunk_hashes(flat)
        doc = np.concatenate(owner)[line] if len(line) else line
        pair = np.unique(np.stack([doc, chunks], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        take = pa.array(pair[:, 0])
        return {"source_uri": b["source_uri"].take(take), "h": b["h"].take(take), "chunk": pa.array(pair[:, 1])}

    return arrow_map(src, run, "source_uri string, h long, chunk long")


def distinct_ids(articles: DataFrame) -> DataFrame:
    """(source_uri, n_ids): distinct ids of each source, over all its rows."""
    return (
        articles.where("source_uri is not null and id is not null").select("source_uri", F.xxhash64("id").alias("h"))
        .dropDuplicates().groupBy("source_uri").agg(F.count(F.lit(1)).alias("n_ids"))
    )


def _excessive(counts: DataFrame, sizes: DataFrame, min_ids: int, share: float) -> DataFrame:
    # in whole numbers: a share of exactly 5 % must not be lost to rounding
    return counts.join(sizes, "source_uri").where((F.col("n") >= min_ids) & (F.col("n") * 1_000_000 >= F.lit(round(share * 1_000_000)) * F.col("n_ids")))


def line_keys(articles: DataFrame) -> DataFrame:
    """(source_uri, id, line_no, f1, f2, first, last): every non-empty line by the hash of its form and its outer chunks."""
    src = articles.where("source_uri is not null and content is not null and id is not null").select("id", "source_uri", "content")

    def run(b: pa.RecordBatch):
        flat, owner, number = [], [], []
        for i, t in enumerate(b["content"].to_pylist()):
            lines = forms(t)
            flat += lines
            owner += [i] * len(lines)
            number += range(1, len(lines) + 1)
        chunks, line = chunk_hashes(flat)
        rows, first, n = np.unique(line, return_index=True, return_counts=True)
        take = pa.array(np.asarray(owner, np.int64)[rows])
        form = np.frombuffer(b"".join([xxhash.xxh3_128_digest(flat[r].encode("utf-8", "surrogatepass")) for r in rows.tolist()]), np.int64).reshape(-1, 2)
        return {
            "source_uri": b["source_uri"].take(take), "id": b["id"].take(take), "line_no": pa.array(np.asarray(number, np.int32)[rows]),
            "f1": form[:, 0], "f2": form[:, 1], "first": chunks[first], "last": chunks[first + n - 1],
        }

    return arrow_map(src, run, "source_uri string, id string, line_no int, f1 long, f2 long, first long, last long")


def _small(measured: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if ``measured`` has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if measured.count() <= BROADCAST_ROWS else df


def p6_found(articles: DataFrame, min_ids: int = MIN_IDS, share: float = MIN_SHARE) -> DataFrame:
    """Lines (id, line_no) whose form stands in at least ``min_ids`` ids and ``share`` of the ids of the source.

    The excessive chunks of a source number at most its chunks per document divided by ``share``. They are materialised
    once and counted; while they are few they travel to the lines, so that only candidate lines are ever shuffled.
    """
    sizes = cut_lineage(distinct_ids(articles))
    counts = chunk_rows(articles).dropDuplicates(["source_uri", "chunk", "h"]).groupBy("source_uri", "chunk").agg(F.count(F.lit(1)).alias("n"))
    often = cut_lineage(_excessive(counts, sizes, min_ids, share).select("source_uri", "chunk"))
    # a line whose form is excessive has no other chunks, so its first and its last one are among them
    lines = line_keys(articles)
    for c in ("first", "last"):
        lines = lines.join(_small(often, often.withColumnRenamed("chunk", c)), ["source_uri", c], "left_semi")
    whole = cut_lineage(lines.select("source_uri", "id", "line_no", "f1", "f2"))
    exact = whole.select("source_uri", "f1", "f2", F.xxhash64("id").alias("h")).dropDuplicates().groupBy("source_uri", "f1", "f2").agg(F.count(F.lit(1)).alias("n"))
    frequent = cut_lineage(_excessive(exact, sizes, min_ids, share).select("source_uri", "f1", "f2"))
    return whole.join(_small(frequent, frequent), ["source_uri", "f1", "f2"]).select("id", "line_no").dropDuplicates()


def cleaned(articles: DataFrame, found: DataFrame) -> DataFrame:
    """(id, content): each document without its found lines; documents without any stay as they are."""
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    a = articles.select("id", "content").join(gone, "id", "left")
    kept = F.filter(F.split("content", "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), (i + 1).cast("int")))
    return a.select("id", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"))
