"""Operator 1: substring dedup by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _STEP, Words, free_name, materialise, mix, quoted, segment_sums, slices, spread_join, table

#: Words after which a long sentence is cut, and sentences in a span.
CUT, RUN = 10, 3
#: A long sentence is cut before a word whose hash is the least among so many words on each side.
NEAR = 3
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Sentences:
    """Sentences of a run of texts; one of more than CUT words counts as several, each of CUT words at most.

    Its words say where it is cut, so a passage is cut in the same way whatever stands before it, but for its edges.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        w = Words(data, offsets)
        n = len(w.start)
        self.row = np.zeros(0, np.int64)
        self.begin = self.code = np.zeros(0, np.int64)
        if n:
            lines = np.cumsum(data == 10)
            last = np.ones(n, bool)
            last[:-1] = (w.row[1:] != w.row[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1] - 1])
            last |= _STOP[data[w.end - 1]]
            opens = np.flatnonzero(np.r_[True, last[:-1]])
            size = np.diff(np.append(opens, n))
            place, size = np.arange(n) - np.repeat(opens, size), np.repeat(size, size)
            least = (size > CUT) & (place >= NEAR) & (place + NEAR < size)
            for i in range(1, NEAR + 1):
                least[i:] &= w.code[i:] <= w.code[:-i]
                least[:-i] &= w.code[:-i] <= w.code[i:]
            opens = np.flatnonzero(least | (place == 0))
            place = np.arange(n) - np.repeat(opens, np.diff(np.append(opens, n)))
            first = np.flatnonzero(place % CUT == 0)
            self.row = w.row[first]
            self.begin = w.start[first]
            self.code = mix(np.add.reduceat(w.code * _STEP[place % CUT], first))
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(first sentence, hash as signed) of every span of RUN sentences of one text, however short."""
        m = len(self.row) - RUN + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = sum(self.code[i : m + i] * _STEP[20 + i] for i in range(RUN))
        ok = np.flatnonzero(self.row[:m] == self.row[RUN - 1 :])
        return ok, mix(h[ok]).view(np.int64)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, data, offsets in slices(batch.column(1)):
            s = Sentences(data, offsets)
            at, h = s.spans()
            rows = s.row[at]
            ids = batch.column(0).take(pa.array(rows + i))
            place = pa.array((at - s.first[rows]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, place, pa.array(h)], names=["id", "at", "h"])


def _cutter(text_at: int, names: list[str]):
    """Cuts the sentences covered by the marked spans; the last column of the input has the marks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, marks = batch.column(text_at), batch.column(batch.num_columns - 1)
            for i, j, data, offsets in slices(column):
                part = marks.slice(i, j - i)
                lengths = np.asarray(part.value_lengths().fill_null(0))
                rows = np.repeat(np.arange(j - i), lengths)
                flat = part.flatten()
                s = Sentences(data, offsets)
                start, h = s.spans()
                hash_at = np.zeros(len(s.row), np.int64)
                known = np.zeros(len(s.row), bool)
                hash_at[start], known[start] = h, True
                at, want = np.asarray(flat.field("at")).astype(np.int64), np.asarray(flat.field("h"))
                inside = at < np.diff(s.first)[rows] if len(rows) else np.zeros(0, bool)
                where = (s.first[rows] + at)[inside]
                # rows of one id may have different texts: a mark holds only where the span is the same
                where = where[known[where] & (hash_at[where] == want[inside])]
                step = np.zeros(len(s.row) + 1, np.int64)
                np.add.at(step, where, 1)
                np.add.at(step, np.minimum(where + RUN, len(s.row)), -1)
                covered = np.cumsum(step)[:-1] > 0
                limit = np.append(s.begin[1:], len(data))
                # a sentence reaches to the next one of its text, or to the end of its text
                limit = np.minimum(limit, offsets[1:][s.row]) if len(s.row) else limit[:0]
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, s.begin[covered], 1)
                np.add.at(edge, limit[covered], -1)
                keep = np.cumsum(edge)[:-1] == 0
                size = segment_sums(keep.astype(np.int64), offsets)
                ends = np.zeros(j - i + 1, np.int64)
                np.cumsum(size, out=ends[1:])
                new = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[keep])))
                new = pa.array(new.cast(pa.string()))
                if column.null_count:
                    new = pc.if_else(column.slice(i, j - i).is_null(), pa.scalar(None, pa.string()), new)
                out = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
                out[text_at] = new
                counts = [np.diff(s.first), segment_sums(covered.astype(np.int64), s.first)]
                yield pa.RecordBatch.from_arrays([*out, *[pa.array(c.astype(np.int64)) for c in counts]], names=names)

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the sentences covered by any span of RUN sentences that occurs before, across the whole table.

    A sentence ends at a word that ends in . ! or ?, or at a line feed; one of more than CUT words is cut where its
    words say, and at the latest after CUT words. Sentences are compared word by word, ASCII letters in lower
    case, by 64-bit hashes; spans of short sentences count as any other. The first occurrence, by (id, sentence),
    stays; of the later ones all covered sentences go, with the white space after them. Returns all columns of
    ``docs`` with the new text, and ``__sentences`` and ``__removed``, the numbers of sentences before and
    removed; where ``docs`` has such a column, that of the counts has more underscores (``free_name``).

    A first aggregation of (hash, count) with map-side combine finds repeated spans; only their occurrences go
    on, those of a hot hash dealt to several tasks, so no group is gathered. Texts of fewer sentences than a span
    stay as they are, null stays null, a very long text is one row of marks, rows that share an id are versions of
    one document (equal ones come out equal), a null id comes first, and an empty table gives an empty table.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).where("text IS NOT NULL")
    spans = spans.mapInArrow(_spans, f"id {id_type}, at int, h long")
    often = materialise(spans.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    again = materialise(spread_join(spans, often, ["h"], ["id", "at"]), "spans")
    first = again.groupBy("h").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n"))
    later = spread_join(again, materialise(first, "first"), ["h"], ["id", "at"]).where("NOT (struct(id, at) <=> first)")
    marks = later.select("id", "at", "h").distinct().groupBy("id").agg(F.collect_list(F.struct("at", "h")).alias("marks"))
    # columns by number, so that no name of the table can meet one of ours
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    both = numbered.join(marks, numbered[f"c{id_at}"].eqNullSafe(marks["id"]), "left").select(*numbered.columns, "marks")
    counts = [free_name(c, docs.columns) for c in ("__sentences", "__removed")]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return both.mapInArrow(_cutter(text_at, [f.name for f in schema.fields]), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__sentences").alias("n_sentences"), F.col("__removed").alias("n_removed"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
