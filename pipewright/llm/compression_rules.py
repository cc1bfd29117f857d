"""Quality rules by compression bands (operator 6).

Whole documents and fixed chunks are compressed with zstandard. A ratio below its band means
repetition, one above it text that is close to random. Short texts carry more overhead, so the
limits depend on the length, of documents and of chunks alike. Simple counts of words, symbols, lines and repeated windows come with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import table
from .wordhash import Words, chunks, windows

LEVEL = 3
CHUNK = 2048  # bytes
# Fixed values: (least bytes, lowest ratio, highest ratio); below the first, no limit.
BANDS = ((128, 0.30, 1.05), (256, 0.28, 0.90), (512, 0.28, 0.82), (1024, 0.25, 0.75), (2048, 0.22, 0.70), (4096, 0.20, 0.66), (16384, 0.18, 0.64))
BAD_CHUNKS = 0.3  # of a text's bytes may lie in chunks outside their band
MIN_WORDS = 50
MAX_REPEATED = 50  # percent
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def band(size: int) -> tuple[float, float]:
    """The limits of the compression ratio for a text of ``size`` bytes."""
    return next(((lo, hi) for least, lo, hi in reversed(BANDS) if size >= least), (0.0, float("inf")))


def _verdicts(data: bytes, bounds: list[int]) -> tuple[list[float], list[float], list[bool]]:
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    ratios, bad, kept = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        text, out = data[a:b], 0
        ratio = len(press(text)) / (b - a) if b > a else 0.0
        lo, hi = band(b - a)
        fits = lo <= ratio <= hi
        for at in range(0, b - a, CHUNK) if b - a > CHUNK else ():
            chunk = text[at : at + CHUNK]
            low, high = band(len(chunk))
            out += 0 if low <= len(press(chunk)) / len(chunk) <= high else len(chunk)
        ratios.append(ratio)
        bad.append(out / (b - a) if b - a > CHUNK else float(not fits))
        kept.append(fits and out <= BAD_CHUNKS * (b - a))
    return ratios, bad, kept


def assess(docs: DataFrame) -> DataFrame:
    """Counts, compression ratios and verdict of every row of ``docs`` (doc_id, text; other columns are not read).

    A null or empty text has no words, ratio 0 and fails for want of words. Whole texts are compressed whatever
    their length, and so is every chunk, the last one against the band of its own size; a text of a single chunk is that chunk.
    ``bad_chunks`` is the share of the text's bytes in chunks outside their bands. Repeated rows and ids are
    judged one by one; a ratio on a limit passes. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                data, bounds = words.data, words.offsets
                per = lambda mask: (lambda c: c[bounds[1:]] - c[bounds[:-1]])(np.concatenate([[0], np.cumsum(mask)]))
                h, row = windows(words, 3)
                # the windows of a row start at its words in turn
                at = np.concatenate([np.arange(a, b - 2) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True) if b - a > 2] or [np.zeros(0, np.int64)])
                _, which, times = np.unique(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
                again = at[times[which] > 1]
                covered = np.zeros(len(words.start), bool)
                for k in range(3):
                    covered[again + k] = True
                repeated = np.bincount(words.rows()[covered], minlength=part.num_rows)
                raw = data.tobytes()
                ends = bounds.tolist()
                dup = []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
                    dup.append(len(lines) - len(set(lines)))
                ratio, bad, kept = _verdicts(raw, ends)
                n = words.counts
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
                columns = [
                    part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(per(words.solid & ((data & 0xC0) != 0x80)).astype(np.int64)), pa.array(per(_SYMBOL[data]).astype(np.int64)),
                    pa.array(dup, pa.int64()), pa.array(repeated.astype(np.int64)), pa.array(failed), pa.array(~failed & np.array(kept, bool)), pa.array(ratio, pa.float64()), pa.array(bad, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    long, flag, real = T.LongType(), T.BooleanType(), T.DoubleType()
    kinds = [docs.schema["doc_id"].dataType, long, long, long, long, long, flag, flag, real, real]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(NAMES, kinds, strict=True)]))


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks"]


def op6_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``assess`` of the whole table; nulls and empty tables as there."""
    return assess(table(spark, sf_dir, "documents"))
