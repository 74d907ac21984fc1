"""Operator 8, substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import cut, table

#: Bytes the rolling hash sees, its bits that are zero at a cut, least and most bytes of a chunk.
SEEN, CUT_BITS, LEAST, MOST = 16, 4, 16, 96

#: Fewest words of a run of repeated chunks. A passage of over 50 words keeps that many between its first and last cut.
RUN_WORDS = 26

#: Bytes hashed at a time; bounds a worker's memory and changes no result.
PART = 1 << 20

#: Chunks sent to Spark at a time.
SENT = 100_000

_GEAR = np.random.default_rng(2016).integers(0, 1 << SEEN, 256, dtype=np.uint16)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: over the last 16 bytes, each byte's number shifted once per later byte.

    Sums over windows of 1, 2, 4, 8 and 16 bytes, each made of two of the last.
    Numbers have as many bits as bytes are seen, so older ones are shifted out.
    """
    h = _GEAR[data]
    for n in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[n:] = h[:-n] << np.uint16(n)
        h = h + shifted
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes; a cut never falls inside a character.

    A cut follows a byte whose hash starts with ``CUT_BITS`` zeros. Where none
    comes within ``MOST`` bytes, the last of the lowest hashes there is cut at,
    so that monotonous passages are cut alike as well.
    """
    total = len(data)
    low = np.empty(total, np.uint8)
    for a in range(0, total, PART):
        back = min(a, SEEN - 1)
        low[a : a + PART] = rolling(data[a - back : a + PART])[back:] >> np.uint16(8)
    low[:-1][(data[1:] & 0xC0) == 0x80] = 255
    ends, last = [], 0
    for at in [*(np.flatnonzero(low[:-1] < 256 >> CUT_BITS) + 1).tolist(), total]:
        while at - last > MOST:
            window = low[last + LEAST - 1 : last + MOST]
            last += MOST - int(window[::-1].argmin())
            ends.append(last)
        if at - last >= LEAST or at == total and at > last:
            ends.append(at)
            last = at
    return ends


CHUNKS = "doc_id long, span long, digest long"


def _text_chunks(doc: int, raw: bytes) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(raw, np.uint8)
    ends = np.array(cuts(data))
    begins = np.concatenate(([0], ends[:-1]))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    words = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])))))
    digest = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], np.uint64)
    span = (points[begins] << 16) + (points[ends] - points[begins] << 8) + words[ends] - words[begins]
    return np.full(len(ends), doc), span, digest.view(np.int64)


def _frame(found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    return pd.DataFrame({name: np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k, name in enumerate(names)})


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of every whole text: its digest, and its start and length in code points and its words in one number."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, held = [], 0
            for doc, text in zip(pdf["_id"], pdf["_text"]):
                if text:
                    found.append(_text_chunks(int(doc), text.encode()))
                    held += len(found[-1][0])
                if held >= SENT:
                    yield _frame(found)
                    found, held = [], 0
            yield _frame(found)

    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(split, CHUNKS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Passages that stand earlier too, in the same or another document: doc_id, start, end, words, kept_in.

    A chunk stays where it first stands in the document with the smallest id;
    the same bytes anywhere else, later in that document too, are repeats. Runs of adjoining repeated
    chunks of at least ``run_words`` words are returned, with the smallest
    document that keeps one of their chunks. Cuts depend on the 32 bytes before
    them only, so what is inserted earlier moves no cut of a passage beyond its
    edges. Documents without repeats have no row.

    Null texts, empty texts and rows with a null id have no chunks; an id names
    one document, whose rows are read as one text; other columns are not read;
    an empty table gives no rows. Digests have 64 bits: a run is several chunks,
    and would need all of them to collide in a row. Chunks are joined with one
    row per repeated digest, so its frequency never multiplies rows, and the
    join can split it.
    """
    parts = chunks(docs, id_col, text_col)
    place = F.struct("doc_id", "span")
    held = parts.groupBy("digest").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first < _last")
    held = cut(held.select("digest", F.col("_first.doc_id").alias("kept_in"), F.col("_first.span").alias("_kept")))
    again = parts.join(held, "digest").filter("doc_id > kept_in or span > _kept").select("doc_id", "span", "kept_in").distinct()
    start = F.shiftright("span", 16)
    placed = again.select("doc_id", start.alias("start"), (start + F.shiftright("span", 8).bitwiseAND(F.lit(255))).alias("end"), F.col("span").bitwiseAND(F.lit(255)).alias("words"), "kept_in")
    order = W.partitionBy("doc_id").orderBy("start", "end", "kept_in")
    breaks = F.when(F.lag("end").over(order) == F.col("start"), 0).otherwise(1)
    runs = placed.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(order))
    spans = runs.groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("kept_in").alias("kept_in"))
    return spans.filter(F.col("words") >= run_words).select("doc_id", "start", "end", "words", "kept_in")


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
