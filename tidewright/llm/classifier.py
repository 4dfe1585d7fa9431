"""Quality classifier: hashed word n-grams, logistic loss, follow-the-regularised-leader.

Words are cut where letters meet other signs, hashed in place, and each text is
a sparse row: its words and its word pairs, hashed into a fixed number of
coordinates, and beside these n-grams LAGS coordinates that tell no word: how
often a word comes again one to eight words later.  (Texts whose fault is
repetition have no words of their own; README has the figures with and without.)
Training runs on shards of a bounded sample of labelled rows; each shard applies
per-coordinate FTRL updates, the shards' states are averaged, and the next
round goes on from there.  Scoring is one pass of sparse dot products.

Defined results: a null or empty text has the bias alone as its score; a very
long text is one row, its values divided by its length; rows whose doc_id is
null are scored and are not held out; a label row without a document, or with a
null label, is not used; without any usable label every score is 0.5; repeated
rows count once each; an empty table gives no rows; extra columns are not read
by scores and kept by keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkernel import byte_symbols, chunks, flat, mix, prefix_hash, span_hash, token_bounds

#: Coordinates of the model (a power of two); 2 MB of weights as float64.
DIMENSIONS = 1 << 18
#: Labelled rows that training uses at most, those of the least hash: the documented bound of the fit.
SAMPLE_ROWS = 12_000
SHARDS, ROUNDS, SLICES = 6, 3, 16
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1.0
LAGS = 8
SCALE = 8.0
SCORES = "doc_id bigint, held_out boolean, score double, predicted int"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, coordinate and value of all n-grams and repetitions; a coordinate may come several times in a row."""
    buf, off = flat(texts)
    starts, ends, first = token_bounds(buf, off)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word = span_hash(prefix_hash(byte_symbols(buf)), starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows, grams = [row], [word]
    same = row[1:] == row[:-1]
    rows.append(row[1:][same])
    grams.append(mix(word[:-1][same] * np.uint64(3) + word[1:][same]))
    for lag in range(1, min(LAGS, n - 1) + 1):
        at = (word[lag:] == word[:-lag]) & (row[lag:] == row[:-lag])
        rows.append(row[lag:][at])
        grams.append(np.full(int(at.sum()), mix(np.array([lag], np.uint64))[0], np.uint64))
    rows_all = np.concatenate(rows)
    size = np.diff(first).astype(float)
    value = SCALE / np.maximum(size, 8)[rows_all]
    return rows_all, (np.concatenate(grams) >> np.uint64(46)).astype(np.int64) & (DIMENSIONS - 1), value


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader in closed form."""
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def learn(z: np.ndarray, n: np.ndarray, texts: pa.Array, labels: np.ndarray) -> None:
    """FTRL over the rows in order, in place; the last coordinate is the bias."""
    rows, at, value = features(texts)
    order = np.argsort(rows, kind="stable")
    at, value = at[order], value[order]
    cut = np.searchsorted(rows[order], np.arange(len(texts) + 1))
    for i, y in enumerate(labels):
        part = slice(cut[i], cut[i + 1])
        idx, back = np.unique(at[part], return_inverse=True)
        x = np.bincount(back, weights=value[part], minlength=len(idx))
        idx, x = np.append(idx, DIMENSIONS), np.append(x, 1.0)
        w = weights(z[idx], n[idx])
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
        z[idx] += g - sigma * w
        n[idx] += g * g


def _on_shard(start):  # start: broadcast state, or None in the first round
    def run(table):
        z, n = (x.copy() for x in start.value or (np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)))
        table = table.sort_by([("place", "ascending"), ("text", "ascending")])
        for batch in chunks(iter(table.combine_chunks().to_batches())):
            learn(z, n, batch.column(2), np.asarray(batch.column(3)))
        cut = lambda x: pa.array([s.tobytes() for s in np.array_split(x, SLICES)], pa.binary())
        return pa.table({"shard": pa.array([table["shard"][0].as_py()] * SLICES, pa.int32()), "slice": pa.array(range(SLICES), pa.int32()), "rows": [table.num_rows] * SLICES, "z": cut(z), "n": cut(n)})

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """One slice of the shards' states, weighted by their rows, so that the driver gets one state however many shards there are."""
    table = table.sort_by("shard")
    mean = lambda x: pa.array([np.average([np.frombuffer(s) for s in table[x].to_pylist()], axis=0, weights=table["rows"].to_numpy()).tobytes()], pa.binary())
    return pa.table({"slice": table["slice"].slice(0, 1), "z": mean("z"), "n": mean("n")})


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights (DIMENSIONS and the bias) from at most `sample_rows` labelled rows.

    The sample's ids (a bounded list) are sent to the scan, so no text is shuffled but the sample's.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.select((F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))).cast("int").alias("shard"), F.xxhash64("doc_id", F.lit(7)).alias("place"), "text", F.col("quality").cast("double").alias("label"))
    state: tuple[np.ndarray, np.ndarray] | None = None
    sample = sample.persist()
    try:
        for _ in range(ROUNDS):
            start = spark.sparkContext.broadcast(state)
            parts = sample.groupBy("shard").applyInArrow(_on_shard(start), "shard int, slice int, rows bigint, z binary, n binary").groupBy("slice").applyInArrow(_averaged, "slice int, z binary, n binary").collect()  # one state, 4 MB
            start.unpersist()
            if not parts:
                break
            parts.sort(key=lambda p: p["slice"])
            state = tuple(np.concatenate([np.frombuffer(p[k]) for p in parts]) for k in ("z", "n"))
    finally:
        sample.unpersist()
    return weights(*state) if state is not None else np.zeros(DIMENSIONS + 1)


def score(docs: DataFrame, model: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """Score of every whole text, as one sparse dot product each; other columns don't enter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in chunks(batches):
            rows, at, value = features(batch.column(2))
            margin = np.bincount(rows, weights=w[at] * value, minlength=batch.num_rows) + w[DIMENSIONS]
            p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = docs["doc_id"].cast("bigint")
    return docs.select(doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"), docs["text"]).mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, model: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in chunks(batches, docs_text):
            rows, at, value = features(batch.column(at_text))
            margin = np.bincount(rows, weights=w[at] * value, minlength=batch.num_rows) + w[DIMENSIONS]
            keep = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) >= threshold
            yield batch.filter(pa.array(keep))

    docs_text = docs.columns[at_text]
    return docs.mapInArrow(run, docs.schema)
