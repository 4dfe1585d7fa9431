r"""Quality rules: base counts of a text, then robust multivariate outliers.

Counts (words, signs, repeated lines and windows) come from one vectorised pass
over each text.  They are transformed to a vector of six; for every language
and source a minimum-covariance-determinant estimate of centre and scatter is
sought from several starts (medians and quartile ranges, and small subsets of
rows) by concentration steps: distances to the present estimate are put in bins,
the bins' moments are summed over all rows (one small aggregate), and the nearest
three quarters give the next estimate.  Of the starts the one of least
determinant goes on.  A subset's scatter is made consistent with normal
variables, the last one by the median distance; spreads below STATS are raised
to it.  A document far from its group's estimate (Mahalanobis) is rejected.

A group of few rows borrows: a language and source of fewer than LEAST_ROWS usable
rows is judged by its language, that by its source, that by all rows.

Defined results: a null or empty text has zero counts and fails the base rule;
null language or source is a group of its own; rows that fail the base rule have
no say in an estimate; a very long text is judged like any other; repeated rows
are judged alike; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.components import looked_up
from tidewright.llm.store import cut
from tidewright.llm.textkernel import IS_WORD, byte_symbols, chunks, flat, mix, owner, prefix_hash, span_hash, windows, word_bounds

#: Fixed values of the base rule: signs, window, least words, greatest share of repeated words in percent.
SYMBOLS, WINDOW, LEAST_WORDS, REPEATED_PERCENT = b"#*$%&|<>", 5, 10, 20
#: Names of the transformed statistics and the least spread that is taken for each.
STATS = {"x_len": 0.6, "x_word": 0.12, "x_sign": 0.35, "x_lines": 0.12, "x_repeat": 0.25, "x_upper": 0.08}
#: Share of rows in the subset; concentration steps of every start, and of the best one; bins of a step; rows below which a group borrows.
SUBSET, START_STEPS, C_STEPS, BINS, LEAST_ROWS = 0.75, 2, 3, 48, 60
#: Starts from small subsets (beside the medians), and rows of such a subset.
SUBSET_STARTS, START_ROWS = 2, 12
#: Squared distance beyond which a document is rejected: of a chi-squared variable with 6 degrees, one in twenty million is larger.
CUTOFF = 45.0
#: Estimates that are broadcast at most; beyond, they are looked up by shuffle.
BROADCAST_GROUPS = 20_000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
SCHEMA = f"doc_id bigint, lang string, source string, {COUNTS}, " + ", ".join(f"{s} double" for s in STATS)


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, and upper-case letters and lines with a word."""
    buf, off = flat(texts)
    n = len(off) - 1
    inside = IS_WORD[buf]
    starts, ends, first = word_bounds(buf, off)
    of = owner(first)
    prefix = prefix_hash(byte_symbols(buf))
    # lines
    cut_at = np.zeros(len(buf) + 1, bool)
    cut_at[off] = True
    cut_at[1:] |= np.concatenate([buf[:-1] == 10, [True]]) if len(buf) else False
    edges = np.flatnonzero(cut_at)
    line_start, line_end = edges[:-1], edges[1:]
    line_end = line_end - (buf[line_end - 1] == 10) if len(line_end) else line_end
    words_before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    worded = words_before[line_end] > words_before[line_start] if len(line_start) else np.zeros(0, bool)
    line_start, line_end = line_start[worded], line_end[worded]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    key = mix(span_hash(prefix, line_start, line_end) + mix(line_doc.astype(np.uint64))) if len(line_start) else np.zeros(0, np.uint64)
    lines = np.bincount(line_doc, minlength=n)
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(line_doc[at], minlength=n)
    # windows that come twice or more in their text
    repeated = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        word = span_hash(prefix, starts, ends)
        gram = windows(word, WINDOW)
        whole = of[: len(gram)] == of[WINDOW - 1 :]
        place = np.flatnonzero(whole)
        gram = mix(gram[place] + mix(of[place].astype(np.uint64)))
        order = np.argsort(gram)
        ranked = gram[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(gram), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, place[twice], 1)
        np.add.at(cover, place[twice] + WINDOW, -1)
        repeated = np.bincount(of[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {
        "n_words": np.diff(first),
        "word_chars": _per_doc(inside & ((buf & 0xC0) != 0x80), off),
        "n_symbols": _per_doc(_IS_SYMBOL[buf], off),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": repeated,
        "lines": lines,
        "upper": _per_doc((buf >= 0x41) & (buf <= 0x5A), off),
    }


def vector(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Transformed statistics, in the order of STATS."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return [
        np.log1p(c["n_words"]),
        np.log(chars / words),
        np.log1p(100 * c["n_symbols"] / chars),
        np.sqrt(c["n_dup_lines"] / np.maximum(c["lines"], 1)),
        np.arcsinh(5 * c["n_repeat_words"] / words),
        np.sqrt(c["upper"] / chars),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and vector of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            c = counts(batch.column(3))
            own = [pa.array(c[name.split()[0]].astype(np.int64)) for name in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *own, *(pa.array(x.astype(float)) for x in vector(c))], [x.split()[0] for x in SCHEMA.split(", ")])

    columns = [docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"]]
    return docs.select(*columns).mapInArrow(run, SCHEMA)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


ESTIMATE = "group bigint, start int, centre array<double>, scatter array<double>, inverse array<double>, spread double"
_STATS = list(STATS)


def _group(level: int):
    """Key of a row's group: by language and source (0), language (1), source (2), or of all rows (3)."""
    lang, source = (F.col(c) if level in of else F.lit(None).cast("string") for c, of in (("lang", (0, 1)), ("source", (0, 2))))
    return F.xxhash64(F.lit(level), lang.isNull(), F.coalesce(lang, F.lit("")), source.isNull(), F.coalesce(source, F.lit("")))


def _below(x: float, degrees: int) -> float:
    """Share of a chi-squared variable of even degrees that is at most x."""
    term, total = 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def consistency(share: float) -> float:
    """How much narrower the nearest share of normal rows is than all of them."""
    low, high, d = 0.0, 200.0, len(STATS)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _below(middle, d) < share else (low, middle)
    return _below(high, d + 2) / share


def _floored(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Inverse of the scatter, directions narrower than the least spreads raised to them; each direction's share of its width; log-determinant."""
    least = np.array(list(STATS.values()))
    width, axis = np.linalg.eigh(scatter / np.outer(least, least))
    axis = axis / least[:, None]
    return (axis / np.maximum(width, 1)) @ axis.T, np.clip(width, 0, 1), float(np.log(np.maximum(width, 1)).sum())


def _median(weights: np.ndarray) -> float:
    """Median of a weighted sum of squared normal variables (Wilson and Hilferty); with six ones that of chi-squared, 5.35."""
    total = weights.sum()
    return max(0.0, total * (1 - 2 * (weights**2).sum() / (9 * total**2)) ** 3) if total else 0.0


def _estimates(group, start, centre: list, scatter: list) -> pd.DataFrame:
    inverse, _, spread = zip(*map(_floored, scatter)) if len(scatter) else ((), (), ())
    return pd.DataFrame({"group": group, "start": start, "centre": [list(c) for c in centre], "scatter": [list(x.ravel()) for x in scatter], "inverse": [list(x.ravel()) for x in inverse], "spread": list(spread)})


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((len(STATS), len(STATS)))
    out[np.triu_indices(len(STATS))] = upper
    return out + out.T - np.diag(np.diag(out))


def _from_quartiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start 0: medians, and quartile ranges as spreads."""
    for pdf in parts:
        q = [np.stack(x) for x in pdf["quartiles"]]
        yield _estimates(pdf["group"].to_numpy(), 0, [x[:, 1] for x in q], [np.diag(((x[:, 2] - x[:, 0]) / 1.349) ** 2) for x in q])


def _from_moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Starts from the sums of small subsets."""
    for pdf in parts:
        centre = [np.asarray(s) / n for s, n in zip(pdf["s1"], pdf["n"])]
        scatter = [_square(np.asarray(s) / n) - np.outer(c, c) for s, n, c in zip(pdf["s2"], pdf["n"], centre)]
        yield _estimates(pdf["group"].to_numpy(), pdf["start"].to_numpy(), centre, scatter)


def _next(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimate from the bins of one group and start: the nearest SUBSET of its rows."""
    pdf = pdf.sort_values("bin")
    reached = pdf["n"].cumsum().to_numpy()
    total = int(reached[-1])
    used = pdf.iloc[: int(np.searchsorted(reached, SUBSET * total)) + 1]
    n = float(used["n"].sum())
    centre = np.stack(used["s1"].to_list()).sum(0) / n
    scatter = _square(np.stack(used["s2"].to_list()).sum(0) / n) - np.outer(centre, centre)
    return _estimates([pdf["group"].iloc[0]], [pdf["start"].iloc[0]], [centre], [scatter / consistency(min(1.0, n / total))])


def _scaled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last estimate, scaled so that the median distance (inside its bin in proportion) is that of normal variables."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy()
    half, reached = n.sum() / 2, n.cumsum()
    at = int(np.searchsorted(reached, half))
    median = np.expm1((pdf["bin"].iloc[at] + 1 - (reached[at] - half) / n[at]) / 6)
    scatter = np.array(pdf["scatter"].iloc[0]).reshape(len(STATS), -1)
    expected = _median(_floored(scatter)[1])
    return _estimates([pdf["group"].iloc[0]], [0], [pdf["centre"].iloc[0]], [scatter * (median / expected if expected else 1.0)])


def _with(rows: DataFrame, estimates: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """Adds `start` and `distance` (squared) to every row, for each estimate of its group."""
    side = estimates.select("group", "start", "centre", "inverse")
    if count <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(side), "group", how)
    else:
        packed = side.groupBy("group").agg(F.collect_list(F.struct("start", "centre", "inverse")).alias("e"))  # a few starts
        joined = looked_up(rows, "group", packed, "doc_id", how).select("*", F.explode_outer("e").alias("of")).select("*", "of.*").drop("e", "of")
    d = len(STATS)
    delta = [F.col(s) - F.col("centre")[i] for i, s in enumerate(_STATS)]
    square = sum((delta[i] * delta[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
    return joined.withColumn("distance", square).drop("centre", "inverse")


def references(usable: DataFrame) -> DataFrame:
    """The group that judges each language and source: (lang, source, level, group)."""
    sizes = cut(usable.groupBy("lang", "source").agg(F.count("*").alias("rows")))
    of_lang, of_source = (F.sum("rows").over(Window.partitionBy(c)) for c in ("lang", "source"))
    level = F.when(F.col("rows") >= LEAST_ROWS, 0).when(of_lang >= LEAST_ROWS, 1).when(of_source >= LEAST_ROWS, 2).otherwise(3)
    group = F.when(F.col("level") == 0, _group(0)).when(F.col("level") == 1, _group(1)).when(F.col("level") == 2, _group(2)).otherwise(_group(3))
    return cut(sizes.withColumn("level", level).withColumn("group", group).select("lang", "source", "level", "group"))


def estimate(usable: DataFrame, judges: DataFrame) -> tuple[DataFrame, int]:
    """Centre and inverse scatter of every group that judges some rows, over all usable rows of the group, and their number."""
    levels = [r["level"] for r in judges.select("level").distinct().collect()]  # four at most
    needed = judges.select("group").distinct()
    groups = needed.count()
    rows = usable.select("doc_id", *_STATS, F.explode(F.array(*(_group(i) for i in sorted(levels)))).alias("group")) if levels else usable.withColumn("group", _group(0))
    rows = rows.join(F.broadcast(needed) if groups <= BROADCAST_GROUPS else needed, "group", "left_semi")
    s1 = F.array(*(F.sum(s) for s in _STATS)).alias("s1")
    s2 = F.array(*(F.sum(F.col(a) * F.col(b)) for i, a in enumerate(_STATS) for b in _STATS[i:])).alias("s2")
    quartiles = F.array(*(F.percentile_approx(s, [0.25, 0.5, 0.75], 2000) for s in _STATS)).alias("quartiles")
    starts = rows.groupBy("group").agg(quartiles).mapInPandas(_from_quartiles, ESTIMATE)
    for k in range(1, SUBSET_STARTS + 1):
        order = Window.partitionBy("group").orderBy(F.xxhash64("doc_id", F.lit(k)), *_STATS)
        few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= START_ROWS)  # ranked before the exchange
        starts = starts.unionByName(few.groupBy("group").agg(F.count("*").alias("n"), s1, s2, F.lit(k).alias("start")).mapInPandas(_from_moments, ESTIMATE))
    present = cut(starts)
    place = F.least(F.floor(6 * F.log1p(F.col("distance"))), F.lit(BINS - 1)).cast("int").alias("bin")

    def binned(*more):
        return _with(rows, present, groups * (SUBSET_STARTS + 1)).select("group", "start", *_STATS, place).groupBy("group", "start", "bin").agg(F.count("*").alias("n"), *more)

    for step in range(START_STEPS + C_STEPS):
        present = cut(binned(s1, s2).groupBy("group", "start").applyInPandas(_next, ESTIMATE))
        if step == START_STEPS - 1:
            best = F.min_by(F.struct(*(c.split()[0] for c in ESTIMATE.split(", "))), F.struct("spread", "start"))
            present = cut(present.groupBy("group").agg(best.alias("e")).select("e.*"))
    last = present.select("group", "centre", "scatter")
    return cut(binned().join(last, "group").groupBy("group").applyInPandas(_scaled, ESTIMATE)), groups


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts, base verdict, squared distance and final verdict of every document."""
    rows = cut(statistics(docs))
    usable = rows.where(~base_failed())
    judges = references(usable)
    estimates, groups = estimate(usable, judges)
    named = judges.select(F.col("lang").alias("j_lang"), F.col("source").alias("j_source"), "group")
    if groups <= BROADCAST_GROUPS:
        named = F.broadcast(named) if judges.count() <= BROADCAST_GROUPS else named
    of = rows.join(named, F.equal_null("lang", "j_lang") & F.equal_null("source", "j_source"), "left")
    verdict = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))
    counted = [c.split()[0] for c in COUNTS.split(", ")]
    return _with(of, estimates, groups, "left").withColumn("base_failed", base_failed()).withColumn("kept", verdict).select("doc_id", *counted, "base_failed", "kept", "distance")
