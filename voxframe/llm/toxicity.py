"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are the words and word beginnings it holds (A-Z lower-cased, punctuation at the ends cut off), each
once, and again as further features if they come twice or four times. A bounded number of them is chosen by how differently confirmed toxic texts and unlabelled texts use them. A
logistic model is trained on both samples with the risk ``prior * R+(positive) + max(0, R-(unlabelled) - prior *
R-(positive))``: unlabelled texts hold toxic ones too, the class prior says how many, and the maximum keeps the
estimate of the negative risk from falling below zero. When it does fall below, the step goes the other way on that
part, as the method asks.

Defined results: null and empty texts hold no feature and get the score of the bias; without a positive or an
unlabelled training text every score is the prior (0 if there are no labels); repeated rows stay; ids that repeat in
the labels count as toxic if one of their labels does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm import folds, textbytes
from voxframe.session import materialize

FOLDS = 5
#: Training texts drawn at most (about) of the confirmed toxic ones and of all others.
POSITIVES, UNLABELLED = 2000, 5000
#: Features that are kept at most, and how many standard deviations their use must differ by.
FEATURES, STRENGTH = 1024, 5.0
#: Lengths in bytes of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
#: A feature that comes this often in a text counts as a further one.
OFTEN = (2, 4)
#: ASCII bytes that are cut off the ends of a word.
EDGE = np.zeros(256, bool)
EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every feature of every text and its row; a feature may come several times."""
    data, offsets = textbytes.lowered(column)
    starts, ends, row = textbytes.word_bounds(data, offsets)
    for _ in range(3):
        full = ends > starts
        starts = starts + (full & EDGE[data[np.minimum(starts, max(len(data) - 1, 0))]]) if len(data) else starts
        full = ends > starts
        ends = ends - (full & EDGE[data[ends - 1]]) if len(data) else ends
    own = ends > starts
    starts, ends, row = starts[own], ends[own], row[own]
    prefix = textbytes.sums(data)
    keys, rows = [textbytes.span_hash(prefix, starts, ends)], [row]
    for k, n in enumerate(BEGINNINGS):
        long = ends - starts > n
        keys.append(textbytes.span_hash(prefix, starts[long], starts[long] + n) ^ np.uint64((k + 1) << 56))
        rows.append(row[long])
    return np.concatenate(keys), np.concatenate(rows)


def _once(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once a row, and once more under another hash for each of ``OFTEN`` times that it comes there."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(keys)))
    keys, rows = keys[at], rows[at]
    parts = [(keys, rows)] + [(keys[times >= n] ^ np.uint64((i + 1) << 60), rows[times >= n]) for i, n in enumerate(OFTEN)]
    return np.concatenate([k for k, _ in parts]), np.concatenate([r for _, r in parts])


def _usage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        toxic, opened = (part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("toxic", "open"))
        keys, rows = _once(*_tokens(part.column("text")))
        keys, sums = textbytes.runs(keys, np.stack([toxic[rows], opened[rows]], 1).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["feature", "pos", "unl"])


def _held(part: pa.RecordBatch, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every chosen feature that a text holds, each once."""
    keys, rows = _tokens(part.column("text"))
    seen = np.zeros(1 << 16, bool)
    seen[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = seen[(keys & np.uint64(0xFFFF)).astype(np.int64)]
    keys, rows = _once(keys[maybe], rows[maybe])
    at = np.minimum(np.searchsorted(features, keys), max(len(features) - 1, 0))
    own = features[at] == keys if len(features) else np.zeros(len(keys), bool)
    return rows[own], at[own]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk with the logistic loss (Adam, full batches)."""
    w, b = np.zeros(positive.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        fp, fu = positive @ w + b, unlabelled @ w + b
        # Slopes of log(1+exp(-f)) for toxic and of log(1+exp(f)) for clean.
        up, down_p, down_u = -_sigmoid(-fp) / len(fp), _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:
            gp, gu = prior * up - prior * down_p, down_u
        else:
            gp, gu = prior * up + prior * down_p, -down_u
        slope = np.append(gp.astype(np.float32) @ positive + gu.astype(np.float32) @ unlabelled + ridge * w, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", fold_count: int = FOLDS, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES, prior: float | None = None) -> dict:
    """Learn from rows outside the held-out fold. ``prior``: share of toxic texts, else that among the labels learnt from."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark"), folds.may_learn(id_col, fold_count).alias("learn")).where("learn and mark is not null")
    marks = marks.groupBy("id").agg(F.max((F.col("mark") == 1).cast("int")).alias("mark"))
    ids = docs.select(F.col(id_col).alias("id"), folds.may_learn(id_col, fold_count).alias("learn"), folds.unit(id_col, 6).alias("draw")).where("learn")
    # Labels count only for documents that are there. Ids are joined; no text moves.
    marked = ids.join(marks, "id", "left").select("id", "draw", F.coalesce(F.col("mark") == 1, F.lit(False)).alias("toxic"), F.col("mark").isNotNull().alias("marked"))
    total = marked.agg(F.count("*").alias("n"), F.count_if("toxic").alias("toxic"), F.count_if("marked").alias("marked")).first()
    n_docs = total["n"]
    share = prior if prior is not None else (total["toxic"] / total["marked"] if total["marked"] else 0.0)
    empty = {"features": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share >= 1 else -40.0)}
    if not total["toxic"] or total["toxic"] >= n_docs or not 0 < share < 1:
        return empty
    # What the draw leaves is bounded, so those ids may go to every task that reads texts.
    drawn = marked.select("id", "toxic", (F.col("draw") < min(1.0, unlabelled / n_docs)).alias("open"), (F.col("draw") < min(1.0, positives / total["toxic"])).alias("sure"))
    wanted = drawn.select("id", (F.col("toxic") & F.col("sure")).alias("toxic"), "open").where("toxic or open").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialize(texts.join(F.broadcast(wanted), "id").select("text", "toxic", "open"))
    usage = sample.select("text", "toxic", "open").mapInArrow(_usage, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    n_pos, n_unl = min(positives, total["toxic"]), min(unlabelled, n_docs)
    p, u = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("unl") + 0.5) / (n_unl + 1.0)
    strength = F.abs(p - u) / F.sqrt((p + u) / 2 * (1.0 / n_pos + 1.0 / n_unl))
    chosen = usage.select("feature", strength.alias("strength")).where(F.col("strength") >= STRENGTH).orderBy(F.desc("strength"), "feature").limit(features).select("feature").collect()
    hashes = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            row, number = _held(part, hashes)
            table = np.zeros((part.num_rows, max(len(hashes), 1)), bool)
            table[row, number] = True
            packed = np.packbits(table, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), part.column("toxic"), part.column("open")], ["bits", "toxic", "open"])

    got = sample.mapInArrow(bits, "bits binary, toxic boolean, open boolean").collect()
    if not len(hashes) or not any(r["toxic"] for r in got) or not any(r["open"] for r in got):
        return empty
    table = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(hashes)].astype(np.float32)
    toxic, opened = np.array([r["toxic"] for r in got]), np.array([r["open"] for r in got])
    weights, bias = train(table[toxic], table[opened], share)
    return {"features": hashes, "weights": weights, "bias": bias}


def score(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", fold_count: int = FOLDS, **limits) -> DataFrame:
    """One row for each document: the id, ``held_out``, ``score`` in [0, 1] and ``predicted`` (1 at 0.5 or more)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, id_col=id_col, label_col=label_col, fold_count=fold_count, **limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        m = model.value
        for part in textbytes.slices(batches, "text"):
            row, number = _held(part, m["features"])
            total = np.bincount(row, m["weights"][number] if len(m["weights"]) else None, part.num_rows).astype(float) + m["bias"]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(_sigmoid(total))], ["id", "held_out", "score"])

    source = docs.select(F.col(id_col).alias("id"), folds.held_out(id_col, fold_count).alias("held_out"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    done = source.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
