"""Language identification in two steps: the family first, then one language within it.

A text becomes the relative frequencies of its hashed byte triples (A-Z lower-cased). Linear support vector machines
with squared hinge loss, one for each pair of families and one for each pair of languages of a family, vote; ties go
to the larger sum of margins, then to the smaller name.

Defined results: a text that is null or has no letter is ``und`` with score 0 (as is any text when nothing could be
learnt); rows stay as they are, repeated ones included; an empty table gives an empty result. Languages without a
known family share the family ``other``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm import folds, textbytes

FOLDS = 5
#: Hashed features of a text.
BUCKETS = 4096
#: Training texts that are drawn for each language at most (about), by a hash of their id.
SAMPLE_PER_LANGUAGE = 400
#: Training texts of all languages together (about); with very many languages each gets fewer, but at least eight.
SAMPLE = 16_000
UNKNOWN = "und"
# Families of common languages by code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
    "cjk": ("zh", "ja", "ko"),
}


def family_of(lang: str) -> str:
    return next((family for family, langs in FAMILIES.items() if lang in langs), "other")


def _triples(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte triple within a text, and the row of each."""
    data, offsets = textbytes.lowered(column)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return bucket[inside], row[:-2][inside]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        bucket, row = _triples(part.column("text"))
        n = part.num_rows
        for at in range(0, n, 64):
            own = (row >= at) & (row < at + 64)
            size = min(64, n - at)
            counts = np.bincount((row[own] - at) * BUCKETS + bucket[own], minlength=size * BUCKETS).reshape(size, BUCKETS)
            share = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("lang").slice(at, size), pa.array([r.tobytes() for r in share], pa.binary())], ["lang", "share"])


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss; both classes weigh the same."""
    n = len(y)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    rate = 0.25 / ((x * x).sum(1).max(initial=0) + 1) if n else 0.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w + b))
        pull = share * slack * y
        vw = 0.9 * vw + rate * (2 * (pull @ x) - ridge * w)
        vb = 0.9 * vb + rate * 2 * pull.sum()
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fold_count: int = FOLDS, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Learn from the rows outside the held-out fold: a bounded sample of each language, whole texts.

    Only the frequencies of sampled texts, ``BUCKETS`` numbers each, reach the driver.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), folds.unit(id_col, 9).alias("draw"), folds.may_learn(id_col, fold_count).alias("learn"))
    known = known.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    sample_per_language = min(sample_per_language, max(8, SAMPLE // max(1, len(counts))))
    model = {"langs": sorted(counts), "families": {}, "pairs": [], "weights": np.zeros((BUCKETS, 0), np.float32), "offsets": np.zeros(0)}
    for lang in model["langs"]:
        model["families"].setdefault(family_of(lang), []).append(lang)
    if len(counts) < 2:
        return model
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("draw") < min(1.0, sample_per_language / n)))
    rows = known.where(wanted).select("text", "lang").mapInArrow(_features, "lang string, share binary").collect()
    langs = np.array([r["lang"] for r in rows])
    x = np.frombuffer(b"".join(bytes(r["share"]) for r in rows), np.float32).reshape(len(rows), BUCKETS)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x = x * scale
    groups = {f: np.isin(langs, m) for f, m in model["families"].items()}
    tasks = [("family", a, b, groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)]
    for members in model["families"].values():
        tasks += [("lang", a, b, langs == a, langs == b) for a, b in combinations(sorted(members), 2)]
    weights, offsets = [], []
    for kind, a, b, left, right in tasks:
        use = left | right
        w, offset = _machine(x[use], np.where(left[use], 1.0, -1.0))
        model["pairs"].append((kind, a, b))
        weights.append(w * scale)
        offsets.append(offset)
    model |= {"weights": np.array(weights, np.float32).T.copy(), "offsets": np.array(offsets)}
    return model


def _elect(names: list[str], rivals: list[tuple[str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner of each row by votes over pairs, and the mean certainty of its own pairs."""
    votes = np.zeros((len(margins), len(names)))
    tie, sure = votes.copy(), votes.copy()
    for k, (a, b) in enumerate(rivals):
        m = margins[:, k]
        p = 1 / (1 + np.exp(-np.clip(6 * m, -30, 30)))
        for name, won, edge, chance in ((a, m >= 0, m, p), (b, m < 0, -m, 1 - p)):
            i = names.index(name)
            votes[:, i] += won
            tie[:, i] += edge
            sure[:, i] += chance
    best = np.argmax(votes + 1e-3 * np.tanh(tie), axis=1) if names else np.zeros(len(margins), int)
    certain = sure[np.arange(len(margins)), best] / (len(names) - 1) if len(names) > 1 else np.ones(len(margins))
    return best, certain


def predict(docs: DataFrame, model: dict, *, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), verdict: str = "lang_pred") -> DataFrame:
    """The id, the language under the name ``verdict`` and ``score``, from the text alone.

    With ``keep`` those columns pass through in place of the id, and the score is named after the verdict.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = [F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter")]
    # The text travels once, also where it is to be passed through.
    names_of = {c: "text" if c == text_col else f"_keep{i}" for i, c in enumerate(keep)}
    columns += [F.col(c).alias(n) for c, n in names_of.items() if n != "text"]
    source = docs.select(*columns)
    out = [c for c in source.columns if c != "_letter" and (c != "text" or text_col in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        m = shared.value
        families = sorted(m["families"])
        for part in textbytes.slices(batches, "text"):
            n = part.num_rows
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            letter = part.column("_letter").to_numpy(zero_copy_only=False)
            if len(m["langs"]) == 1:
                names[:], score[:] = m["langs"][0], 1.0
            elif m["langs"]:
                bucket, row = _triples(part.column("text"))
                size = np.maximum(np.bincount(row, minlength=n), 1)
                margins = np.stack([np.bincount(row, m["weights"][bucket, k], n) / size for k in range(len(m["pairs"]))], 1) + m["offsets"]
                at = [k for k, p in enumerate(m["pairs"]) if p[0] == "family"]
                best, sure = _elect(families, [m["pairs"][k][1:] for k in at], margins[:, at])
                for i, family in enumerate(families):
                    langs = sorted(m["families"][family])
                    own = best == i
                    at = [k for k, p in enumerate(m["pairs"]) if p[0] == "lang" and p[1] in langs]
                    inner, certain = _elect(langs, [m["pairs"][k][1:] for k in at], margins[own][:, at])
                    names[own], score[own] = np.array(langs, object)[inner], sure[own] * certain
            names[~letter], score[~letter] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([part.column(c) for c in out] + [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], [*out, "lang_pred", "score"])

    done = source.mapInArrow(run, T.StructType([*source.select(*out).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    if keep:
        return done.select(*[F.col(n).alias(c) for c, n in names_of.items()], F.col("lang_pred").alias(verdict), F.col("score").alias(f"{verdict}_score"))
    return done.select(F.col("_id").alias(id_col), F.col("lang_pred").alias(verdict), "score")


def identify(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fold_count: int = FOLDS) -> DataFrame:
    """One row for each document: the id, ``held_out``, ``lang_pred`` and ``score`` in [0, 1]."""
    model = fit(docs, text_col=text_col, lang_col=lang_col, id_col=id_col, fold_count=fold_count)
    return predict(docs, model, text_col=text_col, id_col=id_col).select(id_col, folds.held_out(id_col, fold_count).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fold_count: int = FOLDS) -> DataFrame:
    """The documents with a letter in their text; a null language becomes the predicted one, all else stays as it was.

    If no language can be learnt, all texts with a letter stay and null languages stay null.
    """
    model = fit(docs, text_col=text_col, lang_col=lang_col, id_col=id_col, fold_count=fold_count)
    if not model["langs"]:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    judged = predict(docs, model, text_col=text_col, id_col=id_col, keep=tuple(docs.columns), verdict="_told").where(F.col("_told") != UNKNOWN)
    told = F.coalesce(F.col(lang_col), F.col("_told").cast(docs.schema[lang_col].dataType))
    return judged.select(*[told.alias(c) if c == lang_col else F.col(c) for c in docs.columns])
