"""Language model by context-tree weighting over bytes, and a plain word model beside it.

The context-tree model reads the bytes of the text with A-Z lower-cased and a zero byte at the end. A byte is eight binary decisions;
each has a tree of its own over the bytes before it, up to ``depth`` of them (zero bytes before the text). A node
holds how often either decision was met in its context. Its Krichevsky-Trofimov probability follows from the two counts
alone, whatever their order, and so does the weighted probability of a node: half its own estimate, half the product of
its children's. So the trees are grown by counting: strings of ``depth + 1`` bytes are counted in each task and summed
over all of them, then nodes are summed level by level up to the root. All of the learning texts count.

To score, a decision mixes the estimates along its path: from the deepest node that was met upwards,
``rho * own + (1 - rho) * deeper``, where rho is the share that the node's own estimate has in its weighted
probability; below the deepest node met both decisions are equally likely. The score is the sum of the base-10
logarithms; ``code_bytes`` and ``code_length`` give the bits for each byte.

No task holds the tree. The texts are dealt to slices of about ``SLICE`` bytes by their file and row, so a second
read of the files finds the same slices and no copy of the texts is made (texts that are no Parquet scan are written
once). The different strings of each slice are kept, packed, in parts by the ``NEAR`` bytes next to the decision: all
nodes with a longer context lie within one part. Strings of a part are summed over groups of slices and then over
these. A task grows the nodes of its part up to contexts of ``NEAR`` bytes; the few levels above are summed by Spark,
and from the root down every node joins its parent. With what comes from above, the tasks of the parts work out
the scores of their strings. These go to every group of slices, where the strings of each slice fetch theirs, and meet
the texts of their slice again, so a task holds the strings of one slice or of one part. The strings of texts that are not learnt
from have the count 0: a node without counts takes both decisions as equally likely, as it must.

The word model needs the count of every word. Words that make up more than 1 in ``frequent`` of all tokens, so fewer
than ``frequent`` words, go to every task; other words are joined by their 64-bit hash, which stands for the word.

Defined results: null and empty texts consist of the end alone; a null id is neither held out nor learnt from; repeated
rows are scored one by one; ``docs`` must give the same rows whenever it is read; with nothing to learn from, every decision costs one bit and every word score is that of an
empty corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm import folds, textbytes
from voxframe.session import materialize

FOLDS = 10
DEPTH = 5
#: Bound on words that go to every task.
FREQUENT = 1 << 20
#: Bytes of text whose strings meet their scores together (a longer text is a slice of its own).
SLICE = 32 << 20
#: Bytes next to a decision that deal the strings to parts.
NEAR = 2
#: Bytes of text for each part, and bounds on the number of parts.
PART, PARTS = 4 << 20, (32, 4096)
#: Slices whose strings meet the scores of a part in one task.
GROUP = 64
#: Strings of a slice that are looked up by a hash; others are searched for.
HASHED = 1 << 21
#: Strings that a task gathers before it sums them.
GATHERED = 1_500_000
SMOOTHING = 0.1


def _strings(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``depth`` bytes before it as one number, and where each text starts.

    The nearest byte before it comes first in the number, the byte itself last: contexts that end alike stand together.
    """
    data, offsets = textbytes.lowered(column)
    n = len(offsets) - 1
    # Every text gets its end byte, then zero bytes part it from the next one.
    gap = depth + 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.zeros(len(data) + gap * n + depth, np.uint64)
    padded[np.arange(len(data)) + gap * row + depth] = data
    keys = np.zeros(len(padded) - depth, np.uint64)
    for back in range(depth + 1):
        keys |= padded[depth - back : len(padded) - back] << np.uint64(8 * (depth - back + 1) if back else 0)
    starts = offsets[:-1] + gap * np.arange(n)
    inside = np.ones(len(keys), bool)
    for k in range(1, gap):
        inside[offsets[1:] + gap * np.arange(n) + k] = False
    return keys[inside], starts - depth * np.arange(n)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: hash, row, and how often."""
    data, offsets = textbytes.lowered(column)
    starts, ends, row = textbytes.word_bounds(data, offsets)
    keys = textbytes.span_hash(textbytes.sums(data), starts, ends)
    # A word and its row in one number (distinct with near certainty), then the first place of each.
    both = textbytes.mixed(keys + textbytes.mixed(row.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)))
    _, first, times = np.unique(both, return_index=True, return_counts=True)
    return keys[first], row[first], times


class _Sums:
    """Counts by key, summed whenever enough have come together."""

    def __init__(self, width: int):
        self.keys, self.values, self.size, self.width = [], [], 0, width

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.size += len(keys)
        if self.size > GATHERED:
            self._sum()

    def _sum(self) -> None:
        keys, values = textbytes.runs(np.concatenate(self.keys), np.concatenate(self.values))
        self.keys, self.values, self.size = [keys], [values], 0

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order and their sums."""
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._sum()
        return self.keys[0], self.values[0]

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        keys, values = self.done()
        values = values.reshape(-1, self.width)
        for at in range(0, len(keys), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), *[pa.array(values[part, k]) for k in range(self.width)]], names)


def placed(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of ``docs`` with ``file`` and ``at``, the row in it; written first unless ``docs`` is a Parquet scan."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        found = docs.select(*columns, *place)
        found.schema
    except AnalysisException:
        found = materialize(docs.select(*columns)).select("*", *place)
    return found


def _runs_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal whole numbers in ``names``, and these."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in names]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield tuple(int(c[start]) for c in columns), batch.slice(start, stop - start)


def _pack(keys: np.ndarray) -> bytes:
    """Whole numbers in order as their differences. Bytes of one weight stand together, since most are zero."""
    return np.diff(keys, prepend=keys.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _near(depth: int) -> int:
    return min(NEAR, depth)


def count_strings(texts: DataFrame, depth: int, parts: int) -> DataFrame:
    """``slice, part, keys, counts`` of the strings of ``texts(slice, text, learn)``, packed: counts in learning texts."""
    beyond = np.uint64(8 * (depth - _near(depth) + 1))

    def packed(number: int, sums: _Sums) -> Iterator[pa.RecordBatch]:
        keys, counts = sums.done()
        if not len(keys):
            return
        part = (textbytes.mixed(keys >> beyond) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        spans = list(zip(cuts, cuts[1:]))
        columns = [pa.array(np.full(len(spans), number, np.int64)), pa.array(part[cuts[:-1]])]
        columns += [pa.array([_pack(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_pack(np.cumsum(counts[a:b])) for a, b in spans], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        sums, last = _Sums(1), 0
        for (number,), some in _runs_of(batches, ["slice"]):
            if number != last:
                yield from packed(last, sums)
                sums, last = _Sums(1), number
            for part in textbytes.slices([some], "text"):
                strings, starts = _strings(part.column("text"), depth)
                learn = part.column("learn").to_numpy(zero_copy_only=False).astype(np.uint64)
                # The string and whether it is learnt in one number.
                both, times = np.unique(strings << np.uint64(1) | np.repeat(learn, np.diff(np.append(starts, len(strings)))), return_counts=True)
                keys, times = both >> np.uint64(1), times * (both & np.uint64(1)).astype(np.int64)
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                sums.add(keys[at], np.add.reduceat(times, at))
        yield from packed(last, sums)

    return texts.select("slice", "text", "learn").mapInArrow(run, "slice long, part long, keys binary, counts binary")


def summed(strings: DataFrame, by: list[str]) -> DataFrame:
    """``strings(*by, keys, counts)`` with one row for each value of ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        sums, last = _Sums(1), None

        def row() -> Iterator[pa.RecordBatch]:
            if last is not None:
                keys, counts = sums.done()
                yield pa.RecordBatch.from_arrays([*[pa.array([v]) for v in last], pa.array([_pack(keys)], pa.binary()), pa.array([_pack(np.cumsum(counts))], pa.binary())], [*by, "keys", "counts"])

        for number, some in _runs_of(batches, by):
            if number != last:
                yield from row()
                sums, last = _Sums(1), number
            for keys, counts in zip(some.column("keys").to_pylist(), some.column("counts").to_pylist()):
                sums.add(_unpack(keys).view(np.uint64), np.diff(_unpack(counts), prepend=0))
        yield from row()

    rows = strings.select(*by, "keys", "counts").repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in by) + ", keys binary, counts binary")


def count_words(texts: DataFrame) -> DataFrame:
    """``key, learnt, all`` of the words of ``texts(text, learn)``: counts in learning texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        sums = _Sums(2)
        for part in textbytes.slices(batches, "text"):
            learn = part.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            keys, row, times = _words(part.column("text"))
            sums.add(*textbytes.runs(keys, np.stack([times * learn[row], times], 1)))
        yield from sums.batches(["key", "learnt", "every"])

    counted = texts.select("text", "learn").mapInArrow(run, "key long, learnt long, every long")
    return counted.groupBy("key").agg(F.sum("learnt").alias("learnt"), F.sum("every").alias("every"))


_SMALL = 32


def _log_gamma(n: Column, half: bool) -> Column:
    """Natural logarithm of gamma(n + 1/2), or of gamma(n + 1), for whole n from 0: a table, then Stirling's series."""
    table = F.array(*[F.lit(math.lgamma(i + (0.5 if half else 1.0))) for i in range(_SMALL)])
    x = n + (0.5 if half else 1.0)
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < _SMALL, F.get(table, n.cast("int"))).otherwise(series)


def _own(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of the counts."""
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - _log_gamma(zeros + ones, False) - math.log(math.pi)


def _log_gammas(n: np.ndarray, half: bool) -> np.ndarray:
    """As ``_log_gamma``, for an array."""
    table = np.array([math.lgamma(i + (0.5 if half else 1.0)) for i in range(_SMALL)])
    x = np.maximum(n, _SMALL) + (0.5 if half else 1.0)
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], series)


class _Part:
    """The nodes of one part, from strings in order up to contexts of ``near`` bytes.

    Levels are listed from the longest context up; a node is its context and decision in one number.
    """

    def __init__(self, strings: np.ndarray, n: np.ndarray, depth: int, near: int):
        byte, context = strings & 255, strings & ~np.int64(255)
        self.bits = np.stack([(byte >> (7 - k)) & 1 for k in range(8)])
        nodes, self.of = np.unique(np.stack([context | (byte >> (8 - k)) | (1 << k) for k in range(8)]), return_inverse=True)
        self.of = self.of.reshape(8, -1)
        ones = np.bincount(self.of.ravel(), (self.bits * n).ravel(), len(nodes)).astype(np.int64)
        zeros = np.bincount(self.of.ravel(), np.broadcast_to(n, self.bits.shape).ravel(), len(nodes)).astype(np.int64) - ones
        self.one, self.rho, self.up = [(ones + 0.5) / (zeros + ones + 1)], [np.ones(len(nodes))], []
        weighted = self._own(zeros, ones)
        for _ in range(depth - near):
            nodes, up = np.unique(((nodes >> 16) << 8) | (nodes & 255), return_inverse=True)
            zeros, ones = (np.bincount(up, x, len(nodes)).astype(np.int64) for x in (zeros, ones))
            children, own = np.bincount(up, weighted, len(nodes)), self._own(zeros, ones)
            gap = children - own
            # log((exp(own) + exp(children)) / 2) and the share of the first.
            weighted = np.maximum(own, children) + np.log1p(np.exp(-np.abs(gap))) - math.log(2)
            self.one.append((ones + 0.5) / (zeros + ones + 1))
            self.rho.append(1 / (1 + np.exp(np.minimum(gap, 700))))
            self.up.append(up)
        self.nodes, self.zeros, self.ones, self.weighted = nodes, zeros, ones, weighted

    @staticmethod
    def _own(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        return _log_gammas(zeros, True) + _log_gammas(ones, True) - _log_gammas(zeros + ones, False) - math.log(math.pi)

    def scores(self, sure: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Base-10 logarithms of the strings' last bytes; ``sure, rest`` come from above each of ``nodes``."""
        for level in range(len(self.one) - 1, -1, -1):
            sure, rest = sure + rest * self.rho[level] * self.one[level], rest * (1 - self.rho[level])
            if level:
                sure, rest = sure[self.up[level - 1]], rest[self.up[level - 1]]
        out = np.zeros(self.of.shape[1])
        for of, bit in zip(self.of, self.bits):
            out += np.log10(np.where(bit, sure[of], 1 - sure[of]))
        return out


def part_nodes(parts: DataFrame, depth: int) -> DataFrame:
    """``part, node, zeros, ones, weighted`` of the contexts of ``NEAR`` bytes, from ``parts(part, keys, counts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        for batch in batches:
            for number, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                tree = _Part(_unpack(keys), np.diff(_unpack(counts), prepend=0), depth, _near(depth))
                columns = [np.full(len(tree.nodes), number, np.int64), tree.nodes, tree.zeros, tree.ones, tree.weighted]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "node", "zeros", "ones", "weighted"])

    return parts.select("part", "keys", "counts").mapInArrow(run, "part long, node long, zeros long, ones long, weighted double")


def _parent(node: Column) -> Column:
    """The node of the same decision with a context of one byte less."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(F.lit(255)))


def from_above(level: DataFrame, near: int) -> DataFrame:
    """``part, node, sure, rest``: what the shorter contexts give to each node of ``level(part, node, zeros, ones, weighted)``.

    The probability of a one is ``sure + rest * deeper`` where ``deeper`` is that of the node and what lies below it.
    """
    deepest, above = level, []
    for _ in range(near):
        up = level.select(_parent(F.col("node")).alias("node"), "zeros", "ones", "weighted")
        up = up.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))
        own = up.withColumn("own", _own(F.col("zeros"), F.col("ones")))
        gap = F.col("children") - F.col("own")
        weighted = F.greatest("own", "children") + F.log1p(F.exp(-F.abs(gap))) - math.log(2)
        rho = F.when(gap > 700, 0.0).otherwise(1 / (1 + F.exp(gap)))
        level = materialize(own.select("node", "zeros", "ones", weighted.alias("weighted"), rho.alias("rho")))
        above.insert(0, level)
    if not above:
        return deepest.select("part", "node", F.lit(0.0).alias("sure"), F.lit(1.0).alias("rest"))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    state = above[0].select("node", (F.col("rho") * one).alias("sure"), (1 - F.col("rho")).alias("rest"))
    for level in [*above[1:], None]:
        given = state.select(F.col("node").alias("up"), F.col("sure").alias("sure_up"), F.col("rest").alias("rest_up"))
        if level is None:
            own = deepest.select("part", "node", _parent(F.col("node")).alias("up"))
            return own.join(given, "up").select("part", "node", F.col("sure_up").alias("sure"), F.col("rest_up").alias("rest"))
        own = level.select("node", "rho", one.alias("one"), _parent(F.col("node")).alias("up"))
        state = own.join(given, "up").select("node", (F.col("sure_up") + F.col("rest_up") * F.col("rho") * F.col("one")).alias("sure"), (F.col("rest_up") * (1 - F.col("rho"))).alias("rest"))


def part_scores(parts: DataFrame, state: DataFrame, depth: int) -> DataFrame:
    """``part, keys, scores`` of all strings of ``parts(part, keys, counts)`` from ``state(part, node, sure, rest)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        held: list[pa.RecordBatch] = []
        last = None
        for (number, is_strings), some in _runs_of(batches, ["part", "is_strings"]):
            if number != last:
                held, last = [], number
            if not is_strings:
                held.append(some)
                continue
            node, sure, rest = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("node", "sure", "rest"))
            tree = _Part(_unpack(some.column("keys")[0].as_py()), np.diff(_unpack(some.column("counts")[0].as_py()), prepend=0), depth, _near(depth))
            order = np.argsort(node)
            at = order[np.searchsorted(node[order], tree.nodes)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), some.column("keys").slice(0, 1), pa.array([tree.scores(sure[at], rest[at]).tobytes()], pa.binary())], ["part", "keys", "scores"])

    blank = F.lit(None).cast("binary")
    both = state.select("part", F.lit(0).alias("is_strings"), "node", "sure", "rest", blank.alias("keys"), blank.alias("counts"))
    both = both.union(parts.select("part", F.lit(1), F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0), "keys", "counts"))
    return both.repartition("part").sortWithinPartitions("part", "is_strings").mapInArrow(run, "part long, keys binary, scores binary")


def string_scores(scores: DataFrame, strings: DataFrame, groups: int) -> DataFrame:
    """``slice, keys, scores``, packed, of ``strings(slice, part, salt, keys)`` from ``scores(part, keys, scores)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        keys, worth = np.zeros(0, np.int64), np.zeros(0)
        for (_, _, is_strings), some in _runs_of(batches, ["part", "salt", "is_strings"]):
            if not is_strings:
                keys, worth = _unpack(some.column("keys")[0].as_py()), np.frombuffer(some.column("scores")[0].as_py())
                continue
            found = [worth[np.searchsorted(keys, _unpack(own))].tobytes() for own in some.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("slice"), some.column("keys"), pa.array(found, pa.binary())], ["slice", "keys", "scores"])

    spread = scores.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("salt"), F.lit(0).alias("is_strings"), F.lit(0).cast("long").alias("slice"), "keys", "scores")
    both = spread.union(strings.select("part", "salt", F.lit(1), "slice", "keys", F.lit(None).cast("binary")))
    return both.repartition("part", "salt").sortWithinPartitions("part", "salt", "is_strings").mapInArrow(run, "slice long, keys binary, scores binary")


class _Scores:
    """Scores of the strings of one slice."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.scores = keys[order].view(np.uint64), scores[order]
        size = min(HASHED, 1 << (4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.known, self.value = np.full(size, np.uint64((1 << 64) - 1)), np.zeros(size)
        place = self._place(self.keys)
        # Of strings with one place all but one are searched for.
        at = np.zeros(size, np.int64)
        at[place] = np.arange(len(place))
        self.known[place], self.value[place] = self.keys[at[place]], self.scores[at[place]]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (textbytes.mixed(keys) & self.mask).astype(np.int64)

    def __call__(self, strings: np.ndarray) -> np.ndarray:
        place = self._place(strings)
        out = self.value[place]
        other = np.flatnonzero(self.known[place] != strings)
        out[other] = self.scores[np.searchsorted(self.keys, strings[other])]
        return out


def scored(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", fold_count: int = FOLDS, depth: int = DEPTH, frequent: int = FREQUENT) -> DataFrame:
    """One row for each document: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``code_bytes``, ``code_length``."""
    spark = docs.sparkSession
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), folds.held_out(id_col, fold_count).alias("held_out"), folds.may_learn(id_col, fold_count).alias("learn")]
    source = placed(docs, columns)
    size = source.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.when(F.col("learn"), 1)).alias("learn")).first()
    rows_each = max(1, SLICE * size["rows"] // max(size["bytes"] + size["rows"], 1))
    source = source.withColumn("slice", F.xxhash64("file", F.floor(F.col("at") / F.lit(rows_each)))).drop("file", "at")
    count, groups = min(max(size["bytes"] // PART, PARTS[0]), PARTS[1]), 1 + size["bytes"] // (GROUP * SLICE)
    strings = materialize(count_strings(source, depth, count)).withColumn("salt", F.pmod("slice", F.lit(groups).cast("long")))
    parts = materialize(summed(summed(strings, ["part", "salt"]), ["part"]))
    state = from_above(materialize(part_nodes(parts, depth)), _near(depth))
    scores = string_scores(part_scores(parts, state, depth), strings, groups)
    words = materialize(count_words(source))
    ends = size["learn"]
    total = words.agg(F.coalesce(F.sum("learnt"), F.lit(0)).alias("learnt"), F.coalesce(F.sum("every"), F.lit(0)).alias("every"), F.count(F.when(F.col("learnt") > 0, 1)).alias("known")).first()
    n, v = total["learnt"] + ends, total["known"] + (1 if ends else 0)
    bottom = math.log10(n + SMOOTHING * (v + 1))
    top = words.where(F.col("every") * F.lit(frequent) > F.lit(total["every"])).select("key", "learnt").toPandas().sort_values("key")
    common = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64), top["learnt"].to_numpy(np.int64)))
    end_score, end_known = math.log10(ends + SMOOTHING), int(ends > 0)
    kind = source.schema["id"].dataType
    # The scores of a slice, then its texts.
    given = scores.select("slice", F.lit(0).alias("is_text"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("held_out"), "keys", "scores")
    given = given.union(source.select("slice", F.lit(1), "id", "text", "held_out", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    given = given.repartition("slice").sortWithinPartitions("slice", "is_text")

    def scored_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Scores, pa.RecordBatch]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        score_of, last = None, None
        for (number, is_text), some in _runs_of(batches, ["slice", "is_text"]):
            if number != last:
                held, score_of, last = [], None, number
            if not is_text:
                held += [(_unpack(keys), np.frombuffer(worth)) for keys, worth in zip(some.column("keys").to_pylist(), some.column("scores").to_pylist())]
                continue
            if score_of is None:
                score_of = _Scores(*(np.concatenate(c) for c in zip(*held)))
                held = []
            for part in textbytes.slices([some], "text"):
                yield score_of, part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        keys_of, counts_of = common.value
        for score_of, part in scored_slices(batches):
            column, rows = part.column("text"), part.num_rows
            strings, starts = _strings(column, depth)
            worth = np.append(0.0, np.cumsum(score_of(strings)))
            bounds = np.append(starts, len(strings))
            keys, row, times = _words(column)
            keys = keys.view(np.int64)
            at = np.minimum(np.searchsorted(keys_of, keys), max(len(keys_of) - 1, 0))
            met = keys_of[at] == keys if len(keys_of) else np.zeros(len(keys), bool)
            own = counts_of[at[met]]
            base = np.bincount(row[met], times[met] * np.log10(own + SMOOTHING), rows) + end_score
            known = np.bincount(row[met], times[met] * (own > 0), rows).astype(np.int64) + end_known
            rare = np.flatnonzero(~met)
            rare = rare[np.argsort(row[rare], kind="stable")]
            cuts = pa.array(np.searchsorted(row[rare], np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("held_out"),
                    pa.array(np.bincount(row, times, rows).astype(np.int64) + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.array(worth[bounds[1:]] - worth[bounds[:-1]]),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(cuts, pa.array(keys[rare])),
                    pa.ListArray.from_arrays(cuts, pa.array(times[rare].astype(np.int32))),
                ],
                ["id", "held_out", "n_tokens", "known", "base", "score", "bytes", "rare", "times"],
            )

    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens long, known long, base double, score double, bytes long, rare array<long>, times array<int>"
    facts = materialize(given.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    each = facts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), "x.times")
    found = each.join(words.select("key", "learnt"), "key")
    rest = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("learnt") + SMOOTHING)).alias("more"), F.sum(F.when(F.col("learnt") > 0, F.col("times")).otherwise(0)).alias("met"))
    done = facts.select("row", "id", "held_out", "n_tokens", "known", "base", "score", "bytes").join(rest, "row", "left")
    return done.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        "score",
        F.col("bytes").alias("code_bytes"),
        (-F.col("score") / F.lit(math.log10(2)) / F.col("bytes")).alias("code_length"),
    )
