"""Byte-level BPE by recursive queries, and back.

A text is cut into pieces by a pattern; every different piece is encoded once in a task and kept in a small cache. The
pieces that are new become rows (piece, position, token), at first one for each byte. A recursive DuckDB query joins
neighbouring tokens with the merge table, takes the leftmost pair of least rank of each piece and contracts it, until
no piece has a pair that merges. Very long pieces contract all places of their least pair at once, from the left, pairs
that overlap waiting. The rows of the fixpoint, in the
order of their positions, are the tokens; an ordered aggregation of their bytes is the decoded piece.

The merge table follows from the ranks: a token merges from every way to cut it into two tokens, at its own rank. Since
a token ranks after its parts in a trained vocabulary, no contraction gives rise to a pair of lower rank, so taking all
places of the least pair at once gives what one place at a time gives (tested against the public encoder).

Each query runs in one thread with a memory limit, and stops after ``ROUNDS`` contractions to be continued from its
last rows, so that very long pieces need no more memory than ``ROUNDS`` times their length.

Defined results: null and empty texts have no tokens and decode to nothing (their digests are those of no bytes);
repeated rows stay. Special tokens are never made.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm import textbytes

ROUNDS = 64
#: New pieces for each query, and pieces of the younger half of the cache.
PIECES, CACHE = 20_000, 150_000
#: Bytes of a piece that is contracted one place at a time.
SHORT = 64
_BITS = 20

_LOW = (1 << _BITS) - 1

# The contraction of a step. ``spot`` is the piece and the position in one number. Short pieces contract the leftmost
# place of their least pair; long ones contract all places that do not overlap, counted from the left in each run.
_FIRST = """
  SELECT t.*, coalesce(((t.r::BIGINT << 32) | (t.spot & 4294967295)) = g.least, false) AS hit
  FROM t JOIN (SELECT spot >> 32 AS piece, min((r::BIGINT << 32) | (spot & 4294967295)) AS least FROM t WHERE r IS NOT NULL GROUP BY 1) g
    ON g.piece = t.spot >> 32
"""
_EVERY = """
  SELECT *, best AND (place - max(CASE WHEN best THEN 0 ELSE place END) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS hit
  FROM (SELECT t.*, coalesce(t.r = g.least, false) AS best, row_number() OVER (ORDER BY t.spot) AS place
        FROM t JOIN (SELECT spot >> 32 AS piece, min(r) AS least FROM t WHERE r IS NOT NULL GROUP BY 1) g ON g.piece = t.spot >> 32)
"""


def _steps(single: bool) -> str:
    """The recursive query: tok and nxt are neighbouring tokens, r the rank of their pair.

    ``ahead`` holds (contracted, r, nxt) of the next row in one number, so a step looks one row ahead and one back;
    where the row after the next one may be contracted too, ``beyond`` holds the same of that one.
    """
    own = f"(hit::BIGINT << {2 * _BITS}) | (coalesce(r, 0)::BIGINT << {_BITS}) | coalesce(nxt, {_LOW})"
    return f"""
    WITH RECURSIVE t(spot, tok, nxt, r, step) AS (
      SELECT s.spot, s.tok, s.nxt, m.r, 0 FROM start s LEFT JOIN merges m ON m.pair = (s.tok::BIGINT << {_BITS}) | s.nxt
      UNION ALL
      SELECT n.spot, n.tok, n.nxt, m.r, n.step FROM (
        SELECT spot, step + 1 AS step, gone, CASE WHEN hit THEN r ELSE tok END AS tok,
          CASE WHEN nxt IS NULL THEN NULL
               WHEN hit THEN {"" if single else f"CASE WHEN (ahead & {_LOW}) < {_LOW} AND beyond >= (1::BIGINT << {2 * _BITS}) THEN (beyond >> {_BITS}) & {_LOW} ELSE "}nullif(ahead & {_LOW}, {_LOW}){"" if single else " END"}
               WHEN ahead >= (1::BIGINT << {2 * _BITS}) THEN (ahead >> {_BITS}) & {_LOW}
               ELSE nxt END AS nxt
        FROM (
          SELECT spot, step, tok, nxt, r, hit,
            lead({own}) OVER by_place AS ahead, {"NULL" if single else f"lead({own}, 2) OVER by_place"} AS beyond,
            (spot & 4294967295) > 0 AND coalesce(lag(hit) OVER by_place, false) AS gone
          FROM ({_FIRST if single else _EVERY}) WHERE step < {ROUNDS}
          WINDOW by_place AS (ORDER BY spot))
        ) n LEFT JOIN merges m ON m.pair = (n.tok::BIGINT << {_BITS}) | n.nxt
      WHERE NOT n.gone
    )
    SELECT t.spot, t.tok, t.r FROM t JOIN (SELECT spot >> 32 AS piece, max(step) AS last FROM t GROUP BY 1) f ON t.spot >> 32 = f.piece AND t.step = f.last
    """


_DECODE = "SELECT spot >> 32 AS piece, list(tok ORDER BY spot) AS ids, list(bytes ORDER BY spot) AS bytes FROM done JOIN vocabulary USING (tok) GROUP BY 1 ORDER BY 1"

def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 and rank on each line) in order of their ids."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    tokens = [base64.b64decode(token) for token, _ in sorted(pairs, key=lambda p: int(p[1]))]
    if [int(r) for r in sorted((int(r) for _, r in pairs))] != list(range(len(tokens))) or len(tokens) >= (1 << _BITS) - 1:
        raise ValueError("ranks must run from 0 without a gap")
    if not {bytes([i]) for i in range(256)} <= set(tokens):
        raise ValueError("the vocabulary lacks single bytes")
    return tokens


class Encoder:
    """Encodes and decodes pieces with DuckDB; holds the merge table and the cache of one Python process."""

    def __init__(self, tokens: list[bytes], memory: str = "300MB"):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        ranks = {token: i for i, token in enumerate(tokens)}
        pairs, whole = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << _BITS) | right)
                    whole.append(rank)
        self._put("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "r": pa.array(whole, pa.int32())}))
        self._put("vocabulary", pa.table({"tok": pa.array(range(len(tokens)), pa.int32()), "bytes": pa.array(tokens, pa.binary())}))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _put(self, name: str, table: pa.Table) -> None:
        self.con.register("_given", table)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _given")
        self.con.unregister("_given")

    def encode(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian 32-bit) and decoded bytes of each piece; pieces hold a byte at least."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.repeat(np.cumsum(size) - size, size)
        at = (np.repeat(np.arange(len(pieces)), size) << 32) | (np.arange(len(first)) - first)
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        query = _steps(bool(size.max(initial=0) <= SHORT))
        done = []
        while len(at):
            last = np.append(at[1:] >> 32 != at[:-1] >> 32, True)
            self.con.register("start", pa.table({"spot": at, "tok": tok, "nxt": pa.array(np.append(tok[1:], 0).astype(np.int32), pa.int32(), mask=last)}))
            out = self.con.sql(query).to_arrow_table()
            self.con.unregister("start")
            at, tok = out.column("spot").to_numpy(), out.column("tok").to_numpy()
            live = np.isin(at >> 32, at[out.column("r").is_valid().to_numpy()] >> 32)
            done.append(pa.table({"spot": at[~live], "tok": tok[~live]}))
            order = np.argsort(at[live])
            at, tok = at[live][order], tok[live][order]
        self.con.register("done", pa.concat_tables(done))
        out = self.con.sql(_DECODE).to_arrow_table().combine_chunks()
        self.con.unregister("done")
        ids, parts = out.column("ids").chunk(0), out.column("bytes").chunk(0)
        flat = ids.flatten().to_numpy().astype("<u4").tobytes()
        data, at = textbytes.raw(parts.flatten())
        data, cuts = data.tobytes(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        ends = at[cuts].tolist()
        cuts = (4 * cuts).tolist()
        return [(flat[a:b], data[c:d]) for a, b, c, d in zip(cuts, cuts[1:], ends, ends[1:])]

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """The cache with all of ``pieces`` in it. What was not asked for lately leaves it."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        new = []
        for piece in pieces:
            if piece not in self.young:
                known = self.old.get(piece)
                if known is None:
                    new.append(piece)
                else:
                    self.young[piece] = known
        for group in ([p for p in new if len(p) <= SHORT // 4], [p for p in new if len(p) > SHORT // 4]):
            for start in range(0, len(group), PIECES):
                some = group[start : start + PIECES]
                self.young.update(zip(some, self.encode([p.encode() for p in some])))
        return self.young


def _encoder(tokens: list[bytes]) -> Encoder:
    return textbytes.state(("byte_bpe", hashlib.sha256(b"\0".join(tokens)).digest()), lambda: Encoder(tokens))


def encoded(docs: DataFrame, *, vocabulary: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document: the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``vocabulary``: path of a rank file, read once on the driver. ``with_ids`` adds ``ids`` and the ``decoded`` text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [source.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        tokens, cut = shared.value
        coder, pieces_of = _encoder(tokens), regex.compile(cut).findall
        for part in textbytes.slices(batches, "text"):
            pieces = [pieces_of(text) if text else [] for text in part.column("text").to_pylist()]
            known = coder.learn(set().union(*pieces))
            n, ids_digest, decoded_digest, all_ids, all_decoded = [], [], [], [], []
            for own in pieces:
                got = [known[p] for p in own]
                ids, decoded = b"".join([g[0] for g in got]), b"".join([g[1] for g in got])
                n.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                decoded_digest.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int64))
                    all_decoded.append(decoded.decode())
            columns = [part.column("id"), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded_digest, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    done = source.mapInArrow(run, T.StructType(fields))
    return done.select(F.col("id").alias(id_col), *[f.name for f in fields[1:]])
