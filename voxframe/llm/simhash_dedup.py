"""Near copies by SimHash, found with an index of byte positions and a count filter.

A text becomes its words (runs of bytes other than ASCII white space, A-Z lower-cased) and three-word shingles, repeats
included; a bit of the 64-bit fingerprint is 1 if more than half of the shingles' XXH64 values have it. Fingerprints
that differ in at most three bits differ in at most three of their eight bytes, so at least five positional bytes are
the same. One half of the bytes then differs in one byte at most, so the index holds, for either half, the four ways
to choose three of its bytes: eight postings for a fingerprint, of which a linked pair shares one. Rows of a posting
are compared in blocks: the shared positional bytes are tallied, pairs with five or more are kept and verified.

Only distinct fingerprints are indexed, copies follow their fingerprint. A block comparison hands on a spanning forest
of its links, never all pairs.

Defined results: null and empty texts have the fingerprint zero, which links like any other; texts of one or two words
have one shingle, the whole sequence; a null id takes the smallest id of its component, if there is one; repeated rows
stay, each with the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm import blocks, textbytes
from voxframe.llm.components import components
from voxframe.session import materialize

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Positional bytes that two fingerprints within MAX_BITS have in common at least.
SHARED_BYTES = 8 - MAX_BITS


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp`` for each row; the fingerprint as a signed long."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textbytes.release()
        for part in textbytes.slices(batches, "text"):
            data, offsets = textbytes.raw(part.column("text"))
            whole = data.tobytes()
            at = offsets.tolist()
            values = np.array([fingerprint(whole[s:e], shingle_words) for s, e in zip(at, at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _postings() -> list[int]:
    """Masks of three bytes out of either half."""
    masks = []
    for half in (0, 4):
        for left_out in range(4):
            masks.append(sum(0xFF << (8 * (half + i)) for i in range(4) if i != left_out))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that join all fingerprints of ``prints(fp)`` (distinct) within ``max_bits`` (3 at most)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index finds pairs of at most three differing bits")
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("held")) for i, m in enumerate(_postings())])
    posted = prints.select("fp", F.explode(choices).alias("p")).select("fp", "p.choice", "p.held")

    def fn(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table | None:
        fp = table.column("fp").to_numpy()
        both = np.unique(np.concatenate([left, right]))
        own = fp[both].view(np.uint64)
        differ = own[:, None] ^ own[None, :]
        tally = np.zeros(differ.shape, np.int8)
        for i in range(8):
            tally += (differ >> np.uint64(8 * i)) & np.uint64(0xFF) == 0
        pairs = tally >= 8 - max_bits
        pairs[pairs] = np.bitwise_count(differ[pairs]) <= max_bits
        root = blocks.roots(pairs)
        moved = root != np.arange(len(root))
        if not moved.any():
            return None
        return pa.table({"a": fp[both][moved], "b": fp[both][root[moved]]})

    return blocks.compared(posted, ["choice", "held"], "fp", fn, "a long, b long")


def grouped(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each document: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable."""
    prints = materialize(fingerprints(docs, text_col=text_col, id_col=id_col, shingle_words=shingle_words))
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(classes.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with the smallest id of their group, all columns as they were.

    Of rows that share an id one stays, the smallest in the order of the columns. Rows with a null id cannot be told
    apart by id and stay as they are.
    """
    found = materialize(grouped(docs, text_col=text_col, id_col=id_col, max_bits=max_bits).select(F.col(id_col).alias("_id"), "component_id"))
    first = found.where("_id = component_id").groupBy("_id").agg(F.count("*").alias("_times"))
    kept = docs.join(first.select("_id"), docs[id_col] == F.col("_id"), "left_semi")
    nameless = docs.where(F.col(id_col).isNull())
    again = first.where("_times > 1").select("_id")
    if not again.take(1):
        return kept.union(nameless)
    single = kept.join(again, kept[id_col] == F.col("_id"), "left_anti")
    repeated = kept.join(again, kept[id_col] == F.col("_id"), "left_semi")
    once = repeated.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_row")).select("_row.*")
    return single.union(once).union(nameless)
