"""Quality rules: figures of each text, and lines that recur across the documents of a host.

Lines are normalised (lower case, white space to one blank, no blanks at the ends) and hashed. For each host the
documents that hold a line are counted. A line is over the limit if more than ``max_documents`` of a host hold it,
however large the host. Such lines are taken out; a document is depleted, and rejected, if fewer than ``least_words``
words or less than ``least_share`` of its words remain.

Texts are read once; what follows works on line hashes and word counts. Counts are summed in each task before they are
shuffled, and the few lines over the limit join with the line hashes, so a line in very many documents is no hot key.

Defined results: null and empty texts have no words and fail the base rules; a null host is a host of its own; a line
counts once in a document; every row is a document, so copies and repeated rows count and are judged one by one; lines
without a word are never counted or taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.session import materialize

WORD, SPACE, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Documents of a host that a line may be in.
MAX_DOCUMENTS = 50
LEAST_WORDS, LEAST_SHARE = 10, 0.5


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def figures(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``id, host``, the figures of each text, and ``lines`` as (hash, words)."""
    held = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = held.select("id", "host", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), _lines(F.col("text")).alias("kept_lines"))
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(window)]))
    first = split.select(
        "id",
        "host",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("kept_lines") - F.size(F.array_distinct("kept_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("kept_lines", lambda line: F.struct(_line_hash(line).alias("h"), F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))).alias("n"))).alias("lines"),
        F.when(n >= window, hashes).alias("windows"),
    )
    # Only a text with equal windows has them sorted.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    second = first.withColumn("sorted", F.when(again, F.array_sort(pairs))).drop("windows")
    same = lambda s, k: F.coalesce(F.get("sorted", k)["h"] == s["h"], F.lit(False))
    met = F.transform("sorted", lambda s, k: F.when(((k > 0) & same(s, k - 1)) | same(s, k + 1), s["i"]))
    starts = F.array_sort(F.filter(met, lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["sum"] + i + window - F.greatest(i, s["end"])).alias("sum"), (i + window).alias("end")),
        lambda s: s["sum"],
    )
    return second.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("sorted")


def frequent_lines(facts: DataFrame, *, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``host, h`` of the lines over the limit, from ``facts(host, lines)``, one row for each document."""
    each = facts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    return each.groupBy("host", "h").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents).select("host", "h")


def judged(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", max_documents: int = MAX_DOCUMENTS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each document: the id, the figures, ``removed_words``, ``base_failed`` and ``kept``."""
    facts = materialize(figures(docs, text_col=text_col, host_col=host_col, id_col=id_col).withColumn("row", F.monotonically_increasing_id()))
    limit = frequent_lines(facts, max_documents=max_documents).select(F.col("host").alias("name"), F.col("h").alias("line"))
    each = facts.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.n")
    gone = each.join(limit, (F.col("h") == F.col("line")) & F.col("host").eqNullSafe(F.col("name"))).groupBy("row").agg(F.sum("n").alias("removed"))
    done = facts.drop("lines").join(gone, "row", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    fine = (rest >= least_words) & (rest >= least_share * F.col("n_words"))
    return done.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", failed.alias("base_failed"), (~failed & fine).alias("kept"))


def cleaned(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The documents without the lines over the limit, all columns and rows as they were but the text; null stays null."""
    lines = F.transform(_lines(F.coalesce(F.col(text_col), F.lit(""))), lambda line: F.struct(_line_hash(line).alias("h")))
    facts = docs.select(F.col(host_col).cast("string").alias("host"), lines.alias("lines"))
    limit = frequent_lines(facts, max_documents=max_documents).groupBy("host").agg(F.collect_set("h").alias("gone")).select(F.col("host").alias("_host"), "gone")
    joined = docs.join(limit, F.col(host_col).cast("string").eqNullSafe(F.col("_host")), "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda line: ~line.rlike(WORD) | ~F.array_contains("gone", _line_hash(line)))
    return joined.withColumn(text_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
