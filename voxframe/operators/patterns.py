"""Keyword patterns as tables: growth of seed pairs, support, conflicts, choice and quality rules.

Support and overlap come from one inverted index: for each keyword and each run of 32,768 comments a bitmap of the
comments that hold it. A pattern's comments are the meet of the bitmaps of its seeds with the join of those of its
context, an overlap is the number of bits that two patterns share. So what is shuffled is the exploded keywords once and
bitmaps after that; no array of tokens is copied, and no rows arise for pairs of patterns within a comment or keyword.

A choice among overlapping rows is an independent set in rank order: a row is taken unless a better one that is taken
conflicts with it. The table form needs no loop over rows. In each round every undecided row without a better undecided
rival is taken, and what conflicts with it is out; all rows that are best among their rivals are settled at once. Once the
conflicts left are few, one task settles them in order, so that a long chain does not take a round for each link.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.markers import literals
from voxframe.functions.text import collapse_space, safe_text
from voxframe.operators.mining import DEFAULT, MiningRules, comment_keywords, cooccurrence, seed_pairs
from voxframe.operators.relational import attach, top_per_group, unnest
from voxframe.operators.similar import ids_to_texts
from voxframe.rules import messages
from voxframe.session import materialize


#: Conflicts that one task settles by itself.
SETTLED = 200_000


# The limits that must hold for results to be right.
@dataclass(frozen=True)
class PatternLimits:
    """Every limit of the pattern run, the same for any number of comments."""

    min_pair_count: int = 5
    #: Pairs at or above this quantile of the score are seeds; neighbours at or above each of the others may join.
    seed_quantile: float = 0.60
    growth_quantiles: Sequence[float] = (0.88, 0.80, 0.72, 0.64)
    added: int = 3
    #: A keyword joins at this share of the seed's score, with these factors for a link to both seed words, a hub, and
    #: its frequency.
    seed_share: float = 0.42
    bridge: float = 1.12
    hub_factor: float = 0.58
    frequency_scale: float = 3000.0
    frequency_bonus: float = 0.35
    min_support: int = 6
    coverage: tuple[float, float] = (0.02, 34.0)
    #: Patterns conflict from this share of common keywords or comments on.
    keyword_overlap: float = 0.40
    comment_overlap: float = 0.45
    #: Quality rules: least coverage in percent, least keywords a sample comment shares, and similarity of twins.
    min_coverage: float = 0.5
    min_overlap: int = 2
    twin_overlap: float = 0.40
    top_overlap: float = 0.35


LIMITS = PatternLimits()


def _hub(token: Column, rules: MiningRules) -> Column:
    return token.isin(*rules.hubs) if rules.hubs else F.lit(False)


def _abstract(token: Column, rules: MiningRules) -> Column:
    return token.isin(*rules.abstract) if rules.abstract else F.lit(False)


def keyword_frequency(arrays: DataFrame) -> DataFrame:
    """Comments that hold each keyword."""
    return unnest(arrays, F.array_distinct("tokens"), "token").groupBy("token").agg(F.count("*").alias("frequency"))


def expanded_seeds(pairs: DataFrame, arrays: DataFrame, limits: PatternLimits = LIMITS, rules: MiningRules = DEFAULT) -> DataFrame:
    """``seed_a, seed_b, seed_score, keyword_set``: seeds grown by their best neighbours, once for each different set."""
    c = F.col
    cuts = pairs.agg(F.percentile("rank_score", F.array(*[F.lit(q) for q in limits.growth_quantiles])).alias("cuts"))
    seeds = seed_pairs(pairs, limits.seed_quantile, limits.min_pair_count, rules)
    seeds = seeds.select(c("keyword_1").alias("seed_a"), c("keyword_2").alias("seed_b"), c("rank_score").alias("seed_score"))
    # Links of a seed word to any other word, by an equal join on the seed word.
    ways = F.array(F.struct(c("keyword_1").alias("word"), c("keyword_2").alias("token")), F.struct(c("keyword_2").alias("word"), c("keyword_1").alias("token")))
    links = pairs.where("rank_score > 0").select(F.explode(ways).alias("w"), "rank_score").select("w.word", "w.token", "rank_score")
    ends = seeds.select("*", F.explode(F.array(F.struct(c("seed_a").alias("word"), F.lit("a").alias("side")), F.struct(c("seed_b").alias("word"), F.lit("b").alias("side")))).alias("e"))
    near = ends.select("seed_a", "seed_b", "seed_score", "e.word", "e.side").join(links, "word").where("token <> seed_a and token <> seed_b")
    score = lambda side: F.coalesce(F.max(F.when(c("side") == side, c("rank_score"))), F.lit(0.0))
    scored = near.groupBy("seed_a", "seed_b", "seed_score", "token").agg(score("a").alias("to_a"), score("b").alias("to_b"))
    scored = scored.join(keyword_frequency(arrays), "token", "left").where(~_hub(c("token"), rules) | _hub(c("seed_a"), rules) | _hub(c("seed_b"), rules))
    best = F.greatest("to_a", "to_b")
    value = best * F.when((c("to_a") > 0) & (c("to_b") > 0), limits.bridge).otherwise(1.0) * F.when(_hub(c("token"), rules), limits.hub_factor).otherwise(1.0)
    value = value * (1.0 + F.least(F.coalesce("frequency", F.lit(0)) / F.lit(limits.frequency_scale), F.lit(limits.frequency_bonus)))
    levels = cuts.select(F.posexplode("cuts").alias("level", "cut"))
    fits = scored.withColumns({"best": best, "value": F.round(value, 9)}).where(F.round(value, 9) >= F.round(c("seed_score") * limits.seed_share, 9))
    # One row for each level that a neighbour reaches: levels are a handful of numbers beside it.
    reached = fits.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), levels.where(c("level") == i).select("cut").scalar().alias("cut")) for i in range(len(limits.growth_quantiles))])).alias("l"))
    reached = reached.where(c("best") >= c("l.cut")).select("seed_a", "seed_b", c("l.level").alias("level"), "token", "value")
    top = top_per_group(reached, ["seed_a", "seed_b", "level"], [c("value").desc(), c("token")], limits.added, "place")
    sets = top.groupBy("seed_a", "seed_b", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda s: s["token"]).alias("grown"))
    every = seeds.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(limits.growth_quantiles) - 1))).alias("level"))
    whole = every.join(sets, ["seed_a", "seed_b", "level"], "left").select("seed_a", "seed_b", "seed_score", F.concat(F.array("seed_a", "seed_b"), F.coalesce("grown", F.array().cast("array<string>"))).alias("keyword_set"))
    return whole.distinct()


def numbered(arrays: DataFrame) -> DataFrame:
    """Comments with a ``number`` from 1 on that is dense within the task that gave it, written so that it stays."""
    return materialize(arrays.withColumn("number", F.monotonically_increasing_id() + 1))


def _bitmaps(members: DataFrame, *keys: str) -> DataFrame:
    """``bucket, keys, bits`` of ``members(number, keys)``: which numbers of a run of 32,768 a key has."""
    return members.groupBy(F.bitmap_bucket_number("number").alias("bucket"), *keys).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def _words_of(table: pa.Table) -> np.ndarray:
    """Bitmaps of a group as rows of 64-bit words."""
    return np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(table), -1)


def pattern_bitmaps(patterns: DataFrame, comments: DataFrame, rules: MiningRules = DEFAULT) -> DataFrame:
    """``pattern_id, bucket, hits, bits``: the numbers of the comments with both seed words of a pattern and, if its set
    has any, a word that is not abstract. ``comments`` come from :func:`numbered`."""
    context = F.filter("keyword_set", lambda t: ~_abstract(t, rules))
    needs = patterns.select("pattern_id", "seed_a", "seed_b", context.alias("context"))
    entry = lambda t, seed: F.struct(t.alias("token"), F.lit(seed).alias("seed"))
    entries = F.concat(F.array(entry(F.col("seed_a"), True), entry(F.col("seed_b"), True)), F.transform("context", lambda t: entry(t, False)))
    needs = needs.select(F.col("pattern_id").cast("long").alias("pattern_id"), F.size("context").alias("choices"), F.explode(entries).alias("e")).select("pattern_id", "choices", "e.*")
    words = unnest(comments, F.array_distinct("tokens"), "token", "number")
    index = _bitmaps(attach(words, needs.select("token").distinct(), ["token"], "left_semi"), "token")

    def met(table: pa.Table) -> pa.Table:
        ids, seed, bits = table.column("pattern_id").to_numpy(), table.column("seed").to_numpy(), _words_of(table)
        choices = table.column("choices").to_numpy()
        order = np.argsort(ids, kind="stable")
        found = []
        for rows in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
            seeds, others = rows[seed[rows]], rows[~seed[rows]]
            if len(seeds) < 2 or (choices[rows[0]] and not len(others)):
                continue
            own = np.bitwise_and.reduce(bits[seeds], axis=0)
            if choices[rows[0]]:
                own = own & np.bitwise_or.reduce(bits[others], axis=0)
            if hits := int(np.bitwise_count(own).sum()):
                found.append((int(ids[rows[0]]), hits, own.tobytes()))
        bucket = table.column("bucket")[0].as_py()
        own_ids, hits, blobs = zip(*found) if found else ((), (), ())
        return pa.table({"pattern_id": pa.array(own_ids, pa.int64()), "bucket": pa.array([bucket] * len(found), pa.int64()), "hits": pa.array(hits, pa.int64()), "bits": pa.array(blobs, pa.binary())})

    # Dealt by bucket before the words meet their patterns, so that the larger result is not moved.
    joined = attach(index.repartition("bucket"), needs, ["token"], "inner").select("bucket", "pattern_id", "choices", "seed", "bits")
    return joined.groupBy("bucket").applyInArrow(met, "pattern_id long, bucket long, hits long, bits binary")


def pattern_support(bitmaps: DataFrame) -> DataFrame:
    """Comments of each pattern."""
    return bitmaps.groupBy("pattern_id").agg(F.sum("hits").alias("support"))


def _shared(bitmaps: DataFrame) -> DataFrame:
    """``a, b, n``: members that two ids share, ``a`` below ``b``; pairs without any are left out."""

    def count(table: pa.Table) -> pa.Table:
        ids, bits = table.column("pattern_id").to_numpy(), _words_of(table)
        order = np.argsort(ids)
        ids, bits = ids[order], bits[order]
        a, b, n = [], [], []
        for i in range(len(ids) - 1):
            both = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
            some = np.flatnonzero(both)
            a.append(np.full(len(some), ids[i]))
            b.append(ids[i + 1 :][some])
            n.append(both[some])
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.table({"a": join(a), "b": join(b), "n": join(n)})

    return bitmaps.select("bucket", "pattern_id", "bits").groupBy("bucket").applyInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _word_bitmaps(rows: DataFrame, words: str) -> DataFrame:
    """Bitmaps of the words of each pattern; the words of all patterns are a small vocabulary, numbered in order."""
    each = rows.select("pattern_id", F.explode(F.array_distinct(words)).alias("token"))
    numbers = each.select("token").distinct().withColumn("number", F.row_number().over(Window.orderBy("token")).cast("long"))
    return _bitmaps(each.join(numbers, "token"), "pattern_id")


def pattern_members(patterns: DataFrame, comments: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``pattern_id, comment_id, overlap``: comments of a few patterns, and how many words of the set they hold.

    Numbers come from the bitmaps; of a comment's words only those of the patterns travel.
    """
    own = bitmaps.join(patterns.select("pattern_id"), "pattern_id", "left_semi")
    # Bit i of a run is bit i % 8 of byte i / 8; bit 0 of the first run is number 1.
    byte = F.conv(F.hex(F.substring("bits", F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    each = own.select("pattern_id", "bucket", "bits", F.explode(F.sequence(F.lit(0), F.length("bits") - 1)).alias("at")).select("pattern_id", "bucket", "at", byte.alias("byte")).where("byte <> 0")
    each = each.select("pattern_id", "bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("(shiftright(byte, bit) & 1) = 1")
    hits = each.select("pattern_id", ((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("bit") + 1).alias("number"))
    sets = patterns.select("pattern_id", F.explode(F.array_distinct("keyword_set")).alias("token"))
    words = attach(unnest(comments, F.array_distinct("tokens"), "token", "number"), sets, ["token"], "inner")
    counts = words.join(hits, ["pattern_id", "number"], "left_semi").groupBy("pattern_id", "number").agg(F.count("*").alias("overlap"))
    return counts.join(comments.select("number", "comment_id"), "number").select("pattern_id", "comment_id", "overlap")


def candidates(pairs: DataFrame, arrays: DataFrame, total: Column, limits: PatternLimits = LIMITS, rules: MiningRules = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Grown seeds within the limits of support and coverage, with their names and their rank key; and their bitmaps.

    ``arrays`` come from :func:`numbered`."""
    c = F.col
    grown = expanded_seeds(pairs, arrays, limits, rules)
    grown = materialize(grown.withColumn("pattern_id", F.xxhash64("seed_a", "seed_b", "keyword_set")))
    bitmaps = materialize(pattern_bitmaps(grown, arrays, rules))
    support = pattern_support(bitmaps)
    share = c("support") * 100.0 / F.greatest(total, F.lit(1))
    kept = grown.join(support, "pattern_id").withColumn("coverage", share).where((c("support") >= limits.min_support) & c("coverage").between(*limits.coverage))
    kept = kept.withColumns({"coverage": F.round("coverage", 3), "strength": F.round("seed_score", 6)})
    words = kept.select("pattern_id", F.explode("keyword_set").alias("token")).join(keyword_frequency(arrays), "token", "left")
    ranked = F.array_sort(F.collect_list(F.struct(_hub(c("token"), rules).alias("hub"), (-F.coalesce("frequency", F.lit(0))).alias("f"), "token")))
    named = words.groupBy("pattern_id").agg(ranked.alias("ranked"))
    plain = F.array_sort(F.filter("keyword_set", lambda t: ~_hub(t, rules)))
    out = kept.join(named, "pattern_id").select(
        "*", F.array_join(F.slice(F.transform("ranked", lambda r: r["token"]), 1, 3), " / ").alias("pattern_label"), c("ranked")[0]["token"].alias("anchor"),
        F.array_join(F.slice(plain, 1, 2), " ").alias("head"), F.array_join(F.slice(plain, 1, 3), " ").alias("label_key"),
        F.struct((-c("coverage")).alias("c"), (-c("strength")).alias("s"), "seed_a", "seed_b", "keyword_set").alias("rank"),
    ).drop("ranked")
    return materialize(out), bitmaps


def _directed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Give each conflict ``a, b`` of two ids its direction: ``a`` has the better rank."""
    left, right = rows.select(F.col("pattern_id").alias("a"), F.col("rank").alias("__a")), rows.select(F.col("pattern_id").alias("b"), F.col("rank").alias("__b"))
    return pairs.distinct().join(left, "a").join(right, "b").where("__a < __b").select("a", "b")


def _same(rows: DataFrame, key: str) -> DataFrame:
    """Ids that share a key which is not empty; either direction."""
    own = rows.where(F.col(key) != "").select("pattern_id", key)
    return own.select(F.col("pattern_id").alias("a"), key).join(own.select(F.col("pattern_id").alias("b"), key), key).where("a <> b").select("a", "b")


def _sharing(bitmaps: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Ids whose members overlap by ``least`` (shared over all) or more, in either direction."""
    side = lambda n, size: sizes.select(F.col("pattern_id").alias(n), F.col("size").alias(size))
    sized = _shared(bitmaps).join(side("a", "x"), "a").join(side("b", "y"), "b")
    pairs = sized.where(F.col("n") >= (F.col("x") + F.col("y") - F.col("n")) * least).select("a", "b")
    return pairs.union(pairs.select("b", "a"))


def pattern_overlaps(rows: DataFrame, bitmaps: DataFrame, limits: PatternLimits = LIMITS) -> DataFrame:
    """Conflicts ``a, b`` of patterns with common keywords, comments, heads or labels; ``a`` has the better rank."""
    by_word = _sharing(_word_bitmaps(rows, "keyword_set"), rows.select("pattern_id", F.size("keyword_set").alias("size")), limits.keyword_overlap)
    own = bitmaps.join(rows.select("pattern_id"), "pattern_id", "left_semi")
    by_comment = _sharing(own, rows.select("pattern_id", F.col("support").alias("size")), limits.comment_overlap)
    return _directed(rows, by_word.union(by_comment).union(_same(rows, "head")).union(_same(rows, "label_key")).union(_same(rows, "pattern_label")))


def _settled(conflicts: DataFrame) -> DataFrame:
    """The ids taken among those that conflict, settled in one task: better rivals come first."""

    def settle(table: pa.Table) -> pa.Table:
        better: dict[int, list[int]] = {}
        behind: dict[int, list[int]] = {}
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            better.setdefault(b, []).append(a)
            behind.setdefault(a, []).append(b)
        open_rivals = {b: len(r) for b, r in better.items()}
        ready, taken = [a for a in behind if a not in better], set()
        while ready:
            one = ready.pop()
            if not any(r in taken for r in better.get(one, ())):
                taken.add(one)
            for b in behind.get(one, ()):
                open_rivals[b] -= 1
                if not open_rivals[b]:
                    ready.append(b)
        return pa.table({"pattern_id": pa.array(sorted(taken), pa.int64())})

    return conflicts.groupBy(F.lit(0).alias("all")).applyInArrow(settle, "pattern_id long")


def independent(ids: DataFrame, conflicts: DataFrame, settled: int = SETTLED) -> DataFrame:
    """The ids that are taken in rank order when a taken one rules out those behind it that conflict with it.

    Up to ``settled`` conflicts are left to one task; more are first thinned in rounds of joins.
    """
    left, edges = ids.select("pattern_id").distinct(), materialize(conflicts.select("a", "b").distinct())
    taken = left.where("false")
    while edges.count() > settled:
        left = materialize(left)
        ruled = edges.select(F.col("b").alias("pattern_id")).distinct()
        won = materialize(left.join(ruled, "pattern_id", "left_anti"))
        taken = taken.union(won)
        out = edges.join(won.select(F.col("pattern_id").alias("a")), "a", "left_semi").select(F.col("b").alias("pattern_id")).union(won).distinct()
        left = materialize(left.join(out, "pattern_id", "left_anti"))
        rest = left.select("pattern_id")
        edges = materialize(edges.join(rest.select(F.col("pattern_id").alias("a")), "a", "left_semi").join(rest.select(F.col("pattern_id").alias("b")), "b", "left_semi"))
    apart = left.join(edges.select(F.explode(F.array("a", "b")).alias("pattern_id")), "pattern_id", "left_anti")
    return taken.union(apart).union(_settled(edges))


def chosen_patterns(rows: DataFrame, bitmaps: DataFrame, top_n: int, limits: PatternLimits = LIMITS) -> DataFrame:
    """The best patterns that do not overlap: first with different anchors, then, for what is left, whatever their anchor."""
    overlaps = materialize(pattern_overlaps(rows, bitmaps, limits))
    apart = materialize(independent(rows, overlaps.union(_directed(rows, _same(rows, "anchor")))))
    both = overlaps.union(overlaps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(apart.select(F.col("pattern_id").alias("a")), "a", "left_semi").select(F.col("b").alias("pattern_id")).union(apart)
    others = materialize(rows.select("pattern_id").join(near, "pattern_id", "left_anti"))
    fill = independent(others, overlaps.join(others.select(F.col("pattern_id").alias("a")), "a", "left_semi").join(others.select(F.col("pattern_id").alias("b")), "b", "left_semi"))
    order = apart.withColumn("turn", F.lit(0)).union(fill.withColumn("turn", F.lit(1)))
    return rows.join(order, "pattern_id").orderBy("turn", "rank").limit(top_n)


def top_patterns(base: DataFrame, top_n: int = 5, limits: PatternLimits = LIMITS, rules: MiningRules = DEFAULT, samples: int = 3) -> DataFrame:
    """``pattern_label, coverage, keyword_set, representative_comment_ids`` of the chosen patterns."""
    arrays = numbered(comment_keywords(base, rules))
    pairs = materialize(cooccurrence(arrays, limits.min_pair_count, rules))
    rows, bitmaps = candidates(pairs, arrays, F.lit(base.select("comment_id").distinct().count()), limits, rules)
    chosen = materialize(chosen_patterns(rows, bitmaps, top_n, limits))
    best = top_per_group(pattern_members(chosen, arrays, bitmaps), ["pattern_id"], [F.col("overlap").desc(), F.col("comment_id")], samples, "place")
    ids = best.groupBy("pattern_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "comment_id"))), lambda s: s["comment_id"]).alias("representative_comment_ids"))
    return chosen.join(ids, "pattern_id").select("pattern_label", "coverage", "keyword_set", "representative_comment_ids")


def pattern_gate(base: DataFrame, patterns: DataFrame, top_n: int = 5, limits: PatternLimits = LIMITS, rules: MiningRules = DEFAULT) -> dict[str, DataFrame]:
    """Patterns that pass the quality rules, those that do not with the reason, and the different top ones."""
    c = F.col
    rows = patterns.withColumn("pattern_id", F.xxhash64("pattern_label", "keyword_set"))
    core = F.filter("keyword_set", lambda t: ~_abstract(t, rules) & ~_hub(t, rules))
    rows = materialize(rows.select("*", core.alias("core"), F.struct((-c("coverage")).alias("c"), "pattern_label", "keyword_set").alias("rank")))
    ids = rows.select("pattern_id", "keyword_set", F.posexplode("representative_comment_ids").alias("place", "comment_id"))
    tokens = comment_keywords(base.join(ids.select("comment_id").distinct(), "comment_id", "left_semi"), rules)
    held = ids.join(tokens, "comment_id").where(F.size(F.array_intersect("keyword_set", "tokens")) >= limits.min_overlap)
    aligned = held.groupBy("pattern_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "comment_id"))), lambda s: s["comment_id"]).alias("aligned"))
    concrete = F.size(F.filter(F.array_distinct("keyword_set"), lambda t: ~_abstract(t, rules)))
    vague = F.exists("keyword_set", lambda t: _abstract(t, rules)) & (concrete < 2)
    reasons = F.concat_ws(
        "; ",
        F.when(c("coverage") < limits.min_coverage, f"coverage_below_threshold(<{limits.min_coverage}%)"),
        F.when(vague, "contains_abstract_token(issue/problem)"),
        F.when(c("aligned").isNull(), f"representative_alignment_fail(overlap<{limits.min_overlap})"),
    )
    judged = materialize(rows.join(aligned, "pattern_id", "left").withColumn("removed_reason", reasons))
    passed = judged.where("removed_reason = ''").withColumn("representative_comment_ids", c("aligned"))
    similar = materialize(_similar(passed, limits.top_overlap))
    twins = similar.where(c("likeness") >= limits.twin_overlap)
    kept = materialize(independent(passed, twins))
    distinct = passed.join(kept, "pattern_id")
    # The first kept pattern that a removed one repeats.
    labels = distinct.select(c("pattern_id").alias("a"), c("pattern_label").alias("twin"), c("rank").alias("twin_rank"))
    repeats = twins.join(labels, "a").groupBy(c("b").alias("pattern_id")).agg(F.min_by("twin", "twin_rank").alias("twin"))
    again = passed.join(kept, "pattern_id", "left_anti").join(repeats, "pattern_id").withColumn("removed_reason", F.concat(F.lit("semantic_duplicate_of:"), "twin"))
    anchored = distinct.withColumn("anchor", F.coalesce(F.try_element_at(F.filter(F.concat(F.transform(F.split("pattern_label", "/"), lambda p: F.lower(F.trim(p))), "keyword_set"), lambda p: (p != "") & ~_abstract(p, rules)), F.lit(1)), F.lit("")))
    inside = similar.join(kept.select(c("pattern_id").alias("a")), "a", "left_semi").join(kept.select(c("pattern_id").alias("b")), "b", "left_semi")
    top = materialize(independent(kept, inside.select("a", "b").union(_directed(anchored, _same(anchored, "anchor")))))
    columns = ["pattern_label", "coverage", "keyword_set", "representative_comment_ids"]
    final = distinct.join(top, "pattern_id").orderBy("rank").limit(top_n)
    gone = judged.where("removed_reason <> ''").select(*columns, "removed_reason").union(again.select(*columns, "removed_reason"))
    return {"input_patterns": patterns, "filtered_patterns": distinct.select(*columns), "removed_patterns": gone, "final_top_patterns": final.select(*columns)}


def _similar(rows: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b, likeness`` of patterns whose keyword sets or core words are alike; ``a`` has the better rank.

    Patterns without a core word are alike in that.
    """
    rows = rows.withColumn("core", F.when(F.size("core") == 0, F.array(F.lit(""))).otherwise(F.col("core")))

    def likeness(words: str, name: str) -> DataFrame:
        side = lambda n, size: rows.select(F.col("pattern_id").alias(n), F.size(F.array_distinct(words)).alias(size))
        sized = _shared(_word_bitmaps(rows, words)).join(side("a", "x"), "a").join(side("b", "y"), "b")
        return sized.select("a", "b", (F.col("n") / (F.col("x") + F.col("y") - F.col("n"))).alias(name))

    both = likeness("keyword_set", "by_set").join(likeness("core", "by_core"), ["a", "b"], "full")
    alike = both.select("a", "b", F.greatest("by_set", "by_core").alias("likeness")).where(F.col("likeness") >= least)
    alike = alike.union(alike.select("b", "a", "likeness"))
    return alike.join(_directed(rows, alike.select("a", "b")), ["a", "b"])


def snippet(text: Column, longest: int = 170, least: int = 80) -> Column:
    """One line of a text: up to the end of its first sentence if that is not short, and never over ``longest``."""
    value = collapse_space(safe_text(text))
    first = F.regexp_extract(value, r"^(.*?[.!?。！？])\s", 1)
    cut = F.when(F.length(first) + 1 >= least, first).otherwise(value)
    return F.when(F.length(cut) <= longest, cut).otherwise(F.concat(F.rtrim(F.substring(cut, 1, longest)), F.lit("...")))


def pattern_cards(patterns: DataFrame, comments: DataFrame, text: str = "text_clean", samples: int = 3) -> DataFrame:
    """Patterns with a readable label, an insight, an action, and the texts and snippets of their sample comments."""
    c = F.col
    words = F.transform("keyword_set", F.lower)
    label = F.coalesce(
        *[F.when(F.size(F.array_except(literals(needed), c("__words"))) == 0, name) for needed, name in messages.PATTERN_LABELS],
        F.when(F.size("__named") > 0, F.concat(F.lit(messages.PATTERN_LABEL_PREFIX), F.array_join(F.slice("__named", 1, 3), " · "))),
        F.nullif(c("pattern_label"), F.lit("")), F.lit(messages.PATTERN_LABEL_NONE),
    )
    action = F.coalesce(*[F.when(F.arrays_overlap("__words", literals(some)), name) for some, name in messages.PATTERN_ACTIONS], F.lit(messages.PATTERN_ACTION_OTHER))
    focus = F.when(F.size("__named") > 0, F.array_join(F.slice("__named", 1, 2), ", ")).otherwise(c("pattern_label"))
    rows = patterns.withColumns({"__words": words, "__named": F.filter("keyword_set", lambda t: t != "")})
    rows = rows.select(
        *patterns.columns, label.alias("display_label"), F.format_string(messages.PATTERN_INSIGHT, "pattern_label", c("coverage").cast("double"), focus).alias("insight"), action.alias("action")
    )
    rows = rows.withColumn("__key", F.xxhash64("pattern_label", "keyword_set"))
    told = ids_to_texts(rows, "representative_comment_ids", comments, ["__key"], text, samples).drop("__key")
    full = F.filter(F.transform("representative_comments", lambda t: snippet(t)), lambda t: t != "")
    return told.withColumn("representative_comment_snippets", full).withColumnRenamed("representative_comments", "representative_comment_full")
