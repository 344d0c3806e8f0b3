"""Ordered-context operators: neighbours, runs, gaps and segments of a document's rows.

All take rows (``doc``, ``idx``, ...); a document is one window partition, sorted once by ``idx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import starts


def by_doc(doc: str = "doc", idx: str = "idx"):
    return Window.partitionBy(doc).orderBy(idx)


def context(df: DataFrame, k: int, text: str = "text", doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``left`` and ``right``: the texts of up to ``k`` rows on either side, in order."""
    w = by_doc(doc, idx)
    return df.withColumn("left", F.collect_list(text).over(w.rowsBetween(-k, -1))).withColumn("right", F.collect_list(text).over(w.rowsBetween(1, k)))


def tagged_context(df: DataFrame, k: int, text: str = "text", doc: str = "doc", idx: str = "idx") -> DataFrame:
    x = context(df, k, text, doc, idx)
    target = F.concat(F.lit("<sentence>"), F.col(text), F.lit("</sentence>"))
    return x.withColumn("context", F.array_join(F.concat("left", F.array(target), "right"), " ")).drop("left", "right")


def neighbour_budget(df: DataFrame, n: int, text: str = "text", doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``left`` and ``right`` of at most ``n`` neighbours in all, taken in turns from the left first."""
    w = by_doc(doc, idx)
    x = context(df, n, text, doc, idx)
    ahead, after = F.size("left"), F.size("right")
    take = F.least(ahead, F.greatest(F.lit(-(-n // 2)), n - after))
    x = x.withColumn("_l", take).withColumn("_r", F.least(after, n - F.col("_l")))
    left = F.when(F.col("_l") > 0, F.slice("left", -F.greatest("_l", F.lit(1)), F.greatest("_l", F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return x.withColumn("left", left).withColumn("right", F.slice("right", F.lit(1), F.col("_r"))).drop("_l", "_r")


def token_budget(df: DataFrame, budget: int, text: str = "text", doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``n_left`` and ``n_right``: neighbours that fit a budget of words, in turns from the left first; a side
    closes when it ends or its next row doesn't fit, then the other goes on. A row of a word or more costs at
    least one, so no more than ``budget`` rows fit."""
    k = budget
    n = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    w = by_doc(doc, idx)
    x = df.withColumn("_n", F.greatest(n, F.lit(1)))
    x = x.withColumn("_l", F.reverse(F.collect_list("_n").over(w.rowsBetween(-k, -1)))).withColumn("_r", F.collect_list("_n").over(w.rowsBetween(1, k)))
    start = F.struct(F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("used"), F.lit(True).alias("lo"), F.lit(True).alias("ro"))

    def step(s, i):
        left_turn = (i % 2) == 0
        open_left = s["lo"] & (s["l"] < F.size("_l"))
        open_right = s["ro"] & (s["r"] < F.size("_r"))
        go_left = open_left & (left_turn | ~open_right)
        go_right = open_right & ~go_left
        cost = F.when(go_left, F.get("_l", s["l"])).when(go_right, F.get("_r", s["r"])).otherwise(0)
        fits = s["used"] + cost <= budget
        return F.struct(
            (s["l"] + F.when(go_left & fits, 1).otherwise(0)).alias("l"),
            (s["r"] + F.when(go_right & fits, 1).otherwise(0)).alias("r"),
            (s["used"] + F.when(fits, cost).otherwise(0)).alias("used"),
            (s["lo"] & (~go_left | fits)).alias("lo"),
            (s["ro"] & (~go_right | fits)).alias("ro"),
        )

    steps = F.sequence(F.lit(0), F.size("_l") + F.size("_r") + 3)
    out = F.aggregate(steps, start, step)
    return x.withColumn("_s", out).withColumn("n_left", F.col("_s.l")).withColumn("n_right", F.col("_s.r")).withColumn("words_used", F.col("_s.used")).drop("_n", "_l", "_r", "_s")


def numbered_chunk(df: DataFrame, k: int, text: str = "text", doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``chunk``: up to ``k`` rows on either side, numbered from 1; ``target_local_id`` and ``chunk_len``."""
    w = by_doc(doc, idx)
    around = F.collect_list(text).over(w.rowsBetween(-k, k))
    x = df.withColumn("_a", around).withColumn("target_local_id", F.least(F.row_number().over(w) - 1, F.lit(k)) + 1)
    numbered = F.transform("_a", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return x.withColumn("chunk", F.array_join(numbered, "\n")).withColumn("chunk_len", F.size("_a")).drop("_a")


def changed(value: str, doc: str = "doc", idx: str = "idx") -> Column:
    """Whether a row is the document's first or its value differs from the row before."""
    before = F.lag(value).over(by_doc(doc, idx))
    return F.row_number().over(by_doc(doc, idx)).eqNullSafe(1) | ~before.eqNullSafe(F.col(value))


def opened(flag: str, doc: str = "doc", idx: str = "idx") -> Column:
    """The flag, with the first row of each document set."""
    return F.col(flag) | (F.row_number().over(by_doc(doc, idx)) == 1)


def running_scene(flag: str, doc: str = "doc", idx: str = "idx") -> Column:
    return F.sum(F.col(flag).cast("int")).over(by_doc(doc, idx).rowsBetween(Window.unboundedPreceding, 0))


def segment_lengths(df: DataFrame, flag: str, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``scene`` and ``scene_len``, a border starting its scene."""
    x = df.withColumn("scene", running_scene(flag, doc, idx))
    return x.withColumn("scene_len", F.count(F.lit(1)).over(Window.partitionBy(doc, "scene")))


def border_terminated_lengths(df: DataFrame, flag: str, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """(doc, seq, scene_len): lengths with a border ending its scene; rows after the last border are one more."""
    w = by_doc(doc, idx)
    n = df.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col(flag), F.col(idx))).alias("last"))
    borders = df.where(flag).select(doc, F.col(idx).alias("seq"), F.greatest(F.lit(1), F.col(idx) - F.lag(idx, 1, -1).over(w)).cast("long").alias("scene_len"))
    tail = n.select(doc, F.col("n").cast("int").alias("seq"), (F.col("n") - F.coalesce("last", F.lit(-1)) - 1).alias("scene_len")).where("scene_len > 0")
    return borders.unionByName(tail)


def candidates(df: DataFrame, flag: str, long_scene: int = 10, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``merge_candidate``: a border beside a border; ``split_candidate``: another row in a long scene."""
    w = by_doc(doc, idx)
    beside = F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False))
    x = segment_lengths(df, flag, doc, idx).withColumn("merge_candidate", F.col(flag) & beside).withColumn("split_candidate", ~F.col(flag) & (F.col("scene_len") >= long_scene))
    return x.withColumn("review_flag", F.col("merge_candidate") | F.col("split_candidate"))


def consecutive_pairs(df: DataFrame, flag: str, doc: str = "doc", idx: str = "idx", shown: int = 5) -> DataFrame:
    """(doc, pairs, examples): borders right after one another, the first few as examples."""
    b = df.where(flag)
    x = b.select(doc, F.col(idx).alias("b"), F.lead(idx).over(by_doc(doc, idx)).alias("next")).where("next = b + 1")
    return x.groupBy(doc).agg(F.count(F.lit(1)).alias("pairs"), F.slice(F.array_sort(F.collect_list("b")), 1, shown).alias("examples"))


def runs(df: DataFrame, flag: str, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """(doc, start, n): runs of consecutive flagged positions."""
    x = df.where(flag).withColumn("_g", F.col(idx) - F.row_number().over(by_doc(doc, idx)))
    return x.groupBy(doc, "_g").agg(F.min(idx).alias("start"), F.count(F.lit(1)).alias("n")).drop("_g")


def longest_run(df: DataFrame, flag: str, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """(doc, run_len, run_start): the longest run; the earliest of equal ones."""
    best = F.max_by(F.struct("n", "start"), F.struct("n", (-F.col("start")).alias("s")))
    return runs(df, flag, doc, idx).groupBy(doc).agg(best.alias("b")).select(doc, F.col("b.n").alias("run_len"), F.col("b.start").alias("run_start"))


def wide_gaps(df: DataFrame, flag: str, least: int, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """(doc, gaps): how many gaps between successive borders are ``least`` or more."""
    x = df.where(flag).select(doc, (F.lead(idx).over(by_doc(doc, idx)) - F.col(idx)).alias("g"))
    return x.groupBy(doc).agg(F.count_if(F.col("g") >= least).alias("gaps"))


def gap_stats(df: DataFrame, flag: str, doc: str = "doc", idx: str = "idx") -> DataFrame:
    x = df.withColumn("_b", F.when(F.col(flag), F.col(idx)))
    w = by_doc(doc, idx).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_g", F.when(F.col(flag), F.col(idx) - F.last("_b", ignorenulls=True).over(w)))
    return x.groupBy(doc).agg(
        F.avg("_g").alias("avg_gap"), F.min("_g").alias("min_gap"), F.max("_g").alias("max_gap"), (F.count_if(F.col(flag)) / F.count(F.lit(1))).alias("border_rate")
    )


def label_at_offset(label: str, offset: int, valid: str, doc: str = "doc", idx: str = "idx") -> Column:
    """The label of the row whose index differs by exactly ``offset`` (none if that index is missing or invalid)."""
    w = by_doc(doc, idx).rangeBetween(offset, offset)
    return F.max(F.when(F.col(valid), F.col(label))).over(w)


def nearest_valid(df: DataFrame, label: str, valid: str, reach: int = 5, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``prev_label``, ``prev_dist``, ``next_label``, ``next_dist``: the nearest valid labels within ``reach``."""
    w = by_doc(doc, idx)
    ok_label, ok_idx = F.when(F.col(valid), F.col(label)), F.when(F.col(valid) & F.col(label).isNotNull(), F.col(idx))
    back, ahead = w.rangeBetween(-reach, -1), w.rangeBetween(1, reach)
    return (
        df.withColumn("prev_label", F.last(ok_label, ignorenulls=True).over(back))
        .withColumn("prev_dist", F.col(idx) - F.last(ok_idx, ignorenulls=True).over(back))
        .withColumn("next_label", F.first(ok_label, ignorenulls=True).over(ahead))
        .withColumn("next_dist", F.first(ok_idx, ignorenulls=True).over(ahead) - F.col(idx))
    )


def distance_to(flag: str, doc: str = "doc", idx: str = "idx") -> Column:
    """Positions to the nearest flagged row (0 on it); null if the document has none."""
    w, b = by_doc(doc, idx), F.when(F.col(flag), F.col(idx))
    back = F.col(idx) - F.last(b, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(b, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col(idx)
    return F.least(back, ahead)


def opposite_near(df: DataFrame, flag: str, other: str, reach: int, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``near``: whether ``other`` holds within ``reach`` rows (by rank among the rows present), the row itself left out."""
    w = by_doc(doc, idx)
    x = F.coalesce(F.max(F.col(other)).over(w.rowsBetween(-reach, -1)), F.lit(False)) | F.coalesce(F.max(F.col(other)).over(w.rowsBetween(1, reach)), F.lit(False))
    return df.withColumn("near", F.col(flag) & x)


def global_position(df: DataFrame, group: list, order: list, name: str = "position") -> DataFrame:
    """``name``: each row's place from 1 among all rows by ``group``, then ``order``, where ``group`` are columns.

    Groups are counted and their sizes summed by ranges; rows are ranked in their own group, so no task sees all rows.
    """
    n = starts(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), group, "_n", "_start").drop("_n")
    x = df.withColumn("_own", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).join(n, group)
    return x.withColumn(name, (F.col("_own") + F.col("_start")).cast("int")).drop("_own", "_start")
