"""Line dedup by a suffix array over sequences of line ids.

Lines with a word are numbered in order of their digests; only those that occur twice or more matter.  Prefix doubling
ranks the runs of 1, 2, 4, ... such lines that follow one another in a document: the rank of a run of 2L lines is that of
the pair of ranks of its halves, for pairs that occur twice or more.  Two overlapping powers of two give the rank of a run
of any length, and so the interval of suffixes that share it as a prefix.  A repeated run of at least ``min_words`` words
is covered by the shortest such runs that begin, and that end, at each of its lines; so these decide.  Every run but the
earliest of its interval, by id and line, is deleted; what overlapping runs delete together are the maximal repeated runs.

So each line that is deleted is, with its neighbours, part of a run of ``min_words`` words or more that occurs earlier, and
one copy always stays.  Lines without a word are never deleted and do not part a run.  Null texts stay null, empty texts
empty; columns called n_lines or n_removed are replaced.  Rows that repeat an id with another text are documents of their own, ordered by a digest of the text; rows that are
repeated whole are one document and get the same result.  A null id comes first.  Very long texts are cut into lines whole.
An empty table gives no rows.  Other columns, whatever their names, stay as they are.

The interval of a run is the group of the places where it begins; suffixes longer than that are not put in order, since no
decision depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import SPACE, SPACES
from .storage import hot_join, set_aside, written

DOC = ["_k", "_h"]
#: Buckets of documents, so many whatever the input: a bucket without deletions passes its texts on without a shuffle.
BUCKETS = 1 << 20
LEAST = -(1 << 63)


def _ranked(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Numbers that keep the order of ``keys``, for each group with its count; without gathering them anywhere."""
    return written(groups.orderBy(*keys).select(*keys, "_c", F.monotonically_increasing_id().alias(name)))


def repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_k, _h, _gone)``: for each document that loses lines their numbers, from 0."""
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("_k"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    lines = keyed.select(*DOC, F.posexplode(F.split("_text", "\n")).alias("_line", "_l")).withColumn("_l2", F.btrim("_l", F.lit(SPACES))).where("_l2 <> ''")
    lines = lines.select(*DOC, "_line", F.md5(F.col("_l").cast("binary")).alias("_digest"), F.least(F.size(F.split("_l2", SPACE)), F.lit(min_words)).alias("_w"))
    twice = _ranked(lines.groupBy("_digest").agg(F.count("*").alias("_c")).where("_c > 1"), ["_digest"], "r0")
    # Place among the document's lines with a word; neighbours in a run have neighbouring places.
    placed = lines.withColumn("_q", F.dense_rank().over(Window.partitionBy(*DOC).orderBy("_line")))
    kept = hot_join(placed, twice, ["_digest"], "_c", F.struct(*DOC, "_line")).select(*DOC, "_line", "_q", "_w", "r0").dropDuplicates([*DOC, "_q"])
    run = Window.partitionBy(*DOC).orderBy("_q")
    table = written(kept.withColumn("_run", F.col("_q") - F.row_number().over(run)))

    # Shortest runs of min_words words from each line and to each line: at most min_words lines.
    inside = Window.partitionBy(*DOC, "_run").orderBy("_q")
    ahead = F.collect_list("_w").over(inside.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("_w").over(inside.rowsBetween(1 - min_words, 0)))

    def shortest(words):
        """The least number of leading entries that add up to min_words; null if all together do not."""
        state = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")), lambda s, w: F.when(s.w >= min_words, s).otherwise(F.struct((s.n + 1).alias("n"), (s.w + w).alias("w"))))
        return F.when(state.w >= min_words, state.n)

    sized = table.withColumns({"_ahead": ahead, "_behind": behind})
    sized = sized.select(*table.columns, shortest(F.col("_ahead")).alias("_from"), shortest(F.col("_behind")).alias("_to"))
    sized = written(sized)
    longest = sized.agg(F.greatest(F.max("_from"), F.max("_to"))).first()[0]
    if longest is None:
        return table.limit(0).select(*DOC, F.array(F.col("_line")).alias("_gone"))

    ranks, level = sized.select(*DOC, "_run", "_q", "r0"), 0
    while 2 << level <= longest:
        halves = ranks.withColumns({"_a": F.col(f"r{level}"), "_b": F.lead(f"r{level}", 1 << level).over(inside)})
        pairs = halves.where("_a is not null and _b is not null").groupBy("_a", "_b").agg(F.count("*").alias("_c")).where("_c > 1")
        level += 1
        ranks = halves.join(_ranked(pairs, ["_a", "_b"], f"r{level}").drop("_c"), ["_a", "_b"], "left").drop("_a", "_b")
        ranks = written(ranks)

    # Each run by its length and the ranks of its first and last 2**level lines, which overlap.
    power = "cast(floor(log2(_m) + 1e-9) as int)"
    runs = sized.select(*DOC, F.explode(F.array(F.struct(F.col("_q").alias("s"), F.col("_from").alias("m")), F.struct((F.col("_q") - F.col("_to") + 1).alias("s"), F.col("_to").alias("m")))).alias("_r"))
    runs = runs.select(*DOC, F.col("_r.s").alias("_s"), F.col("_r.m").alias("_m")).where("_m is not null").distinct()
    runs = runs.withColumns({"_e": F.expr(power), "_t": F.expr(f"_s + _m - cast(shiftleft(1, {power}) as int)")})
    of = ranks.select(*DOC, "_q", F.array(*[F.col(f"r{k}") for k in range(level + 1)]).alias("_ranks"))
    first = runs.join(of.withColumnRenamed("_q", "_s"), [*DOC, "_s"]).withColumn("_x", F.expr("_ranks[_e]")).drop("_ranks").where("_x is not null")
    ranked = first.join(of.withColumnRenamed("_q", "_t"), [*DOC, "_t"]).withColumn("_y", F.expr("_ranks[_e]")).drop("_ranks").where("_y is not null")
    ranked = written(ranked.select(*DOC, "_s", "_m", "_x", "_y"))
    place = F.struct("_k", "_h", "_s")
    earliest = written(ranked.groupBy("_m", "_x", "_y").agg(F.min(place).alias("_first"), F.count("*").alias("_c")).where("_c > 1"))
    later = hot_join(ranked, earliest, ["_m", "_x", "_y"], "_c", place).where(place > F.col("_first"))
    places = later.select(*DOC, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_m") - 1)).alias("_q")).distinct()
    return places.join(sized.select(*DOC, "_q", "_line"), [*DOC, "_q"]).groupBy(*DOC).agg(F.collect_list("_line").alias("_gone"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` without later copies of repeated runs of lines, with ``n_lines`` and ``n_removed``; all rows stay."""
    docs, back = set_aside(docs, {"_k", "_h", "_gk", "_gh", "_gone", "_lines", "_stay", "_new", "_b"})
    gone = written(repeated_lines(docs, min_words, id_col, text_col)).withColumnRenamed("_k", "_gk").withColumnRenamed("_h", "_gh")
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    hit = F.broadcast(gone.select(bucket(F.col("_gh")).alias("_b")).distinct())  # BUCKETS rows at most
    keyed = docs.withColumns({"_k": F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)), "_h": F.xxhash64(text_col)}).withColumn("_b", bucket(F.col("_h")))
    touched = keyed.join(hit, "_b", "left_semi").join(gone, (F.col("_k") == F.col("_gk")) & (F.col("_h") == F.col("_gh")), "left").drop("_gk", "_gh")
    both = touched.unionByName(keyed.join(hit, "_b", "left_anti").withColumn("_gone", F.lit(None).cast(gone.schema["_gone"].dataType)))
    lines = both.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split(text_col, "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    lines = lines.withColumn("_stay", F.when(F.col("_gone").isNotNull(), stay))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform("_stay", lambda k: F.get(F.col("_lines"), k)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")) + 1)
    out = lines.withColumns({"n_lines": n_lines.cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "_new": text})
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [F.col("_new").alias(c) if c == text_col else F.when(F.col("_gone").isNull(), F.col(c)).otherwise(F.length("_new").cast(docs.schema[c].dataType)).alias(c) if c == length_col else F.col(f"`{c}`").alias(back.get(c, c)) for c in kept]
    return out.select(*columns, "n_lines", "n_removed")
