"""The working set of a run: passages, alignment of evidence, validation of drafts, eviction, follow-ups, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_terms, anchors, jaccard, scope_tokens
from ..functions.wording import CONTENT_STOP_WORDS, hedge_of
from .graph import gathered

WINDOW, LOOK_BACK, MOST, SEEDS, BUDGET = 4000, 800, 6, 5, 24_000
#: Characters of passages that a task's Python holds before it hands them on.
HELD = 4_000_000


def windows_of(text: str, size: int = WINDOW, back: int = LOOK_BACK) -> list[tuple[int, int]]:
    """Offsets of consecutive windows, broken at the last blank line or else the last newline near their end."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            start = max(at, end - back)
            if (k := text.rfind("\n\n", start, end)) >= 0:
                end = k + 2
            elif (k := text.rfind("\n", start, end)) >= 0:
                end = k + 1
        out.append((at, end))
        at = max(end, at + 1)
    return out


def segmented(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, most: int = HELD) -> DataFrame:
    """``(id, n, start, end, passage)`` for every window of every text, handed on as soon as they have ``most`` characters."""

    out = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("passage", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):  # one text at a time as a Python string
                key, text = key.as_py(), text.as_py()
                for n, (a, b) in enumerate(windows_of(text, size)) if text else ():
                    rows.append((key, n, a, b, text[a:b]))
                    held += b - a
                    if held >= most:
                        yield pa.record_batch(list(zip(*rows)), schema=out)
                        rows, held = [], 0
        if rows:
            yield pa.record_batch(list(zip(*rows)), schema=out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n int, start long, end long, passage string")


def selected(passages: DataFrame, query: str) -> DataFrame:
    """Up to six passages a text: all of a short one, else the best by overlap with ``query`` within the budget, and neighbours.

    A budgeted choice in order of score is a fold over a text's own windows."""
    q = F.array_distinct(scope_tokens(F.lit(query), unicode_letters=True))
    score = jaccard(q, F.array_distinct(scope_tokens(F.col("passage"), unicode_letters=True))) + F.when(F.col("passage").rlike(r"^#{1,6}\s"), F.lit(0.08)).otherwise(F.lit(0.0))
    scored = passages.select("id", "n", F.length("passage").alias("size"), F.round(score, 9).alias("score"))
    all_ = scored.groupBy("id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "n", "size"))).alias("ranked"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def take(s: Column, p: Column) -> Column:
        fits = (F.size(s.taken) < SEEDS) & (s.used + p["size"] <= BUDGET)
        return F.when(fits, F.struct((s.used + p["size"]).alias("used"), F.concat(s.taken, F.array(p["n"])).alias("taken"))).otherwise(s)

    seeds = all_.withColumn("s", F.aggregate("ranked", start, take))
    sizes = F.map_from_entries(F.transform("ranked", lambda p: F.struct(p["n"], p["size"])))
    near = F.flatten(F.transform(F.col("s.taken"), lambda n: F.array(n + 1, n - 1)))

    def widen(s: Column, n: Column) -> Column:
        size = F.try_element_at(F.col("sizes"), n)
        fits = (F.size(s.taken) < MOST) & size.isNotNull() & ~F.array_contains(s.taken, n) & (s.used + size <= BUDGET)
        return F.when(F.coalesce(fits, F.lit(False)), F.struct((s.used + size).alias("used"), F.concat(s.taken, F.array(n)).alias("taken"))).otherwise(s)

    grown = seeds.withColumn("sizes", sizes).withColumn("near", near).withColumn("s", F.when(F.col("total") > MOST, F.aggregate("near", F.col("s"), widen)).otherwise(F.struct(F.lit(0).cast("long").alias("used"), F.transform("ranked", lambda p: p["n"]).alias("taken"))))
    return grown.select("id", F.explode(F.array_sort("s.taken")).alias("n"))


def alignment(claim: Column, evidence: Column, anchors: Column, text: Column) -> Column:
    """Lexical overlap of content terms, bounded by the share of the claim's anchors that the evidence holds."""
    least = F.least(F.size(claim), F.size(evidence))
    lexical = F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(claim, evidence)) / least)
    held = F.size(F.filter(anchors, lambda a: F.contains(F.lower(text), a)))
    return F.when(F.size(anchors) == 0, lexical).otherwise(F.least(lexical, held / F.size(anchors)))


def draft_verdict(span: Column, passage: Column, known_question: Column, score: Column, missing: Column) -> Column:
    """Why a drafted claim is turned down, first reason first; null if it stands."""
    return (
        F.when(F.coalesce(F.trim(span), F.lit("")) == "", F.lit("empty_span")).when(passage.isNull(), F.lit("unknown_passage")).when(~passage.contains(span), F.lit("span_not_verbatim"))
        .when(~known_question, F.lit("unknown_sub_question")).when(score == 0, F.lit("not_aligned")).when(missing > 0, F.lit("missing_anchors"))
    )


def evicted(entries: DataFrame, cap: int) -> DataFrame:
    """Entries beyond ``cap`` that go first: the lowest rank, then the oldest."""
    extra = entries.count() - cap
    return entries.orderBy("rank", "age", "id").limit(max(extra, 0))


def follow_up(targets: DataFrame, tried: DataFrame) -> DataFrame:
    """The most urgent target of each family that no run has tried."""
    left = targets.join(tried, ["family_id", "type", "id"], "left_anti")
    w = Window.partitionBy("family_id").orderBy("priority", "type", "id")
    return left.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


FOLLOW_UPS = 3


def continued(families: DataFrame, targets: DataFrame, followed: DataFrame, most: int = FOLLOW_UPS) -> DataFrame:
    """``(family_id, status, used, type, id)`` if research of each family went on now.

    ``followed(family_id, type, id)`` are the targets of runs that followed up before: with ``most`` of them it is ``cap_reached``; else
    the most urgent target that none of them had is ``queued``, or there is ``no_work``."""
    used = followed.groupBy("family_id").agg(F.count("*").alias("used"))
    tried = followed.select("family_id", "id").distinct()
    left = targets.join(tried, ["family_id", "id"], "left_anti").groupBy("family_id").agg(F.min(F.struct("priority", "type", "id")).alias("_t"))
    rows = families.select("family_id").join(used, "family_id", "left").join(left, "family_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    status = F.when(F.col("used") >= most, F.lit("cap_reached")).when(F.col("_t").isNull(), F.lit("no_work")).otherwise(F.lit("queued"))
    shown = lambda c: F.when(F.col("status") == "queued", F.col(f"_t.{c}")).alias(c)
    return rows.withColumn("status", status).select("family_id", "status", (F.col("used") + F.when(F.col("status") == "queued", 1).otherwise(0)).alias("used"), shown("type"), shown("id"))


def by_type(sources: DataFrame, kind: str) -> DataFrame:
    """``(kind, n, place, kinds)``: sources by kind, the most first, and how many kinds there are (few, whatever the input)."""
    counts = sources.groupBy(kind).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    return counts.select(kind, "n", F.row_number().over(everything.orderBy(F.col("n").desc(), F.col(kind).asc_nulls_last())).alias("place"), F.count("*").over(everything).alias("kinds"))


def most_common(rows: DataFrame, key: str, value: Column, order: str = "id") -> DataFrame:
    """The most common value of each key; of equals the one seen first by ``order``."""
    counts = rows.groupBy(key, value.alias("value")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(F.min_by("value", F.struct(-F.col("_n"), F.col("_first"))).alias("value"))


def dominant(rows: DataFrame, key: str, kind: str, share: float = 0.7) -> DataFrame:
    """``(key, kind, share)``: kinds that make up more than ``share`` of their key's rows."""
    counts = rows.groupBy(key, kind).agg(F.count("*").alias("_n"))
    out = counts.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy(key)))
    return out.where(F.col("share") > share).select(key, kind, F.round("share", 6).alias("share"))


def aligned(rows: DataFrame, claim: Column, evidence: Column) -> DataFrame:
    """``rows`` with ``score``, ``missing`` anchors and the first twelve ``matched`` terms of a claim and its evidence."""
    known = rows.withColumns({"_c": anchor_terms(claim, CONTENT_STOP_WORDS), "_e": anchor_terms(evidence, CONTENT_STOP_WORDS), "_a": anchors(claim, named_dates=True)})
    missing = F.filter("_a", lambda a: ~F.contains(F.lower(evidence), a))
    out = known.withColumns({"score": alignment(F.col("_c"), F.col("_e"), F.col("_a"), evidence), "missing": missing, "matched": F.slice(F.array_sort(F.array_intersect("_c", "_e")), 1, 12)})
    return out.drop("_c", "_e", "_a")


def drafted_findings(drafts: DataFrame, source: str, order: list[str], most: int = 12) -> DataFrame:
    """Drafts that stand as findings, ``most`` of each source in ``order``, hedged by their confidence."""
    w = Window.partitionBy(source).orderBy(*order)
    return drafts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").withColumn("hedge", hedge_of(F.col("confidence")))


def first_passage(text: Column, size: int = 16_000) -> Column:
    return F.left(text, F.lit(size))


def question_coverage(questions: DataFrame, links: DataFrame, n: int = 0) -> DataFrame:
    """``(question, n_sources, n_domains, n_findings, status)`` of every question.

    ``links(question, source_id, domain, confidence, failed)``: each finding's source, which has one domain; ``n`` of them at most.
    Counted by source, then by domain, then by question, so that no row is repeated for a distinct count, where a question's rows are."""
    by_source = gathered(links, n, "question").groupBy("question", "domain", "source_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.bool_or("failed").alias("failed"))
    by_domain = by_source.groupBy("question", "domain").agg(F.count("*").alias("s"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.bool_or("failed").alias("failed"))
    known = F.col("domain").isNotNull()
    counts = by_domain.groupBy("question").agg(F.sum("s").alias("n_sources"), F.count_if(known).alias("n_domains"), F.sum("n").alias("n_findings"), F.round(F.sum("c") / F.sum("n"), 6).alias("depth"), F.bool_or("failed").alias("promo"))
    status = F.when(F.col("n_sources").isNull(), F.lit("uncovered")).when((F.col("n_sources") < 2) | (F.col("n_domains") < 2), F.lit("thin")).when(F.col("promo") | (F.col("depth") < 0.04), F.lit("risky")).otherwise(F.lit("adequate"))
    return questions.join(counts, "question", "left").select("question", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_sources", "n_domains", "n_findings")], status.alias("status"))


def best_of_each(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """``(key, value)``: the value that comes first by ``order`` for each key."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))
