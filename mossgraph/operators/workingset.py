"""The state of a research run as tables: capacity, coverage, gaps and what to do about them, budgets, summaries, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wording import gap_key, gap_priority
from .graph import saved

# What a run of each depth may use.
PROFILE_FIELDS = ("max_sources", "max_extractions", "max_gap_loops", "min_gap_loops", "max_tool_calls", "max_tokens", "max_time_ms", "max_state_entries")
PROFILES = {
    "quick": (35, 15, 2, 1, 60, 150_000, 300_000, 200), "standard": (70, 60, 4, 2, 200, 400_000, 480_000, 500), "deep": (140, 100, 6, 3, 400, 800_000, 1_800_000, 1000),
    "exhaustive": (220, 150, 8, 4, 800, 1_500_000, 2_700_000, 2000), "tree": (100, 50, 999, 0, 300, 600_000, 900_000, 500),
}
# Kinds of sources that a search may be widened to, and the capability that each needs.
SOURCE_KINDS = ("academic", "web", "github", "reddit", "hackernews", "stackoverflow", "documentation", "news", "youtube")
METHOD_NEEDS = {"academic": "academic", "github": "code", "reddit": "reddit", "hackernews": "hackernews", "stackoverflow": "stackoverflow"}


def numbered(frame: DataFrame, *order) -> DataFrame:
    """``frame`` with ``n``, its place in a total order, from 1.

    Sorted ranges are numbered each by itself and offset by the sizes of those before; only the sizes reach the driver."""
    placed = saved(frame.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # one row a range
    offsets, before = [], 0
    for p, size in sizes:
        offsets.append((int(p), before))
        before += size
    table = frame.sparkSession.createDataFrame(offsets, "_p long, _before long")
    out = placed.withColumn("_p", part).join(F.broadcast(table), "_p")
    return out.withColumn("n", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_before")


def admitted(entries: DataFrame, cap: int, *order) -> DataFrame:
    """Entries with ``accepted``: whether they come before the state holds ``cap`` of them; others are turned away."""
    return numbered(entries, *order).withColumn("accepted", F.col("n") <= cap)


def of_question(rows: DataFrame, question, column: str = "questions") -> DataFrame:
    return rows.where(F.array_contains(column, question))


def overlay(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` of the last of ``updates(key, ord, value)``; keys without an update keep theirs."""
    latest = updates.groupBy(key).agg(F.max_by("value", "ord").alias("_value"))
    return rows.join(latest, key, "left").withColumn(column, F.coalesce("_value", column)).drop("_value")


def open_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.where(F.col("status").isin("open", "in_progress"))


def unresolved(contradictions: DataFrame) -> DataFrame:
    return contradictions.where("status = 'unresolved'")


def truncated_questions(runs: DataFrame, index: int) -> DataFrame:
    """``(run_id, n, question)`` of the questions before ``index``."""
    return runs.select("run_id", F.posexplode(F.slice("questions", 1, index)).alias("n", "question"))


def diary(entries: DataFrame, most: int = 50) -> DataFrame:
    """The last ``most`` entries of each run, in order."""
    w = Window.partitionBy("run_id").orderBy(F.col("ord").desc())
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def profile(depth: Column, max_time_ms: Column | None = None) -> Column:
    """The budget of a depth as a struct; an unknown depth is standard; ``max_time_ms`` goes before the profile's own."""
    out = None
    as_struct = lambda values: F.struct(*[(F.coalesce(max_time_ms, F.lit(v)) if name == "max_time_ms" and max_time_ms is not None else F.lit(v)).cast("long").alias(name) for name, v in zip(PROFILE_FIELDS, values, strict=True)])
    for name, values in PROFILES.items():
        out = F.when(depth == name, as_struct(values)) if out is None else out.when(depth == name, as_struct(values))
    return out.otherwise(as_struct(PROFILES["standard"]))


def remaining(limit: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), limit - used)


def step_costs(costs: DataFrame) -> DataFrame:
    return costs.groupBy("run_id", "step").agg(F.sum("cost").alias("cost"))


def plateau(loops: DataFrame, share: float = 0.05) -> DataFrame:
    """``loops(run_id, n, added)`` -> ``(run_id, plateau)``: the last two loops each added less than ``share`` of all findings."""
    w = Window.partitionBy("run_id")
    rows = loops.withColumns({"_total": F.sum("added").over(w), "_back": F.row_number().over(w.orderBy(F.col("n").desc()))})
    return rows.groupBy("run_id").agg(((F.max("_total") > 0) & (F.count("*") >= 2) & (F.count_if((F.col("_back") <= 2) & (F.col("added") >= F.col("_total") * share)) == 0)).alias("plateau"))


def new_gaps(gaps: DataFrame, known: DataFrame) -> DataFrame:
    """Gaps of keys that are not open yet, the first (by ``ord``) of each key."""
    keyed = lambda rows: rows.withColumn("_key", gap_key(F.col("category"), F.col("question_id"), F.col("finding_id")))
    fresh = keyed(gaps).join(keyed(open_gaps(known)).select("_key").distinct(), "_key", "left_anti")
    w = Window.partitionBy("_key").orderBy("ord")
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def coverage(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """``(question_id, n_sources, n_domains, n_types)``: explode, aggregate by question, then join."""
    links = sources.select(F.explode("questions").alias("question_id"), "id", "domain", "source_type").distinct()
    counts = links.groupBy("question_id").agg(F.count("*").alias("n_sources"), F.size(F.collect_set("domain")).alias("n_domains"), F.size(F.collect_set("source_type")).alias("n_types"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return questions.join(counts, "question_id", "left").select("question_id", zero("n_sources"), zero("n_domains"), zero("n_types"))


def continue_loop(runs: DataFrame) -> DataFrame:
    """``runs(run_id, exhausted, loops, min_loops, thin, questions, well_covered, open_gaps, urgent, later)`` with ``goes_on``.

    ``thin``: a question has fewer than two sources or domains; ``urgent``: open gaps of priority 2 or less; ``later``: all open
    gaps above 3; ``well_covered``: questions with three sources of two types."""
    ratio = F.when(F.col("questions") > 0, F.col("well_covered") / F.col("questions")).otherwise(F.lit(0.0))
    calm = F.col("urgent") == 0
    goes = (
        F.when(F.col("exhausted"), False).when(F.col("thin"), True).when(F.col("open_gaps") == 0, False).when(F.col("loops") < F.col("min_loops"), True).when(F.col("later"), False)
        .when(calm & (ratio > 0.5) & (F.col("loops") >= F.col("questions")), False).when(calm & (F.col("loops") >= F.greatest(F.lit(2), F.col("min_loops"))) & (ratio >= 0.3), False).otherwise(True)
    )
    return runs.withColumn("goes_on", goes)


def planned_searches(gaps: DataFrame, capabilities: set[str]) -> DataFrame:
    """``gaps(id, category, question, claim, query, missing, dominant)`` -> ``(id, method, text, freshness, limit)``.

    A method is planned only where its capability is there; a missing kind of source gives one search for each kind."""
    able = [m for m, need in METHOD_NEEDS.items() if need in capabilities]
    step = lambda method, text, freshness=None, limit=10: F.struct(method.alias("method") if isinstance(method, Column) else F.lit(method).alias("method"), text.alias("text"), F.lit(freshness).cast("string").alias("freshness"), F.lit(limit).alias("limit"))
    only = lambda s, given: F.filter(F.array(F.when(given.isNotNull(), s)), lambda x: x.isNotNull())
    question, claim, query = F.col("question"), F.col("claim"), F.col("query")
    spread = F.transform(F.filter("missing", lambda x: x.isin(*able) if able else F.lit(False)), lambda x: step(x, query))
    other = None
    for kind in ("academic", "github", "reddit", "hackernews", "stackoverflow"):
        if kind in able:
            other = F.when(F.col("dominant") != kind, F.lit(kind)) if other is None else other.when(F.col("dominant") != kind, F.lit(kind))
    other = F.lit(None).cast("string") if other is None else other
    plan = (
        F.when(F.col("category") == "unanswered_sub_question", only(step("search", question), question)).when(F.col("category") == "missing_recency", only(step("search", claim, "year"), claim))
        .when(F.col("category") == "single_source_dependency", only(step("academic" if "academic" in able else "search", question), question)).when(F.col("category") == "thin_coverage", only(step("search", question, None, 15), question))
        .when(F.col("category") == "missing_source_type", spread).when(F.col("category") == "overrepresented_viewpoint", only(step(other, query), other))
    )
    return gaps.select("id", F.explode(plan).alias("s")).select("id", "s.method", "s.text", "s.freshness", "s.limit")


def guarded(sources: DataFrame, findings: DataFrame, gaps: DataFrame, cap: int) -> DataFrame:
    """``(kind, id)`` of what goes so that no more than ``cap`` entries stay: sources without findings from the lowest rank up,
    then findings of fewer than two sources, the least confident first, then gaps by priority.

    ``sources(id, rank)``, ``findings(id, sources, confidence)``, ``gaps(id, priority)``."""
    used = findings.select(F.explode("sources").alias("id")).distinct()
    one = sources.join(used, "id", "left_anti").select(F.lit(0).alias("stage"), F.lit("source").alias("kind"), "id", F.col("rank").cast("double").alias("by"))
    two = findings.where(F.size("sources") < 2).select(F.lit(1), F.lit("finding"), "id", F.col("confidence").cast("double"))
    three = gaps.select(F.lit(2), F.lit("gap"), "id", F.col("priority").cast("double"))
    total = sources.count() + findings.count() + gaps.count()
    if total <= cap:
        return one.limit(0).select("kind", "id")
    return numbered(one.union(two).union(three), "stage", "by", "id").where(F.col("n") <= total - cap).select("kind", "id")


def findings_by_question(findings: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` findings, by id, of each question."""
    rows = findings.select("id", "claim", F.explode("questions").alias("question_id"))
    w = Window.partitionBy("question_id").orderBy("id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def executive_summary(findings: DataFrame, questions: DataFrame, contradictions: DataFrame) -> DataFrame:
    """One row a run: ``(run_id, summary)``."""
    covered = findings.select("run_id", "id", F.explode_outer("questions").alias("q")).groupBy("run_id").agg(F.countDistinct("id").alias("n"), F.countDistinct("q").alias("covered"))
    asked = questions.groupBy("run_id").agg(F.count("*").alias("asked"))
    open_ = contradictions.where("status <> 'resolved'").groupBy("run_id").agg(F.count("*").alias("open"))
    rows = asked.join(covered, "run_id", "left").join(open_, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    said = F.format_string("This research found %d claims covering %d of %d research questions.", zero("n"), zero("covered"), "asked")
    more = F.when(zero("open") > 0, F.format_string(" %d unresolved %s identified between sources.", "open", F.when(F.col("open") == 1, F.lit("contradiction was")).otherwise(F.lit("contradictions were")))).otherwise(F.lit(""))
    return rows.select("run_id", F.when(zero("n") == 0, F.lit("[Source-note synthesis only] No findings extracted during this research run.")).otherwise(F.concat(said, more)).alias("summary"))


def report_sections(findings: DataFrame, questions: DataFrame, sources: DataFrame) -> DataFrame:
    """``(run_id, question_id, heading, body, n_references)``: a report's themes, with findings and references in order."""
    rows = findings.select("run_id", "id", "claim", "sources", F.explode("questions").alias("question_id"))
    told = rows.groupBy("run_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("id", "claim"))).alias("f"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("refs"))
    used = told.select("run_id", "question_id", F.explode("refs").alias("id")).join(sources.where("usable").select("id"), "id").groupBy("run_id", "question_id").agg(F.count("*").alias("n_references"))
    out = questions.join(told, ["run_id", "question_id"]).join(used, ["run_id", "question_id"], "left")
    return out.select("run_id", "question_id", F.concat(F.lit("## "), "question").alias("heading"), F.array_join(F.transform("f", lambda x: F.concat(F.lit("- "), x["claim"])), "\n").alias("body"), F.coalesce("n_references", F.lit(0)).alias("n_references"))


def merged_findings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(keep, absorb)`` merged: sources, questions and groundings united in order, each grounding once; absorbed rows go.

    ``findings(id, sources, questions, groundings)``; a grounding is told by source, passage and span."""
    into = pairs.select(F.col("absorb").alias("id"), F.col("keep"))
    rows = findings.join(into, "id", "left").withColumn("_to", F.coalesce("keep", "id"))
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((F.col("id") != F.col("_to")).alias("o"), F.col("id").alias("i"), F.col(c).alias("v")))), lambda x: x["v"]))).alias(c)
    return rows.groupBy(F.col("_to").alias("id")).agg(united("sources"), united("questions"), united("groundings"))


def valid_groundings(groundings: DataFrame, sources: DataFrame) -> DataFrame:
    """``groundings(finding_id, source_id, declared, hash, start, end)`` with ``problem``: sources that are not just the declared
    ones, a hash that is not the source's, a span that ends before it begins; null where all is well."""
    w = Window.partitionBy("finding_id")
    rows = groundings.join(sources.select(F.col("id").alias("source_id"), F.col("hash").alias("_hash")), "source_id", "left").withColumn("_all", F.array_sort(F.collect_set("source_id").over(w)))
    problem = F.when(F.col("_all") != F.array_sort(F.array_distinct("declared")), F.lit("sources")).when(~F.col("hash").eqNullSafe(F.col("_hash")), F.lit("hash")).when(F.col("start") >= F.col("end"), F.lit("span"))
    return rows.select("finding_id", "source_id", "start", problem.alias("problem"))


def finding_events(findings: DataFrame) -> DataFrame:
    """``findings(id, run_id, claim_id, sources, opposed, expires)`` -> ``(id, nth, event_type, ref)``: the events each gives.

    The claim, evidence for it (and against it where the finding is opposed) by source, the expiry of what it replaces."""
    claim = F.array(F.struct(F.lit(0).alias("nth"), F.lit("CLAIM_OBSERVED").alias("event_type"), F.col("claim_id").cast("string").alias("ref")))
    support = F.transform("sources", lambda s, i: F.struct((i + 1).alias("nth"), F.lit("EVIDENCE_LINKED").alias("event_type"), F.concat(F.lit("supports:"), s.cast("string")).alias("ref")))
    oppose = F.when(F.col("opposed"), F.transform("sources", lambda s, i: F.struct((i + F.size("sources") + 1).alias("nth"), F.lit("EVIDENCE_LINKED").alias("event_type"), F.concat(F.lit("opposes:"), s.cast("string")).alias("ref")))).otherwise(F.slice(claim, 1, 0))
    expiry = F.when(F.col("expires").isNotNull(), F.array(F.struct((F.size("sources") * 2 + 1).alias("nth"), F.lit("CLAIM_EXPIRED").alias("event_type"), F.col("expires").cast("string").alias("ref")))).otherwise(F.slice(claim, 1, 0))
    return findings.select("id", F.explode(F.concat(claim, support, oppose, expiry)).alias("e")).select("id", "e.nth", "e.event_type", "e.ref")


def reranked(passages: DataFrame, scores: DataFrame) -> DataFrame:
    """``passages(id, n, lexical)`` by 0.7 of a judge's score of 1 to 10 and 0.3 of the lexical one.

    ``scores(id, n, score)`` of a text count only if every passage has one whole number from 1 to 10; else the lexical order holds."""
    ok = F.col("score").between(1, 10) & (F.col("score") == F.floor("score"))
    good = scores.groupBy("id").agg((F.bool_and(F.coalesce(ok, F.lit(False))) & (F.count("*") == F.countDistinct("n"))).alias("_ok"), F.count("*").alias("_given"))
    sizes = passages.groupBy("id").agg(F.count("*").alias("_size"))
    fit = good.join(sizes, "id").where("_ok and _given = _size").select("id", F.lit(True).alias("judged"))
    rows = passages.join(fit, "id", "left").join(scores, ["id", "n"], "left")
    blend = F.when(F.coalesce("judged", F.lit(False)), 0.7 * (F.col("score") - 1) / 9 + 0.3 * F.col("lexical")).otherwise(F.col("lexical"))
    rows = rows.withColumn("blend", F.round(blend, 6))
    return rows.select("id", "n", "blend", F.coalesce("judged", F.lit(False)).alias("judged"), F.row_number().over(Window.partitionBy("id").orderBy(F.col("blend").desc(), "n")).alias("place"))


def gap_records(gaps: DataFrame) -> DataFrame:
    """Gaps with their default priority and key."""
    return gaps.withColumns({"priority": gap_priority(F.col("category")), "key": gap_key(F.col("category"), F.col("question_id"), F.col("finding_id"))})
