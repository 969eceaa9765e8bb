"""Quality rules: an ordered decision list learnt by sequential covering, applied as one Spark conditional expression.

Statistics of each whole text come from built-in functions.  A rule is a conjunction of thresholds on them that says
"reject".  Rules are grown condition by condition by FOIL gain on two thirds of the labelled rows, pruned from the end on
the other third, and accepted while precise enough; what a rule covers is taken away before the next is grown.  Every step
is one small aggregation: counts by statistic, bin and label.

Fitting uses about ``max_labelled`` labelled rows at most, taken by hash of the id; everything else covers all rows.  Null
and empty texts have no words and fail the base conditions.  Without labels of both kinds there are no rules, and the base
conditions alone decide.  Null ids are never labelled.  Rows are independent, so repeated rows get equal verdicts; several
labels of an id are all used.  Columns of ``docs`` that begin with ``_q_`` are replaced; others stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import set_aside, written

# White space that parts words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"
#: Statistics that rules may use.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "n_words", "mark_share")
PREFIX = "_q_"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of ``text_col`` in columns that begin with ``_q_``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = text
    for c in SPACES:
        packed = F.replace(packed, F.lit(c), F.lit(""))
    q = lambda name: f"`{PREFIX}{name}`"
    first = docs.withColumn(f"{PREFIX}text", text)
    first = first.withColumns({
        f"{PREFIX}word_chars": F.length(packed.cast("string")).cast("long"),
        f"{PREFIX}n_symbols": F.regexp_count(F.col(f"{PREFIX}text"), F.lit(SYMBOLS)).cast("long"),
        f"{PREFIX}upper": F.length(F.regexp_replace(F.col(f"{PREFIX}text"), r"[^\p{Lu}]+", "")).cast("long"),
        f"{PREFIX}marks": F.regexp_count(F.col(f"{PREFIX}text"), F.lit(r"[!?;:=]")).cast("long"),
        f"{PREFIX}trimmed": F.btrim(F.col(f"{PREFIX}text"), F.lit(SPACES)),
        f"{PREFIX}lines": F.filter(F.split(F.col(f"{PREFIX}text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0),
    })
    words = first.withColumn(f"{PREFIX}words", F.when(F.length(f"{PREFIX}trimmed") == 0, F.array().cast("array<string>")).otherwise(F.split(f"{PREFIX}trimmed", SPACE)))
    words = words.withColumns({
        f"{PREFIX}n_words": F.size(f"{PREFIX}words").cast("long"),
        f"{PREFIX}n_dup_lines": (F.size(f"{PREFIX}lines") - F.size(F.array_distinct(f"{PREFIX}lines"))).cast("long"),
        f"{PREFIX}distinct": F.size(F.array_distinct(f"{PREFIX}words")).cast("long"),
        f"{PREFIX}wh": F.expr(f"transform({q('words')}, w -> xxhash64(w))"),
    })
    # Windows of five words, as hashes in text order; equal neighbours in sorted order are windows found twice or more.
    wh = q("wh")
    windows = words.withColumn(
        f"{PREFIX}win",
        F.expr(f"CASE WHEN size({wh}) < 5 THEN cast(array() as array<bigint>) ELSE slice(transform({wh}, (x, i) -> xxhash64(x, get({wh}, i + 1), get({wh}, i + 2), get({wh}, i + 3), get({wh}, i + 4))), 1, greatest(size({wh}) - 4, 0)) END"),
    )
    ordered = windows.withColumn(f"{PREFIX}sorted", F.sort_array(f"{PREFIX}win"))
    found = ordered.withColumn(f"{PREFIX}twice", F.expr(f"exists(transform({q('sorted')}, (x, i) -> x = get({q('sorted')}, i + 1)), x -> x)"))
    placed = found.withColumn(
        f"{PREFIX}placed",
        F.expr(f"CASE WHEN {q('twice')} THEN array_sort(transform({q('win')}, (x, i) -> struct(x as h, i as i))) ELSE cast(array() as array<struct<h:bigint,i:int>>) END"),
    )
    starts = placed.withColumn(
        f"{PREFIX}starts",
        F.expr(f"sort_array(transform(filter({q('placed')}, (e, k) -> e.h <=> get({q('placed')}, k + 1).h or (k > 0 and e.h <=> get({q('placed')}, k - 1).h)), e -> e.i))"),
    )
    repeat = F.expr(f"aggregate(transform({q('starts')}, (p, k) -> least(5, coalesce(get({q('starts')}, k + 1), p + 5) - p)), 0L, (a, x) -> a + x)")
    out = starts.withColumn(f"{PREFIX}n_repeat_words", repeat)
    drop = [f"{PREFIX}{c}" for c in ("text", "trimmed", "lines", "words", "wh", "win", "sorted", "twice", "placed", "starts")]
    over = lambda a, b: F.coalesce(F.try_divide(F.col(f"{PREFIX}{a}").cast("double"), F.col(f"{PREFIX}{b}").cast("double")), F.lit(0.0))
    out = out.drop(*drop).withColumns({
        f"{PREFIX}base_failed": F.expr(f"{q('n_words')} < 10 or 100 * {q('n_repeat_words')} > 20 * {q('n_words')}"),
        f"{PREFIX}mean_word": over("word_chars", "n_words"),
        f"{PREFIX}symbol_share": over("n_symbols", "word_chars"),
        f"{PREFIX}dup_line_share": over("n_dup_lines", "n_words"),
        f"{PREFIX}repeat_share": over("n_repeat_words", "n_words"),
        f"{PREFIX}upper_share": over("upper", "word_chars"),
        f"{PREFIX}distinct_share": over("distinct", "n_words"),
        f"{PREFIX}mark_share": over("marks", "word_chars"),
    })
    # The statistics go through a generator: a filter on one would otherwise be pushed below the projections, where each
    # use of an intermediate result would compute it anew.
    own = [F.col(f"`{c}`") for c in docs.columns if not c.startswith(PREFIX)]
    return out.select(*own, F.inline(F.array(F.struct(*[F.col(c) for c in out.columns if c.startswith(PREFIX)]))))


#: A condition: (statistic, whether at least, threshold).
Condition = tuple[str, bool, float]


def _holds(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for name, at_least, cut in rule:
        column = F.col(f"{PREFIX}{name}")
        out = out & ((column >= F.lit(cut)) if at_least else (column < F.lit(cut)))
    return out


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", max_labelled: int = 20_000, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 3) -> list[list[Condition]]:
    """Rules for "reject" (label 0), in order."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_label_id"), (F.col(label_col) == 0).alias("_bad"))
    n = known.count()
    if not n:
        return []
    share = min(1.0, max_labelled / n)
    part = lambda salt: F.pmod(F.xxhash64("_label_id", F.lit(salt)), F.lit(1_000_000))
    sample = known.where(part(1) < math.ceil(share * 1_000_000)).withColumn("_prune", part(2) < 333_333)
    named = [f"{PREFIX}{f}" for f in FEATURES]
    texts = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col)).join(F.broadcast(sample), "_label_id")  # about max_labelled rows
    rows = written(with_statistics(texts, text_col).select("_bad", "_prune", *named))

    levels = [k / 48 for k in range(1, 48)]
    marks = rows.groupBy("_bad").agg(*[F.percentile_approx(c, F.array(*map(F.lit, levels)), F.lit(2000)).alias(c) for c in named]).collect()
    if len(marks) < 2:
        return []
    cuts = {c: sorted({float(v) for m in marks for v in (m[c] or [])}) for c in named}  # at most 94 each

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[c])).cast("array<double>"), lambda t: t <= F.col(c)))

    bins = written(rows.select("*", F.array(*map(bin_of, named)).alias("_bins")))

    rules: list[list[Condition]] = []
    free = F.lit(True)
    while len(rules) < max_rules:
        grow = bins.where(~F.col("_prune") & free)
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            tally = grow.where(_holds(rule)).select("_bad", F.posexplode("_bins").alias("f", "b")).groupBy("f", "b").agg(F.sum(F.col("_bad").cast("long")), F.sum((~F.col("_bad")).cast("long"))).collect()  # features * bins rows
            by: dict[int, dict[int, tuple[int, int]]] = {}
            for f, b, bad, good in tally:
                by.setdefault(f, {})[b] = (bad, good)
            if not by:
                break
            p0, n0 = (sum(v[k] for v in by[min(by)].values()) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f, counts in sorted(by.items()):
                below = [0, 0]
                for b in range(1, len(cuts[named[f]]) + 1):
                    for k in (0, 1):
                        below[k] += counts.get(b - 1, (0, 0))[k]
                    for at_least, p1, n1 in ((True, p0 - below[0], n0 - below[1]), (False, below[0], below[1])):
                        if p1 >= min_covered:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (FEATURES[f], at_least, cuts[named[f]][b - 1]))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            for wanted in (F.col("_bad"), ~F.col("_bad")):
                for side in (F.col("_prune"), ~F.col("_prune")):
                    sums.append(F.coalesce(F.sum((side & wanted & _holds(rule[:k])).cast("long")), F.lit(0)))
        got = bins.where(free).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        quads = [tuple(got[4 * k : 4 * k + 4]) for k in range(len(rule))]  # bad in prune, bad in grow, good in prune, good in grow
        worth = lambda v: (v[0] - v[2]) / (v[0] + v[2]) if v[0] + v[2] else -1.0
        keep = max(range(len(rule)), key=lambda k: (worth(quads[k]), -k))
        bad, good = quads[keep][0] + quads[keep][1], quads[keep][2] + quads[keep][3]
        if bad + good == 0 or bad / (bad + good) < min_precision or bad < min_covered:
            break
        rules.append(rule[: keep + 1])
        free = free & ~_holds(rules[-1])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects a row, from 1; 0 where none does.  One ordered conditional expression."""
    out = F
    for k, rule in enumerate(rules):
        out = out.when(_holds(rule), F.lit(k + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def judged(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """``docs`` with statistics and ``_q_rule`` and ``_q_kept``."""
    found = with_statistics(docs, text_col).withColumn(f"{PREFIX}rule", verdict(rules))
    return found.withColumn(f"{PREFIX}kept", ~F.col(f"{PREFIX}base_failed") & (F.col(f"{PREFIX}rule") == 0))


def kept_rows(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns."""
    docs, back = set_aside(docs, {c for c in docs.columns if c.startswith(PREFIX)})
    return judged(docs, rules, text_col).where(f"{PREFIX}kept").select(*[F.col(f"`{c}`") for c in docs.columns]).withColumnsRenamed(back)
