"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is cut into paragraph parts: lines, cut further at sentence ends and after 40 characters, so that one-line texts have
parts too; the parts joined are the text.  Each part is hashed to LANES signed 16-bit numbers; a fingerprint is their sum
over all parts, lane by lane, modulo 2**32.  So it does not depend on the order of parts, equal texts have equal
fingerprints, and a part is inserted or deleted by adding or subtracting its own vector.  As the entries of a part's vector
are independent with mean zero, the inner product of two fingerprints estimates how many parts they share, which gives a
likeness between 0 and 1.

Null texts are empty; the empty text has the zero fingerprint, like itself with 1 and like others with 0.  The next document
follows by ascending id (nulls first), then text; rows that repeat an id or a whole row are documents of their own.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import parallelism

#: Lanes of a fingerprint, in blocks that are summed by themselves.
LANES, BLOCK = 256, 64
MODULUS = 1 << 32
#: A part: up to 40 characters of a line with the marks that end them, or marks alone.
PART = r"[^\n.!?]{1,40}[\n.!?]*|[\n.!?]+"
#: Documents in a range of ids, about; ranges at most.
RANGE_ROWS, RANGES = 4000, 1 << 14


def parts_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PART), F.lit(0))


def part_lanes(part: Column, block: Column) -> list[Column]:
    """BLOCK lanes of the vector of one part, as columns; a null part has the zero vector."""
    zero = F.lit(-0x7FFF7FFF7FFF8000)  # 0x8000800080008000: four times the middle
    hashed = [F.when(part.isNull(), zero).otherwise(F.xxhash64(F.xxhash64(part), F.xxhash64(F.lit("second"), part), block * (BLOCK // 4) + k)) for k in range(BLOCK // 4)]
    return [F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(0xFFFF)) - F.lit(32768) for h in hashed for k in range(4)]


def signed(lane: Column) -> Column:
    """A sum modulo 2**32 as a number from -2**31."""
    return F.pmod(lane + F.lit(MODULUS // 2), F.lit(MODULUS)) - F.lit(MODULUS // 2)


def combine(a: Column, b: Column) -> Column:
    """The fingerprint (array of lanes) of two texts' parts together: insertion of all of ``b``."""
    return F.zip_with(a, b, lambda x, y: signed(x + y))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the parts of ``b``."""
    return F.zip_with(a, b, lambda x, y: signed(x - y))


def spelled(lanes: Column) -> Column:
    """Lowercase hex, eight digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(F.pmod(x, F.lit(MODULUS))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common parts of two fingerprints: 2 <a, b> / (<a, a> + <b, b>), within 0 and 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = dot(a, a) + dot(b, b)
    return F.when(norms == 0, F.lit(1.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / norms)))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``lanes`` of each distinct key: texts of a key count together."""
    parts = rows.select(*keys, F.explode_outer(parts_of(F.col(text_col))).alias("_part"))
    blocks = parts.select(*keys, "_part", F.explode(F.array(*[F.lit(b) for b in range(LANES // BLOCK)])).alias("_block"))
    sums = [F.sum(x).alias(f"_l{k}") for k, x in enumerate(part_lanes(F.col("_part"), F.col("_block")))]
    grouped = blocks.groupBy(*keys, "_block").agg(*sums).select(*keys, "_block", F.array(*[signed(F.col(f"_l{k}")) for k in range(BLOCK)]).alias("_lanes"))
    lanes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_lanes"))), lambda x: x["_lanes"]))
    return grouped.groupBy(*keys).agg(lanes.alias("lanes"))


def _range_of(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``column``, found in two steps."""
    step = max(1, math.isqrt(len(bounds)))

    def below(cuts: list[int]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda b: b <= column))

    if len(bounds) <= 64:
        return below(bounds) if bounds else F.lit(0)
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    block = below([b[0] for b in blocks])
    inner = F.element_at(F.array(*[F.array(*map(F.lit, b)).cast("array<long>") for b in blocks]), F.greatest(block, F.lit(1)))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + F.size(F.filter(inner, lambda b: b <= column)))


def with_next(texts: DataFrame) -> DataFrame:
    """``texts(_id, _text)`` -> ``(_range, _nth, _copy, _id, _text, _next)``: each row with the text of the row after it.

    Rows are dealt into ranges of ids.  The first row of a range is also put behind the range before it, and the very first
    row behind the last range, as a row with ``_copy`` 1; so no row needs rows of another range."""
    spark = texts.sparkSession
    n, lowest, nulls = texts.agg(F.count("*"), F.min("_id"), F.count_if(F.col("_id").isNull())).first()
    ranges = min(RANGES, max(4 * parallelism(spark), n // RANGE_ROWS), max(1, n))
    bounds: list[int] = []
    if n and lowest is not None and ranges > 1:
        marks = texts.agg(F.percentile_approx("_id", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(20 * ranges))).first()[0]
        bounds = sorted({int(m) for m in marks} - ({lowest} if not nulls else set()))
    range_ = F.when(F.col("_id").isNull(), F.lit(0)).otherwise(_range_of(F.col("_id"), bounds))
    head = F.col("_id").isNull() if nulls else F.col("_id") == F.lit(lowest)
    at_bound = F.col("_id") == F.element_at(F.array(*map(F.lit, bounds)).cast("array<long>"), F.greatest(F.col("_range"), F.lit(1))) if bounds else F.lit(False)
    copies = F.filter(
        F.array(
            F.struct(F.col("_range").alias("r"), F.lit(0).alias("c")),
            F.when((F.col("_range") > 0) & at_bound, F.struct((F.col("_range") - 1).alias("r"), F.lit(1).alias("c"))),
            F.when(head, F.struct(F.lit(len(bounds)).alias("r"), F.lit(2).alias("c"))),
        ),
        lambda x: x.isNotNull(),
    )
    dealt = texts.withColumn("_range", range_.cast("int")).select("_id", "_text", F.explode(copies).alias("_at")).select("_id", "_text", F.col("_at.r").alias("_range"), F.col("_at.c").alias("_copy"))
    order = Window.partitionBy("_range").orderBy("_copy", F.col("_id").asc_nulls_first(), "_text")
    return dealt.select(
        "_range", F.row_number().over(order).alias("_nth"), "_copy", "_id", "_text", F.lead("_text").over(order).alias("_next"),
        F.lag("_copy").over(order).alias("_former"),
    ).where("_copy = 0 or _former = 0").drop("_former")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every whole text.

    The edited text has the last quarter of its characters replaced by the first as many of the next document."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = with_next(texts)
    n = F.length("_text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - tail), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), tail))
    rows = rows.select("_range", "_nth", "_copy", "_id", n.cast("long").alias("_n"), "_text", edited.alias("_edited"))
    rows = rows.withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256))
    kinds = F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))
    own = ["_range", "_nth", "_copy", "_id", "_n", "_sha"]
    both = rows.select(*own, F.explode(kinds).alias("_kind")).where("_copy = 0 or _kind.k = 0").select(*own, F.col("_kind.k").alias("_k"), F.col("_kind.t").alias("_t"))
    found = fingerprints(both, [*own, "_k"], "_t")
    order = Window.partitionBy("_range").orderBy("_nth", "_k")
    lined = found.withColumns({"_l1": F.lead("lanes", 1).over(order), "_l2": F.lead("lanes", 2).over(order)}).where("_copy = 0 and _k = 0")
    return lined.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
        spelled(F.col("lanes")).alias("fingerprint"), spelled(F.col("_l1")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("_l1")).alias("near_edited"), likeness(F.col("lanes"), F.col("_l2")).alias("near_next"),
    )
