"""Components, linkage of similar findings, summaries of clusters and what stands for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without one, a local folder in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mossgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(frame: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder, and read again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/mossgraph/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    again = spark.read.schema(frame.schema).parquet(path)
    again.saved_path = path
    return again


def removed(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote for ``frames``, once all that reads them has been written itself."""
    for frame in frames:
        session = frame.sparkSession
        target = session._jvm.org.apache.hadoop.fs.Path(frame.saved_path)
        target.getFileSystem(session._jsc.hadoopConfiguration()).delete(target, True)


#: A node with more edges than this, or than a 100,000th of all, is a hub, whose edges are dealt out over several tasks.
HUB = 10_000


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: for each id on an edge the smallest id that it reaches.

    Self-loops and repeated edges do no harm; rows with a null end are ignored; no edges give no rows.  Each round takes the
    smallest label among neighbours and then the label of that label, so paths halve, and is written to the shared folder; neighbours
    are pre-aggregated before they are shuffled, and the edges of a hub dealt out by their other ends."""
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = saved(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = both.groupBy("b").agg(F.count("*").alias("k"))
    rows, largest = degrees.agg(F.sum("k"), F.max("k")).first()
    least = max(HUB, (rows or 0) // 100_000)
    salts = -(-(largest or 0) // least)
    salted, hubs, old = both.withColumn("salt", F.lit(0)), None, [both]
    if salts > 1:  # 100,000 hubs at most, whatever the input
        hubs = saved(degrees.where(F.col("k") > least).select(F.col("b").alias("hub")))
        salt = F.when(F.col("hub").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
        salted = saved(both.join(F.broadcast(hubs), F.col("b") == F.col("hub"), "left").select("a", "b", salt.alias("salt")))
        old += [hubs, salted]
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        ends = labels.select(F.col("id").alias("b"), "component").withColumn("salt", F.lit(0))
        if hubs is not None:
            many = F.when(F.col("hub").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
            ends = ends.drop("salt").join(F.broadcast(hubs), F.col("b") == F.col("hub"), "left").select("b", "component", F.explode(many).alias("salt"))
        near = salted.join(ends, ["b", "salt"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        far = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = saved(step.join(far, "next").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("changed")))
        removed(labels)
        labels = moved.select("id", "component")
        labels.saved_path = moved.saved_path
        if moved.where("changed").isEmpty():
            removed(*old)
            return labels


def spread(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Rows of few bytes and much work each over a fixed number of tasks; small partitions would be put together otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows that one task groups by a key at most on average, whatever the input.
GROUPED = 1_000_000


def gathered(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``rows``, ``n`` of them or fewer, by key, before they are grouped by it: tasks hold a bounded number of rows, and no task
    holds groups of all keys, as one does that sums rows up before a shuffle though few of them have a key in common."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUPED)), *by)


#: Members of a class that one row holds at most on average, while pairs of classes become pairs of members.
CHUNK = 256


def classes_of(rows: DataFrame, on: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows that agree in ``on``, whose values are not to be told apart, as one: ``(id, n, *on)`` with the smallest id, and the members ``(id, rep, n)``."""
    told = rows.select(F.col(key).alias("id"), F.sha2(F.to_json(F.struct(*on)), 256).alias("_digest"), *on)
    classes = saved(told.groupBy("_digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in on]))
    members = told.select("id", "_digest").join(classes.select("_digest", F.col("id").alias("rep"), "n"), "_digest").select("id", "rep", "n")
    return classes.drop("_digest"), members


#: Members of all classes that a cell of the grid holds of each side at most on average, the fewest stripes of a side, and the fewest tasks for them.
STRIPE, STRIPES, TASKS = 1 << 19, 16, 64


def _met(pairs: DataFrame, left: DataFrame, right: DataFrame, by: tuple[str, ...], kind: Column | None) -> DataFrame:
    """``pairs(a, b, ...)`` of classes as ``(a, b, ..., x, y)``, each member of the one with each of the other.

    Classes are dealt into stripes, and a cell of the grid holds one stripe of each side, so a pair travels to its cell as two
    places and not with its members; only a class of one member goes with the pair."""
    spark = pairs.sparkSession

    def side(members: DataFrame) -> tuple[DataFrame, int]:
        dealt = members.withColumn("_chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)))
        units = dealt.groupBy("rep", "n", "_chunk", *by).agg(F.collect_list("id").alias("ids")).select("rep", "n", "_chunk", F.struct(*by, "ids").alias("e"))
        each = units.groupBy("rep", "n", "_chunk").agg(F.collect_list("e").alias("e")) if by else units.withColumn("e", F.array("e"))
        each = saved(each.select("rep", (F.col("n") > 1).alias("many"), F.xxhash64("rep", "_chunk").alias("h"), "e"))
        return each, each.where("many").count() * CHUNK

    one, n = side(left)
    two, m = (one, n) if right is left else side(right)
    stripes = max(STRIPES, -(-max(n, m) // STRIPE))

    def striped(each: DataFrame) -> tuple[DataFrame, DataFrame]:
        each = each.withColumn("g", F.pmod("h", F.lit(stripes)).cast("long"))
        return each, saved(each.where("many").groupBy("g").agg(F.collect_list(F.struct("rep", "e")).alias("u")))

    def placed(each: DataFrame, held: DataFrame, s: str) -> tuple[DataFrame, DataFrame]:
        """Where each class stands, and the members of each stripe."""
        none = F.lit(None).cast(each.schema["e"].dataType)
        places = held.select("g", F.posexplode("u.rep").alias("p", "rep")).select(F.col("rep").alias(s), F.col("g").alias(f"_g{s}"), F.col("p").alias(f"_p{s}"), none.alias(f"_e{s}"))
        alone = each.where("not many").select(F.col("rep").alias(s), F.col("g").alias(f"_g{s}"), F.lit(None).cast("int").alias(f"_p{s}"), F.col("e").alias(f"_e{s}"))
        return places.union(alone), spark.range(stripes).withColumnRenamed("id", "g").join(held, "g", "left").select(F.col("g").alias(f"_g{s}"), F.col("u.e").alias(f"_u{s}"))

    sides = striped(one)
    (at, own), (to, other) = placed(*sides, "a"), placed(*(sides if right is left else striped(two)), "b")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cell = (F.col("_ga") * stripes + F.col("_gb")).alias("_cell")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))
    rows = own.withColumn("_gb", everywhere).select(cell, "_ua").repartition(tasks, "_cell")
    cells = rows.join(other.withColumn("_ga", everywhere).select(cell, "_ub").repartition(tasks, "_cell").hint("merge"), "_cell")
    asked = pairs.join(at, "a").join(to, "b").select(cell, "a", "b", *rest, "_pa", "_pb", "_ea", "_eb").repartition(tasks, "_cell")
    both = asked.join(cells.hint("merge"), "_cell")  # rows of several MB are not to be broadcast
    of = lambda s: F.explode(F.coalesce(f"_e{s}", F.get(f"_u{s}", F.col(f"_p{s}")))).alias(f"_{s}")
    both = both.select("a", "b", *rest, "_ub", "_pb", "_eb", of("a")).select("a", "b", *rest, "_a", of("b"))
    if kind is not None:
        told = both.select("*", *[F.col(f"_{s}")[c].alias(f"{s}_{c}") for s in "ab" for c in by])
        both, rest = told.withColumn("kind", kind).where("kind is not null"), [*rest, "kind"]
    return both.select("a", "b", *rest, "_b", F.explode("_a.ids").alias("x")).select("a", "b", *rest, "x", F.explode("_b.ids").alias("y"))


def expanded(pairs: DataFrame, members: DataFrame, by: tuple[str, ...] = (), kind: Column | None = None) -> DataFrame:
    """``pairs(a, b, ...)`` between classes, a = b for the pairs within one, as pairs a < b of their members.

    What else ``pairs`` has must hold in both directions.  ``members(id, rep, n, *by)``: with ``by`` pairs of members have a ``kind``,
    over the columns of ``pairs``, ``a_<by>`` and ``b_<by>``, and those without one go.  Members travel as arrays, so pairs are made
    where they are used and not shuffled."""
    each = _met(pairs, members, members, by, kind).where("a <> b or x < y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *[c for c in each.columns if c not in ("a", "b", "x", "y")])


def _signature(tokens: str, words: int) -> list[Column]:
    """A set as 64 bits a word, each told by its tokens' parity: two sets differ by as many tokens at least as bits."""
    bits = F.transform(tokens, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * words)).cast("int"))
    word = lambda k: F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.when(F.floor(b / 64) == k, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64))).otherwise(s))
    return [word(k).alias(f"s{k}") for k in range(words)]


def _words_for(sets: DataFrame) -> int:
    """Words of a signature with two bits a token of nearly all sets: with about one, unlike sets differ in no more bits than like ones may."""
    size = sets.agg(F.percentile_approx(F.size("t"), 0.95, 1000)).first()[0] or 0
    return next((k for k in (4, 8, 16) if 32 * k >= size), 32)


def similar_sets(sets: DataFrame, threshold: float, block: list[str]) -> DataFrame:
    """``(a, b, score, *block)``, a < b, of ``sets(id, t, *block)``, which differ within a block: Jaccard ``threshold`` or more.

    Only pairs that share one of the rarest tokens of both can qualify: each set is looked up by its prefix by global rarity,
    as long as a partner of its own size or less requires, in an index of the shorter prefixes that partners of its own size or
    more require.  The smaller set of a pair (of equals the lower id) is the one in the index.  The places of the first common token
    bound what can be common, and signatures what differs, before a pair is shuffled."""
    words = _words_for(sets)
    bits = [f"s{k}" for k in range(words)]
    flat = sets.select(*block, "id", F.size("t").alias("n"), F.explode("t").alias("token"))
    counts = flat.groupBy(*block, "token").agg(F.count("*").alias("c")).where("c > 1")
    w = Window.partitionBy(*block, "id").orderBy("c", "token")
    required = lambda t: F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1
    ranked = flat.join(counts, [*block, "token"], "left").withColumn("c", F.coalesce("c", F.lit(1)))
    placed = ranked.withColumn("place", F.row_number().over(w)).where((F.col("place") <= required(threshold)) & (F.col("c") > 1))
    prefix = saved(placed.join(sets.select(*block, "id", *_signature("t", words)), [*block, "id"]))
    entry = lambda s, f: f.select(*block, "token", F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "place", *bits)])
    left = entry("x", prefix.where(F.col("place") <= required(2 * threshold / (1 + threshold))))
    least = F.ceil((F.col("n_x") + F.col("n_y")) * (threshold / (1 + threshold)) - 1e-6)
    differ = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in bits), F.lit(0))
    found = left.join(entry("y", prefix), [*block, "token"]).where((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y")))).where(F.col("n_x") >= F.col("n_y") * threshold - 1e-6)
    found = found.where((F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) + 1 >= least) & (differ <= F.col("n_x") + F.col("n_y") - 2 * least))
    pairs = spread(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "a", "b").distinct()
    one = sets.select(*block, F.col("id").alias("a"), F.col("t").alias("ta"))
    two = sets.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(one, "a").join(two, "b").withColumn("score", F.round(jaccard(F.col("ta"), F.col("tb")), 6)).where(F.col("score") >= threshold).select("a", "b", "score", *block)


def similar_classes(rows: DataFrame, threshold: float, block: list[str], key: str = "id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, score, *block)`` between sets that differ, a = b for a set that several rows have, and their members ``(id, rep, n)``."""
    sets = rows.select(*block, F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    for name in block:
        sets = sets.where(F.col(name).isNotNull())
    classes, members = classes_of(sets, [*block, "t"])
    within = classes.where("n > 1").select("id", F.col("id").alias("b"), F.lit(1.0).alias("score"), *block)
    return similar_sets(classes, threshold, block).union(within), members


def similar_pairs(rows: DataFrame, threshold: float, block: list[str], key: str = "id", tokens: str = "tokens", keep: Column | None = None) -> DataFrame:
    """``(a, b, score)``, a < b: pairs of a block whose token sets have Jaccard ``threshold`` or more, and that meet ``keep``.

    Equal sets of a block are compared as one, and stand for their rows again at the end.  ``keep`` is over ``score`` and the block."""
    pairs, members = similar_classes(rows, threshold, block, key, tokens)
    return expanded((pairs if keep is None else pairs.where(keep)).select("a", "b", "score"), members)


def linked_findings(findings: DataFrame, block: list[str], direct: float = 0.92) -> DataFrame:
    """``findings(id, tokens, positive, confidence, *block)`` -> ``(id, cluster)``: near-equal findings of one polarity."""
    pairs, members = similar_classes(findings, direct, [*block, "positive"])
    found = components(pairs.select("a", "b"))
    held = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("cluster"))
    return findings.select("id").join(held, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def cluster_summary(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members, the most confident (earliest on ties) and distinct sources of each cluster."""
    rows = findings.join(clusters, "id")
    return rows.groupBy("cluster").agg(
        F.count("*").alias("members"), F.max_by("id", F.struct("confidence", -F.col("id"))).alias("representative"), F.countDistinct("source").alias("n_sources"),
    )


def representative_edges(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """``(from_claim, to_claim)``: edges between clusters as edges between the claims that stand for them.

    ``clusters(id, cluster, confidence)``: the most confident, the smallest id on ties; edges of unknown clusters go."""
    best = clusters.groupBy("cluster").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("claim"))
    side = lambda s, name: best.select(F.col("cluster").alias(s), F.col("claim").alias(name))
    return edges.join(side("a", "from_claim"), "a").join(side("b", "to_claim"), "b").select("from_claim", "to_claim")


def by_text(contradictions: DataFrame, claims: DataFrame) -> DataFrame:
    """``(contradiction, claim_a, claim_b)``: both texts as the first claim that says so; unresolved ones go."""
    known = claims.groupBy("text").agg(F.min("id").alias("id"))
    side = lambda s: known.select(F.col("text").alias(f"text_{s}"), F.col("id").alias(f"claim_{s}"))
    return contradictions.join(side("a"), "text_a").join(side("b"), "text_b").select("contradiction", "claim_a", "claim_b")


def related(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, shared)``: each query with all rows of higher id that share its question or whose tokens have a Jaccard above
    ``threshold``.  Token sets are compared once, by their numbers of common tokens; pairs of a question are not met a second time."""
    told = lambda f: f.select("id", "question", F.array_sort("tokens").alias("t"))
    (q, asked), (r, held) = classes_of(told(queries), ["t"]), classes_of(told(rows), ["t"])
    words = lambda f, s: f.select(F.col("id").alias(s), F.size("t").alias(f"n{s}"), F.explode("t").alias("w"))
    common = words(q, "a").join(words(r, "b"), "w").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    alike = common.where(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")) > threshold).select("a", "b")
    with_question = lambda members, f: members.join(f.select("id", "question"), "id")
    other = F.when(~F.coalesce(F.col("a_question") == F.col("b_question"), F.lit(False)), F.lit(False))
    apart = _met(alike, with_question(asked, queries), with_question(held, rows), ("question",), other)

    def of_question(f: DataFrame) -> DataFrame:
        named = f.where("question is not null").select("id", F.col("question").alias("rep"))
        return named.join(named.groupBy("rep").agg(F.count("*").alias("n")), "rep")

    ours = of_question(queries)
    same = _met(ours.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("kind")).distinct(), ours, of_question(rows), (), None)
    return apart.union(same.select(apart.columns)).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("kind").alias("shared"))
