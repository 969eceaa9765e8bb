"""Claims, sources and edges kept up to date batch by batch, by deltas that can be taken back.

Every event is lifted to a fact: a row about one key whose columns can be merged in any order (counts, the first and the last
value with their places, largest and least).  What is known of a key is the merge of its facts that count.  A batch

* merges its own facts into what is known of their keys;
* on a rollback finds the keys that the run has facts of and merges those anew from the facts that still count, wherever in the
  log they are; this is what makes a fact's effects go away;
* turns each change of a piece of evidence into -1 for the claim and stance that it had and +1 for those that it has;
* on a merge or the loss of one finds the claims that are merged with either side, and follows pointers among these alone;
* derives the claims that any of this changed from what is known of their members.

All tables are cut into buckets by key, and a batch opens only those of its keys: its work goes with what it affects, not with the
log.  ``report`` says how many rows each batch read and wrote.  A batch ends with a manifest of its own; one that is run again
after a failure starts from the manifest before it and replaces what it wrote.  A store is also a checkpoint to go on from:
``resumed`` takes the last sound manifest of the right version and gives it the events since, or starts from the first event.

Events without the id of what they are about, or of other types, change nothing.  Batches need not be in order of ``seq`` among each
other, as facts are merged by place; a repeated event counts twice, so a log is given once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import removed, saved
from ..operators.knowledge import aliases
from ..operators.projection import AUDIT_ONLY, payload, rollback_class
from ..sources import files
from ..sources.buckets import Buckets

VERSION = 1
#: Columns of a fact: first, last, first known and last known values with their places; count, largest, least, whether ever.
FACT = "n long, first_seq long, f1 string, f2 string, f3 string, known_seq long, known string, last_seq long, l1 string, l2 string, l3 string, l4 string, late_seq long, late string, top string, low string, flag boolean"
NAMES = [c.split()[0] for c in FACT.split(", ")]
KINDS = dict(c.split() for c in FACT.split(", "))


def _fact(kind: str, key: Column, **fields: Column) -> Column:
    values = [fields.get(name, F.lit(None)).cast(KINDS[name]).alias(name) for name in NAMES]
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), *values)


def lifted(events: DataFrame) -> DataFrame:
    """``(kind, key, seq, run_id, class, <columns of a fact>)`` of every event that the views depend on."""
    seq, event = F.col("seq"), F.col("event_type")
    hashed = payload("contentHash")
    later = _fact("source", payload("sourceId"), n=F.lit(0), late_seq=F.when(hashed.isNotNull(), seq), late=hashed, flag=event == "SOURCE_RETRACTED")
    edge = _fact("edge", F.coalesce(payload("id"), payload("edgeId")), n=F.lit(1), last_seq=seq, l1=payload("fromClaimId"), l2=payload("toClaimId"), l3=payload("relation"), l4=F.when(event == "EDGE_ADDED", F.lit("there")))
    into = F.when(payload("claimId") != payload("intoClaimId"), payload("intoClaimId"))
    authority = payload("authorityClass")
    facts = (
        F.when(event == "CLAIM_OBSERVED", _fact("claim", payload("claimId"), n=F.lit(1), first_seq=seq, f1=payload("familyId"), f2=payload("subject"), top=payload("observedAt")))
        .when(event == "EVIDENCE_LINKED", _fact("evidence", payload("id"), n=F.lit(1), last_seq=seq, l1=payload("claimId"), l2=payload("stance")))
        .when(event == "CLAIM_MERGED", _fact("merge", F.when(into.isNotNull(), payload("claimId")), n=F.lit(1), low=into))
        .when(event == "CLAIM_EXPIRED", _fact("expiry", payload("claimId"), n=F.lit(1), last_seq=seq, l1=payload("expiredAt")))
        .when(event == "SOURCE_OBSERVED", _fact("source", payload("sourceId"), n=F.lit(1), first_seq=seq, f1=payload("url"), f2=payload("domain"), f3=payload("observedAt"), known_seq=F.when(authority.isNotNull(), seq), known=authority, last_seq=seq, l1=payload("observedAt"), flag=F.lit(False)))
        .when(event.isin("SOURCE_READ", "SOURCE_CHANGED", "SOURCE_RETRACTED"), later)
        .when(event.isin("EDGE_ADDED", "EDGE_REMOVED"), edge)
    )
    rows = events.where(~event.isin(*AUDIT_ONLY)).select("seq", "run_id", rollback_class(event).alias("class"), facts.alias("_f")).where("_f.key is not null")
    return rows.select("_f.kind", "_f.key", "seq", "run_id", "class", *[F.col(f"_f.{name}").alias(name) for name in NAMES])


def merged(facts: DataFrame) -> DataFrame:
    """One row a key; partial sums before the shuffle, so a key with most facts is no burden to one task."""
    at = lambda function, seq, *names: [function(F.struct(*names), F.col(seq)).alias(f"_{seq}")]
    out = facts.groupBy("kind", "key").agg(
        F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), *at(F.min_by, "first_seq", "f1", "f2", "f3"), F.min("known_seq").alias("known_seq"), *at(F.min_by, "known_seq", "known"),
        F.max("last_seq").alias("last_seq"), *at(F.max_by, "last_seq", "l1", "l2", "l3", "l4"), F.max("late_seq").alias("late_seq"), *at(F.max_by, "late_seq", "late"), F.max("top").alias("top"), F.min("low").alias("low"), F.bool_or("flag").alias("flag"),
    )
    inside = {"f1": "first_seq", "f2": "first_seq", "f3": "first_seq", "known": "known_seq", "l1": "last_seq", "l2": "last_seq", "l3": "last_seq", "l4": "last_seq", "late": "late_seq"}
    return out.select("kind", "key", *[F.col(f"_{inside[n]}.{n}").alias(n) if n in inside else F.col(n) for n in NAMES])


TABLES = {
    "facts": (["kind", "key"], f"kind string, key string, seq long, run_id string, class string, {FACT}"), "runs": (["run_id"], "run_id string, kind string, key string"), "rolled": (["run_id"], "run_id string"),
    "known": (["kind", "key"], f"kind string, key string, {FACT}"), "support": (["key"], "key string, n_supports long, n_opposes long"), "alias": (["id"], "id string, survivor string"),
    "members": (["survivor"], "survivor string, id string"),
    "claims": (["id"], "id string, family_id string, subject string, n_observations long, last_seen_at string, n_supports long, n_opposes long, expired_at string"),
}


class Incremental:
    """The views of a log under ``folder``, as of the last batch or of the last before ``batch``."""

    def __init__(self, spark: SparkSession, folder: str, batch: int | None = None, buckets: int = 8, target: int = 100_000):
        self.spark, self.folder, self.reports = spark, folder.rstrip("/"), []
        manifest = self._manifest(batch) or {"batch": -1, "cursor": None, "version": VERSION, "tables": {}, "unused": {}}
        self.batch, self.cursor, self.version = manifest["batch"], manifest["cursor"], manifest["version"]
        self.tables = {}
        for name, (keys, schema) in TABLES.items():
            known = manifest["tables"].get(name, {})
            self.tables[name] = Buckets(spark, f"{self.folder}/{name}", keys, schema, known.get("count", buckets), target, known.get("entries"))
        self.unused, self.used = manifest["unused"], self._versions()

    def _manifest(self, before: int | None) -> dict | None:
        """The newest, or the newest of an earlier batch; batches are numbered without gaps."""
        number = before - 1 if before is not None else int(files.read_text(self.spark, f"{self.folder}/last.json") or "-1")
        text = files.read_text(self.spark, f"{self.folder}/manifest-{number}.json") if number >= 0 else None
        try:
            return json.loads(text) if text else None
        except ValueError:
            return {"batch": number, "cursor": None, "version": None, "tables": {}, "unused": {}}

    def _versions(self) -> dict[str, set[int]]:
        return {name: {e[0] for versions in t.entries.values() for e in versions} for name, t in self.tables.items()}

    def _commit(self, number: int) -> None:
        tables = {name: {"count": t.count, "entries": t.entries} for name, t in self.tables.items()}
        used = self._versions()
        unused = {name: sorted(self.used[name] - used[name]) for name in used}
        files.write_text(self.spark, f"{self.folder}/manifest-{number}.json", json.dumps({"batch": number, "cursor": self.cursor, "version": self.version, "tables": tables, "unused": unused}))
        files.write_text(self.spark, f"{self.folder}/last.json", str(number))
        for name, versions in self.unused.items():  # what the batch before this one ceased to use: nothing goes back that far
            for version in versions:
                files.remove(self.spark, f"{self.folder}/{name}/v{version}")
        self.batch, self.used, self.unused = number, used, unused

    def sound(self) -> bool:
        return self.version == VERSION and self.batch >= 0 and all(t.sound() for t in self.tables.values())

    # --- a batch ---

    def apply(self, events: DataFrame, number: int | None = None) -> dict:
        """Bring all views up to ``events(seq, run_id, event_type, payload)`` and say what that took."""
        number = self.batch + 1 if number is None else number
        t, made = self.tables, []

        def kept(rows: DataFrame) -> DataFrame:
            made.append(saved(rows))
            return made[-1]

        for table in t.values():
            table.rows_read = table.rows_written = 0
        rows = kept(events.select("seq", "run_id", "event_type", "payload"))
        new = kept(lifted(rows))
        gone = kept(rows.where("event_type = 'RUN_ROLLED_BACK'").select(payload("run_id").alias("run_id")).where("run_id is not null").distinct())
        t["facts"].append(new, 2 * number, new.count())
        t["runs"].append(new.where("class <> 'cross_run_mutation'").select("run_id", "kind", "key").distinct(), 2 * number)
        again = not gone.isEmpty()
        if again:
            t["rolled"].append(gone, 2 * number)
        changed = kept(self._known(new, gone if again else None, number, kept))
        touched = self._support(changed, number, kept)
        moved = self._aliases(changed, number, kept)
        self._claims(changed, touched, moved, number, kept)
        for table in t.values():
            table.tidy(2 * number + 1)
        top = rows.agg(F.max("seq")).first()[0]
        self.cursor = max((c for c in (self.cursor, top) if c is not None), default=None)
        report = {"batch": number, "read": {name: x.rows_read for name, x in t.items()}, "written": {name: x.rows_written for name, x in t.items()}}
        self._commit(number)
        removed(*made)
        self.reports.append(report)
        return report

    def _counting(self, facts: DataFrame) -> DataFrame:
        """Facts that no rollback takes away: a run's own go with it, and its removals of edges that it had added itself."""
        rolled = self.tables["rolled"].lookup(facts.select("run_id").where("run_id is not null").distinct()).withColumn("_rolled", F.lit(True))
        marked = facts.join(rolled, "run_id", "left")
        own = marked.where("_rolled and kind = 'edge' and l4 = 'there'").select("key", "run_id").distinct().withColumn("_own", F.lit(True))
        removal = F.col("class") == "dynamic_edge"
        lost = F.col("_rolled") & ((F.col("class") == "pure_run_local") | (removal & F.col("_own")))
        return marked.join(own, ["key", "run_id"], "left").where(~F.coalesce(lost, F.lit(False)))

    def _known(self, new: DataFrame, gone: DataFrame | None, number: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Merge the batch into what is known of its keys; ``(kind, key, before, now)`` of those keys."""
        facts, known = self.tables["facts"], self.tables["known"]
        live = new
        anew = None
        if self.tables["rolled"].entries:
            rolled = self.tables["rolled"].lookup(new.select("run_id").where("run_id is not null").distinct())
            late = new.join(rolled, "run_id", "left_semi").select("kind", "key")  # facts of runs that are rolled back already
            anew = late if gone is None else late.union(self.tables["runs"].lookup(gone).join(gone, "run_id", "left_semi").select("kind", "key"))
            anew = kept(anew.distinct())
            live = new.join(anew, ["kind", "key"], "left_anti")
        keys = kept((live.select("kind", "key") if anew is None else live.select("kind", "key").union(anew)).distinct())
        before = kept(known.lookup(keys))
        old = before if anew is None else before.join(anew, ["kind", "key"], "left_anti")
        now = merged(old.unionByName(live.select("kind", "key", *NAMES)))
        if anew is not None:
            now = now.unionByName(merged(self._counting(facts.lookup(anew))))
        now = kept(now)
        known.replace(keys, now, 2 * number)
        pack = lambda rows, name: rows.select("kind", "key", F.struct(*NAMES).alias(name))
        return pack(before, "before").join(pack(now, "now"), ["kind", "key"], "full")

    def _support(self, changed: DataFrame, number: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Counts of supporting and opposing evidence moved by each change of a piece of evidence; the claims concerned."""
        evidence = changed.where("kind = 'evidence'")
        side = lambda name, sign: evidence.where(F.col(name).isNotNull()).select(F.col(f"{name}.l1").alias("key"), F.col(f"{name}.l2").alias("stance"), F.lit(sign).alias("sign"))
        moves = side("before", -1).union(side("now", 1)).where("key is not null")
        total = lambda stance: F.sum(F.when(F.col("stance") == stance, F.col("sign")).otherwise(0)).cast("long")
        deltas = kept(moves.groupBy("key").agg(total("supports").alias("n_supports"), total("opposes").alias("n_opposes")).where("n_supports <> 0 or n_opposes <> 0"))
        support = self.tables["support"]
        now = support.lookup(deltas.select("key")).unionByName(deltas).groupBy("key").agg(F.sum("n_supports").alias("n_supports"), F.sum("n_opposes").alias("n_opposes"))
        support.replace(deltas.select("key"), kept(now.where("n_supports <> 0 or n_opposes <> 0")), 2 * number)
        return deltas.select("key")

    def _aliases(self, changed: DataFrame, number: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """Follow merges anew among the claims tied to a merge that came or went; these claims with their former survivors."""
        merges = changed.where("kind = 'merge' and not (before.low <=> now.low)")
        ends = kept(merges.select(F.explode(F.array("key", "before.low", "now.low")).alias("id")).where("id is not null").distinct())
        if ends.isEmpty():
            return None
        alias, members = self.tables["alias"], self.tables["members"]
        tops = kept(self._survivors(ends).select("survivor").distinct())
        tied = members.lookup(tops).select("id", F.col("survivor").alias("former"))
        group = kept(tied.union(tops.select("survivor", "survivor")).union(ends.join(tied, "id", "left_anti").select("id", "id")).distinct())
        edges = self.tables["known"].lookup(group.select(F.lit("merge").alias("kind"), "id")).select(F.col("key").alias("id"), F.col("low").alias("to"))
        now = kept(aliases(edges).select("id", F.col("to").alias("survivor")))
        alias.replace(group.select("id"), now, 2 * number)
        members.replace(group.select("former").union(now.select("survivor")).distinct(), now, 2 * number)
        return group

    def _survivors(self, ids: DataFrame) -> DataFrame:
        """``ids(id)`` -> ``(id, survivor)``; a claim that was not merged is its own."""
        return ids.join(self.tables["alias"].lookup(ids), "id", "left").select("id", F.coalesce("survivor", "id").alias("survivor"))

    def _claims(self, changed: DataFrame, touched: DataFrame, moved: DataFrame | None, number: int, kept: Callable[[DataFrame], DataFrame]) -> None:
        """Derive the claims that changed from what is known of their members."""
        raw = changed.where("kind = 'claim'").select(F.col("key").alias("id")).union(touched.select("key"))
        if moved is not None:
            raw = raw.union(moved.select("id"))
        ids = self._survivors(kept(raw.distinct())).select(F.col("survivor").alias("id")).union(changed.where("kind = 'expiry'").select("key"))
        if moved is not None:
            ids = ids.union(moved.select("former"))
        ids = kept(ids.distinct())
        alone = ids.join(self.tables["alias"].lookup(ids), "id", "left_anti")
        parts = kept(alone.select(F.col("id").alias("survivor"), "id").union(self.tables["members"].lookup(alone).select("survivor", "id")))
        known, support = self.tables["known"], self.tables["support"]
        seen = known.lookup(parts.select(F.lit("claim").alias("kind"), "id")).select(F.col("key").alias("id"), "n", "first_seq", "f1", "f2", "top")
        counted = support.lookup(parts.select("id")).withColumnRenamed("key", "id")
        expired = known.lookup(alone.select(F.lit("expiry").alias("kind"), "id")).select(F.col("key").alias("id"), F.col("l1").alias("expired_at"))
        rows = parts.join(seen, "id", "left").join(counted, "id", "left").groupBy("survivor").agg(
            F.min_by("f1", "first_seq").alias("family_id"), F.min_by("f2", F.when(F.col("first_seq").isNotNull(), F.struct(F.col("id") != F.col("survivor"), F.col("first_seq")))).alias("subject"), F.sum("n").alias("n_observations"), F.max("top").alias("last_seen_at"),
            F.coalesce(F.sum("n_supports"), F.lit(0)).alias("n_supports"), F.coalesce(F.sum("n_opposes"), F.lit(0)).alias("n_opposes"),
        )
        rows = rows.where("n_observations > 0").withColumnRenamed("survivor", "id").join(expired, "id", "left")
        self.tables["claims"].replace(ids, kept(rows.select(*self.tables["claims"].columns)), 2 * number)

    # --- reading ---

    def status(self, latest: int | None = None) -> DataFrame:
        """``(version, last_applied_seq, status)``, one row: ready, behind ``latest``, of another version, or empty."""
        state = "empty" if self.batch < 0 else "incompatible" if self.version != VERSION else "behind" if latest is not None and (self.cursor or 0) < latest else "ready"
        return self.spark.createDataFrame([(self.version, self.cursor, state)], "version int, last_applied_seq long, status string")

    def views(self) -> dict[str, DataFrame]:
        """The same views as a rebuild of the whole log gives."""
        known = self.tables["known"].read()
        sources = known.where("kind = 'source' and n > 0").select(
            F.col("key").alias("id"), F.col("f1").alias("url"), F.col("f2").alias("domain"), F.col("known").alias("authority"), F.col("n").alias("run_count"), F.col("f3").alias("first_seen_at"), F.col("l1").alias("last_seen_at"), F.col("late").alias("content_hash"),
            F.coalesce("flag", F.lit(False)).alias("retracted"),
        )
        edges = known.where("kind = 'edge' and l4 = 'there' and l1 <> l2").select(F.col("key").alias("id"), F.col("l1").alias("from_id"), F.col("l2").alias("to_id"), F.col("l3").alias("relation"))
        return {"claims": self.tables["claims"].read(), "sources": sources, "edges": edges}


def maintained(events: DataFrame, folder: str, checkpoint: str, **options: int) -> StreamingQuery:
    """Views under ``folder`` brought up to each micro-batch of a stream of events."""

    def update(batch: DataFrame, number: int) -> None:
        Incremental(batch.sparkSession, folder, number, **options).apply(batch, number)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update).trigger(availableNow=True).start()


def resumed(spark: SparkSession, folder: str, log: DataFrame, **options: int) -> tuple[Incremental, bool]:
    """The views of ``log`` and whether they come from the checkpoint in ``folder`` and the events since its cursor.

    A checkpoint that is missing, of another version or not what its manifest says is put aside, and all events are applied."""
    store = Incremental(spark, folder, **options)
    sound = store.sound()
    if not sound:
        files.remove(spark, folder)
        store = Incremental(spark, folder, **options)
    store.apply(log if store.cursor is None else log.where(F.col("seq") > store.cursor))
    return store, sound
