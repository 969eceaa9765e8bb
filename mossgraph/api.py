"""Named reads and run actions over the views, as one object: what a service in front of the engine would call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.wording import shown_payload
from .operators import feeds, ledger, longitudinal, readmodel, rollback
from .operators.feeds import Graph

ACTIONS = ("families", "threads", "claims", "evidence", "contradictions", "gaps", "entity", "belief", "why", "timeline", "changes", "research-next", "family-view")


class Knowledge:
    """``ask(action, ...)`` over views: families, threads, claims, evidence, sources, contradictions, gaps, entities; and a log.

    An action that the engine does not have can be registered, and one that it has replaced (``register``)."""

    def __init__(self, views: dict[str, DataFrame], log: DataFrame):
        self.views, self.log, self.graph = views, log, Graph(views)
        for name, action in {"entity": self.entity, "belief": self.belief, "why": self.why, "timeline": self.timeline, "changes": self.changes, "research-next": self.research_next, "family-view": self.family_view, "claims": self.claims}.items():
            self.graph.register(name, action)

    def register(self, name: str, action: Callable[..., DataFrame]) -> None:
        self.graph.register(name, action)

    def ask(self, action: str, **arguments) -> DataFrame:
        return self.graph.ask(action, **arguments)

    def claims(self, family_id=None, thread_id=None, limit: int | None = None, cursor: list | None = None) -> DataFrame:
        """Active claims, latest first, a page at a time."""
        wanted = {k: v for k, v in (("family_id", family_id), ("thread_id", thread_id)) if v is not None}
        return readmodel.page(readmodel.filtered(readmodel.active(self.views["claims"]), **wanted), limit=limit, cursor=cursor)

    def entity(self, entity_id=None, label: str | None = None) -> DataFrame:
        rows = self.views["entities"]
        return rows.where(F.col("id") == F.lit(entity_id)) if entity_id is not None else rows.where(F.lower("label") == F.lower(F.lit(label)))

    def _one(self, claim_id) -> tuple[DataFrame, DataFrame]:
        return self.views["claims"].where(F.col("id") == F.lit(claim_id)), self.views["evidence"].where(F.col("claim_id") == F.lit(claim_id))

    def belief(self, claim_id) -> DataFrame:
        return longitudinal.belief_view(*self._one(claim_id), self.views["sources"])

    def why(self, claim_id) -> DataFrame:
        return longitudinal.provenance(*self._one(claim_id), self.views["sources"])

    def timeline(self, limit: int | None = None, **ids) -> DataFrame:
        """Events whose payload names one of ``claim_id``, ``source_id``, ``contradiction_id``, ``gap_id``, oldest first."""
        names = {"claim_id": "claimId", "source_id": "sourceId", "contradiction_id": "contradictionId", "gap_id": "gapId"}
        fits = F.lit(False)
        for name, value in ids.items():
            fits = fits | (F.get_json_object("payload", f"$.{names[name]}") == F.lit(str(value)))
        rows = self.log.where(fits).select("seq", "event_type", feeds.told().alias("description")).orderBy("seq")
        return rows if limit is None else rows.limit(limit)

    def changes(self, since: int, family_id=None, limit: int = 100) -> DataFrame:
        """The next ``limit`` events after a place, by kind of change."""
        rows = self.log.where(F.col("seq") > since)
        if family_id is not None:
            claims = self.views["claims"].select(F.col("id").cast("string").alias("claim_id"), F.col("family_id").cast("string").alias("family_id"))
            wanted = F.col("family_id") == F.lit(str(family_id))
            mine = feeds.owning_families(rows, claims.where(wanted)).where(wanted).select("seq")
            rows = rows.join(mine.orderBy("seq").limit(limit), "seq", "left_semi")  # the log meets the first places only
        return rows.orderBy("seq").limit(limit).select("seq", "event_type", feeds.bucket().alias("bucket"))

    def research_next(self, family_id) -> DataFrame:
        mine = lambda name: self.views[name].where(F.col("family_id") == F.lit(family_id))
        return longitudinal.research_targets(mine("gaps"), mine("contradictions"))

    def family_view(self, family_id) -> DataFrame:
        families = self.views["families"].where(F.col("id") == F.lit(family_id))
        claims = self.views["claims"].where(F.col("family_id") == F.lit(family_id))
        return longitudinal.family_dashboard(families, claims, self.views["evidence"])


class Runs:
    """Reads and rollback of runs over ``log(seq, run_id, family_id, event_type, payload)``."""

    def __init__(self, log: DataFrame):
        self.log = log

    def list(self, family_id=None, before: int | None = None, limit: int | None = None) -> DataFrame:
        rows = ledger.lifecycle(self.log)
        runs = rows.groupBy("run_id").agg(F.min("seq").alias("seq"), F.min("family_id").alias("family_id"), F.max_by("event_type", "seq").alias("last"))
        return readmodel.run_page(runs if family_id is None else runs.where(F.col("family_id") == F.lit(family_id)), before, limit)

    def status(self, run_id) -> DataFrame:
        return ledger.latest_state(self.log.where(F.col("run_id") == F.lit(run_id)))

    def history(self, run_id) -> DataFrame:
        rows = ledger.lifecycle(self.log.where(F.col("run_id") == F.lit(run_id)), heartbeats=True)
        return rows.select("seq", "event_type", shown_payload(F.col("event_type"), F.col("payload")).alias("payload")).orderBy("seq")

    def events(self, run_id, after: int = 0, limit: int = 100) -> DataFrame:
        """The feed of a run after a place, without heartbeats, up to its end."""
        rows = ledger.lifecycle(feeds.until_terminal(self.log.where(F.col("run_id") == F.lit(run_id)), after))
        return rows.select("seq", "event_type", shown_payload(F.col("event_type"), F.col("payload")).alias("payload")).orderBy("seq").limit(min(max(limit, 1), 500))

    def rollback(self, run_id, at: str) -> DataFrame | None:
        return rollback.rollback_batch(self.log, run_id, at)
