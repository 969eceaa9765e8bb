"""Reconciliation in order: each observation meets the claims that those before it made, as they stand by then.

What an observation becomes depends on the claims that a rule can match it with: those of its subject and predicate, of its entity
and predicate, or with so many common words that the score can reach a near duplicate's.  Observations that are tied by any of
these, directly or through others, form a component, and components do not touch each other.  They are found by joins (groups by
key, the similarity join, connected components) and folded side by side, each in order; a family is no unit of work.  A claim that
no rule can match is no candidate here, where a full list of a family's claims would let it outrank a weaker one that can.

A claim that an observation is the same as takes over its wording, polarity and hedge; number, period and entity stay the founder's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NARROWING, REPLACEMENT
from .evaluate import b_cubed_by
from .graph import components, saved, similar_pairs
from .reconcile import AMBIGUITY_GAP, ASSERTION, NEAR, OBJECT_JACCARD, REUSE, _quantity, _text, prepared

#: Common share of words that a near duplicate needs at least: all else agreeing, NEAR = 0.7 * share + 0.3.
SHARE = (NEAR - 0.3) / 0.7
COLUMNS = ["id", "claim", "nsubject", "npredicate", "nobject", "given", "polarity", "hedge", "quantity", "value", "unit", "event_date", "version", "entity_id", "replacing", "narrowing", "seed"]


def described(rows: DataFrame) -> DataFrame:
    """Observations with their normal forms, words and wording, as the fold wants them."""
    extra = [c for c in ("seed",) if c in rows.columns]
    out = prepared(rows, "o").withColumns({"_replacing": _text("o").rlike(REPLACEMENT), "_narrowing": _text("o").rlike(NARROWING), "_quantity": _quantity("o")})
    plain = {c: F.col(f"o_{c}") for c in ASSERTION} | {c: F.col(f"o_{c}") for c in ("nsubject", "npredicate", "nobject", "words")} | {c: F.col(f"_{c}") for c in ("replacing", "narrowing", "quantity")}
    out = out.select(*[v.alias(k) for k, v in plain.items()], F.col("o_object").isNotNull().alias("given"))
    out = out.withColumns({"claim": F.concat(F.lit("claim_"), F.col("id").cast("string")), "value": F.col("value").cast("double")})
    return out.join(rows.select("id", *extra), "id") if extra else out.withColumn("seed", F.lit(False))


def tied(rows: DataFrame) -> DataFrame:
    """``(id, component)`` of ``described`` rows with a family: observations that may have to do with each other."""
    texts = rows.withColumn("_text", F.array_join("words", " ")).groupBy("family_id", "_text").agg(F.min("id").alias("_first"), F.first("words").alias("words"))
    first = lambda *keys: rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy("family_id", *keys).agg(F.min("id").alias("b"))
    star = lambda *keys: rows.join(first(*keys), ["family_id", *keys]).select(F.col("id").alias("a"), "b")
    same = rows.withColumn("_text", F.array_join("words", " ")).join(texts.select("family_id", "_text", F.col("_first").alias("b")), ["family_id", "_text"]).select(F.col("id").alias("a"), "b")
    alike = similar_pairs(texts.select("family_id", F.col("_first").alias("id"), F.col("words").alias("tokens")), round(SHARE - 1e-6, 6), ["family_id"]).select("a", "b")
    found = components(same.union(star("nsubject", "npredicate")).union(star("entity_id", "npredicate")).union(alike))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


class Claims:
    """The claims of one component, in the order in which they were made."""

    def __init__(self, full: bool):
        self.full, self.made = full, []

    def observe(self, o: dict) -> tuple:
        """``(class, score, method, matched, canonical)`` of the next observation."""
        words = set(f"{o['nsubject']} {o['npredicate']} {o['nobject']}".split())
        scored = []
        for c in self.made:
            if self.full or self._relevant(o, words, c):
                scored.append((-self._score(o, words, c), c["claim"], c))
        scored.sort(key=lambda x: x[:2])
        score = -scored[0][0] if scored else 0.0
        best = scored[0][2] if scored else None
        kind = self._class(o, best, score, score + scored[1][0] if len(scored) > 1 else None) if best else "new_claim"
        keyed = best is not None and self._keyed(o, best)
        method = "canonical_key_exact" if keyed else "entity_aware_v3" if best is not None and score >= REUSE and self._scoped(o, best) else "lexical_rules_v2"
        matched = best["claim"] if best is not None and kind != "new_claim" else None
        if kind == "same_claim":
            for name in ("nsubject", "npredicate", "polarity", "hedge", "quantity"):
                best[name] = o[name]
            if o["given"]:
                best["nobject"] = o["nobject"]
            best["words"] = set(f"{best['nsubject']} {best['npredicate']} {best['nobject']}".split())
            return kind, score, method, matched, matched
        self.add(o)
        return kind, score, method, matched, o["claim"]

    def add(self, o: dict) -> None:
        self.made.append({**o, "words": set(f"{o['nsubject']} {o['npredicate']} {o['nobject']}".split())})

    def _relevant(self, o: dict, words: set, c: dict) -> bool:
        if o["npredicate"] == c["npredicate"] and (o["nsubject"] == c["nsubject"] or (o["entity_id"] is not None and o["entity_id"] == c["entity_id"])):
            return True
        return self._share(words, c["words"]) >= SHARE - 1e-6

    @staticmethod
    def _share(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a or b else 1.0

    @staticmethod
    def _period(o: dict) -> str:
        return o["event_date"] if o["event_date"] is not None else o["version"] or ""

    def _periods_agree(self, o: dict, c: dict) -> bool:
        a, b = self._period(o), self._period(c)
        return not a or not b or a == b

    @staticmethod
    def _numbers(o: dict, c: dict) -> bool | None:
        if o["value"] is None or c["value"] is None:
            return None
        return o["unit"] == c["unit"] and abs(o["value"] - c["value"]) / max(abs(o["value"]), abs(c["value"]), 1.0) <= 0.1

    @staticmethod
    def _heads(o: dict, c: dict) -> bool:
        return o["nsubject"] == c["nsubject"] and o["npredicate"] == c["npredicate"]

    @staticmethod
    def _apart(o: dict, c: dict) -> bool:
        return o["entity_id"] is not None and c["entity_id"] is not None and o["entity_id"] != c["entity_id"]

    def _keyed(self, o: dict, c: dict) -> bool:
        return self._heads(o, c) and o["quantity"] == c["quantity"] and o["nobject"] == c["nobject"] and self._periods_agree(o, c)

    def _scoped(self, o: dict, c: dict) -> bool:
        far = o["nobject"] and c["nobject"] and self._share(set(o["nobject"].split()), set(c["nobject"].split())) < OBJECT_JACCARD
        return self._heads(o, c) and not far and self._periods_agree(o, c)

    def _score(self, o: dict, words: set, c: dict) -> float:
        numbers = self._numbers(o, c)
        if self._keyed(o, c) and o["polarity"] == c["polarity"] and numbers is not False:
            return 1.0
        if self._apart(o, c):
            return 0.0
        base = self._share(words, c["words"]) * 0.7 + (0.5 if numbers is None else float(numbers)) * 0.15 + 0.1 * (o["polarity"] == c["polarity"]) + 0.05 * (o["hedge"] == c["hedge"])
        base = max(0.0, min(1.0, base))
        return round(max(base, 0.85) if o["entity_id"] is not None and o["entity_id"] == c["entity_id"] and self._heads(o, c) else base, 6)

    @staticmethod
    def _newer(o: dict, c: dict) -> bool:
        if o["event_date"] is not None and c["event_date"] is not None:
            return o["event_date"] > c["event_date"]
        numbers = [[int(x) for x in m.group().split(".")] for v in (o["version"], c["version"]) if v and (m := re.search(r"\d+(?:\.\d+)*", v))]
        if len(numbers) < 2:
            return False
        n = max(map(len, numbers))
        a, b = (x + [0] * (n - len(x)) for x in numbers)
        return a > b

    def _class(self, o: dict, c: dict, score: float, gap: float | None) -> str:
        numbers, scoped, keyed = self._numbers(o, c), self._scoped(o, c), self._keyed(o, c)
        if scoped and (numbers is False or (o["polarity"] != c["polarity"] and "conditional" not in (o["polarity"], c["polarity"]))):
            return "contradiction"
        known = o["entity_id"] is not None and c["entity_id"] is not None
        heads = o["entity_id"] == c["entity_id"] if known else o["nsubject"] == c["nsubject"]
        if heads and o["npredicate"] == c["npredicate"] and self._newer(o, c) and o["replacing"] and c["nobject"] in f"{o['nsubject']} {o['npredicate']} {o['nobject']}":
            return "supersedes"
        if (scoped or keyed) and (o["polarity"] == "conditional" or (o["hedge"] != c["hedge"] and c["hedge"] == "certain") or o["narrowing"]):
            return "qualification"
        if self._heads(o, c) and len(o["nobject"]) > len(c["nobject"]) and c["nobject"] in o["nobject"]:
            return "elaboration"
        if self._apart(o, c) and score >= REUSE:
            return "near_duplicate"
        if keyed or (score >= REUSE and scoped):
            return "near_duplicate" if not keyed and gap is not None and round(gap, 6) < AMBIGUITY_GAP else "same_claim"
        return "near_duplicate" if score >= NEAR else "new_claim"


OUT = "group long, observation_id long, classification string, score double, method string, matched_claim_id string, canonical_claim_id string"


def folded(rows: DataFrame, order: str, full: bool = False) -> DataFrame:
    """``described`` rows with a ``group`` folded by group, sorted within partitions; a row with ``seed`` is a claim from the start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, claims = None, None
        for batch in batches:
            out = []
            clean = batch.astype(object).where(batch.notna(), None)
            for row in clean.to_dict("records"):
                if row["group"] != group:
                    group, claims = row["group"], Claims(full)
                if row["seed"]:
                    claims.add(row)
                else:
                    out.append((int(group), int(row["id"]), *claims.observe(row)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    wanted = rows.select("group", F.col(order).alias("_order"), *COLUMNS).repartition("group").sortWithinPartitions("group", F.col("seed").desc(), "_order")
    return wanted.mapInPandas(run, OUT)


def plan_ladder(observations: DataFrame, order: str = "ord") -> DataFrame:
    """``(observation_id, classification, score, method, matched_claim_id, canonical_claim_id)`` of observations with long ids, in
    ``order`` within their family.  The score of a new claim is that of the best candidate, 0 without one."""
    rows = saved(described(observations))
    placed = rows.join(tied(rows), "id").withColumnRenamed("component", "group")
    if order != "id":
        placed = placed.join(observations.select("id", F.col(order).alias("_ord")), "id")
    return folded(placed, "id" if order == "id" else "_ord").drop("group")


def scenario_scores(rows: DataFrame, order: str) -> DataFrame:
    """``rows(scenario, seed, gold, <assertion>)`` -> ``(scenario, n, precision, recall, f1)``: scenarios replayed side by side.

    Seeds are claims from the start, all claims of the scenario are candidates, and the canonical claims of its observations are
    compared with their gold clusters."""
    assertions = described(rows.withColumn("family_id", F.col("scenario"))).join(rows.select("id", F.col("scenario").cast("long").alias("group"), *([F.col(order).alias("_ord")] if order != "id" else [])), "id")
    found = folded(assertions, "id" if order == "id" else "_ord", full=True)
    gold = rows.where("not seed").select(F.col("id").alias("observation_id"), "gold")
    return b_cubed_by(found.join(gold, "observation_id").select(F.col("group").alias("scenario"), F.col("canonical_claim_id").alias("pred"), "gold"), "scenario")
