"""Curation commands and what they do to the views, against a loop over them one by one."""

import json
import random

import pytest

from mossgraph.operators import curation

COMMANDS = "seq long, command_id string, expected long, actor string, kind string, body string"


class World:
    """The views as plain dictionaries, changed by one command after another."""

    def __init__(self, rng, n=14):
        self.claims = {f"c{k}": {"family": f"f{k % 2}", "status": "active", "into": None} for k in range(n)}
        self.observations = {f"o{k}": {"claim": f"c{rng.randrange(n)}", "at": f"t{rng.randrange(6)}", "status": "active"} for k in range(n * 3)}
        self.evidence = {f"e{k}": {"claim": f"c{rng.randrange(n)}", "stance": rng.choice(["supports", "opposes", "context"])} for k in range(n * 2)}
        self.relations = {}
        for k in range(6):
            a, b = rng.sample(sorted(self.claims), 2)
            self.relations[f"r{k}"] = (a, b, "supports")
        self.made = 0

    def of(self, table, claim):
        return sorted(k for k, v in table.items() if v["claim"] == claim)

    def command(self, rng):
        """A command that is in order as things are."""
        active = sorted(c for c, v in self.claims.items() if v["status"] == "active")
        kind = rng.choice(["merge", "split", "retract", "retract", "relate", "stance"])
        if kind == "merge":
            pairs = [(a, b) for a in active for b in active if a != b and self.claims[a]["family"] == self.claims[b]["family"]]
            a, b = rng.choice(pairs)
            return kind, {"sourceClaimId": a, "survivorClaimId": b}
        if kind == "split":
            bound = {x for r in self.relations.values() for x in r[:2]}
            able = [c for c in active if len(self.of(self.observations, c)) > 1 and c not in bound]
            if able:
                source = rng.choice(able)
                obs, ev = self.of(self.observations, source), self.of(self.evidence, source)
                self.made += 1
                cut = rng.randrange(1, len(obs))
                parts = [(f"d{self.made}a", obs[:cut], ev[: len(ev) // 2]), (f"d{self.made}b", obs[cut:], ev[len(ev) // 2 :])]
                return kind, {"sourceClaimId": source, "results": [{"claimId": c, "observationIds": o, "evidenceIds": e, "currentObservationId": o[0]} for c, o, e in parts]}
            kind = "retract"
        if kind == "retract":
            if rng.random() < 0.5:
                target = rng.choice([c for c, v in self.claims.items() if v["status"] in ("active", "retracted")])
                status = "retracted" if self.claims[target]["status"] == "active" else "active"
                return kind, {"target": {"kind": "claim", "id": target}, "newStatus": status}
            target = rng.choice(sorted(self.observations))
            return kind, {"target": {"kind": "observation", "id": target}, "newStatus": "retracted" if self.observations[target]["status"] == "active" else "active"}
        if kind == "relate":
            rid = f"r{rng.randrange(9)}"
            if rid in self.relations and rng.random() < 0.4:
                return kind, {"relationId": rid, "after": None}
            a, b = rng.sample(active, 2)
            return kind, {"relationId": rid, "after": {"id": rid, "fromClaimId": a, "toClaimId": b, "relation": rng.choice(["supports", "contradicts"])}}
        return "stance", {"evidenceId": rng.choice(sorted(self.evidence)), "newStance": rng.choice(["supports", "opposes", "context"])}

    def apply(self, kind, body):
        if kind == "merge":
            a, b = body["sourceClaimId"], body["survivorClaimId"]
            self.claims[a] |= {"status": "merged", "into": b}
            for table in (self.observations, self.evidence):
                for k in self.of(table, a):
                    table[k]["claim"] = b
            moved = {k: tuple(b if x == a else x for x in r[:2]) + r[2:] for k, r in self.relations.items()}
            self.relations = {k: r for k, r in moved.items() if r[0] != r[1]}
        elif kind == "split":
            source = body["sourceClaimId"]
            self.claims[source]["status"] = "split"
            for r in body["results"]:
                self.claims[r["claimId"]] = {"family": self.claims[source]["family"], "status": "active", "into": None}
                for k in r["observationIds"]:
                    self.observations[k]["claim"] = r["claimId"]
                for k in r["evidenceIds"]:
                    self.evidence[k]["claim"] = r["claimId"]
        elif kind == "retract":
            target = body["target"]
            if target["kind"] == "claim":
                self.claims[target["id"]]["status"] = body["newStatus"]
                for k in self.of(self.observations, target["id"]):
                    self.observations[k]["status"] = body["newStatus"]
            else:
                self.observations[target["id"]]["status"] = body["newStatus"]
        elif kind == "relate":
            after = body["after"]
            self.relations.pop(body["relationId"], None)
            if after:
                self.relations[body["relationId"]] = (after["fromClaimId"], after["toClaimId"], after["relation"])
        else:
            self.evidence[body["evidenceId"]]["stance"] = body["newStance"]

    def rows(self):
        out = []
        for c, v in self.claims.items():
            live = [(o["at"], k) for k, o in self.observations.items() if o["claim"] == c and o["status"] == "active"]
            latest = max((a for a, _ in live), default=None)
            count = lambda s: 0 if v["status"] == "retracted" else sum(e["stance"] == s and e["claim"] == c for e in self.evidence.values())  # noqa: E731, B023
            out.append((c, v["family"], v["status"], v["into"], len(live), min((k for a, k in live if a == latest), default=None), count("supports"), count("opposes")))
        return sorted(out)


def views_of(spark, world):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "claims": frame([(c, v["family"]) for c, v in world.claims.items()], "id string, family_id string"),
        "observations": frame([(k, v["claim"], v["at"]) for k, v in world.observations.items()], "id string, claim_id string, observed_at string"),
        "evidence": frame([(k, v["claim"], v["stance"]) for k, v in world.evidence.items()], "id string, claim_id string, stance string"),
        "relations": frame([(k, *v) for k, v in world.relations.items()], "id string, from_id string, to_id string, relation string"),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_commands_and_views_as_a_loop_leaves_them(spark, seed):
    rng = random.Random(seed)
    world = World(rng)
    views = views_of(spark, world)
    start = cursor = 100
    commands, want, done = [], [], {}
    for seq in range(90):
        roll = rng.random()
        if roll < 0.45 or not done:
            kind, body = world.command(rng)
            command = (f"k{seq}", cursor, "ann", kind, json.dumps(body))
        elif roll < 0.6:  # repeated, whatever place it expects
            name = rng.choice(sorted(done))
            command = (name, rng.choice([done[name][0], cursor, cursor + 1]), *done[name][1:])
        elif roll < 0.7:
            name = rng.choice(sorted(done))
            command = (name, cursor, "bob", *done[name][2:])
        else:
            kind, body = world.command(rng)
            command = (f"k{rng.randrange(seq + 3)}x", cursor + rng.choice([-2, -1, 1, 2, 5]), "ann", kind, json.dumps(body))
        name, expected, *content = command
        commands.append((seq, *command))
        if name in done:
            want.append((seq, name, "repeated" if list(done[name][1:]) == content else "conflict", done[name][0] + 1))
        elif expected != cursor:
            want.append((seq, name, "stale", None))
        else:
            done[name] = (expected, *content)
            cursor += 1
            want.append((seq, name, "applied", cursor))
            world.apply(content[1], json.loads(content[2]))
    frame = spark.createDataFrame(commands, COMMANDS).repartition(3)
    assert sorted(map(tuple, curation.command_outcomes(frame, start).collect())) == want
    assert {w[2] for w in want} == {"applied", "repeated", "conflict", "stale"}
    events = curation.curation_events(frame, start)
    got = curation.curated(views, events)
    assert sorted(map(tuple, got["claims"].collect())) == world.rows()
    assert sorted((r.id, r.claim_id, r.status) for r in got["observations"].collect()) == sorted((k, v["claim"], v["status"]) for k, v in world.observations.items())
    assert sorted(map(tuple, got["evidence"].collect())) == sorted((k, v["claim"], v["stance"]) for k, v in world.evidence.items())
    assert sorted(map(tuple, got["relations"].collect())) == sorted((k, *v) for k, v in world.relations.items())


def test_commands_that_expect_what_was_applied_before_them(spark):
    """Two commands that expect places 0 and 1 of the log both happen, wherever they stand in the stream."""
    frame = spark.createDataFrame([(5, "a", 0), (9, "b", 1), (11, "c", 1), (12, "a", 2), (13, "d", 2)], "seq long, command_id string, expected long")
    assert [tuple(r) for r in curation.command_outcomes(frame).orderBy("seq").collect()] == [(5, "a", "applied", 1), (9, "b", "applied", 2), (11, "c", "stale", None), (12, "a", "repeated", 1), (13, "d", "applied", 3)]
    assert curation.command_outcomes(frame.limit(0)).count() == 0


def test_many_repetitions_over_several_blocks(spark, monkeypatch):
    """A repetition met at every step, in blocks that each remember what the ones before have done."""
    monkeypatch.setattr(curation, "FOLD", 150)
    data = [(k, k - (2 if k % 4 == 3 else 0) - (300 if k % 9 == 8 and k > 300 else 0), k // 3 - (k % 5 == 0)) for k in range(600)]
    place, done, want = 0, set(), set()
    for seq, name, expected in data:
        if expected == place and name not in done:
            want.add(seq)
            done.add(name)
            place += 1
    got = {r.seq for r in curation.happened(spark.createDataFrame(data, "seq long, command_id long, expected long")).collect()}
    assert got == want and len(want) > 10
