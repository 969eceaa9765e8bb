"""N-best segmentation over a SentencePiece vocabulary of the merge kind, and decoding.

A text is escaped as the model does it (a mark in front, a mark for each space).  The model merges neighbours in the order
of their scores.  So a segmentation is its encoding where no two neighbouring pieces hold parts that would have merged
before either was complete.  The list begins with the model's own encoding; behind it come the best of all other
segmentations by the sum of the scores of their pieces, then by fewer pieces.

No piece crosses from other characters into a mark, holds a newline, or holds letters next to anything but letters (if one of
a vocabulary does, units are cut at marks and newlines alone), so the lattice of a text is a chain of the lattices of its
units.  In a unit, one forward pass finds the one segmentation of every prefix whose neighbours would not have merged,
and the Viterbi score of every prefix; a backward A* search over the lattice takes these scores as exact heuristics, so
segmentations leave its queue in order.  For the n best of a text only the n - 1 units whose second choice costs least can
differ from their best; all others are contracted to one arc, and a backward A* search over the chain of these units' own n
best, again with exact heuristics, gives the text's.  Characters outside the vocabulary are spelled by byte pieces, each 10
worse than the worst piece.

Null and empty texts have no pieces, score 0 and the empty text back.  Very long texts are segmented whole, unit by unit; a
unit is as long as its word.  Other ties are broken by the place of the first difference.  Rows are independent; repeated
rows, null ids and other columns, whatever their names, do no harm.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

MARK = "▁"
#: Numerals that the classes below would count as letters.
NUMERALS = "²³¹¼½¾"
UNITS = re.compile(f"\n|{MARK}*(?:[^\\W\\d_{NUMERALS}]+|(?:(?![{MARK}\n])[\\W\\d_{NUMERALS}])+)|{MARK}+")
COARSE_UNITS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Characters that a table of transitions covers, the length of units that are worked in step, and characters of a slice.
COMMON, LONGEST, SLICE = 160, 40, 1 << 21
#: Units kept by a worker; beyond that the half used last stays.
MEMO_UNITS = 1_200_000
NEVER = 1 << 60
#: Costs are whole numbers: one unit of score, plus one for each piece.
SCORE = 1 << 12
NONE = 1 << 62


class Merges:
    """Which neighbouring pieces the model would not have left apart."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self.sides: dict[str, tuple[list, list]] = {}
        self.known: dict[str, dict[str, bool]] = {}
        self.size = 0

    def merged(self, text: str) -> list[tuple]:
        """The pieces that merging makes of ``text``, as trees (piece, left, right)."""
        rank, parts = self.rank, [(c, None, None) for c in text]
        while True:
            found = [(r, k) for k in range(len(parts) - 1) if (r := rank.get(parts[k][0] + parts[k + 1][0])) is not None]
            if not found:
                return parts
            _, k = min(found)
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k], parts[k + 1])]

    def _sides(self, piece: str) -> tuple[list, list]:
        """The parts at the left and at the right edge of a piece, each with the rank at which it is used up."""
        sides = self.sides.get(piece)
        if sides is None:
            tree = self.merged(piece)
            sides = ([], []) if len(tree) == 1 else ([(piece, NEVER)], [(piece, NEVER)])
            for side, found in enumerate(sides) if len(tree) == 1 else ():
                part, gone = tree[0], NEVER
                while part:
                    found.append((part[0], gone))
                    gone, part = self.rank.get(part[0], NEVER), part[1 + side]
            self.sides[piece] = sides
        return sides

    def reached(self, piece: str) -> bool:
        """Whether merging makes the piece of its own characters."""
        return len(self.merged(piece)) == 1

    def after(self, a: str) -> dict[str, bool]:
        """What is known of the pieces behind ``a``."""
        if self.size > 4_000_000:
            self.known, self.size = {}, 0
        return self.known.setdefault(a, {})

    def join(self, a: str, b: str) -> bool:
        """Whether merging would not have left ``a`` and ``b`` apart."""
        rank, left = self.rank, self._sides(b)[0]
        found = False
        for x, used in self._sides(a)[1]:
            for y, gone in left:
                r = rank.get(x + y)
                if r is not None and r < used and r <= gone:
                    found = True
                    break
            if found:
                break
        self.after(a)[b] = found
        self.size += 1
        return found


class PieceLattice:
    """Segmentations of units and texts, kept for the units met before."""

    def __init__(self, model_file: str, n: int = 4):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = n
        ids = range(model.get_piece_size())
        self.spelled = [model.id_to_piece(i) for i in ids]
        byte = [model.is_byte(i) for i in ids]
        self.bytelike = np.array(byte)
        self.byte_of = {i: int(self.spelled[i][3:5], 16) for i in ids if byte[i]}
        self.byte_id = {v: k for k, v in self.byte_of.items()}
        self.score = {self.spelled[i]: (float(model.get_score(i)), i) for i in ids if not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.byte_score = min(s for s, _ in self.score.values() if s > -1e8) - 10.0
        self.merges = Merges({p: round(-SCORE * s) for p, (s, _) in self.score.items()})
        self.byte_cost = round(-SCORE * self.byte_score) + 1
        #: A trie of the pieces; "" leads to (cost, ids, piece, whether merging makes it) where one ends.
        self.trie: dict = {}
        for p, (score, i) in self.score.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (round(-SCORE * score) + 1, (i,), p, self.merges.reached(p))
        self._compile()
        self.pattern = UNITS if all(len(UNITS.findall(p)) == 1 for p in self.score) else COARSE_UNITS
        self._forget()

    def _compile(self) -> None:
        """The part of the trie over the COMMON characters as a table: node and character give the next node, -1 if none."""
        counts = Counter(chain.from_iterable(self.score))
        common = [c for c, _ in counts.most_common() if c in self.score][:COMMON]
        self.class_of = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(common):
            self.class_of[ord(c)] = k + 1
        nodes, rows = [self.trie], []
        for node in nodes:  # grows on the way
            row = []
            for k, c in enumerate(common):
                if c in node:
                    row.append((k + 1, len(nodes)))
                    nodes.append(node[c])
            rows.append(row)
        self.next = np.full((len(nodes), len(common) + 1), -1, np.int32)
        self.node_piece = np.full(len(nodes), -1, np.int32)
        for n, (node, row) in enumerate(zip(nodes, rows, strict=True)):
            for k, to in row:
                self.next[n, k] = to
            if "" in node:
                self.node_piece[n] = node[""][1][0]
        self.piece_cost, self.piece_reached = np.zeros(len(self.spelled), np.int64), np.zeros(len(self.spelled), bool)
        for p, (score, i) in self.score.items():
            self.piece_cost[i], self.piece_reached[i] = round(-SCORE * score) + 1, self.merges.reached(p)
        self.pair_keys, self.pair_joins, self.pairs = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool), 0

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Merges.join`` for arrays of pieces, by a table of the pairs met so far."""
        if self.pairs > len(self.pair_keys) // 2:
            self.pair_keys[:], self.pairs = -1, 0
        mask = len(self.pair_keys) - 1
        keys = a.astype(np.int64) * len(self.spelled) + b
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        out = np.zeros(len(keys), bool)
        todo = np.arange(len(keys))
        new: list[np.ndarray] = []
        while len(todo):
            held = self.pair_keys[slots[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.pair_joins[slots[todo[hit]]]
            empty = held == -1
            if empty.any():
                new.append(todo[empty])
            todo = todo[~hit & ~empty]
            slots[todo] = (slots[todo] + 1) & mask
        if new:
            missed = np.concatenate(new)
            distinct, back = np.unique(keys[missed], return_inverse=True)
            found = np.array([self.merges.join(self.spelled[k // len(self.spelled)], self.spelled[k % len(self.spelled)]) for k in distinct.tolist()], bool)
            out[missed] = found[back]
            for key, joins in zip(distinct.tolist(), found.tolist(), strict=True):
                slot = ((key * 0x9E3779B97F4A7C15) % 2**64 >> 40) & mask
                while self.pair_keys[slot] != -1:
                    slot = (slot + 1) & mask
                self.pair_keys[slot], self.pair_joins[slot] = key, joins
            self.pairs += len(distinct)
        return out

    @staticmethod
    def _traced(came: np.ndarray, piece: np.ndarray, rows: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the path that leads to the end of each row, how many, and the pieces as an array, -1 in front."""
        at, steps = np.full(len(rows), len(came) - 1), []
        while at.any():
            steps.append(np.where(at > 0, piece[at, rows], -1))
            at = np.where(at > 0, came[at, rows], 0)
        table = np.stack(steps[::-1], axis=1)
        there = table >= 0
        sizes = there.sum(axis=1)
        raw, edges = table[there].astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], sizes, table

    def _describe_many(self, units: list[str]) -> Iterator[tuple[list[str], list[bytes], list[bytes], dict[str, np.ndarray]]]:
        """What ``describe`` says, for units of one length at a time: the same forward and backward pass, all units in step."""
        by_size: dict[int, list[str]] = {}
        for unit in units:
            by_size.setdefault(len(unit), []).append(unit)
        alone: list[str] = []
        for size, own in by_size.items():
            if size > LONGEST or len(own) < 4:
                alone += own
                continue
            chars = self.class_of[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(len(own), size)
            fits = chars.all(axis=1)
            if not fits.all():
                alone += [u for u, ok in zip(own, fits.tolist(), strict=True) if not ok]
                own, chars = [u for u, ok in zip(own, fits.tolist(), strict=True) if ok], chars[fits]
            if not own:
                continue
            n = len(own)
            best, came, taken = np.full((size + 1, n), NONE), np.zeros((size + 1, n), np.int8), np.zeros((size + 1, n), np.int32)
            last, last_came = np.full((size + 1, n), -1, np.int32), np.zeros((size + 1, n), np.int8)
            best[0] = 0
            arcs: list[list[tuple]] = [[] for _ in range(size + 1)]
            for a in range(size):
                rows, node = np.arange(n), np.zeros(n, np.int32)
                for b in range(a + 1, size + 1):
                    node = self.next[node, chars[rows, b - 1]]
                    alive = node >= 0
                    if not alive.all():
                        rows, node = rows[alive], node[alive]
                        if not len(rows):
                            break
                    piece = self.node_piece[node]
                    is_piece = piece >= 0
                    if not is_piece.any():
                        continue
                    ends, piece = rows[is_piece], piece[is_piece]
                    cost = self.piece_cost[piece]
                    arcs[b].append((a, ends, cost))
                    total = best[a, ends] + cost
                    better = total < best[b, ends]
                    to = ends[better]
                    best[b, to], came[b, to], taken[b, to] = total[better], a, piece[better]
                    open_ = (last[b, ends] < 0) & self.piece_reached[piece]
                    if a:
                        open_ &= last[a, ends] >= 0
                    to, piece = ends[open_], piece[open_]
                    if a and len(to):
                        apart = ~self._joined(last[a, to], piece)
                        to, piece = to[apart], piece[apart]
                    last[b, to], last_came[b, to] = piece, a
            whole = last[size] >= 0
            if not whole.all():
                alone += [u for u, ok in zip(own, whole.tolist(), strict=True) if not ok]
            after, gap, equal = np.full((size + 1, n), NONE), np.full(n, NONE), np.zeros(n, np.int64)
            after[size] = 0
            for b in range(size, 0, -1):
                for a, ends, cost in arcs[b]:
                    total = after[b, ends] + cost
                    after[a, ends] = np.minimum(after[a, ends], total)
                    more = total + best[a, ends] - best[size, ends]
                    equal[ends] += more == 0
                    gap[ends] = np.minimum(gap[ends], np.where(more > 0, more, NONE))
            rows = np.flatnonzero(whole)
            if not len(rows):
                continue
            names = [u for u, ok in zip(own, whole.tolist(), strict=True) if ok]
            own_ids, own_n, own_table = self._traced(last_came, last, rows)
            best_ids, best_n, _ = self._traced(came, taken, rows)
            own_cost = np.where(own_table >= 0, self.piece_cost[own_table], 0).sum(axis=1)
            numbers = {"own": own_cost, "own_n": own_n, "best": best[size, rows], "best_n": best_n, "gap": np.where(equal[rows] == best_n, gap[rows], 0)}
            yield names, own_ids, best_ids, numbers
        if alone:
            found = [self.describe(u) for u in alone]
            own_ids, best_ids = ([array("I", f[k]).tobytes() for f in found] for k in (0, 2))
            pick = lambda k: np.array([f[k] for f in found], np.int64)
            sizes = lambda k: np.array([len(f[k]) for f in found], np.int64)
            yield alone, own_ids, best_ids, {"own": pick(1), "own_n": sizes(0), "best": pick(3), "best_n": sizes(2), "gap": pick(4)}

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.own_ids: list[bytes] = []
        self.best_ids: list[bytes] = []
        self.numbers = {name: np.zeros(1024, np.int64) for name in ("own", "own_n", "best", "best_n", "gap", "same", "used")}
        self.now = 0
        self.searched: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def _spelled(self, c: str) -> tuple:
        ids = tuple(self.byte_id[x] for x in c.encode("utf-8", "surrogatepass"))
        return self.byte_cost * len(ids), ids, None, True

    def _lattice(self, unit: str) -> tuple[list[list[tuple]], list[int], list[tuple | None]]:
        """Arcs (begin, (cost, ids, piece, reached)) by their end, the Viterbi cost of every prefix, and the last arc of the
        model's own encoding of every prefix."""
        end, trie, merges = len(unit), self.trie, self.merges
        into: list[list[tuple]] = [[] for _ in range(end + 1)]
        best, last = [0] + [NONE] * end, [None] * (end + 1)
        for a in range(end):
            base, before = best[a], last[a]
            piece = before[1][2] if before else None
            behind = merges.after(piece) if piece is not None else None
            fits = a == 0 or before is not None
            node, b = trie, a
            while b < end:
                node = node.get(unit[b])
                if node is None:
                    break
                b += 1
                arc = node.get("")
                if arc is not None:
                    made = (a, arc)
                    into[b].append(made)
                    cost = base + arc[0]
                    if cost < best[b]:
                        best[b] = cost
                    if fits and last[b] is None and arc[3]:
                        if behind is None:
                            last[b] = made
                        else:
                            joined = behind.get(arc[2])
                            if joined is None:
                                joined = merges.join(piece, arc[2])
                            if not joined:
                                last[b] = made
            first = trie.get(unit[a])
            if first is None or "" not in first:
                made = (a, self._spelled(unit[a]))
                into[a + 1].append(made)
                best[a + 1] = min(best[a + 1], base + made[1][0])
                if fits and last[a + 1] is None:
                    last[a + 1] = made
        return into, best, last

    def describe(self, unit: str) -> tuple[tuple, int, tuple, int, int]:
        """(ids and cost of the model's own encoding, ids and cost of the best by score, what the second best costs more)."""
        into, best, last = self._lattice(unit)
        end = len(unit)
        total = best[end]
        if last[end] is None:  # no segmentation is free of merges left undone: take the merges themselves
            own, own_cost = self._merged(unit)
        else:
            parts, own_cost, at = [], 0, end
            while at:
                at, arc = last[at]
                parts.append(arc[1])
                own_cost += arc[0]
            own = tuple(chain.from_iterable(reversed(parts)))
        parts, at = [], end
        while at:
            goal = best[at]
            for a, arc in into[at]:
                if best[a] + arc[0] == goal:
                    break
            parts.append(arc[1])
            at = a
        # An arc that is on no best path shows how much the best way through it costs more.
        after = [NONE] * end + [0]
        gap, equal = NONE, 0
        for b in range(end, 0, -1):
            ahead = after[b]
            if ahead < NONE:
                for a, arc in into[b]:
                    cost = ahead + arc[0]
                    if cost < after[a]:
                        after[a] = cost
                    cost += best[a] - total
                    if cost == 0:
                        equal += 1
                    elif cost < gap:
                        gap = cost
        return own, own_cost, tuple(chain.from_iterable(reversed(parts))), total, gap if equal == len(parts) else 0

    def _merged(self, unit: str) -> tuple[tuple, int]:
        ids, cost = [], 0
        for piece, _, _ in self.merges.merged(unit):
            if piece in self.score:
                ids.append(self.score[piece][1])
                cost += round(-SCORE * self.score[piece][0]) + 1
            else:
                spelled = [self.byte_id[x] for x in piece.encode("utf-8", "surrogatepass")]
                ids += spelled
                cost += self.byte_cost * len(spelled)
        return tuple(ids), cost

    def search(self, unit: str, n: int) -> list[tuple[int, bytes]]:
        """The ``n`` best segmentations of a unit by score, as (cost, ids).

        An entry of the queue takes the k-th best arc into a place; its total is exact, so the ways that follow it are taken at
        once along the best arcs, and only the next best arc of each place on the way enters the queue."""
        into, best, _ = self._lattice(unit)
        ways: list[list[tuple] | None] = [None] * (len(unit) + 1)
        queue: list[tuple] = [(best[-1], 0, len(unit), 0, 0, None)]
        order, found = 0, []
        while queue:
            total, _, at, k, behind, path = heapq.heappop(queue)
            while True:
                way = ways[at]
                if way is None:
                    way = ways[at] = sorted((best[a] + arc[0], a, arc) for a, arc in into[at]) if len(into[at]) > 1 else [(best[a] + arc[0], a, arc) for a, arc in into[at]]
                if k + 1 < len(way):
                    order += 1
                    heapq.heappush(queue, (way[k + 1][0] + behind, order, at, k + 1, behind, path))
                _, at, arc = way[k]
                behind, path, k = behind + arc[0], (arc[1], path), 0
                if not at:
                    break
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((total, array("I", ids).tobytes()))
            if len(found) == n:
                break
        return found

    def _searched(self, unit: str, n: int) -> list[tuple[int, bytes]]:
        found = self.searched.get((unit, n))
        if found is None:
            if len(self.searched) >= MEMO_UNITS // 30:
                self.searched.clear()
            found = self.searched[unit, n] = self.search(unit, n)
        return found

    def _make_room(self, more: int) -> None:
        size = len(self.number)
        if size + more > MEMO_UNITS:
            kept = np.sort(np.argsort(self.numbers["used"][:size], kind="stable")[size // 2 :])
            names = list(self.number)
            self.number = {names[k]: n for n, k in enumerate(kept.tolist())}
            self.own_ids, self.best_ids = [self.own_ids[k] for k in kept.tolist()], [self.best_ids[k] for k in kept.tolist()]
            self.numbers = {name: x[kept] for name, x in self.numbers.items()}
            size = len(kept)
        room = len(self.numbers["own"])
        if size + more > room:
            grown = max(size + more, 2 * room)
            self.numbers = {name: np.concatenate([x, np.zeros(grown - room, x.dtype)]) for name, x in self.numbers.items()}

    def learn(self, units: set[str]) -> dict[str, int]:
        """Take in ``units``: the model's own encoding and the two best by score; their numbers, valid until the next call."""
        self.now += 1
        new = units.difference(self.number)
        known = units.intersection(self.number)
        self.numbers["used"][np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))] = self.now
        self._make_room(len(new))
        for names, own_ids, best_ids, numbers in self._describe_many(list(new)):
            first = len(self.own_ids)
            place = slice(first, first + len(names))
            self.number.update(zip(names, range(first, first + len(names)), strict=True))
            for name, values in numbers.items():
                self.numbers[name][place] = values
            same = [x == y for x, y in zip(own_ids, best_ids, strict=True)]
            self.numbers["same"][place], self.numbers["used"][place] = same, self.now
            self.own_ids += own_ids
            self.best_ids += [x if ok else y for x, y, ok in zip(own_ids, best_ids, same, strict=True)]
        return dict(zip(units, map(self.number.__getitem__, units), strict=True))

    def units(self, text: str) -> list[str]:
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment_units(self, names: list[str], known: dict[str, int]) -> tuple[list[int], list[tuple[float, int, dict[int, bytes] | None]]]:
        """The numbers of units that have been learnt, and the list for them one behind another: (score, pieces, choices).

        The first is the model's own encoding, with None for its choices; the others differ from the units' best by score in
        the units that ``choices`` names by their place."""
        if not names:
            return [], [(0.0, 0, None)]
        at = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        size = int(self.numbers["own_n"][at].sum())
        out = [(self._score(int(self.numbers["own"][at].sum()), size), size, None)]
        numbers = at.tolist()
        if self.n == 1:
            return numbers, out
        # The unit with the r-th least gap can show its k-th choice in the r + k-th entry at the earliest.
        gap = self.numbers["gap"][at]
        near = np.flatnonzero(gap <= np.partition(gap, self.n - 2)[self.n - 2]) if len(names) >= self.n else np.arange(len(names))
        near = near[np.argsort(gap[near], kind="stable")[: self.n - 1]].tolist()
        options = {k: self._searched(names[k], self.n - r) for r, k in enumerate(near) if gap[k] < NONE}
        near = sorted(options)
        choices = [options[k] for k in near]
        fixed = int(self.numbers["best"][at].sum()) - sum(c[0][0] for c in choices)
        size = int(self.numbers["best_n"][at].sum()) - sum(len(c[0][1]) // 4 for c in choices)
        same = len(names) - int(self.numbers["same"][at].sum()) == sum(not self.numbers["same"][numbers[k]] for k in near)
        # Backward over the chain of the units that may differ; ``ahead`` is the exact cost of what lies before.
        ahead = [fixed]
        for c in choices:
            ahead.append(ahead[-1] + c[0][0])
        queue: list[tuple] = [(ahead[-1], 0, len(choices), 0, ())]
        order = 0
        while queue and len(out) < self.n:
            total, _, left, behind, picks = heapq.heappop(queue)
            if not left:
                if not same or any(ids != self.own_ids[numbers[k]] for k, ids in zip(near, picks, strict=True)):
                    pieces = size + sum(map(len, picks)) // 4
                    out.append((self._score(total, pieces), pieces, dict(zip(near, picks, strict=True))))
                continue
            for cost, ids in choices[left - 1]:
                order += 1
                heapq.heappush(queue, (ahead[left - 1] + cost + behind, order, left - 1, behind + cost, (ids, *picks)))
        return numbers, out

    @staticmethod
    def _score(cost: int, pieces: int) -> float:
        return round((pieces - cost) / SCORE, 3)

    def ids_of(self, numbers: list[int], choices: dict[int, bytes] | None) -> bytes:
        """The ids of an entry of the list."""
        if choices is None:
            return b"".join(map(self.own_ids.__getitem__, numbers))
        return b"".join([choices[k] if k in choices else self.best_ids[n] for k, n in enumerate(numbers)])

    def segment(self, text: str) -> list[tuple[float, int, bytes]]:
        """The list of a whole text, as (score, pieces, ids)."""
        names = self.units(text)
        numbers, found = self.segment_units(names, self.learn(set(names)))
        return [(score, pieces, self.ids_of(numbers, choices)) for score, pieces, choices in found]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids."""
        numbers = np.frombuffer(ids, "<u4")
        if not self.bytelike[numbers].any():
            return "".join(map(self.spelled.__getitem__, numbers.tolist())).replace(MARK, " ")[1:]
        out, raw = [], bytearray()
        for i in numbers.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
            else:
                if raw:
                    out.append(raw.decode("utf-8", "surrogatepass"))
                    raw = bytearray()
                out.append(self.spelled[i])
        out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out).replace(MARK, " ")[1:]


@lru_cache(maxsize=2)
def lattice_of(model_file: str, n: int) -> PieceLattice:
    """One lattice for all tasks of a worker process."""
    return PieceLattice(model_file, n)


def encode_nbest(docs: DataFrame, model_file: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_pieces, ids_crc32, best_score, nbest_scores, nbest_pieces, round_trip)`` of every whole text.

    ``ids_crc32``, ``best_score`` and the first of each list are of the model's own encoding.  ``round_trip``: it decodes to
    the text (of a text that holds the mark itself it does not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model_file, n)
        for batch in batches:
            rows, texts = [], [t or "" for t in batch.column(1).to_pylist()]
            for first, last in slices(texts, SLICE):
                split = [lattice.units(t) for t in texts[first:last]]
                known = lattice.learn(set(chain.from_iterable(split)))
                for text, names in zip(texts[first:last], split, strict=True):
                    numbers, found = lattice.segment_units(names, known)
                    ids = lattice.ids_of(numbers, None)
                    rows.append((found[0][1], zlib.crc32(ids), found[0][0], [f[0] for f in found], [f[1] for f in found], lattice.decode(ids) == text))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]],
                [id_col, "n_pieces", "ids_crc32", "best_score", "nbest_scores", "nbest_pieces", "round_trip"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` long, n_pieces long, ids_crc32 long, best_score double, nbest_scores array<double>, nbest_pieces array<long>, round_trip boolean")
