"""Operator 5: secret scans with one combined automaton.

All rules are compiled together: each regex becomes a nondeterministic automaton, subset
construction makes the union of "anything, then a rule" deterministic, minimisation merges
equal states, and the result is one transition array over bytes. A text is read once; a
state tells which rules a match ends for. Where a match ends, a small automaton of the
reversed rule, compiled the same way, walks back to its leftmost start.

Matches of one rule do not overlap, the leftmost wins and is as long as it can be; those
shorter than the rule's limit are dropped after they have used up their bytes. Rules use
ASCII only, so non-ASCII letters never match, in either case.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole;
repeated rows get equal results; an empty table gives an empty result; columns beside those
named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as c
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``least``: characters a match needs, counted from where the rule first accepts if
    ``of_value``, else in all."""

    kind: str
    pattern: str
    least: int
    of_value: bool = False


#: The base rules, then those this operator adds. Every class is ASCII.
BASE = (
    Rule(
        "assign",
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
        8,
        of_value=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
ADDED = (
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)


# ---------------------------------------------------------------- compilation


class Nfa:
    """States with byte-set edges and empty moves."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, parsed, start: int, backward: bool) -> int:
        """Append a parsed sequence after ``start``; the state it ends in."""
        for op, value in reversed(parsed) if backward else parsed:
            if op is c.LITERAL:
                start = self._step(start, frozenset((value,)))
            elif op is c.IN:
                start = self._step(start, self._members(value))
            elif op is c.SUBPATTERN:
                start = self.add(value[-1], start, backward)
            elif op is c.BRANCH:
                end = self.state()
                for branch in value[1]:
                    fresh = self.state()
                    self.empty[start].append(fresh)
                    self.empty[self.add(branch, fresh, backward)].append(end)
                start = end
            elif op is c.MAX_REPEAT:
                start = self._repeat(value, start, backward)
            else:
                raise ValueError(f"rules can't use {op}")
        return start

    def _step(self, start: int, members: frozenset[int]) -> int:
        end = self.state()
        self.edges[start].append((members, end))
        return end

    @staticmethod
    def _members(parts) -> frozenset[int]:
        out: set[int] = set()
        for op, value in parts:
            out |= {value} if op is c.LITERAL else set(range(value[0], value[1] + 1))
        return frozenset(out)

    def _repeat(self, value, start: int, backward: bool) -> int:
        least, most, inner = value
        for _ in range(least):
            start = self.add(inner, start, backward)
        if most is c.MAXREPEAT:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop, backward)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(inner, start, backward)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


@dataclass
class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256; ``accepts[state]`` a bit mask of rules.

    State 0 starts, accepting states come last, from ``accepting`` (times 256) on. ``dead``
    is the state that leads nowhere, or -1.
    """

    table: list[int]
    accepts: list[int]
    accepting: int
    dead: int


def _subsets(nfa: Nfa, start: int, ends: dict[int, int], search: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: next state by state and byte, accept mask by state."""
    # Bytes that no edge tells apart move alike; only one of each class is followed.
    alike: dict[tuple[bool, ...], list[int]] = {}
    sets = list({members for edges in nfa.edges for members, _ in edges})
    for byte in range(256):
        alike.setdefault(tuple(byte in members for members in sets), []).append(byte)
    first = nfa.closure([start])
    number, order, rows = {first: 0}, [first], []
    closed: dict[frozenset[int], frozenset[int]] = {}
    for states in order:
        row = np.zeros(256, np.int64)
        moves = [edge for s in states for edge in nfa.edges[s]]
        for alikes in alike.values():
            to = frozenset(t for members, t in moves if alikes[0] in members)
            if to not in closed:
                closed[to] = nfa.closure(to | ({start} if search else frozenset()))
            reached = closed[to]
            if reached not in number:
                number[reached] = len(order)
                order.append(reached)
            row[alikes] = number[reached]
        rows.append(row)
    accepts = np.array([sum(1 << ends[s] for s in states if s in ends) for states in order])
    return np.array(rows), accepts


def _minimised(table: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Merge states that no input tells apart, by refining classes until they are stable."""
    _, classes = np.unique(accepts, return_inverse=True)
    while True:
        signature = np.column_stack((classes, classes[table]))
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        if finer.max() == classes.max():
            break
        classes = finer
    members = [int(np.flatnonzero(classes == k)[0]) for k in range(classes.max() + 1)]
    # the start first, accepting states last
    rank = sorted(range(len(members)), key=lambda k: (k != classes[0], accepts[members[k]] != 0))
    new = np.empty(len(members), np.int64)
    new[rank] = np.arange(len(members))
    final = np.array([new[classes[table[members[k]]]] for k in rank])
    masks = [int(accepts[members[k]]) for k in rank]
    plain = sum(1 for m in masks if not m)
    dead = [k for k in range(len(rank)) if not masks[k] and (final[k] == k).all()]
    return Dfa((final * 256).ravel().tolist(), masks, plain * 256, dead[0] * 256 if dead else -1)


def combined(rules: tuple[Rule, ...]) -> Dfa:
    """One automaton that finds where matches of all rules end."""
    nfa = Nfa()
    start, ends = nfa.state(), {}
    for bit, rule in enumerate(rules):
        fresh = nfa.state()
        nfa.empty[start].append(fresh)
        ends[nfa.add(parser.parse(rule.pattern), fresh, False)] = bit
    return _minimised(*_subsets(nfa, start, ends, True))


def reversed_rule(rule: Rule) -> Dfa:
    nfa = Nfa()
    start = nfa.state()
    end = nfa.add(parser.parse(rule.pattern), start, True)
    return _minimised(*_subsets(nfa, start, {end: 0}, False))


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    forward: Dfa
    backward: list[Dfa]

    @property
    def restarts(self) -> int:
        """Rules after whose matches reading starts anew.

        Their last class holds every character of the other rules, so no other match goes on.
        """
        return sum(1 << bit for bit, rule in enumerate(self.rules) if rule.of_value)

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        return cls(rules, combined(rules), [reversed_rule(r) for r in rules])

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule."""
        table, accepts, accepting = self.forward.table, self.forward.accepts, self.forward.accepting
        ended = [0] * len(self.rules)
        began = [0] * len(self.rules)
        found: list[tuple[int, int, int]] = []
        state = on = 0
        restarts = self.restarts
        for at, byte in enumerate(data):
            state = table[state + byte]
            if on or state >= accepting:
                now = accepts[state >> 8]
                if now != on:
                    closed = on & ~now
                    if closed:
                        self._close(data, closed, at, ended, began, found)
                        if closed & restarts:
                            # A keyword inside a finished value can't start another match.
                            state = table[byte]
                            now = accepts[state >> 8]
                    for bit in range(len(began)):
                        if now >> bit & 1 and not on >> bit & 1:
                            began[bit] = at
                    on = now
        if on:
            self._close(data, on, len(data), ended, began, found)
        return sorted(found)

    def _close(self, data, closed: int, end: int, ended, began, found) -> None:
        for bit, rule in enumerate(self.rules):
            if closed >> bit & 1:
                start = self._start(bit, data, end, ended[bit])
                if start >= 0:
                    size = end - (began[bit] if rule.of_value else start)
                    if size >= rule.least:
                        found.append((start, bit, end))
                    ended[bit] = end

    def _start(self, bit: int, data: bytes, end: int, low: int) -> int:
        dfa, state, best = self.backward[bit], 0, -1
        for at in range(end - 1, low - 1, -1):
            state = dfa.table[state + data[at]]
            if state >= dfa.accepting:
                best = at
            elif state == dfa.dead:
                break
        return best


# ---------------------------------------------------------------- Spark


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte places as code points."""
    raw = np.frombuffer(data, np.uint8)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(before[a]), bit, int(before[b])) for a, bit, b in spans]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end) in code points, by start and rule."""
    compiled = docs.sparkSession.sparkContext.broadcast(Scanner.of(rules))  # size fixed by the rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kinds = compiled.value, [r.kind for r in rules]
        for batch in batches:
            out = []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = scanner.spans(data)
                out.append([(kinds[bit], a, b) for a, bit, b in _points(data, found)] if found else [])
            flat = [span for spans in out for span in spans]
            values = pa.StructArray.from_arrays(
                [pa.array([s[0] for s in flat], pa.string()), *(pa.array([s[i] for s in flat], pa.int64()) for i in (1, 2))],
                ["kind", "start", "end"],
            )
            offsets = np.cumsum([0, *map(len, out)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "spans"])

    kind = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in BASE]

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
