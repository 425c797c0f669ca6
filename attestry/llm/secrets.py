"""Secret scans by one combined deterministic automaton over bytes.

Rule regexes become a Thompson automaton, then by subset construction and
minimisation transition arrays of (state, byte class). One pass over the bytes
runs all rules at once and marks where a match may end; it advances many lines
side by side in numpy, since a line feed takes every state back to the start.
Only at marks the start is found with a reversed automaton, and the longest end
with the rule's own automaton.

A rule's matches are leftmost, longest and non-overlapping. Ends are found before
starts, so a rule may not have a whole match of its own inside the part of
another that precedes that one's first possible end; such rules are refused
when they are compiled. Rules may name a check on the matched text (a failing match
is dropped but uses up its text).

Defined results: null and empty texts have no spans; texts of any length are
scanned whole, very long lines too; rules never match across line feeds; letters
are ASCII, and rules that ignore case do so for ASCII only; offsets are code
points, ends exclusive; repeated rows are scanned alike and further columns pass.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import textbuf
from attestry.llm.shared import column, text_map

SPANS = "array<struct<kind:string,start:long,stop:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    #: The matched text must have this many characters in ``group``.
    least: int = 0
    group: int = 0


#: The base kinds, in the order in which they are listed. Runs of 24 hex digits are the runs that would pass a later length check. Elsewhere lengths are checked on the match: counters of overlapping attempts would multiply the states.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Well-known formats of keys and tokens, listed after the base kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=36),
)


class _Nfa:
    """Thompson's construction from the standard library's parse trees."""

    def __init__(self):
        self.jump: list[list[int]] = []
        self.arc: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.jump.append([])
        self.arc.append([])
        return len(self.jump) - 1

    def read(self, tree, at: int, fold: bool, back: bool) -> int:
        """Adds the tree's parts after state ``at`` (``back``: in reversed order); returns the state behind them."""
        for op, arg in reversed(tree) if back else tree:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                to = self.state()
                self.arc[at].append((_bytes_of(op, arg, fold), to))
                at = to
            elif op is C.SUBPATTERN:
                at = self.read(arg[3], at, fold, back)
            elif op is C.BRANCH:
                to = self.state()
                for branch in arg[1]:
                    self.jump[self.read(branch, at, fold, back)].append(to)
                at = to
            elif op is C.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.read(body, at, fold, back)
                if high is C.MAXREPEAT:
                    loop, to = self.state(), self.state()
                    self.jump[at].append(loop)
                    self.jump[self.read(body, loop, fold, back)].append(loop)
                    self.jump[loop].append(to)
                    at = to
                else:
                    to = self.state()
                    for _ in range(high - low):
                        self.jump[at].append(to)
                        at = self.read(body, at, fold, back)
                    self.jump[at].append(to)
                    at = to
            else:
                raise ValueError(f"rules don't support {op}")
        return at


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    if op in (C.LITERAL, C.NOT_LITERAL):
        found, negate = {arg}, op is C.NOT_LITERAL
    else:
        found, negate = set(), False
        for kind, x in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"rules don't support {kind}")
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {ord(c) for b in found for c in (chr(b).lower(), chr(b).upper())}
    return frozenset(set(range(256)) - found - {10} if negate else found)


@dataclass
class Dfa:
    """classes: byte -> class; move: (state, class) -> state, state 0 is the start; accepts: state -> bit set of rules."""

    classes: np.ndarray
    move: np.ndarray
    accepts: np.ndarray

    def __post_init__(self):
        self.rows: list[list[int]] = self.move.tolist()
        self.code: bytes = self.classes.tobytes()
        self.final: list[int] = self.accepts.tolist()
        #: The state that never accepts and never leaves itself, or -1.
        self.dead = next((k for k, row in enumerate(self.rows) if not self.final[k] and set(row) == {k}), -1)

    def longest(self, raw: bytes, at: int, stop: int, step: int = 1) -> int:
        """The last place where an anchored run from ``at`` accepts (going down to ``stop`` where step is -1), or -1."""
        code, rows, final, dead, state, best, k = self.code, self.rows, self.final, self.dead, 0, -1, at
        skip = 0 if step > 0 else -1
        while k != stop:
            state = rows[state][code[raw[k + skip]]]
            if state == dead:
                break
            k += step
            if final[state]:
                best = k
        return best


def compile_rules(rules: tuple[Rule, ...], anywhere: bool, back: bool = False) -> Dfa:
    """Subset construction and minimisation of all rules together. anywhere: a match may begin at any byte."""
    nfa = _Nfa()
    start, final = nfa.state(), {}
    for k, rule in enumerate(rules):
        own = nfa.state()
        nfa.jump[start].append(own)
        final[nfa.read(list(_parser.parse(rule.pattern)), own, rule.ignore_case, back)] = 1 << k

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.jump[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.arc[x] or x in final)

    # Bytes that no arc tells apart share a class.
    sets = sorted({s for arcs in nfa.arc for s, _ in arcs}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]
    first = closed([start])
    index, todo, move = {first: 0}, [first], []
    while todo:
        here = todo.pop(0)
        row = []
        for b in sample:
            to = closed([t for x in here for s, t in nfa.arc[x] if b in s] + ([start] if anywhere else []))
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        move.append(row)
    accepts = np.array([functools.reduce(int.__or__, (final.get(x, 0) for x in s), 0) for s in index], np.int64)
    return _minimal(classes, np.array(move, np.int32), accepts)


def _minimal(classes: np.ndarray, move: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Splits groups of states until all states of a group move alike (Moore)."""
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[move]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    # State 0 stays the start; states that accept come last, so that one comparison finds them.
    size = group.max() + 1
    member = np.zeros(size, np.int64)
    member[group[::-1]] = np.arange(len(group))[::-1]
    order = np.lexsort((np.arange(size), np.arange(size) != group[0], accepts[member] > 0))
    new = np.empty(size, np.int64)
    new[order] = np.arange(size)
    return Dfa(classes, new[group[move[member[order]]]].astype(np.int32), accepts[member[order]])


def ends_inside(rule: Rule, one: Dfa | None = None) -> bool:
    """Whether a match of the rule can end inside another, after that one's start and before its first possible end: a walk over pairs of states, of the match and of all that begin later."""
    one, later = one or compile_rules((rule,), anywhere=False), compile_rules((rule,), anywhere=True)
    bytes_ = np.unique(np.column_stack([one.classes, later.classes]), axis=0)
    live = np.zeros(len(one.move), bool)
    live[one.accepts > 0] = True
    while (grown := live | live[one.move].any(axis=1)).sum() > live.sum():
        live = grown
    todo = list({(int(one.move[0, a]), 0) for a, _ in bytes_})
    seen = set(todo)
    while todo:
        p, q = todo.pop()
        if not live[p] or one.accepts[p]:
            continue
        if later.accepts[q]:
            return True
        for a, b in bytes_:
            step = int(one.move[p, a]), int(later.move[q, b])
            if step not in seen:
                seen.add(step)
                todo.append(step)
    return False


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = compile_rules(rules, anywhere=True)
        self.back = [compile_rules((r,), anywhere=False, back=True) for r in rules]
        self.ahead = [compile_rules((r,), anywhere=False) for r in rules]
        if inside := [r.kind for r, one in zip(rules, self.ahead, strict=True) if ends_inside(r, one)]:
            raise ValueError(f"a match may end inside another: {', '.join(inside)}")
        self.checks = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) if r.least else None for r in rules]
        if (self.all.move[:, self.all.classes[10]] != 0).any():
            raise ValueError("a rule matches across line feeds")
        self.first = int(np.flatnonzero(self.all.accepts)[0])

    def marks(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, bit set of rules) wherever some rule accepts the bytes before the place, in order."""
        lines = np.union1d(offsets, np.flatnonzero(raw == 10) + 1)
        starts, sizes = lines[:-1], np.diff(lines)
        by = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[by], sizes[by]
        code = self.all.classes[raw]
        move, width = self.all.move.ravel(), self.all.move.shape[1]
        state = np.zeros(len(starts), np.int32)
        places, states = [], []
        active, k = len(starts), 0
        while True:
            active = int(np.searchsorted(-sizes[:active], -k, "left"))
            if active < 64:
                break
            state = move[state[:active] * width + code[starts[:active] + k]]
            hit = np.flatnonzero(state >= self.first)
            if len(hit):
                places.append(starts[hit] + k + 1)
                states.append(state[hit])
            k += 1
        # The few longest lines go on one by one.
        rows = self.all.rows
        for line in range(active):
            s, at, end = int(state[line]), int(starts[line]) + k, int(starts[line] + sizes[line])
            own, known = [], []
            for lo in range(at, end, textbuf.PIECE):
                for p, c in enumerate(code[lo : min(end, lo + textbuf.PIECE)].tobytes(), lo + 1):
                    s = rows[s][c]
                    if s >= self.first:
                        own.append(p)
                        known.append(s)
            places.append(np.array(own, np.int64))
            states.append(np.array(known, np.int32))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, found = np.concatenate(places), np.concatenate(states)
        by = np.argsort(place, kind="stable")
        return place[by], self.all.accepts[found[by]]

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, stop, rule) in code points for each text, by start, then rule."""
        place, bits = self.marks(raw, offsets)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        doc = np.searchsorted(offsets, place, "left") - 1
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=len(offsets)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d = int(doc[a])
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            text = raw[lo:hi].tobytes()
            found = []
            for k in range(len(self.rules)):
                ends = place[a:b][(bits[a:b] >> k & 1) > 0] - lo
                found += [(s, e, k) for s, e in self._resolve(text, ends.tolist(), k)]
            if found:
                wide = np.concatenate(([0], np.cumsum((raw[lo:hi] & 0xC0) != 0x80)))
                out[d] = sorted((int(wide[s]), int(wide[e]), k) for s, e, k in found)
                out[d].sort(key=lambda x: (x[0], x[2]))
        return out

    def _resolve(self, text: bytes, ends: list[int], k: int):
        used = 0
        for e in ends:
            if e <= used:
                continue
            s = self.back[k].longest(text, e, used, -1)
            if s < 0:
                continue
            stop = self.ahead[k].longest(text, s, len(text))
            used = stop
            check, rule = self.checks[k], self.rules[k]
            if check is None or len(check.fullmatch(text[s:stop].decode())[rule.group]) >= rule.least:
                yield s, stop


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(df: DataFrame, text: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Adds ``out``: every span (kind, start, stop) of the whole text, by start, then kind as listed."""
    held = df.sparkSession.sparkContext.broadcast(scanner(rules))  # a few MB, whatever the data

    def make():
        s = held.value

        def apply(batch: pa.Array) -> pa.Array:
            raw, offsets = textbuf.buffers(batch)
            rows = []
            for i, j in textbuf.doc_groups(offsets):
                rows += [[{"kind": rules[k].kind, "start": a, "stop": b} for a, b, k in found] for found in s.spans(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            return pa.array(rows, SPAN_TYPE)

        return apply

    return df.withColumn(out, text_map(make, SPANS)(column(text)))


def joined(spans):
    """kind:start:stop, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found, s = scan(docs.select("doc_id", "text")), F.col("secrets")
    base = F.filter(s, lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count_kind(s, r.kind) for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))
