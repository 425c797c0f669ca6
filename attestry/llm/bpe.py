"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads token arcs. It starts as one state with a loop for each
byte; every merge (a, b) -> ab then applies one gadget: the target of a's arcs
is copied without its arc b, a's arcs go to the copy, and wherever an arc a
stood before which b could follow, an arc ab is added that leads where a then b
led. In the result, the state after an arc depends on that arc only, and a
sequence of tokens is a path if and only if it is what the merges make of its
bytes. Written out, the states would hold a row of 50,000 arcs for each token,
so rows are shared: a state has the arcs that it lost, each with the time, and
beyond them the row of the state that it was copied from, as it was at that
time.

Encoding is deterministic over bytes. Every prefix of a word has exactly one
path, so what can follow depends on the pairs (state, label begun) that are open
behind it. Such a set of pairs is a state of the byte table; its row says for
each byte the next set and the arc that ends there. Rows are made from the
automaton when they are first asked for. A pre-split word is one run through the
table, a step a byte, and its arcs are read off from the end. The different
words of a batch are run side by side. Decoding concatenates arc labels.

Defined results: null and empty texts have no tokens and decode to the empty
text; texts of any length are encoded whole;
repeated rows are encoded alike; no result depends on what the table holds; other columns pass through untouched, and the
added column gets underscores appended where its name is taken.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from attestry.llm import textbuf
from attestry.llm.shared import column, free_name, ship, text_map

#: Fixed value: Unicode's white space, as the pre-splitter of byte-level vocabularies takes it.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Letters and digits of Unicode 17; the pre-splitter's tables are older and take them for other signs.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def split_pattern(letter: str, digit: str, other: str) -> str:
    """Fixed value: the pre-splitting pattern of this family of vocabularies, over classes of signs."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def latin_class(kind: str) -> str:
    """The signs below U+0250 whose general category begins so, for a class of the standard library's regexes."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: Bytes of text that are split at a time, and words that run through the byte table side by side.
GROUP, SIDE = 2 << 20, 1 << 14
#: A longer word runs alone.
LONG = 64
#: Sets and entries at which a worker's byte table begins anew; results don't depend on it.
MOST_SETS, MOST_STEPS = 200_000, 1 << 19
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table:
    """Numbers by number, with open addressing in two arrays, so that whole columns are looked up at a time."""

    def __init__(self, most: int):
        self.size = 1 << (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (textbuf.mix(keys.astype(np.uint64)) & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        out, at, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slots(keys)
        while len(at):
            held = self.keys[slot]
            hit = held == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            at, slot = at[on], (slot[on] + 1) & (self.size - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that aren't held, each once; doubles the arrays where they are half full."""
        if 2 * (self.n + len(keys)) > self.size:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.size *= 2
            self.clear()
        self.n += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys for a slot the last one wins
            won = free & (self.keys[slot] == keys)
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & (self.size - 1)


class Automaton:
    """States are named by the arc that leads to them; -1 is where words begin."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, back = spec["model"], byte_alphabet()
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.arc = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.label: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for s, i in self.arc.items():
            self.label[i] = s
        for s, i in self.special.items():
            self.label[i] = s.encode()
        self.born, self.copied, self.head = ([-1] * len(self.label) for _ in range(3))
        self.lost: dict[int, int] = {}
        for time, pair in enumerate(model["merges"]):
            a, b = (as_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self._gadget(time, self.arc[a], self.arc[b], self.arc[a + b])
        # The labels as a tree: the child of a node by a byte, and the arc that a node completes.
        child: dict[int, int] = {}
        done = [-1]
        for s, i in self.arc.items():
            node = 0
            for byte in s:
                node = child.setdefault(node << 8 | byte, len(done))
                if node == len(done):
                    done.append(-1)
            done[node] = i
        inner = [False] * len(done)
        for key in child:
            inner[key >> 8] = True
        # By node << 8 | byte what a pair needs of the child: its number (0 where no label goes on) << 32 | 1 + the arc that it completes.
        self.next = {key: (node if inner[node] else 0) << 32 | done[node] + 1 for key, node in child.items()}
        self.known: dict[int, bool] = {}
        self.sets: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.table = _Table(1 << 16)
        self._set([0])
        self.later = regex.compile(f"[{LATER}]")
        # Texts of signs below U+0250 take the standard library's engine, four times as fast with the same classes.
        letter, digit, space = latin_class("L"), latin_class("N"), r"\t-\r\x20\x85\xa0"
        self.beyond = re.compile("[\u0250-\U0010ffff]")
        self.latin_split = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.plain_split = regex.compile(split_pattern(r"\p{L}", r"\p{N}", rf"[^{_SPACE}\p{{L}}\p{{N}}]"))
        self.exact_split = regex.compile(split_pattern(rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]", rf"[[^{_SPACE}\p{{L}}\p{{N}}]||[{LATER}]]"), regex.V1)
        self.kinds = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3 if re.match(f"[{space}]", chr(c)) else 0) for c in range(0x250)], np.uint8)
        self.label_bytes, self.label_size = np.frombuffer(b"".join(self.label), np.uint8), np.array([len(x) for x in self.label])
        self.mark_bytes = [x.encode() for x in self.special]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _gadget(self, time: int, a: int, b: int, ab: int) -> None:
        """One merge: the state after a loses arc b, arc ab appears where a stood, and its state begins as a copy of the state after b."""
        self.born[ab], self.head[ab], self.copied[ab] = time, a, b
        self.lost[a << 32 | b] = time

    def lost_at(self, state: int, arc: int) -> int:
        """When the state's row lost the arc: itself, or before the copy the state that it was copied from."""
        until = NEVER
        while state >= 0:
            time = self.lost.get(state << 32 | arc, NEVER)
            if time < until:
                return time
            until, state = self.born[state], self.copied[state]
        return NEVER

    def has(self, state: int, arc: int) -> bool:
        """Whether the state has the arc: it got it if it had the arc's head when the arc was born, and it must not have lost it."""
        if self.lost_at(state, arc) < NEVER:
            return False
        while self.head[arc] >= 0:
            # An arc aa is born when the state after a loses a; that state doesn't get it.
            if self.lost_at(state, self.head[arc]) <= self.born[arc]:
                return False
            arc = self.head[arc]
        return True

    def _set(self, pairs: list[int]) -> int:
        """The number of a set of open pairs, each (state + 1) << 32 | node."""
        held = array("q", pairs).tobytes()
        k = self.number.setdefault(held, len(self.sets))
        if k == len(self.sets):
            self.sets.append(held)
        return k

    def _row(self, key: int) -> int:
        """The table's entry for set << 8 | byte: next set << 32 | arc that ends with the byte."""
        byte, next_, known = key & 255, self.next, self.known
        after, ended = [], -1
        for pair in memoryview(self.sets[key >> 8]).cast("q"):
            found = next_.get((pair & 0xFFFFFFFF) << 8 | byte)
            if found is None:
                continue
            if found >> 32:
                after.append(pair >> 32 << 32 | found >> 32)
            if ended < 0 and (arc := (found & 0xFFFFFFFF) - 1) >= 0:
                has = known.get(at := pair >> 32 << 32 | arc)
                if has is None:
                    has = known[at] = self.has((pair >> 32) - 1, arc)
                if has:
                    ended = arc
        after.append((ended + 1) << 32)
        return self._set(after) << 32 | ended

    def _steps(self, keys: np.ndarray) -> np.ndarray:
        """The table's entries; those that it doesn't hold are made."""
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            wanted, which = np.unique(keys[new], return_inverse=True)
            made = np.array([self._row(k) for k in wanted.tolist()], np.int64)
            self.table.add(wanted, made)
            found[new] = made[which]
        return found

    def _fresh(self) -> None:
        if len(self.sets) > MOST_SETS or self.table.n > MOST_STEPS:
            for full in (self.table, self.number, self.sets, self.known):
                full.clear()
            self._set([0])

    def path(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells ``word``."""
        at, ends = 0, []
        for byte in word:
            if len(self.sets) > 2 * MOST_SETS + 1:
                pairs = memoryview(self.sets[at]).cast("q").tolist()
                self._fresh()
                at = self._set(pairs)
            step = int(self._steps(np.array([at << 8 | byte]))[0])
            at = step >> 32
            ends.append(step & 0xFFFFFFFF)
        out, k = [], len(word)
        while k:
            out.append(ends[k - 1])
            k -= len(self.label[out[-1]])
        return out[::-1]

    def paths(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the arcs of all words one after another, the number of each word's arcs): the words run side by side, a byte of each at a time."""
        size = np.diff(offsets)
        counts, rows, places, arcs = np.zeros(len(size), np.int64), [], [], []
        by = np.argsort(-size, kind="stable")
        for k in by[: np.count_nonzero(size > LONG)].tolist():
            self._fresh()
            found = self.path(body[offsets[k] : offsets[k + 1]].tobytes())
            rows.append(np.full(len(found), k))
            places.append(np.arange(-len(found), 0))
            arcs.append(np.array(found, np.int64))
        by = by[np.count_nonzero(size > LONG) :]
        for lo in range(0, len(by), SIDE):
            self._fresh()
            mine = by[lo : lo + SIDE]
            first, n = offsets[mine], size[mine]
            ends = np.zeros((int(n[0]), len(mine)), np.int32)
            at, active = np.zeros(len(mine), np.int64), len(mine)
            for k in range(int(n[0])):
                active = int(np.searchsorted(-n[:active], -k, "left"))
                step = self._steps(at[:active] << 8 | body[first[:active] + k])
                at, ends[k, :active] = step >> 32, step & 0xFFFFFFFF
            # From the end, an arc of every word at a time.
            left, open_, turn = n.copy(), np.flatnonzero(n), 0
            while len(open_):
                arc = ends[left[open_] - 1, open_]
                rows.append(mine[open_])
                places.append(np.full(len(open_), -turn))
                arcs.append(arc.astype(np.int64))
                left[open_] -= self.label_size[arc]
                open_, turn = open_[left[open_] > 0], turn + 1
        row, place, arc = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, places, arcs))
        return arc[np.lexsort((place, row))].astype("<u4"), np.bincount(row, minlength=len(size))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.marks is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += (self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join((*out, self._plain(text[at:] if at else text)))

    def _plain(self, text: str) -> bytes:
        return self._words(pa.array([w.encode() for w in self.pieces(text)], pa.large_binary()))[0].tobytes()

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the words one after another, where each word's end); each different word is run once."""
        body, edges, which = textbuf.different(words)
        flat, size = self.paths(body, edges)
        return gathered(flat, size, which)

    def pieces(self, text: str) -> list[str]:
        """The pre-split words; together they are the text."""
        if not self.beyond.search(text):
            return self.latin_split.findall(text)
        split = self.exact_split if self.later.search(text) else self.plain_split
        return split.findall(text)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, as text; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def word_starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-split words of texts of signs below U+0250 begin, as ``latin_split`` splits them, for a whole column at a time."""
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        n = len(at)
        sign = raw[at].astype(np.uint16)
        two = np.flatnonzero(sign >= 0x80)
        sign[two] = (sign[two] & 0x1F) << 6 | raw[at[two] + 1] & 0x3F
        kind = self.kinds[sign]
        new = np.zeros(n + 1, bool)  # where texts begin, and the end
        new[np.searchsorted(at, offsets)] = True
        start = new.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # The last blank before another sign of the text is a word of its own, or, if it is a space, the beginning of the next.
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~new[1:n])
        start[last] = True
        start[last + 1] = sign[last] != 0x20
        # An apostrophe that begins a word takes the endings of contractions, and what follows them begins another.
        mark = np.flatnonzero(start[:n] & (sign == 0x27))
        mark = mark[mark + 1 < n]
        mark = mark[~new[mark + 1]]
        one = sign[mark + 1]
        other = np.where((mark + 2 < n) & ~new[(mark + 2).clip(max=n)], sign[(mark + 2).clip(max=n - 1)], 0)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long_ = ((one == 0x72) | (one == 0x76)) & (other == 0x65) | (one == 0x6C) & (other == 0x6C)
        start[mark[short | long_] + 1] = False
        start[mark[long_] + 2] = False
        start[mark[short] + 2] = True
        start[mark[long_] + 3] = True
        return at[np.flatnonzero(start[:n])]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, the number of each text's ids)."""
        raw, offsets = textbuf.buffers(texts)
        ids, counts = [], []
        for i, j in textbuf.doc_groups(offsets, GROUP):
            part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            # Texts with other signs or with marks of the vocabulary go one by one.
            beyond = np.flatnonzero((part >= 0xCA) | (part == 0xC9) & (np.append(part[1:], 0) >= 0x90))
            odd = np.unique(np.searchsorted(off, beyond, "right") - 1).tolist()
            if any(m in (body := part.tobytes()) for m in self.mark_bytes):
                odd = sorted({*odd, *(k for k in range(j - i) if any(m in body[off[k] : off[k + 1]] for m in self.mark_bytes))})
            at = 0
            for k in [*odd, j - i]:
                if at < k:
                    found, n = self._plain_all(part[off[at] : off[k]], off[at : k + 1] - off[at])
                    ids.append(found)
                    counts.append(n)
                if k < j - i:
                    one = np.frombuffer(self.encode(part[off[k] : off[k + 1]].tobytes().decode()), "<u4")
                    ids.append(one)
                    counts.append(np.array([len(one)]))
                at = k + 1
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _plain_all(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        begin = self.word_starts(raw, offsets)
        ids, total = self._words(pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw))), pa.py_buffer(raw)]))
        return ids, np.diff(np.append(0, total)[np.searchsorted(begin, offsets)])

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all texts one after another, where each begins): the labels of the arcs."""
        offsets, parts, sizes = np.append(0, np.cumsum(counts)), [], [np.zeros(1, np.int64)]
        for i, j in textbuf.doc_groups(offsets, GROUP // 4):
            part, total = gathered(self.label_bytes, self.label_size, ids[offsets[i] : offsets[j]])
            parts.append(part)
            sizes.append(sizes[-1][-1] + np.append(0, total)[offsets[i + 1 : j + 1] - offsets[i]])
        return np.concatenate([np.zeros(0, np.uint8), *parts]), np.concatenate(sizes)


def gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the rows ``which`` of a list of rows that lie one after another in ``flat``, where each ends in the result)."""
    first = np.cumsum(size) - size
    n = size[which]
    total = np.cumsum(n)
    return flat[np.repeat(first[which] - (total - n), n) + np.arange(total[-1] if len(total) else 0)], total


@functools.lru_cache(maxsize=2)
def automaton(text: str) -> Automaton:
    return Automaton(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spec(df: DataFrame, path: str | None):
    """The vocabulary file, read by the driver and broadcast: a file of a few MB, whatever the data."""
    return df.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text())


def id_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary for each text: its ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((4 * np.append(0, np.cumsum(counts))).astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Adds the binary column ``out``: the ids of the whole text as little-endian unsigned 32-bit integers."""
    spec = _spec(df, path)

    def make():
        a = automaton(spec.value)
        return lambda batch: id_column(*a.encode_all(batch))

    return df.withColumn(out, text_map(make, "binary")(column(text)))


def round_trip(df: DataFrame, text: str = "text", out: str = "bpe", path: str | None = None) -> DataFrame:
    """Adds the struct column ``out``: ``ids`` (binary, as by ``encode``), ``n_tokens`` and ``decoded``, the text made of the ids alone."""
    spec = _spec(df, path)

    def make():
        a = automaton(spec.value)

        def apply(batch: pa.Array) -> pa.Array:
            ids, counts = a.encode_all(batch)
            body, at = a.decode_all(ids, counts)
            if np.array_equal(body, textbuf.buffers(batch)[0]):  # so it is text
                decoded = pa.Array.from_buffers(pa.string(), len(batch), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])
            else:
                decoded = pa.array([body[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)], pa.string())
            return pa.StructArray.from_arrays([id_column(ids, counts), pa.array(counts, pa.int64()), decoded], ["ids", "n_tokens", "decoded"])

        return apply

    return df.withColumn(out, text_map(make, "struct<ids:binary,n_tokens:long,decoded:string>")(column(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text of a binary column of ids; null and empty ids give the empty text."""
    spec = _spec(df, path)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(spec.value)
        for batch in batches:
            yield pa.array((a.decode(x.as_py() or b"") for x in batch), pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, arrow_udf(run, "string")(column(ids)))


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The documents' columns as given, with ``ids`` (binary, as by ``encode``), ``n_tokens`` and the digests of ids and decoded text."""
    name = free_name(docs, "bpe")
    coded = round_trip(docs, text, name, path)
    part = lambda field: column(name)[field]
    added = {"ids": part("ids"), "n_tokens": part("n_tokens"), "ids_sha256": F.sha2(part("ids"), 256), "decoded_sha256": F.sha2(part("decoded").cast("binary"), 256)}
    return coded.select(*[column(c) for c in docs.columns], *[x.alias(free_name(docs, c)) for c, x in added.items()])


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's columns: ids and decoded text of every document as digests."""
    coded = round_trip(docs.select("doc_id", "text"), path=path)
    return coded.select("doc_id", F.col("bpe.n_tokens").alias("n_tokens"), F.sha2(F.col("bpe.ids"), 256).alias("ids_sha256"), F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))
