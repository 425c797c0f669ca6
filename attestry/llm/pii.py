"""Personal data by a semi-Markov conditional random field.

Candidate segments are scored as whole spans (shape, digit count, checksum,
surroundings, cue words before them): runs of digits and the signs between them
where a region holds at least seven digits, of at most 19 digits in six runs;
account numbers; and addresses with ``@`` or with ``at`` and ``dot`` written
out. A segment holds at most ``MOST_PARTS`` parts; what these bounds leave out
the model doesn't propose, while base spans may have any length. Dynamic programming over a region of text
chooses boundaries and types together, and every stretch outside entities costs
what its parts cost. The weights are the maximum-likelihood fit, by gradient
ascent on the exact lattice, to sentences that are generated here from a fixed
seed: spans of each type in several notations, and numbers that are no personal
data (dates, versions, sums, times, counts, and prose with ``at`` and ``dot``).

Segments of the base patterns below are candidates too, of any length, and carry
a potential that no path without them reaches; where two base segments of
different kinds overlap, a path holds one only, and the rest is decoded in a
further run. So base spans always stay and the model adds spans beside them.

Defined results: null and empty texts have no spans; whole texts are searched;
offsets are code points, ends exclusive; repeated rows give equal spans; further
columns pass through untouched.
"""

from __future__ import annotations

import functools
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.secrets import count_kind, joined
from attestry.llm.shared import column, free_name, text_map

#: ``base`` marks spans of the base patterns; the model proposes spans of all kinds.
SPANS = "array<struct<kind:string,start:long,stop:long,base:boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
#: In the order in which they are listed; the base kinds come first.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE_KINDS = KINDS[:4]
#: Parts (runs of letters, runs of digits, single signs) in a segment that the model proposes.
MOST_PARTS = 18

#: The base patterns. Possessive runs and the lookbehind change no match; they keep long runs linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Where the model looks: runs of signs that occur in numbers and addresses, with a digit or an ``@`` in them.
_REGION = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,8}(?: ?[A-Z0-9]{1,3})?|[+(]*[0-9][0-9 ().+/:,-]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,8}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Where an address may be that isn't written with an ``@``: what stands for it, and what stands around it.
_HINTS = (" dot ", "(dot", "[dot", "{dot", "(at", "[at", "{at")
_AT = re.compile(r" ?[\[({] ?[aA][tT] ?[\])}] ?| [aA][tT] |@")
_NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?[dD][oO][tT] ?[\])}] ?| [dD][oO][tT] |\.)[A-Za-z0-9-]{2,63}){1,4}")
#: Frequent last labels of hosts.
ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu ch at us example".split())
_PART = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_CUE = re.compile(r"[A-Za-z]+")
#: Words that announce a type when they stand just before it.
CUES = {"mail": "email", "email": "email", "write": "email", "contact": "email", "reach": "email", "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "cell": "phone", "ssn": "ssn", "social": "ssn", "security": "ssn", "card": "card", "visa": "card", "iban": "iban", "account": "iban", "ip": "ip", "host": "ip", "version": "other", "date": "other", "total": "other", "page": "other", "pages": "other", "order": "other", "year": "other"}


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that pass its check."""
    out = []
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            used = found.end()
        at = text.find("@", max(at + 1, used))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def hidden(text: str) -> list[tuple[int, int]]:
    """Where an address with ``at`` and ``dot`` written out may stand."""
    low = text.lower()
    if not any(x in low for x in _HINTS):
        return []
    out, used = [], 0
    for m in _AT.finditer(text):
        name = _NAME.search(text, max(used, m.start() - 64), m.start())
        host = _HOST.match(text, m.end()) if name else None
        if host and (m[0] != "@" or not _DOMAIN.fullmatch(host[0])) and (m[0].strip().lower() != "at" or " " in host[0] or any(c in host[0] for c in "[({")):
            out.append((name.start(), host.end()))
            used = host.end()
    return out


def features(text: str, start: int, stop: int, kind: str) -> list[str]:
    """Whole-span features of a segment of one type."""
    body = text[start:stop]
    if kind == "email":
        words = _CUE.findall(text[max(0, start - 24) : start])
        sign = next((x for x in "@([{" if x in body), "word")
        last = re.split(r"[^A-Za-z0-9-]+", body)[-1]
        dots = "plain" if re.search(r"[A-Za-z0-9]\.[A-Za-z0-9-]+$", body) else "bracket" if body.count(")") + body.count("]") + body.count("}") > 1 else "word"
        found = ["bias", f"sign {sign}", f"dots {dots}", f"end {last.lower() in ENDINGS}", f"cue {next((CUES[w.lower()] for w in reversed(words[-3:]) if w.lower() in CUES), 'none')}", f"name {any(c in '._0123456789' for c in re.split(r'[ @([{]', body)[0])}"]
        return [f"email {x}" for x in found]
    digits = "".join(c for c in body if "0" <= c <= "9")
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 9)}", body))
    words = _CUE.findall(text[max(0, start - 24) : start])
    cue = next((CUES[w.lower()] for w in reversed(words[-3:]) if w.lower() in CUES), "none")
    before = text[start - 1 : start]
    after = text[stop : stop + 1]
    edge = lambda c: "digit" if c.isdigit() else "letter" if c.isalpha() else "sign" if c and not c.isspace() and c not in ",;)" else "free"
    found = ["bias", f"n{len(digits)}", f"shape {shape if len(shape) < 24 else 'long'}", f"cue {cue}", f"before {edge(before)}", f"after {edge(after)}"]
    if 12 <= len(digits) <= 19:
        found.append(f"luhn {luhn(digits)}")
    if body[0] in "+(":
        found.append("opens " + body[0])
    elif kind == "phone" and not body.strip("0123456789 "):
        found.append(f"spaced {digits[0] == '0'} {cue}")
    return [f"{kind} {x}" for x in found]


def segments(text: str, start: int, stop: int) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Part boundaries of a region, and the candidates (first part, last part + 1, type): at most MOST_PARTS parts and six runs of digits."""
    parts = _PART.findall(text, start, stop)
    edges = [start]
    for p in parts:
        edges.append(edges[-1] + len(p))
    out, n = [], len(parts)
    for i, first in enumerate(parts):
        if edges[i] and text[edges[i] - 1].isalnum():
            continue
        if not i and (text[start:stop].find("@") > 0 or first[0].isalpha() and hidden(text[start:stop]) == [(0, stop - start)]):
            if n <= MOST_PARTS:
                out.append((0, n, "email"))
            continue
        if len(first) == 2 and first.isupper() and i + 1 < n and len(parts[i + 1]) >= 2:
            m = _IBAN.match(text, edges[i], stop)
            if m and m.end() in (found := set(edges[i : i + MOST_PARTS + 1])):
                out.append((i, i + 1 + sum(e < m.end() for e in found if e > edges[i]), "iban"))
            continue
        if not (first[0] in "+(" or "0" <= first[0] <= "9"):
            continue
        digits = groups = dots = 0
        for j in range(i, min(n, i + MOST_PARTS)):
            part = parts[j]
            if not "0" <= part[0] <= "9":
                if part not in " ().+-":
                    break
                dots += part == "."
                continue
            digits += len(part)
            groups += 1
            if digits > 19 or groups > 6:
                break
            if text[edges[j + 1] : edges[j + 1] + 1].isalnum():
                continue
            if 9 <= digits <= 15 or digits == 7:
                out.append((i, j + 1, "phone"))
            if digits == 9 and [len(x) for x in parts[i : j + 1]] == [3, 1, 2, 1, 4]:
                out.append((i, j + 1, "ssn"))
            if digits >= 12:
                out.append((i, j + 1, "card"))
            if dots == 3 and groups == 4 and j == i + 6:
                out.append((i, j + 1, "ip"))
    return edges, out


def number_regions(text: str) -> list[tuple[int, int]]:
    """Where the model looks for numbers."""
    return [(m.start(), m.start() + len(m[0].rstrip(" ().+/:,-"))) for m in _REGION.finditer(text) if sum(map(str.isdigit, m[0])) >= 7]


def outside(part: str) -> list[str]:
    """Features of a part that is in no entity."""
    return [f"out d{min(len(part), 9)}" if part.isdigit() else "out a" if part.isalpha() else "out s"]


class Model:
    """Weights by feature name; absent features weigh nothing."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, names: list[str]) -> float:
        w = self.weights
        return sum(w.get(x, 0.0) for x in names)

    def decode(self, text: str, edges: list[int], found: list[tuple[int, int, str]], fixed: dict[tuple[int, int, str], float]) -> list[tuple[int, int, str]]:
        """The best segmentation of a region: (start, stop, type) of its entities."""
        n = len(edges) - 1
        ending: dict[int, list[tuple[int, str, float]]] = {}
        for i, j, kind in found:
            bonus = fixed.get((edges[i], edges[j], kind), 0.0)
            ending.setdefault(j, []).append((i, kind, self.score(features(text, edges[i], edges[j], kind)) + bonus))
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1] + self.score(outside(text[edges[j - 1] : edges[j]])), (j - 1, None)
            for i, kind, score in ending.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind)
        out, j = [], n
        while j:
            i, kind = back[j]
            if kind:
                out.append((edges[i], edges[j], kind))
            j = i
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All base spans, and what the model adds beside them, by start, then kind as listed."""
        base = base_spans(text)
        masked = hidden(text)
        if not base and not masked and not any(c in text for c in "0123456789"):
            return []
        order = {k: n for n, k in enumerate(KINDS)}
        kept: list[tuple[int, int, str]] = []
        left, at = sorted(base), 0
        regions = _joined(number_regions(text) + masked + [x[:2] for x in base])
        for start, stop in regions:
            first = at
            while at < len(left) and left[at][0] < stop:
                at += 1
            inside = left[first:at]
            edges, found = segments(text, start, stop)
            while True:
                all_edges = sorted({*edges, *(p for x in inside for p in x[:2])}) if inside else edges
                if inside:
                    place = {p: k for k, p in enumerate(all_edges)}
                    free = [(place[edges[i]], place[edges[j]], k) for i, j, k in found]
                    arcs = list(dict.fromkeys([*free, *((place[s], place[e], k) for s, e, k in inside)]))
                else:
                    arcs = found
                chosen = self.decode(text, all_edges, arcs, dict.fromkeys(inside, 1e6))
                kept += chosen
                taken = set(chosen)
                inside = [x for x in inside if x not in taken]
                if not inside:
                    break
                edges, found = [start, stop], []  # what is left overlaps what was chosen: base segments alone
        # What the model proposes must not overlap a base span that a further run added.
        own, cover, k = set(base), _joined([x[:2] for x in base]), 0
        out = []
        for x in sorted(set(kept), key=lambda x: (x[0], order[x[2]], x[1])):
            while k < len(cover) and cover[k][1] <= x[0]:
                k += 1
            if x in own or k == len(cover) or cover[k][0] >= x[1]:
                out.append(x)
        return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, overlapping ones united."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def examples(n: int = 1500, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with their entities."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdeghilmnorstuv") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = r.choice("3456") + num(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return r.choice([body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        if r.random() < 0.5:
            return foreign()
        # National numbers in groups: with a zero before them, or announced.
        led = r.random() < 0.5
        body = r.choice([f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(4)} {num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"]) if led else f"{r.randint(2, 9)}{num(2)} {num(3)} {num(4)}"
        if not led or r.random() < 0.5:
            body = "\0" + body
        return body

    def email() -> str:
        at, dot = r.choice([("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", ".")])
        return r.choice([word(), word() + "." + word(), word() + str(r.randint(1, 99))]) + at + word() + dot + r.choice(["com", "org", "net", "de", "example"])

    foreign = lambda: r.choice([
        f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])
    own = {
        "email": email,
        "phone": phone,
        "card": card,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "iban": lambda: r.choice(["DE", "FR", "ES", "GB"]) + num(2) + " " + " ".join(num(4) for _ in range(r.randint(3, 5))),
    }
    none = [
        lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: num(r.randint(1, 14)), lambda: f"{num(3)},{num(3)},{num(3)}", lambda: f"{num(4)}-{num(4)}",
        lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: " ".join(num(r.randint(1, 4)) for _ in range(r.randint(2, 7))), lambda: f"{num(r.randint(4, 6))}.{num(r.randint(3, 7))}", lambda: f"{num(3)} {num(3)} {num(4)}", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{num(3)} {num(2)} {num(4)}", lambda: f"{r.randint(2, 9)}{num(2)} {num(3)} {num(4)}",
        lambda: f"{r.randint(1, 9)}{num(3)} {num(3)} {num(3)}", lambda: f"met {word()} at {word()} dot {word()} there", lambda: f"{word()} (at {word()}) dot", lambda: f"{word()} at {word()} dot dot {word()}",
    ]
    cues = [c for c, k in CUES.items() if k == "other"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 4))) + " "
            if r.random() < 0.5:
                kind = r.choice(list(own))
                body = own[kind]()
                announced, body = body.startswith("\0"), body.removeprefix("\0")
                if announced or r.random() < 0.4:
                    text += r.choice([c for c, k in CUES.items() if k == kind] or [word()]) + r.choice([" ", ": ", ". ", f" {word()} at ", f" {word()} "] if announced else [" ", ": "])
                spans.append((len(text), len(text) + len(body), kind))
            else:
                text += r.choice([*cues, word()]) + " "
                body = r.choice(none)()
            text += body + r.choice([" ", ", ", ". ", "; "]) + word() + " "
        out.append((text, spans))
    return out


def fit(sentences: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Weights by stochastic gradient ascent on the log-likelihood of the true segmentations (forward and backward sums over the lattice)."""
    lattices = []
    for text, gold in sentences:
        for start, stop in _joined(number_regions(text) + hidden(text) + [x[:2] for x in base_spans(text) if x[2] == "email"]):
            edges, found = segments(text, start, stop)
            if not found:
                continue
            place = {p: k for k, p in enumerate(edges)}
            true = {(place[s], place[e], k) for s, e, k in gold if s in place and e in place} & set(found)
            arcs = [(i, j, features(text, edges[i], edges[j], k), (i, j, k) in true) for i, j, k in found]
            inside = {p for i, j, _ in true for p in range(i, j)}
            arcs += [(i, i + 1, outside(text[edges[i] : edges[i + 1]]), i not in inside) for i in range(len(edges) - 1)]
            lattices.append((len(edges) - 1, arcs))
    weights: dict[str, float] = {}
    r = random.Random(1)
    for _ in range(rounds):
        r.shuffle(lattices)
        for n, arcs in lattices:
            score = [sum(weights.get(x, 0.0) for x in f) for _, _, f, _ in arcs]
            ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            by_stop = sorted(range(len(arcs)), key=lambda a: arcs[a][1])
            for a in by_stop:
                i, j = arcs[a][:2]
                ahead[j] = _add(ahead[j], ahead[i] + score[a])
            for a in sorted(range(len(arcs)), key=lambda a: -arcs[a][0]):
                i, j = arcs[a][:2]
                behind[i] = _add(behind[i], behind[j] + score[a])
            for a, (i, j, names, true) in enumerate(arcs):
                step = rate * (true - math.exp(ahead[i] + score[a] + behind[j] - ahead[n]))
                if abs(step) > 1e-6:
                    for x in names:
                        weights[x] = weights.get(x, 0.0) * (1 - decay) + step
    return Model(weights)


def _add(a: float, b: float) -> float:
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


@functools.lru_cache(maxsize=1)
def model() -> Model:
    return fit(examples())


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: every span (kind, start, stop, base) of the whole text."""
    held = df.sparkSession.sparkContext.broadcast(model())  # a few thousand weights

    def make():
        m = held.value

        def one(text: str) -> list[dict]:
            found = m.spans(text)
            own = set(base_spans(text)) if found else ()
            return [{"kind": k, "start": s, "stop": e, "base": (s, e, k) in own} for s, e, k in found]

        return lambda batch: pa.array([one(t.as_py()) for t in batch], SPAN_TYPE)

    return df.withColumn(out, text_map(make, SPANS)(column(text)))


def mask(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with each span of the text (overlapping ones united) replaced by its first kind in brackets; ``length``, where present, counts the new text. Null texts stay null."""
    held = df.sparkSession.sparkContext.broadcast(model())

    def make():
        m = held.value

        def clean(t: str) -> str:
            out, at, end = [], 0, 0
            for s, e, kind in m.spans(t):
                if s >= end:
                    out += (t[at:s], f"[{kind.upper()}]")
                end = at = max(end, e)
            return "".join((*out, t[at:])) if out else t

        return lambda batch: pa.array([clean(t.as_py()) for t in batch], pa.string())

    name = free_name(df, "clean")
    body = F.when(column(text).isNull(), F.lit(None).cast("string")).otherwise(column(name))
    marked = df.withColumn(name, text_map(make, "string")(column(text)))
    given = dict(df.dtypes)
    kept = [body.alias(c) if c == text else F.coalesce(F.length(body).cast(given[c]), column(c)).alias(c) if c == length else column(c) for c in df.columns]
    return marked.select(*kept)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns; counts and digest are those of the base spans."""
    found, s = find(docs.select("doc_id", "text")), F.col("pii")
    base = F.filter(s, lambda x: x["base"])
    return found.select("doc_id", "pii", base.alias("base")).select(
        "doc_id", *[count_kind(F.col("base"), k) for k in BASE_KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans")
    )
