"""Byte-pair codes, secrets, personal data and decontamination against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import bpe, decontam, pii, secrets, textbuf

ODD = [None, "", " ", "\n\n", "a", "é" * 50, "x" * 200_000, "same text", "same text", "<|endoftext|> it's   here\t漢字 ſ \u0558", "word " * 30_000]


def docs(spark, texts, extra="long"):
    """Texts with ids, and columns whose names clash with what operators add."""
    rows = [(i, t, "keep") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, found string")


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    r = random.Random(2)
    parts = [" ", "  ", "\n", "the", " in", "ation", "é", "漢", "12", "!", "'s", "'ll", "\u3000", "\x1c", "<|endoftext|>", "<|end", "🙂", "zzzz", "aaaaaaa", "\u0558"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)]
    got = {x.doc_id: x for x in bpe.digest(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def merged(spec, rank, word):
    """A word's ids by the merges' definition: the first merge that applies, everywhere from the left, until none does."""
    shown = {b: c for c, b in bpe.byte_alphabet().items()}
    parts = [shown[b] for b in word.encode()]
    while len(parts) > 1:
        best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, 1 << 40))
        if best not in rank:
            break
        out, k = [], 0
        while k < len(parts):
            both = tuple(parts[k : k + 2]) == best
            out.append("".join(best) if both else parts[k])
            k += 1 + both
        parts = out
    return [spec["model"]["vocab"][x] for x in parts]


def test_bpe_equals_the_merges_themselves(monkeypatch):
    import json

    spec = json.loads(open(bpe.default_path()).read())
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(spec["model"]["merges"])}
    a = bpe.Automaton(json.dumps(spec))
    r = random.Random(21)
    parts = ["a", "aa", "e", "the", "tion", "in", " ", "é", "漢", "1", "!", "=", "==", "Ġ", "zz", "ou", "er", "th"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(1500)] + ["a" * 37, "=" * 61, "abab" * 9]
    expected = [merged(spec, rank, w) for w in words]
    assert [a.path(w.encode()) for w in words] == expected
    flat, size = a.paths(*textbuf.different(pa.array([w.encode() for w in words], pa.large_binary()))[:2])
    found = {w: x.tolist() for w, x in zip(dict.fromkeys(words), np.split(flat, np.cumsum(size)[:-1]), strict=True)}
    assert [found[w] for w in words] == expected
    monkeypatch.setattr(bpe, "MOST_SETS", 7)  # the byte table begins anew all the time, also inside words
    monkeypatch.setattr(bpe, "SIDE", 5)
    b = bpe.Automaton(json.dumps(spec))
    assert [b.path(w.encode()) for w in words[:300]] == expected[:300]
    flat, size = b.paths(*textbuf.buffers(pa.array(words[:300], pa.large_string())))
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == expected[:300]


def test_bpe_splits_columns_as_the_pattern_does():
    a = bpe.automaton(open(bpe.default_path()).read())
    r = random.Random(22)
    parts = ["'", "'s", "'ll", "'re", "'l", "'v", " ", "  ", "\n", "\t", "\x85", "\xa0", "a", "é", "Z", "1", "²", "!", "s", "t", "''", "ɏ", "ll", "re"]
    for _ in range(800):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(20)]
        raw, offsets = textbuf.buffers(pa.array(texts, pa.large_string()))
        words = [w for t in texts for w in a.latin_split.findall(t)]
        assert "".join(words) == "".join(texts)
        assert a.word_starts(raw, offsets).tolist() == np.cumsum([0, *(len(w.encode()) for w in words)])[:-1].tolist()


def test_bpe_of_signs_that_are_newer_than_the_vocabulary(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    ends = re.findall(r"(.)(?:-(.))?", bpe.LATER)
    signs = [chr(c) for a, b in ends for c in {ord(a), ord(b or a), (ord(a) + ord(b or a)) // 2}]
    texts = [f"x{s}1 {s}{s}a 2{s} '{s}s" for s in signs] + ["<|endoftext|>a <|endoftext|>", "a'" + "\u0250", "plain text", None]
    monkeypatch.setattr(bpe, "GROUP", 64)
    ids, counts = bpe.automaton(open(bpe.default_path()).read()).encode_all(pa.array(texts))
    at = np.append(0, np.cumsum(counts))
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bpe_decodes_what_it_encodes(spark):
    back = bpe.decode(bpe.encode(docs(spark, ODD), out="ids"), "ids", "back")
    assert all(r.back == (r.text or "") and r.found == "keep" for r in back.collect())
    assert bpe.digest(docs(spark, ODD).limit(0)).count() == 0


def secret_spans(t):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), m.end(), 0) for m in assign.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secrets_equal_the_regexes(spark):
    r = random.Random(3)
    parts = ["token", "secret", "api_key", "PassWord", "ſecret", " ", ":", "=", '"', "abc", "abcdef", "A1+/", "é", "\n", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGH12345678", "漢"]
    texts = ODD + ["a" * 300_000 + " token=abcdef " + "0f" * 40] + ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    got = {x.doc_id: x for x in secrets.digest(docs(spark, texts)).collect()}
    kinds = [k.kind for k in secrets.BASE]
    for i, text in enumerate(texts):
        wanted = secret_spans(text or "")
        line = ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in wanted)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for *_, k in wanted) for n in range(3)]


def test_added_secret_kinds():
    s = secrets.scanner(secrets.BASE + secrets.MORE)
    raw, off = textbuf.buffers(pa.array(["-----BEGIN RSA PRIVATE KEY----- ghp_" + "Z" * 36 + " xoxb-123456789012 é"]))
    assert [k for *_, k in s.spans(raw, off)[0]] == [3, 4, 5]


def test_rules_whose_matches_end_inside_others_are_refused():
    for pattern in ("xay|a", "ab*c|b", "(foo)?bar.baz|bar"):
        assert secrets.ends_inside(secrets.Rule("r", pattern.replace(".", "-")))
        with pytest.raises(ValueError):
            secrets.Scanner((secrets.Rule("r", pattern.replace(".", "-")),))
    assert not any(secrets.ends_inside(r) for r in secrets.BASE + secrets.MORE + (secrets.Rule("r", "a+b"), secrets.Rule("r", "abc|bcd")))


def pii_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_personal_data_keeps_every_base_span(spark):
    r = random.Random(4)
    parts = ["a.b", "joe", "@", "mail.example", "com", ".", "1", "255", "256", "+", "(", ")", " ", "-", "4111111111111111", "4111 1111", "5555", "_", "é", "10.0.0.1", "123-45-6789", "\n"]
    texts = [t for t in ODD if t is None or len(t) < 100_000] + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    got = {x.doc_id: x for x in pii.digest(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        wanted = pii_spans(text or "")
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in wanted)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text


def test_the_field_finds_more_and_masks(spark):
    m = pii.model()
    right = sum(m.spans(t) == sorted(g) for t, g in pii.examples(200, 99))
    assert right >= 180
    out = pii.mask(spark.createDataFrame([(1, "call (212) 555-0187 or a@b.org", 30, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars long, clean string")).orderBy("doc_id").collect()
    assert out[0].text == "call [PHONE] or [EMAIL]" and out[0].n_chars == len(out[0].text) and out[0].clean == "x"
    assert out[1].text is None and out[1].n_chars is None


def segmentations(n, arcs, at=0):
    """Every way through the parts ``at``..n: parts outside, and arcs."""
    if at == n:
        yield []
        return
    for rest in segmentations(n, arcs, at + 1):
        yield rest
    for i, j, kind in arcs:
        if i == at:
            for rest in segmentations(n, arcs, j):
                yield [(i, j, kind), *rest]


def test_the_decoder_finds_the_best_of_all_segmentations():
    m, r, seen = pii.model(), random.Random(31), 0
    shapes = ["212 555 0187", "10.1.2.3", "123-45-6789", "0171 55 12", "4111 1111 1111 1111", "2020-01-02", "1 22 333", "+1 212 555 0187", "(212) 555-0187"]
    for _ in range(150):
        text = r.choice(["call ", "", "page ", "ip "]) + r.choice([" ", "-", "/", ", "]).join(r.choice(shapes) for _ in range(r.randint(1, 2)))
        for start, stop in pii.number_regions(text):
            edges, arcs = pii.segments(text, start, stop)
            n = len(edges) - 1
            fixed = {(edges[i], edges[j], k): 1e6 for i, j, k in arcs if r.random() < 0.05}
            part = [m.score(pii.outside(text[edges[k] : edges[k + 1]])) for k in range(n)]
            own = {a: m.score(pii.features(text, edges[a[0]], edges[a[1]], a[2])) + fixed.get((edges[a[0]], edges[a[1]], a[2]), 0.0) for a in arcs}

            def total(path):
                inside = {k for i, j, _ in path for k in range(i, j)}
                return sum(own[a] for a in path) + sum(part[k] for k in range(n) if k not in inside)

            if len(arcs) > 40:
                continue
            best = max(map(total, segmentations(n, arcs)))
            place = {e: k for k, e in enumerate(edges)}
            assert abs(total([(place[s], place[e], k) for s, e, k in m.decode(text, edges, arcs, fixed)]) - best) < 1e-6 * max(1, abs(best))
            seen += len(arcs) > 1
    assert seen > 50


@pytest.mark.parametrize(
    "text,body,kind",
    [
        ("call Jane at 212 555 0187", "212 555 0187", "phone"),
        ("tel. 0171 555 0123 now", "0171 555 0123", "phone"),
        ("020 7946 0958", "020 7946 0958", "phone"),
        ("write to joe.b (at) mail (dot) org please", "joe.b (at) mail (dot) org", "email"),
        ("joe at example dot com", "joe at example dot com", "email"),
        ("pages 100 200 3000 of", None, None),
        ("see 212 555 0187 there", None, None),
        ("we met at noon dot then", None, None),
        ("in 2020 2021 2022 2023", None, None),
    ],
)
def test_the_field_on_single_lines(text, body, kind):
    found = [(text[s:e], k) for s, e, k in pii.model().spans(text)]
    assert found == ([(body, kind)] if body else [])


def test_precision_and_recall_of_every_kind():
    m = pii.model()
    for kind in pii.KINDS:
        right = wrong = missed = 0
        for text, gold in pii.examples(1200, 99):
            base = set(pii.base_spans(text))
            found = {x for x in m.spans(text) if x[2] == kind and x not in base - set(gold)}
            given = {x for x in gold if x[2] == kind and not any(x != b and x[0] < b[1] and b[0] < x[1] for b in base)}
            right, wrong, missed = right + len(found & given), wrong + len(found - given), missed + len(given - found)
        assert right >= 0.97 * (right + wrong) > 0 and right >= 0.97 * (right + missed)


def test_long_runs_stay_linear():
    m = pii.model()
    for t in ("a" * 300_000 + "@" + "b" * 100, "1" * 100_000, "1 " * 50_000, "+1" + "-" * 100_000, "1." * 50_000, "@" * 100_000, "a (at) " * 30_000, " at " * 50_000 + " dot ", "x at y dot " * 20_000, "(at)" * 50_000):
        m.spans(t)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    windows = {}
    for item, t in items:
        w = words(t)
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(item or "")
    for t in texts:
        w = words(t)
        hit, ids = bytearray(len(w)), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if found := windows.get(tuple(w[p : p + size])):
                    ids |= found
                    hit[p : p + size] = b"\1" * size
        yield len(w), sum(hit), sorted(ids)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["é", "Zz"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [("a", text(25)), ("b", text(12)), ("c", text(3)), ("d", None), ("e", " "), (None, text(14)), ("f", text(10))]
    items += [("g", items[0][1]), ("a", items[1][1])]
    texts = ODD + [text(8) + " " + (r.choice(items)[1] or "") + ". " + text(5) for _ in range(60)] + [text(400)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for bytes_ in (decontam.PIECE_BYTES, 60):  # one piece, then many
        monkeypatch.setattr(decontam, "PIECE_BYTES", bytes_)
        got = {x.doc_id: x for x in decontam.digest(docs(spark, texts), benchmark).collect()}
        for i, (n, hit, ids) in enumerate(brute(texts, items)):
            assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, hit, len(ids))
            assert got[i].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert decontam.decontaminate(docs(spark, texts), benchmark.limit(0)).count() == len(texts)
    assert decontam.decontaminate(docs(spark, texts), benchmark).columns == ["doc_id", "text", "found"]
    clean = {r.doc_id for r in decontam.decontaminate(docs(spark, texts), benchmark).select(F.col("doc_id")).collect()}
    assert clean == {i for i, (_, hit, _) in enumerate(brute(texts, items)) if not hit}


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


def test_decontamination_tells_words_apart_by_their_bytes(spark):
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    got = decontam.digest(docs(spark, [one, two, one + "x", f"x {two} y"]), spark.createDataFrame([("q", one)], "item_id string, text string")).orderBy("doc_id").collect()
    assert [x.contaminated for x in got] == [True, False, False, False]


def test_decontamination_of_repeated_words_is_bounded():
    import resource

    rows = [("long", "z " * 5000), ("short", "z z z"), ("ten", "z " * 10), ("two", "z z y " * 700)]
    texts = ["z " * 200_000, "z z y " * 50_000 + "z " * 9, "y z " * 100]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = decontam.find(pa.array(texts), decontam.TestSet(rows)).to_pylist()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kilobytes
    assert [(f["n_words"], [tuple(h.values()) for h in f["hits"]], sorted(f["item_ids"])) for f in found] == [
        (200_000, [(0, 200_000)], ["long", "short", "ten"]),
        (150_009, [(0, 150_009)], ["short", "two"]),
        (200, [], []),
    ]
    assert found[0]["matches"][:2] == [{"item_id": "long", "item_start": 0, "start": 0, "n_words": 5000}, {"item_id": "short", "item_start": 0, "start": 0, "n_words": 3}]


def test_longest_matches_and_where_they_are():
    rows = [("a", " ".join(f"w{k}" for k in range(30))), ("b", "x " + " ".join(f"w{k}" for k in range(5, 25)) + " y")]
    text = "start " + " ".join(f"w{k}" for k in range(3, 22)) + " cut " + "x " + " ".join(f"w{k}" for k in range(5, 25)) + " end"
    found = decontam.find(pa.array([text, None]), decontam.TestSet(rows)).to_pylist()
    assert [tuple(m.values()) for m in found[0]["matches"]] == [("a", 3, 1, 19), ("b", 0, 21, 21)]
    assert sorted(found[0]["item_ids"]) == ["a", "b"] and found[1] == {"n_words": 0, "hits": [], "item_ids": [], "matches": []}
