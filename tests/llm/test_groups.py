"""Near-duplicates, embeddings, URLs, chats, classifiers and the pipeline against brute force, with odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from attestry.llm import chat, embeddings, graph, labelled, quality, simhash, textbuf, toxicity, urls


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("few", [graph.FEW, 0])
def test_components_of_paths_and_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 160)}, 200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w)] if w and len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(spark, texts):
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.digest(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()}
    prints = [fingerprint(t) for t in texts]
    root = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == root


def test_simhash_equals_brute_force(spark, monkeypatch):
    r = random.Random(1)
    base = [f"w{r.randint(0, 9999)}" for _ in range(2000)]
    near = []
    for _ in range(120):
        w = list(base)
        w[r.randint(0, 1999)] = "other"
        near.append(" ".join(w))
    texts = [None, "", "  \n", "One", "one", "a b", "a b c", "A  B\tC", "x\u00a0y", "z " * 5000] + near + [" ".join(f"v{r.randint(0, 99)}" for _ in range(r.randint(1, 12))) for _ in range(60)]
    check_simhash(spark, texts)
    monkeypatch.setattr(graph, "PIECE", 16)  # near copies overflow their buckets
    check_simhash(spark, texts)


def test_keep_one_of_equal_and_near_texts(spark):
    r = random.Random(2)
    base = [f"w{r.randint(0, 9999)}" for _ in range(300)]
    near = " ".join(base[:-1] + ["changed"])
    other = [" ".join(f"u{r.randint(0, 99999)}" for _ in range(80)) for _ in range(20)]
    rows = [(5, " ".join(base), "a"), (3, near, "b"), (3, near, "c"), (9, None, "d"), (8, "", "e"), (None, "lonely words here", "f")] + [(20 + i, t, "g") for i, t in enumerate(other)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, place string").coalesce(1)).collect()
    ids = sorted((x.doc_id is None, x.doc_id or 0) for x in kept)
    assert ids == [(False, 3), (False, 8)] + [(False, 20 + i) for i in range(20)] + [(True, 0)]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((80, 16))
    near = v[0] + 0.15 * rng.standard_normal((60, 16))
    rows = [*v, *near, v[1], v[1], 2 * v[2]]
    data = [(i, [float(x) for x in np.float32(r)], 0) for i, r in enumerate(rows)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    u = np.array([d[1] for d in data])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    root = union(len(u), zip(*np.nonzero(linked), strict=True))
    for piece in (1024, 8):
        monkeypatch.setattr(graph, "PIECE", piece)
        got = {r.vec_id: r for r in embeddings.digest(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, n_links int")).collect()}
        assert sum(got[i].n_links for i in range(len(u))) >= 0.9 * (linked.sum() - len(u))
        assert all(got[i].n_links <= linked[i].sum() - 1 for i in range(len(u)))
        assert [got[i].component_id for i in range(len(u))] == root
        assert [(got[k].n_links, got[k].component_id, got[k].kept) for k in (900, 901, 902, 903, 904)] == [(0, k, True) for k in (900, 901, 902, 903, 904)]
        assert (got[905].n_links, got[906].component_id) == (1, 905)
    assert embeddings.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_urls_against_brute_force(spark):
    r = random.Random(4)
    hosts = ["com", "example.com", "WWW.example.com", "a.b.net", "net", "fooexample.com", "x..com", ""]
    given = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/es/a', '/fr/?q', '?/en/', '#x'])}" for _ in range(200)] + [None, "none", "a://b://c.com/x"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(given)], "page_id long, url string, verdict string")
    rules = [*urls.RULES, ("com", "/", "block"), ("net", None, "block"), (None, "/", "block")]
    got = {x.page_id: x for x in urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    own = {}
    for h, p, v in rules:
        if h is not None:
            own[h, p or ""] = max(v, own.get((h, p or ""), ""))
    for i, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in own.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict_, got[i].verdict) == (host, path, best[2], best[3], "mine")
    assert urls.digest(pages.limit(0)).count() == 0


def test_urls_with_very_long_hosts(spark):
    hosts = ["a." * 20_000 + "example.com", "x" * 1_000_000 + ".net", "b." * 500_000 + "org", "www.example.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/en/{'p' * 1000}") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {x.page_id: x for x in urls.digest(pages).collect()}
    assert [(got[i].host == h, got[i].rule, got[i].verdict) for i, h in enumerate(hosts)] == [(True, "example.com/en/", "block"), (True, None, "allow"), (True, None, "allow"), (True, "www.example.com/en/", "allow")]


def test_embeddings_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, [1.0, 0.0, 0.0])]
    for kind in ("float", "double"):
        got = sorted(map(repr, map(tuple, embeddings.digest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect())))
        expected = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, True), (None, 0, None, True), (5, 0, 5, True), (6, 0, 6, True)]
        assert got == sorted(map(repr, expected))


def test_embedding_recall_on_many_vectors(spark):
    rng = np.random.default_rng(23)
    centres = rng.standard_normal((700, 32))
    v = np.float32(np.concatenate([centres, centres[rng.integers(0, 700, 2300)] + 0.2 * rng.standard_normal((2300, 32)), centres[:1] + 0.1 * rng.standard_normal((900, 32))]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = {x.vec_id: x.n_links for x in embeddings.digest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()}
    counts = np.array([found[i] for i in range(len(v))])
    assert (counts <= links).all() and counts.sum() >= 0.99 * links.sum() > 100_000


CHAT = [(1, 0, "user", "Hello there.\nHow are you today?\n\nSecond   paragraph here."), (1, 1, "assistant", "I am fine."), (1, 2, "user", "> how are  you today?\nYes!\n"), (1, 3, "assistant", ">> How are you today?\n> Yes!\nGood reply"), (1, 4, "user", ">I am fine.\nok"), (2, None, "x", None), (None, 0, None, "> nope\n"), (2, 0, "a", ">>> a\n> b\nc"), (2, 5, "a", "")]


def test_chat_links_and_order(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    got = {(r.conv, r.place): r for r in chat.messages_in_order(df).collect()}
    assert [(got[1, k].turn, got[1, k].parent, got[1, k].root) for k in range(5)] == [(0, None, 0), (2, 0, 0), (3, 2, 0), (1, None, 1), (4, 1, 1)]
    assert [got[1, k].body for k in (1, 2, 4)] == ["Yes!", "Good reply", "ok"]
    assert got[None, 0].role == "unknown" and got[2, 0].turn is None and got[2, 1].body == "c"
    out = chat.formatted(df).collect()
    assert sum(r.n_messages for r in out) == len(CHAT)
    assert not any(">" in line[:1] for r in out for line in r.chat.split("\n"))
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_blocks_and_long_chains(spark):
    rows = [(7, k, "u", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.messages_in_order(df).collect(), key=lambda r: r.place)
    assert [r.turn for r in got] == list(range(100)) and {r.root for r in got} == {0}
    assert sorted(r.n_messages for r in chat.formatted(df).collect()) == [4, 32, 32, 32]


def positive(scores):
    """What toxicity.segments takes."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(np.array(scores) > 0)
    return at.tolist(), total[at].tolist(), total[at + 1].tolist()


def best_segments(scores, at=0):
    """Maximal scoring segments by definition: the best one, then the best ones on either side of it."""
    found = [(sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best = max(found, default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    return best_segments(scores[:i], at) + [(at + i, at + j)] + best_segments(scores[j:], at + j)


def test_segments_are_maximal():
    assert toxicity.segments([], [], []) == []
    r = random.Random(13)
    for n in [*range(1, 12), 20, 30]:
        for _ in range(60):
            scores = [r.choice([-1, 1, 1]) * r.random() if r.random() < 0.7 else -0.05 * r.random() for _ in range(n)]
            found = toxicity.segments(*positive(scores))
            assert [x[:2] for x in found] == best_segments(scores)
            assert all(abs(sum(scores[s:e]) - x) < 1e-9 for s, e, x in found)


def test_segments_take_linear_time():
    import time

    def took(scores):
        given = positive(scores)
        began = time.process_time()
        toxicity.segments(*given)
        return time.process_time() - began

    r = random.Random(14)
    for make in (lambda n: [5.0] + [-0.01, 0.005] * n, lambda n: [-0.01, 0.005] * n, lambda n: [0.005, -0.01] * n + [1e6], lambda n: [r.random() - 0.5 for _ in range(2 * n)]):
        assert took(make(200_000)) < 3


def test_toxicity_scores_equal_plain_python(spark):
    r = random.Random(15)
    words = ["alpha", "beta", "gamma", "zork", "zonked", "zonking", "zonker", "zilch", "Δοκ"]
    text = lambda bad: " ".join(r.choice(words if bad else words[:3]) + r.choice([".", "", "!"]) for _ in range(r.randint(1, 60)))
    docs = spark.createDataFrame([(i, text(i % 4 == 0)) for i in range(200)], "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    table = dict(zip(m.token.tolist(), m.score.tolist(), strict=True))
    hashed = lambda w, more=0: int(textbuf.mix(np.array([(sum((b + 1) * pow(textbuf.BASE, k, 1 << 64) for k, b in enumerate(w)) + more) % (1 << 64)], np.uint64))[0])
    texts = [text(True) for _ in range(50)] + ["", "zonkest zonk zo", "beta " * 3000 + "zork zork"]
    import pyarrow as pa

    for t, (n, found) in zip(texts, m.found(pa.array(texts, pa.large_string())), strict=True):
        tokens = [w.encode().lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        scores = [table.get(hashed(w), table.get(hashed(w[:4], 1) if len(w) >= 4 else 0, labelled.grid(toxicity.DRIFT))) for w in tokens]
        assert n == len(tokens)
        if n < 100:
            assert sorted(x[:2] for x in found) == best_segments([float(x) for x in scores])
        total = sum(x for *_, x in found)
        best = max((x for *_, x in found), default=0)
        surprise = [min(-np.log(max(-np.expm1(-min(50, m.scale * n * np.exp(-m.decay * x))), 1e-12)), 99) for *_, x in found]
        strong = [x for x in surprise if x >= -np.log(0.05)]
        z = np.dot(m.weights, [max(surprise, default=0), np.log1p(sum(strong)), np.log1p(len(strong)), np.log1p(total), 1])
        assert abs(m.probability(n, found) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9 and best <= total + 1e-9


def hash64(body, more=0):
    """textbuf's hash of bytes, in plain integers."""
    h = (sum((b + 1) * pow(textbuf.BASE, k, 1 << 64) for k, b in enumerate(body)) + more) % (1 << 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ h >> shift) * factor % (1 << 64)
    return h


def test_quality_scores_equal_plain_python():
    import pyarrow as pa

    r = random.Random(16)
    m = quality.Model(labelled.grid(np.random.default_rng(1).standard_normal(1 << quality.BITS)), 0.25)
    parts = ["the", "tion", "Ünï", "漢字", "x", "!!", "a|b", "🙂", "same same", "same"]
    texts = [None, "", " \n", "a", "é é é", "w" * 3000, "word word " * 400] + [r.choice([" ", "\t", "\n "]).join(r.choice(parts) + r.choice(["", "."]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    found = m.scores(pa.array(texts, pa.large_string()))
    for t, z in zip(texts, found, strict=True):
        words = re.findall(r"[^\x00-\x20\x7f]+", t or "")
        names = []
        for w in words:
            marked = "\2" + w + "\3"
            names += [hash64(w.encode())] + [hash64(marked[k : k + g].encode(), g) for g in quality.GRAMS for k in range(len(marked) - g + 1)]
        buckets = [h >> (64 - quality.BITS) for h in names] + [quality.AGAIN for a, b in zip(words, words[1:], strict=False) if a == b]
        mean = sum(m.bucket[b] for b in buckets) / max(1, len(buckets))
        assert abs(z - 1 / (1 + np.exp(-np.clip(mean + 0.25, -30, 30)))) < 1e-12
        ids, share = quality.bag(t or "")
        counted = {b: buckets.count(b) / max(1, len(buckets)) for b in set(buckets)}
        assert {int(i): pytest.approx(float(x), abs=1e-6) for i, x in zip(ids, share, strict=True) if x} == counted


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_do_not_depend_on_partitions(spark, module, label):
    r = random.Random(17)
    text = lambda k: " ".join(r.choice(["alpha", "beta", "gamma"] + ["zork", "zilch"] * (k % 3 == 0)) for _ in range(r.randint(1, 50)))
    rows = [(i % 290, text(i)) for i in range(300)]  # some ids have two texts
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], f"doc_id long, {label} int")
    scores = []
    try:
        for partitions, order in ((4, 1), (7, -1)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(partitions)
            m = module.train(docs, labels)
            scores.append(sorted((x.text, repr(x.s if label == "quality" else x.s.score)) for x in module.score(docs, m, out="s").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(40))
    bad = lambda: good() + " " + " ".join(r.choice(["zork", "zonk", "zilch"]) for _ in range(6))
    rows = [(i, bad() if i % 3 == 0 else good(), "s") for i in range(400)] + [(400, None, "s"), (401, "", "s"), (402, "beta " * 50_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = [(i, (i % 3 == 0) == (label == "toxic")) for i in range(400)] + [(1, None), (None, True)]
    labels = spark.createDataFrame([(i, None if m is None else int(m)) for i, m in marks], f"doc_id long, {label} int")
    got = {x.doc_id: x for x in module.digest(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == int((i % 3 == 0) == (label == "toxic")) for i in held) >= 0.95 * len(held) > 0
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= (0.5 if label == "toxic" else 0.3)) for x in got.values())
    for few in (labels.limit(0), labels.filter(f"{label} = 1")):
        assert module.digest(docs, few).count() == len(rows)
    assert module.digest(docs.limit(0), labels).count() == 0


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    text = lambda n=60: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n)) + "."
    item = text(20)
    clean = [text() for _ in range(60)]
    junk = ["!! ".join(text().upper().split()) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean + junk)]
    rows += [(200, clean[0]), (201, clean[1] + " more"), (202, text() + " " + item), (203, text() + " write to joe@mail.example.org now")]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "pii", "bpe"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in out) == [*range(60), 203]
    masked = corpus_pipeline.mask_personal_data(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert masked.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert "joe@" not in masked.filter("doc_id = 203").first().text


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w)} if 0 < len(w) <= 5 else {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def survivors(texts):
    """The least index of every exact component at 0.8."""
    sets = [shingles(t) for t in texts]
    near = lambda a, b: a == b or len(a & b) * 5 >= len(a | b) * 4
    root = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near(sets[i], sets[j])])
    return sorted(set(root))


def kept_ids(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(x.doc_id for x in simhash.keep_one(rows).collect())


def tail_changed(r, base, same):
    """A text of as many words whose first ``same`` words are the base's."""
    return " ".join(base[:same] + [f"x{r.randint(0, 10**9)}" for _ in range(len(base) - same)])


def test_keep_one_keeps_pairs_below_the_similarity(spark, monkeypatch):
    r = random.Random(9)
    texts = []
    for _ in range(60):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(204)]
        texts += [" ".join(base), tail_changed(r, base, 178)]  # 174 of 200 shingles shared: 0.770
    assert kept_ids(spark, texts) == survivors(texts) == list(range(120))
    base = [f"w{r.randint(0, 10**6)}" for _ in range(204)]
    group = [tail_changed(r, base, 200) for _ in range(60)] + texts[:20]
    monkeypatch.setattr(graph, "PIECE", 16)  # the group overflows its bucket
    assert kept_ids(spark, group) == survivors(group) == [0, *range(60, 80)]


def test_keep_one_finds_every_pair_at_the_similarity(spark):
    r = random.Random(10)
    texts = []
    for n, same in ((8, 8), (9, 9), (10, 10), (19, 16), (104, 93), (204, 183), (504, 450)):
        for _ in range(40):
            base = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
            texts += [" ".join(base), " ".join(base) + " more" if same == n else tail_changed(r, base, same)]
    for k in range(20):
        line = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(12)) + " "
        rest = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(104))
        texts += [line * 2 + rest, line * (10 + 10 * k) + rest]
    assert kept_ids(spark, texts) == survivors(texts)


def test_keep_one_with_a_frequent_line(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    r = random.Random(11)
    line = " ".join(f"l{k}" for k in range(20))
    texts = []
    for _ in range(60):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([6, 30, 120]))]
        texts += [line + " " + " ".join(base), line + " " + tail_changed(r, base, len(base) - r.randint(0, 12) % len(base))]
    assert 60 <= len(survivors(texts)) < 120
    assert kept_ids(spark, texts) == survivors(texts)


def test_pipeline_returns_documents_and_ids(spark, tmp_path):
    import hashlib

    import corpus_pipeline
    from attestry.llm import bpe

    rows = [(1, "Hello there, tokens.", "en", "s", 20), (1, "Grüße an alle \U0001f600", "de", "t", 15), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.encode_tokens(spark, docs, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = out.collect()
    assert sorted(map(repr, (tuple(x)[:5] for x in got))) == sorted(map(repr, rows))
    vocabulary = bpe.automaton(open(bpe.default_path()).read())
    for x in got:
        assert vocabulary.decode(bytes(x.ids)) == (x.text or "") and x.n_tokens == len(x.ids) // 4
        assert x.ids_sha256 == hashlib.sha256(x.ids).hexdigest() and x.decoded_sha256 == hashlib.sha256((x.text or "").encode()).hexdigest()
    assert bpe.encoded(docs.withColumnRenamed("lang", "ids")).columns[-4:] == ["ids_", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import hashlib
    import re

    import corpus_pipeline
    from attestry.llm import bpe

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    r = random.Random(12)
    words = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    changed = lambda base, same: base[:same] + [f"w{r.randint(10_000, 10**6)}" for _ in range(len(base) - same)]
    good = [words(60) for _ in range(60)]
    junk = [[x.upper() + "!!" for x in words(60)] for _ in range(40)]
    item, line = words(20), words(12)
    for same in (158, 171, 183, 186):  # 0.61, 0.72, 0.81 and 0.83 of 200 shingles
        for _ in range(8):
            base = words(204)
            good += [base, changed(base, same)]
    for n in (8, 9, 10):
        for _ in range(8):
            base = words(n)
            good += [base, base + words(1)]
    rest = words(104)
    good += [line * 2 + rest, line * 40 + rest, words(40) + item[:10] + words(20), words(40) + item[:9] + words(20), words(50) + ["joe@mail.example.org"] + words(9)]
    texts = [" ".join(x) for x in good]
    bad = [" ".join(x) for x in junk]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts + bad)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i in range(len(docs))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", " ".join(item))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    windows = {tuple(item[k : k + 10]) for k in range(11)}
    expected = []
    for i in survivors(texts):
        if any(tuple(good[i][k : k + 10]) in windows for k in range(len(good[i]) - 9)):
            continue
        text = re.sub(r"[\w.]+@[\w.]+", "[EMAIL]", texts[i])
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        expected.append((i, text, "en", f"s{i % 3}", len(text), ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = sorted((x.doc_id, x.text, x.lang, x.source, x.n_chars, bytes(x.ids), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [x[0] for x in got] == [x[0] for x in expected]
    assert got == expected


ODD_TEXTS = [None, "", " ", "\n\n", "é" * 50, "x" * 100_000, "same text of more than five words", "same text of more than five words", "word " * 20_000]


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None if i % 2 else "en", "s", None if t is None else len(t)) for i, t in enumerate(ODD_TEXTS)] + [(None, "a text without an id is kept as well", None, None, None), (3, "an id that is given twice has two texts", "en", "s", 39)]
    empty = [("documents", kinds), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")]
    for name, given in (("odd", rows), ("none", [])):
        for table, kind in empty:
            spark.createDataFrame(given if table == "documents" else [], kind).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # Without labels the classifier rejects nothing; texts without shingles are copies of one another.
    assert sorted((x.text or "") for x in out) == sorted(["", *{t for t in ODD_TEXTS if t and t.strip()}, "a text without an id is kept as well", "an id that is given twice has two texts"])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    clash = spark.createDataFrame([(1, "some words that nobody else has said", 7, 8, 9, "k")], "doc_id long, text string, place long, found long, score long, `a.b` string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, f"{tmp_path}/odd").collect() == clash.collect()


def test_only_a_local_master_gets_a_temporary_checkpoint_folder(monkeypatch):
    from types import SimpleNamespace

    from attestry.llm import shared

    set_to = []
    empty = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    make = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, _jsc=empty, setCheckpointDir=set_to.append))
    shared.ensure_checkpoint_dir(make("local[4]"))
    assert len(set_to) == 1
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.ensure_checkpoint_dir(make(master))
