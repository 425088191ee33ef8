"""Trained operators, scans and searches against brute force, and on awkward texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetledger.llm import backoff_lm, inner_topk, language_id, license_scan, quality, url_filter
from sheetledger.llm.queries import PHRASES, RULES, TEMPLATES

from .conftest import CLASHES, HARD

ENGLISH = ["the house of the river and the garden with the old tree", "this is what they thought of that other thing", "where the three brothers went that night"]
GERMAN = ["der hund und die katze sind nicht zusammen in dem haus", "ich weiß nicht was sich gehört und was nicht", "schöne grüße aus der alten stadt am fluss"]


def test_language_id(spark, documents):
    train = documents(ENGLISH * 3 + GERMAN * 3 + [None, "x"], langs=["en"] * 9 + ["de"] * 9 + ["en", None])
    trees = language_id.train(train)
    texts = [*HARD, "the other river", "nicht der alte hund", "١٢٣", "½ 12", "é"]
    for df in (documents(texts), documents(texts, extra=True).repartition(3)):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, trees).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            lettered = any(c.isalpha() for c in t or "")
            assert got[i][0] in (("en", "de") if lettered else ("und",)) and 0 <= got[i][1] <= 1
        assert got[len(HARD)][0] == "en" and got[len(HARD) + 1][0] == "de"
    assert language_id.predict(documents([]), trees).count() == 0
    nothing = language_id.train(documents([None, "a"], langs=["en", None]))
    assert [r["lang_pred"] for r in language_id.predict(documents(["abc"]), nothing).collect()] == ["und"]
    kept = language_id.passing(documents(texts, extra=True), trees)
    assert set(CLASHES) < set(kept.columns) and {r["doc_id"] for r in kept.collect()} <= {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}


def ppm(train, text, languages):
    """Code lengths by the definition: a context's own bytes share what its escape leaves, all others share the escape
    as the next shorter context deals it out among them."""
    out = []
    for lang in languages:
        seen = {}
        for t, known in train:
            if known == lang:
                b = b"\n\n\n" + t.encode()
                for i in range(3, len(b)):
                    for k in range(4):
                        seen.setdefault(b[i - k:i], Counter())[b[i]] += 1

        def dist(context):
            shorter = dist(context[1:]) if context else dict.fromkeys(range(256), 1 / 256)
            has = seen.get(context)
            if not has:
                return shorter
            whole = sum(has.values()) + len(has)
            left = sum(v for s, v in shorter.items() if s not in has)
            return {s: has[s] / whole if s in has else len(has) / whole * shorter[s] / left for s in range(256)}

        b = b"\n\n\n" + text.encode()
        out.append(-sum(math.log2(dist(b[i - 3:i])[b[i]]) for i in range(3, len(b))))
    return out


def test_code_lengths_are_exact(spark, documents):
    rows_ = [(t, "en") for t in ENGLISH] + [(t, "de") for t in GERMAN]
    trees = language_id.train(documents([t for t, _ in rows_], langs=[x for _, x in rows_]))
    for text in ("the hund", "a", "zzz é", "the river and nicht"):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        got = language_id.code_lengths(trees, data, np.array([0, len(data)]))[0]
        assert got == pytest.approx(ppm(rows_, text, ["de", "en"]), rel=1e-4)


def test_quality(spark, documents):
    good = [" ".join(ENGLISH[(i + j) % 3] for j in range(5)) for i in range(30)]
    bad = ["BUY!! NOW!! CHEAP!! " * 5, "same same same same same same " * 4, "a | b | c | d | e | " * 5] * 10
    docs = documents(good + bad)
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(999, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, epochs=20)
    texts = [*HARD, good[0] + " and more of it", "WIN!! BIG!! NOW!! " * 4]
    for df in (documents(texts), documents(texts, extra=True).repartition(3)):
        got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
        assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
        assert got[0] == got[1] == got[2] and got[3] == got[4]
        assert got[len(HARD)] > 0.5 > got[len(HARD) + 1]
    assert quality.score(documents([]), model).count() == 0
    assert {r["score"] for r in quality.score(documents(texts), quality.train(docs, labels.limit(0))).collect()} == {0.5}
    kept = quality.passing(documents(texts, extra=True), model, 0.5)
    assert set(CLASHES) < set(kept.columns) and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_features_do_not_depend_on_neighbours():
    texts = [(t or "").encode() for t in HARD if len(t or "") < 1000]
    edges = np.cumsum([0, *map(len, texts)])
    owner, found = quality.features(np.frombuffer(b"".join(texts), dtype=np.uint8), edges, 1 << 12)
    for i, t in enumerate(texts):
        _, alone = quality.features(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]), 1 << 12)
        assert sorted(found[owner == i]) == sorted(alone)
        words = t.split()
        assert (alone == (1 << 12) - 1).sum() == sum(x == y for x, y in zip(words, words[1:]))


def brute_scan(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    cut = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, starts, base, more, best = re.findall(cut, t), [], set(), set(), 0.0
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [k for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    stride = max(len(words_.split()) for words_, _ in TEMPLATES)
    for start in range(0, len(words), stride):
        have = set(words[start:start + 2 * stride])
        for words_, label in TEMPLATES:
            share = len(have & set(words_.split())) / len(set(words_.split()))
            if share >= 0.8:
                more.add(label)
                best = max(best, share)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if starts else best)


def test_license_scan(documents):
    texts = [*HARD, "Released under the MIT License.", "x under\nthe mit, license under the MIT license", "cc by nc cc-by-NC 4.0", "This work is licensed under GNU general public license, version 3",
             "licensed under the Apache software License Version 2.0", "under the \u212aMIT license", "\u0130 UNDER THE MIT LICENSE", "public license version 3 gnu general work is", "APACHE LICENSE VERSION 2" * 2,
             "This work is licensed under the GNU General\nPublic License, version 3", "Licensed under the\nApache software License,\nVersion 2.0", "some other words " * 9 + "licensed under CC\n\nBY the NC 4.0"]
    for df in (documents(texts), documents(texts, extra=True).repartition(3)):
        got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(df, PHRASES, TEMPLATES).collect()}
        assert got == {i: brute_scan(t) for i, t in enumerate(texts)}
        assert [got[len(texts) - 3 + i][5] for i in range(3)] == ["gpl-3", "apache-2", "cc-by-nc"]
    assert license_scan.scan(documents([]), PHRASES, TEMPLATES).count() == 0
    assert [r["labels"] for r in license_scan.scan(documents(["a b a b a"]), [("a b a", "x")], []).collect()] == ["x"]


def brute_url(url):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fit, key=len) if fit else None


def test_url_filter(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/", "http://example.com", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/ES/1",
            "ftp://net/fr/", "http://a://b.net/fr/", "http://Ünï.net?/fr/", "http://casino-bets.example.org/en/1", "http://library.example.org/en/1", "http://x.org/" + "y" * 50_000, "a\nb://c.com/z", "https://h.com#/p"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in CLASHES])
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES, model).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule = brute_url(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (dict(RULES)[rule] if rule else "block" if got[i]["score"] >= 0.5 else "allow")
    assert got[13]["verdict"] == "block" and got[14]["verdict"] == "allow"
    assert url_filter.judge(df.limit(0), RULES, model).count() == 0


def brute_lm(train, texts):
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    c = Counter(w for t in train for w in tok(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tok(t)), sum(c[w] > 0 for w in tok(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t))) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bound", [{}, {"words": 4}])
def test_backoff_lm_base_and_bounds(documents, bound):
    train = [*ENGLISH * 2, *HARD]
    texts = [*HARD, "the river zebra zebra", *ENGLISH]
    model = backoff_lm.train(documents(train, extra=True), **bound)
    got = {r["doc_id"]: r for r in backoff_lm.score(documents(texts, extra=True).repartition(3), model).collect()}
    for i, (n, known, base) in brute_lm(train, texts).items():
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known) and got[i]["base_score"] == pytest.approx(base)
    assert all(r["score"] < 0 for r in got.values())
    assert backoff_lm.score(documents([]), model).count() == 0
    empty = backoff_lm.score(documents(["a"]), backoff_lm.train(documents([]), **bound)).collect()[0]
    assert (empty["n_known"], empty["n_tokens"], empty["base_score"]) == (0, 2, 0.0)


def test_backoff_lm_probabilities_add_up(documents):
    """After any words, the next word's probabilities over all words, the end and one unknown word make one."""
    train = ENGLISH * 4 + ["the river", "the garden"]
    model = backoff_lm.train(documents(train))
    known = sorted({w for t in train for w in t.split()})
    befores = ([], ["the"], ["the", "river"], ["zebra"], ["of", "the"])
    texts = [" ".join([*before, w]).strip() for before in befores for w in [*known, "unseen"]] + [" ".join(before) for before in befores]
    runs = backoff_lm.segments(documents(texts), "text", "doc_id").withColumn("shard", F.lit(0))
    machine = backoff_lm.automaton(backoff_lm.slices(runs, model).toArrow())
    number = lambda words: machine.numbers(backoff_lm._hashed([w.encode() for w in words]))
    for before in befores:
        state = machine.after(number([" "]))
        for w in number(before):
            state, _ = machine.step(state, w)
        assert sum(10 ** machine.step(state, w)[1] for w in number([*known, "", "unseen"])) == pytest.approx(1.0, abs=1e-9)


def brute_backoff(train, texts, discount=0.75):
    tok = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b""]
    one, two, three, next_one, next_two = Counter(), Counter(), Counter(), {}, {}
    for t in train:
        w = [b" ", *tok(t)]
        one.update(w[1:])
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    for (b, c), n in two.items():
        next_one.setdefault(b, {})[c] = n
    for (a, b, c), n in three.items():
        next_two.setdefault((a, b), {})[c] = n
    scale = sum(one.values()) + 0.5 * (len(one) + 1)
    p1 = lambda c: (one[c] + 0.5) / scale

    def after(seen, c, lower):
        if not seen:
            return lower(c)
        total = sum(seen.values())
        if c in seen:
            return (seen[c] - discount) / total
        return max(1e-12, discount * len(seen) / total) / max(1e-12, 1 - sum(map(lower, seen))) * lower(c)

    def p2(b, c):
        return after(next_one.get(b), c, p1)

    out = {}
    for i, t in enumerate(texts):
        w = [b" ", *tok(t)]
        out[i] = sum(math.log10(after(next_two.get((w[k - 2], w[k - 1])) if k > 1 else None, w[k], lambda c: p2(w[k - 1], c))) for k in range(1, len(w)))
    return out


def test_backoff_lm_scores_by_every_ngram(documents):
    """More words than any shortlist had, most n-grams once, and phrases of rare words repeated."""
    filler = [" ".join(f"f{(i * 37 + j * 101) % 5000}" for j in range(300)) for i in range(60)]
    train = [*filler, *filler[:20], "rareone raretwo rarethree rarefour"] + ["oncea onceb oncec", None, "", "X y Z"] * 2
    texts = ["rareone raretwo rarethree rarefour", "raretwo rarethree zebra rarefour", "onceb oncec oncea onceb", "zebra zebra", None, "x Y z", *filler[:3], "f1 f102 rareone raretwo"]
    for bound, cuts in (({}, {}), ({"words": 4}, {"size": 7, "shard": 100})):  # one shard; short segments in many shards
        model = backoff_lm.train(documents(train, extra=True).repartition(3), **bound)
        got = {r["doc_id"]: r["score"] for r in backoff_lm.score(documents(texts, extra=True).repartition(3), model, **cuts).collect()}
        assert got == pytest.approx(brute_backoff(train, texts), abs=1e-6)


def brute_top(vectors, k, scale):
    ints = {i: np.floor(scale * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in vectors.items()
            if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ints:
        if q % 20 == 0:
            order = sorted(((-int(ints[q] @ ints[i]), i) for i in ints if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    return sorted(out)


def test_inner_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = {i: [float(np.float32(x)) for x in rng.normal(size=8) * rng.exponential()] for i in range(700)}
    for i in range(100, 140):
        vectors[i] = vectors[60]  # ties and repeated vectors
    vectors |= {900: None, 901: [None] * 8, 902: [float("nan")] * 8, 903: [float("inf")] + [0.0] * 7, 920: [0.0] * 8, 940: []}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in CLASHES])
    for sizes in ({}, {"block": 7, "tile": 50, "lanes": 2, "lead": 3}):
        got = sorted(map(tuple, inner_topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, **sizes).collect()))
        assert got == brute_top(vectors, 20, 64.0)
    few = df.where("vec_id < 4")
    assert sorted(map(tuple, inner_topk.top_k(few, F.col("vec_id") % 20 == 0).collect())) == brute_top({i: vectors[i] for i in range(4)}, 20, 64.0)
    assert inner_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_of_large_components_are_exact(spark):
    rng = np.random.default_rng(9)
    vectors = {i: [float(x) for x in rng.integers(-16_000_000, 16_000_000, 8)] for i in range(60)} | {60: [3e7] + [1.0] * 7, 61: [2.0 ** 20] * 8}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int").repartition(3)
    for scale in (1.0, 64.0):
        whole = {i: [math.floor(scale * x) for x in v] for i, v in vectors.items()}
        wanted = []
        for q in range(0, 62, 20):
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:20]
            wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
        got = inner_topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, scale=scale, block=2, tile=9)
        assert sorted(map(tuple, got.collect())) == sorted(wanted)
    x, q = np.array([[1 << 40, -5], [7, 1 << 33]], dtype=np.int64), np.array([(1 << 22) + 1, 3], dtype=np.int64)
    assert inner_topk.exact_scores(x, q).tolist() == [(1 << 40) * ((1 << 22) + 1) - 15, 7 * ((1 << 22) + 1) + 3 * (1 << 33)]
    with pytest.raises(ValueError):
        inner_topk.exact_scores(np.array([[1 << 40]]), np.array([1 << 40]))
    with pytest.raises(Exception, match="too large"):
        inner_topk.top_k(df.limit(1).withColumn("embedding", F.array(F.lit(1e300))), F.lit(True)).collect()
    with pytest.raises(ValueError):
        inner_topk.top_k(df.unionByName(df.limit(1).withColumn("embedding", F.array(F.lit(1.0)))), F.lit(True))
