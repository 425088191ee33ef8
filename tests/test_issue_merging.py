"""Merged candidates and scored compliance issues: literal rows and small brute-force versions."""

import random
from difflib import SequenceMatcher

from conftest import rows

from sheetledger.operators.compliance import issue_scores, match_issues, obligation_confusion
from sheetledger.operators.fusion import merge_candidates

CANDS = "k string, at int, ref string, snippet string, severity string, source string"


def alike(a, b, least):
    return bool(a) and bool(b) and SequenceMatcher(None, a, b).ratio() >= least


def brute_merge(cands, least, most):
    groups = []
    for _, at, ref, text, severity, source in sorted(cands, key=lambda c: c[1]):
        hit = next((g for g in groups if ref and g["ref"] == ref or alike(text, g["snippet"], least)), None)
        if hit is None:
            groups.append({"at": at, "ref": ref or "", "snippet": text or "", "severity": severity, "sources": [source]})
        elif source not in hit["sources"]:
            hit["sources"].append(source)
    up = {"info": "minor", "minor": "major", "major": "critical"}
    return [(g["at"], g["ref"], g["snippet"], up.get(g["severity"], g["severity"]) if len(g["sources"]) > 1 else g["severity"], "+".join(g["sources"])) for g in groups[:most]]


def merged(spark, cands, least=0.72, most=20):
    out = {}
    for r in merge_candidates(spark.createDataFrame(cands, CANDS), ["k"], "at", least, most).collect():
        out.setdefault(r["k"], []).append((r["at"], r["ref"], r["snippet"], r["severity"], r["sources"]))
    return {k: sorted(v) for k, v in out.items()}


# Texts with the groups that must come out.
def test_merging_literal_rows(spark):
    ref, other = "GB50010-2010 8.2.1", "GB50011-2010 3.1.1"
    cands = [("ref", 0, ref, "锚固长度不足", "minor", "kg"), ("ref", 1, ref, "完全不同的措辞文本", "info", "rag"),
             ("text", 0, "", "钢筋锚固长度明显不足需复核", "minor", "kg"), ("text", 1, "", "钢筋锚固长度明显不足，需要复核", "minor", "rag"),
             ("apart", 0, ref, "锚固长度不足", "minor", "kg"), ("apart", 1, other, "抗震等级需复核，与前者完全无关", "minor", "rag"),
             ("first", 0, ref, "KG原始描述", "critical", "kg"), ("first", 1, ref, "RAG不同措辞", "info", "rag")]
    cands += [("cap", i, f"REF-{i}", t, "info", "kg") for i, t in enumerate(["锚固长度不足", "抗震等级不满足", "防火分区超限", "疏散距离过长", "楼板厚度偏薄", "梁配筋率不足", "消防水量不足"])]
    got = merged(spark, cands, 0.7, 5)
    assert [g[4] for g in got["ref"]] == ["kg+rag"] and [g[4] for g in got["text"]] == ["kg+rag"]
    assert len(got["apart"]) == 2 and len(got["cap"]) == 5
    assert got["first"] == [(0, ref, "KG原始描述", "critical", "kg+rag")]


def test_merging_equals_first_fit(spark):
    rng = random.Random(3)
    letters = "abcdef"
    cands = []
    for k in ("a", "b", None):
        base = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(5)]
        for at in range(60):
            text = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                text[rng.randrange(9)] = rng.choice(letters)
            cands.append((k, at, rng.choice(["", "", None, "R1", "R2", "R3"]), rng.choice(["".join(text), "".join(text), "", None]), rng.choice(["info", "minor", "critical"]), rng.choice(["kg", "rag", "x"])))
    wanted = {k: brute_merge([c for c in cands if c[0] == k], 0.72, 1000) for k in ("a", "b", None)}
    assert merged(spark, cands, 0.72, None) == wanted
    assert merge_candidates(spark.createDataFrame([], CANDS), ["k"], "at").count() == 0


GOLD, FOUND = "k string, gold_id int, ref string, snippet string, severity string, obligation string", "k string, found_id int, ref string, description string, severity string"


def scored(spark, gold, found, recalled=None):
    """gold: (ref, snippet, severity, obligation); found: (ref, description, severity)."""
    table = lambda data, form: spark.createDataFrame([("s", i, *r) for i, r in enumerate(data)], form)
    marks = match_issues(table(gold, GOLD), table(found, FOUND), ["k"], None if recalled is None else table(recalled, FOUND))
    return issue_scores(marks, []).first(), rows(obligation_confusion(marks, []))


# Gold and found issues with the counts that must come out.
def test_scores_of_literal_rows(spark):
    ref, other = "GB50010-2010 8.2.1", "GB50011-2010 3.1.1"
    s, confusion = scored(spark, [(ref, "", "major", "MUST")], [(" gb50010-2015 8.2.1", "[MUST] 锚固长度不足", "critical")])
    assert (s.tp, s.fp, s.fn, s.hit_rate, s.downgrade_rate) == (1, 0, 0, 1.0, 0.0) and confusion == [("MUST", "MUST", 1)]
    s, _ = scored(spark, [(ref, "", "critical", None)], [(ref, "锚固问题", "info")])
    assert (s.tp, s.fp, s.fn, s.wrong_severity, s.spurious, s.wrong_ref) == (0, 1, 0, 1, 0, 0)
    s, _ = scored(spark, [(ref, "锚固长度不足需复核", "major", None)], [("", "完全无关的疏散距离问题描述内容", "major")])
    assert (s.tp, s.fp, s.fn, s.spurious, s.missed, s.dropped) == (0, 1, 1, 1, 1, 0)
    s, _ = scored(spark, [(ref, "钢筋锚固长度明显不足需要复核", "major", None), (other, "抗震等级需复核", "major", None)],
                  [("GB50099-1999 9.9.9", "钢筋锚固长度明显不足，需要复核一下", "major"), (other, "抗震等级需复核", "major")])
    assert (s.tp, s.wrong_ref) == (1, 1)
    s, _ = scored(spark, [(ref, "", "major", None)], [], [(ref, "曾被召回但 LLM 核查剔除", "major")])
    assert (s.fn, s.missed, s.dropped) == (1, 0, 1)
    s, _ = scored(spark, [("A", "", "major", "MUST"), ("B", "", "major", "MUST")], [("A", "[SHOULD] 降级判定", "major"), ("B", "[MUST] 判定正确", "major")])
    assert (s.tp, s.downgrade_rate) == (2, 0.5)
    s, _ = scored(spark, [], [])
    assert (s.tp, s.fp, s.fn, s.precision, s.recall, s.f1, s.hit_rate, s.downgrade_rate) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)


def brute_marks(gold, found, least=0.72):
    refs, taken_g, taken_p, marks = {}, set(), set(), []
    for i, (r, *_) in enumerate(found):
        refs.setdefault(r, []).append(i)
    pairs = []
    for i, (r, *_) in enumerate(gold):
        if r and refs.get(r):
            pairs.append((i, refs[r].pop(0)))
    taken_g, taken_p = {i for i, _ in pairs}, {j for _, j in pairs}
    texts = sorted((-SequenceMatcher(None, g[1], p[1]).ratio(), i, j) for i, g in enumerate(gold) for j, p in enumerate(found)
                   if i not in taken_g and j not in taken_p and not (g[0] and p[0]) and alike(g[1], p[1], least))
    for _, i, j in texts:
        if i not in taken_g and j not in taken_p:
            taken_g.add(i), taken_p.add(j), pairs.append((i, j))
    rank = {"info": 0, "minor": 1, "major": 2, "critical": 3}
    for i, j in pairs:
        marks.append(("tp" if abs(rank[gold[i][2]] - rank[found[j][2]]) <= 1 else "wrong_severity", i, j))
    marks += [("wrong_ref" if any(alike(p[1], g[1], least) for g in gold) else "spurious", -1, j) for j, p in enumerate(found) if j not in taken_p]
    return sorted(marks + [("missed", i, -1) for i in range(len(gold)) if i not in taken_g])


def test_marks_equal_greedy_matching(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef") for _ in range(8)) for _ in range(6)]

    def one():
        text = list(rng.choice(base))
        text[rng.randrange(8)] = rng.choice("abcdef")
        return rng.choice(["", "", "R1", "R2"]), "".join(text), rng.choice(["info", "minor", "major", "critical"])

    samples = {k: ([one() for _ in range(25)], [one() for _ in range(30)]) for k in ("a", "b")}
    gold = spark.createDataFrame([(k, i, *r, "MUST") for k, (g, _) in samples.items() for i, r in enumerate(g)], GOLD)
    found = spark.createDataFrame([(k, i, *r) for k, (_, p) in samples.items() for i, r in enumerate(p)], FOUND)
    got = {}
    for r in match_issues(gold, found, ["k"]).collect():
        got.setdefault(r["k"], []).append((r["mark"], -1 if r["gold_id"] is None else r["gold_id"], -1 if r["found_id"] is None else r["found_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_marks(*s) for k, s in samples.items()}
