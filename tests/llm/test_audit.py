"""The filter audit and the resampling against plain versions, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from rostrum.llm import filter_audit, target_resampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask string, part string, rank string"


def table(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, lang, "s", len(t or ""), "m", "p", "r") for k, t, lang in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(300)] + ["Über", "Ça", "x#y", "|", "AB", "Z9"]
    texts = [" ".join(rng.choices(pool[: rng.choice([3, 40, 306])], k=rng.choice([0, 1, 2, 19, 20, 21, 199, 200, 230]))) for _ in range(50)]
    out = [(k, t, rng.choice(["en", "fr", None, ""])) for k, t in enumerate(texts)]
    out += [(k, rng.choice(texts), rng.choice(["en", "de"])) for k in range(50, 110)]
    out += [(200, None, None), (201, "", "en"), (202, " \t\n", "en"), (None, texts[3], "en"), (None, None, None), (7, texts[7], "fr"), (7, texts[7], "de"), (203, " ".join(rng.choices(pool, k=30_000)), "en"), (204, "A" * 5_000, "de")]
    return out


def fails(rows):
    """Each row's set of letters that it fails."""
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, t, _ in rows:
        t = t or ""
        ws = WORD.findall(t)
        tests = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": k is not None and t in least and least[t] < k,
        }
        out.append({c for c, bad in tests.items() if bad})
    return out


def test_audit_is_that_of_filters_applied_one_by_one(spark, rows):
    labels = [(k, k % 3, k % 2) for k in range(0, 220, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)]
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    want, shares = {}, Counter()
    for part in {lang or "" for _, _, lang in rows}:
        own = [(k, bad) for (k, _, lang), bad in zip(rows, fails(rows), strict=True) if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [(k, bad) for k, bad in left if c in bad]
                left = [(k, bad) for k, bad in left if c not in bad]
                shares[part, c] += len(gone)
                everywhere = [bad for _, bad in own if c in bad]
                want[part, order, step] = (len(left), len(gone), len(everywhere) - len(gone), everywhere.count({c}), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone))
    got = filter_audit.audit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:9] for r in got} == want
    assert all(r.shapley == shares[r.part, r.filter_order[r.step - 1]] for r in got)
    assert len(got) == len(want)


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table(spark, []), labels).count() == 0
    found = filter_audit.audit(table(spark, [(1, None, None)]), labels.limit(0)).collect()
    assert len(found) == 600 and {(r.part, r.good_lost) for r in found} == {("", 0)}


def features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def plain_scores(rows, target):
    hashed = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(map(hashed, features(text)[1]))
    for text in target:
        t.update(map(hashed, features(text)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float((t[b] + 1) * (n_s + 10_000)) / float((s[b] + 1) * (n_t + 10_000))))
    out = []
    for k, text, _ in rows:
        words, fs = features(text)
        weight = sum(gain(hashed(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("nodes", [None, 50])
def test_resampling_is_that_of_all_features_counted(spark, rows, monkeypatch, nodes):
    """Also with tries that start anew all the time (in workers, so by the closure's own value)."""
    if nodes:
        monkeypatch.setattr(target_resampling.Trie, "full", property(lambda self: len(self.list) + len(self.edges) > 50))
    target = ["w1 w2 w3 w4", None, "", "Über ça w7", "w1 w2"] * 3
    got = target_resampling.resampled(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), keep=("lang", "mask")).collect()
    want = plain_scores(rows, target)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    may = sorted(((-score, k is None, k or 0) for k, words, _, _, score in want if words >= 20))
    drawn = may[: 25 * len(may) // 100]
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_of_empty_tables_and_clashing_names(spark, rows):
    none = spark.createDataFrame([], "text string")
    assert target_resampling.resampled(table(spark, []), none).count() == 0
    found = target_resampling.resampled(table(spark, rows[:9]), none).collect()
    assert len(found) == 9
    with pytest.raises(ValueError, match="rank"):
        target_resampling.resampled(table(spark, rows), none, keep=("rank",))


def test_trie_counts_what_it_walks():
    rng = random.Random(2)
    bodies = [" ".join(rng.choices(["a", "b", "Cd", "é", "7x"], k=rng.randrange(30))).encode() for _ in range(40)]
    trie, want = target_resampling.Counted(101), defaultdict(int)
    for i in range(0, 40, 7):
        trie.add(bodies[i : i + 7])
    for body in bodies:
        for f in features(body.decode())[1]:
            want[zlib.crc32(f.encode()) % 101] += 1
    assert trie.settle().tolist() == [want[b] for b in range(101)]
    assert not trie.list and not len(trie.edges)
