"""Segmentation against a search of all cuts and of all state sequences, and terms of whole texts."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rostrum.functions import segmentation as sg
from rostrum.operators import retrieval
from rostrum.plans.catalog import QUERIES
from rostrum.plans.retrieval import squeezed


def dictionary(rng, letters="abcd", n=25):
    return {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3, 4]))): rng.randrange(1, 60) for _ in range(n)}


def test_trie_holds_its_words_and_no_others():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdeé中文") for _ in range(rng.randrange(1, 6))): -float(k) for k in range(400)}
    walker = sg.Trie.of(words).lists()
    for length in range(1, 5):
        for letters in itertools.product("abcdeé中文z", repeat=length):
            word = "".join(letters)
            assert walker.holds(word) == (word in words)
            assert walker.words(word, 0) == [(k, words[word[:k]]) for k in range(1, length + 1) if word[:k] in words]
    assert not sg.Trie.of({}).lists().words("a", 0)


def test_best_path_is_the_best_of_all_cuts():
    rng = random.Random(2)
    for _ in range(150):
        counts = dictionary(rng)
        model = sg.model_of(counts)
        walker, total = model.trie.lists(), sum(counts.values())
        run = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 10)))
        every = []
        for marks in itertools.product((0, 1), repeat=len(run) - 1):
            edges = [0, *(k + 1 for k, m in enumerate(marks) if m), len(run)]
            words = [run[a:b] for a, b in itertools.pairwise(edges)]
            if all(len(w) == 1 or w in counts for w in words):
                every.append((sum(math.log(counts.get(w, 1) / total) for w in words), words))
        found = sg.best_path(walker, run, model.unknown)
        assert "".join(found) == run
        assert sum(math.log(counts.get(w, 1) / total) for w in found) == pytest.approx(max(s for s, _ in every))


def test_states_are_the_best_of_all_sequences():
    rng = random.Random(3)
    legal = {(a, b) for a, bs in sg.FOLLOWS.items() for b in bs}
    for _ in range(60):
        model = sg.model_of(dictionary(rng))
        run = "".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 7)))

        def score(states, model=model, run=run):
            return model.starts[states[0]] + sum(model.letters[s].get(c, sg.NEVER) for s, c in zip(states, run, strict=True)) + sum(model.moves[a][b] for a, b in itertools.pairwise(states))

        every = [s for s in itertools.product(range(4), repeat=len(run)) if s[0] in (sg.BEGIN, sg.SINGLE) and s[-1] in (sg.END, sg.SINGLE) and all(p in legal for p in itertools.pairwise(s))]
        found = sg.by_states(model, run)
        states = [s for w in found for s in ([sg.SINGLE] if len(w) == 1 else [sg.BEGIN, *[sg.MIDDLE] * (len(w) - 2), sg.END])]
        assert "".join(found) == run and score(states) == pytest.approx(max(map(score, every)))


def test_cuts_of_known_and_unknown_stretches():
    counts = {"南京": 40, "南京市": 30, "市长": 10, "长江": 30, "长江大桥": 25, "大桥": 20, "研究": 30, "研究生": 8, "生命": 20, "起源": 20, "的": 90, "我": 50}
    model = sg.model_of(counts)
    walker = model.trie.lists()
    assert sg.cut(model, walker, "南京市长江大桥") == ["南京市", "长江大桥"]
    assert sg.cut(model, walker, "研究生命的起源") == ["研究", "生命", "的", "起源"]
    assert sg.for_search(walker, ["南京市", "长江大桥"]) == ["南京", "南京市", "长江", "大桥", "长江大桥"]
    assert "".join(sg.cut(model, walker, "我杭研大厦的")) == "我杭研大厦的"
    terms = sg.terms_of("The 南京市长江大桥 is ＬＯＮＧ, 1/2! été _x_ 。", model, walker)
    assert terms == ["the", "南京", "南京市", "长江", "大桥", "长江大桥", "is", "long", "1", "2", "été", "x"]
    assert sg.terms_of("", model, walker) == [] == sg.terms_of("。！ __", model, walker)


def test_long_runs_take_linear_time():
    model = sg.model_of({"ab": 5, "abc": 3, "c": 2, "d": 1})
    run = "abcd" * 25_000
    assert "".join(sg.cut(model, model.trie.lists(), run)) == run


def test_words_learned_from_runs_stand_together(spark):
    rng = random.Random(5)
    words = ["南京", "长江", "大桥", "研究", "生命", "起源", "我", "的", "是", "在", "有", "和"]
    texts = ["".join(rng.choice(words) for _ in range(40)) + " and 英" for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("no such run",)], "text string")
    found = sg.cohesive_words(df, cohesion=4.0)
    two = {w for w in found if len(w) == 2}
    assert two == {w for w in words if len(w) == 2} and {w for w in words if len(w) == 1} <= set(found)
    joined = "".join(texts)
    assert all(n == sum(joined.startswith(w, k) for k in range(len(joined))) or len(w) > 1 for w, n in found.items())
    right = total = 0
    model = sg.model_of(found)
    walker = model.trie.lists()
    for _ in range(20):
        true = [rng.choice(words) for _ in range(30)]
        edges = lambda ws: set(itertools.accumulate(map(len, ws)))
        right += len(edges(true) & edges(sg.cut(model, walker, "".join(true))))
        total += len(true)
    assert right / total > 0.95
    assert sg.cohesive_words(df.limit(0)) == {} and sg.spaced_words(df.limit(0)) == {}


def test_retrieval_over_segmented_texts(spark):
    counts = {"南京": 40, "长江": 30, "大桥": 20, "市": 9}
    terms = sg.analyzer(sg.model_of(counts))
    slides = spark.createDataFrame([(0, "南京市的大桥"), (1, "长江"), (2, None), (3, "bridge 大桥")], "slide_id long, text string")
    queries = spark.createDataFrame([(7, "长江大桥"), (8, "Bridge")], "query_id long, text string")
    got = retrieval.bm25(slides, queries, terms(F.col("text")), terms(F.col("text"))).collect()
    assert {(r.query_id, r.slide_id) for r in got} == {(7, 0), (7, 1), (7, 3), (8, 3)}


def test_words_of_documents_without_spaces_are_found_again(spark):
    """At the smallest size, where every word of the documents was met: most boundaries, though many words are made of others."""
    folder = "/root/testdata/sf0.001"
    docs, _, terms = squeezed(spark, folder)
    found = {r.slide_id: r.terms for r in docs.select("slide_id", terms(F.col("text")).alias("terms")).collect()}
    counts = sg.spaced_words(spark.read.parquet(f"{folder}/documents.parquet"))
    model = sg.model_of(counts)
    walker = model.trie.lists()
    right = total = 0
    for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect():
        lines = re.sub(" +", "", r.text.lower())
        assert found[r.doc_id] == sg.terms_of(lines, model, walker, r"\p{L}")
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        ends = lambda ws: set(itertools.accumulate(map(len, ws)))
        again = [w for run in re.findall(r"[^\W\d_]+", lines) for w in sg.cut(model, walker, run)]
        right += len(ends(words) & ends(again))
        total += len(words)
    assert right / total > 0.8


def test_bm25_over_closed_texts_is_that_of_its_terms(spark):
    folder = "/root/testdata/sf0.001"
    docs, queries, terms = squeezed(spark, folder)
    own, asked = ({r[0]: r[1] for r in df.select(df.columns[0], terms(F.col("text"))).collect()} for df in (docs, queries))
    frequency = Counter(t for ts in own.values() for t in set(ts))
    mean, n = sum(map(len, own.values())) / len(own), len(own)
    want = {}
    for q, ts in asked.items():
        scores = []
        for d, held in own.items():
            tf = Counter(held)
            score = sum(math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(held) / mean)) for t in set(ts) if tf[t])
            if score > 0:
                scores.append((-round(score, 9), d))
        want.update({(q, k): (d, round(-s, 6)) for k, (s, d) in enumerate(sorted(scores)[:3], 1)})
    got = {(r.query_id, r["rank"]): (r.slide_id, r.score) for r in QUERIES["bm25_segmented_top3"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
    assert sum(got[k][0] == want[k][0] for k in want) > 0.98 * len(want)
