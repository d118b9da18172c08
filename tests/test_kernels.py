"""Order-dependent kernels: golden values, exhaustive search on small inputs, invariants."""

import itertools
import random

import numpy as np
import pytest

from rostrum.operators import alignment, projection, ranking, segmentation
from rostrum.sources import pages


def test_path_starts_on_the_first_slide_and_jumps_when_it_pays():
    def row(best, n=8):
        out = np.zeros(n)
        out[best] = 1
        return out

    assert list(alignment.best_path(np.array([row(0), row(7), row(7)]))) == [0, 7, 7]
    assert alignment.best_path(np.array([row(5)]))[0] == 0


def path_value(grid, path):
    cost = alignment.penalties(grid.shape[1])
    return sum(grid[t, s] for t, s in enumerate(path)) - sum(cost[a, b] for a, b in itertools.pairwise(path))


def test_path_is_the_best_of_all():
    rng = np.random.default_rng(0)
    for _ in range(20):
        grid = rng.random((4, 6)).round(2)
        best = max(path_value(grid, (0, *p)) for p in itertools.product(range(6), repeat=3))
        assert path_value(grid, alignment.best_path(grid)) == pytest.approx(best)


def test_ties_of_paths_keep_the_larger_slide():
    assert alignment.best_path(np.zeros((2, 3)))[-1] == 0
    assert list(alignment.best_path(np.array([[0.0, 0, 0], [0, 0.05, 0]]))) == [0, 1]


def objective(ranges, lengths, costs):
    cut = [costs[b - 1] for _, b in ranges[:-1]]
    return tuple(cut.count(k) for k in (5, 4, 3, 2, 1)), len(ranges), sum(sum(lengths[a:b]) ** 2 for a, b in ranges)


def test_partitions_are_the_best_of_all():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9)
        lengths, costs = [rng.randrange(40, 200) for _ in range(n)], [rng.randrange(6) for _ in range(n)]
        every = []
        for cuts in itertools.product((0, 1), repeat=n - 1):
            edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
            ranges = list(itertools.pairwise(edges))
            if all(sum(lengths[a:b]) <= segmentation.MAX_PASSAGE for a, b in ranges):
                every.append(objective(ranges, lengths, costs))
        assert objective(segmentation.best_cuts(lengths, costs), lengths, costs) == min(every)


def test_longest_passages():
    assert segmentation.best_cuts([150, 150], [5, 0]) == [(0, 2)]
    assert segmentation.best_cuts([150, 151], [5, 0]) == [(0, 1), (1, 2)]
    assert segmentation.best_cuts([301], [0]) is None
    assert segmentation.best_cuts([2] * 98, [5] * 98) == [(0, 98)]


def test_prototype_partitions_are_the_best_of_all():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 9)
        lengths, labels = [rng.randrange(20, 260) for _ in range(n)], [rng.choice(list(segmentation.REWARDS)) for _ in range(n)]
        every = []
        for cuts in itertools.product((0, 1), repeat=n - 1):
            edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
            sizes = [sum(lengths[a:b]) for a, b in itertools.pairwise(edges)]
            if max(sizes) <= 450 and all(labels[e - 1] != "continue" for e in edges[1:-1]):
                fit = sum(-max(80 - x, 0) / 8 - max(x - 280, 0) / 12 for x in sizes)
                every.append((round(fit + sum(segmentation.REWARDS[labels[e - 1]] for e in edges[1:-1]), 6), list(itertools.pairwise(edges))))
        found = segmentation.prototype_cuts(lengths, labels)
        assert found is None if not every else max(every)[0] == dict((tuple(r), v) for v, r in every)[tuple(found)]


def test_far_texts_are_given_up():
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdef ") for _ in range(20_000)) for _ in range(2))
    assert projection.project(a, [b]).error == "difference_too_large"
    assert projection.project(a, ["x" * 20_000]).error == "difference_too_large"
    assert projection.edits(a[:50], b[:50], 3) is None
    near = a[:9_000] + "xyz" + a[9_010:]
    assert projection.project(a, [near[:500], near[500:]]).ranges[0] == (0, 500)


def test_prototype_never_cuts_a_continuation():
    assert segmentation.prototype_cuts([100, 100, 100], ["continue", "required_break", None]) == [(0, 2), (2, 3)]
    assert segmentation.prototype_cuts([300, 300], ["continue", None]) is None


def test_split_mix_and_shuffle():
    draw = ranking.split_mix(0)
    assert [next(draw) for _ in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    for n in range(30):
        assert sorted(ranking.shuffled(n, 7)) == list(range(n))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9, 40])
def test_plans_show_every_passage_each_round(n):
    groups = ranking.comparisons(n, 8, 42)
    assert len(groups) == (0 if n < 2 else -(-n // min(4, n)) * 8)
    for k in range(0, len(groups), max(len(groups) // 8, 1)):
        assert {x for g in groups[k : k + len(groups) // 8] for x in g} == set(range(n))
    assert all(len(set(g)) == min(4, n) for g in groups)


def rebuilt(script, source, proposed):
    assert "".join(source[e.a : e.b] for e in script) == source and "".join(proposed[e.c : e.d] for e in script) == proposed
    assert all(source[e.a : e.b] == proposed[e.c : e.d] for e in script if e.equal)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edit_scripts_are_shortest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        script = projection.edits(a, b)
        rebuilt(script, a, b)
        assert sum(e.b - e.a for e in script if e.equal) == common(a, b)


def test_projection_limits():
    source = "abcdefghijklmnopqrst"
    assert projection.project(source, [source[:9], source[9:]]).ranges == [(0, 9), (9, 20)]
    assert projection.project(source, [source[:9], "X" + source[10:]]).error == "difference_too_large"
    long = source * 2
    found = projection.project(long, [long[:20], "X" + long[21:]])
    assert found.ranges == [(0, 20), (20, 40)] and (found.changed, found.compared) == (1, 40)
    assert projection.project("", ["a"]).error == "empty_source"
    assert projection.project("a", []).error == "no_passages"
    assert projection.project("a", ["a", ""]).error == "empty_proposed_passage"


def test_times_within_an_island():
    tokens = [(c, 100 * k, 100 * k + 100) for k, c in enumerate("abcdefghij")]
    assert projection.timed_island(["abcde", "fghij"], [(0, 1000), (0, 1000)], tokens) == [(0, 500), (500, 1000)]
    assert projection.timed_island(["xxxxx", "fghij"], [(0, 1000), (0, 1000)], tokens) is None
    assert projection.timed_island(["..."], [(0, 1000)], tokens) is None
    assert projection.timed_island(["abc", "defg"], [(0, 700), (0, 700)], tokens[:7]) == [(0, 300), (300, 700)]


def test_recognised_lines():
    own = ["The quick brown fox jumps"]
    assert pages.merge_lines(own, ["THE QUICK BROWN FOX", "Another line here", "abc"]) == [*own, "Another line here"]
    assert pages.merge_lines(["ab"], ["a longer recognised line"]) == ["a longer recognised line"]
    assert pages.is_duplicate("thequickbrownf0x", own) and not pages.is_duplicate("zzzzzzzz", own)
    assert pages.merge_lines(own, ["new words in line", "new words in line"]) == [*own, "new words in line"]


def test_common_is_a_longest_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        text, line = ("".join(rng.choice("abc") for _ in range(rng.randrange(n))) for n in (30, 12))
        best = [[0] * (len(line) + 1) for _ in range(len(text) + 1)]
        for i, c in enumerate(text):
            for j, d in enumerate(line):
                best[i + 1][j + 1] = best[i][j] + 1 if c == d else max(best[i][j + 1], best[i + 1][j])
        found = pages.common(text, line)
        assert len(found) == best[-1][-1]
        assert all(text[i] == line[j] for i, j in found) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


def test_recognised_lines_of_long_pages():
    page = ["A page of many words and numbers 12345"] * 3 + ["x" * 100_000, "the last line is here"]
    assert pages.merge_lines(page, ["THE LAST L1NE IS HERE", "quite unlike all of it"]) == [*page, "quite unlike all of it"]


def test_secrets_across_chunks():
    from rostrum.functions.redaction import Redactor

    text = "xxsecsecretyysecretsec"
    for size in range(1, 9):
        own, out = Redactor("secret"), ""
        for k in range(0, len(text), size):
            out += own.feed(text[k : k + size], k + size >= len(text))
        assert out == text.replace("secret", "<REDACTED>")
    assert Redactor("").feed("a") == "a"
