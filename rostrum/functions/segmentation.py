"""Segmentation of scripts without spaces into words, by a dictionary and a state table that are learned from texts.

A run of such characters is cut where the words of a dictionary have the highest
probability: every word that begins at a place is an edge of the run's word graph,
found in one walk down a trie, and the best path follows from the run's end to its
start. What is left as single characters that are no dictionary word together is cut
again by the most probable sequence of states, where a character begins, continues or
ends a word or is one. Search mode adds the words of two and three characters inside
longer ones, before them.

The trie is a double array: a node's child by a character lies at the node's base
plus the character's code, if its owner there is the node. It is made on the driver
from at most ``MAX_WORDS`` words, of which nothing depends on the size of the texts,
and goes to workers as three arrays.

Texts are normalised (NFKC) first; null gives null. Time is linear in a text but for
the length of the longest word. Of equally probable paths the one whose first word is
longest is taken, and so on.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rostrum.session import checkpointed

#: Words of a dictionary at most, characters of a word, and how often a word must occur.
MAX_WORDS, MAX_LENGTH, MIN_COUNT = 50_000, 16, 2
#: Runs that are segmented, as a regular expression of characters: scripts written without spaces.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: How much likelier than by chance the parts of a word found in runs must stand together, and its characters at most.
COHESION, RUN_WORD = 20.0, 4
#: Places that are tried for the children of a node before the trie's array grows.
TRIES = 32
#: Log probability of what was never seen.
NEVER = -20.0
BEGIN, MIDDLE, END, SINGLE = range(4)


@dataclass
class Trie:
    """Words as a double array; ``weight`` of a word's last node is its log probability, NaN where no word ends."""

    codes: dict[str, int]
    base: np.ndarray
    owner: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, weights: dict[str, float]) -> Trie:
        codes = {c: k for k, (c, _) in enumerate(Counter(c for word in weights for c in word).most_common(), 1)}
        spelled = sorted(([codes[c] for c in word], weight) for word, weight in weights.items() if word)
        base, owner, weight, free = [1], [-1], [float("nan")], 2

        def grown(size: int) -> None:
            more = size - len(base)
            if more > 0:
                base.extend([0] * more)
                owner.extend([-1] * more)
                weight.extend([float("nan")] * more)

        # nodes still to be given children: (node, depth, words from, to)
        waiting = [(0, 0, 0, len(spelled))]
        while waiting:
            node, depth, low, high = waiting.pop()
            if low < high and len(spelled[low][0]) == depth:
                weight[node] = spelled[low][1]
                low += 1
            children, at = [], low
            while at < high:
                code, first = spelled[at][0][depth], at
                while at < high and spelled[at][0][depth] == code:
                    at += 1
                children.append((code, first, at))
            if not children:
                continue
            while free < len(owner) and owner[free] >= 0:
                free += 1
            # gaps are tried a few times from the first free place on, then the array grows
            taken = lambda at: any(at + code < len(owner) and owner[at + code] >= 0 for code, _, _ in children)  # noqa: B023, E731
            first_fit = max(free - children[0][0], 1)
            start = next((at for at in range(first_fit, first_fit + TRIES) if not taken(at)), max(len(owner) - children[0][0], 1))
            while taken(start):
                start += 1
            grown(start + children[-1][0] + 1)
            base[node] = start
            for code, first, last in children:
                owner[start + code] = node
                waiting.append((start + code, depth + 1, first, last))
        return cls(codes, np.array(base, np.int32), np.array(owner, np.int32), np.array(weight))

    def words(self) -> dict[int, str]:
        """The words by their last nodes."""
        letters, spelled = {code: c for c, code in self.codes.items()}, {0: ""}
        base, owner = self.base.tolist(), self.owner.tolist()

        def spell(node: int) -> str:
            path = []
            while node not in spelled:
                path.append(node)
                node = owner[node]
            for child in reversed(path):
                spelled[child] = spelled[owner[child]] + letters[child - base[owner[child]]]
            return spelled[path[0]] if path else spelled[node]

        return {node: spell(node) for node in np.flatnonzero(~np.isnan(self.weight)).tolist()}

    def lists(self) -> Walker:
        return Walker(self.codes, self.base.tolist(), self.owner.tolist(), self.weight.tolist())


@dataclass
class Walker:
    """The trie's arrays as lists, which single look-ups read faster."""

    codes: dict[str, int]
    base: list[int]
    owner: list[int]
    weight: list[float]

    def words(self, text: str, start: int) -> list[tuple[int, float]]:
        """(end, log probability) of every word that begins at ``start``, shorter ones first."""
        out, node = [], 0
        for end in range(start, len(text)):
            code = self.codes.get(text[end])
            if code is None:
                break
            child = self.base[node] + code
            if child >= len(self.owner) or self.owner[child] != node:
                break
            node = child
            if self.weight[node] == self.weight[node]:
                out.append((end + 1, self.weight[node]))
        return out

    def holds(self, word: str) -> bool:
        found = self.words(word, 0)
        return bool(found) and found[-1][0] == len(word)


@dataclass
class Model:
    """What segmentation needs: the trie, the log probability of a character that is no word, and the state table."""

    trie: Trie
    unknown: float
    starts: list[float]
    moves: list[list[float]]
    letters: list[dict[str, float]]


def model_of(counts: dict[str, int]) -> Model:
    """The model of words and how often each occurs. States are those of the words' own characters."""
    total = sum(counts.values())
    letters, moves = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for word, n in counts.items():
        states = [SINGLE] if len(word) == 1 else [BEGIN, *[MIDDLE] * (len(word) - 2), END]
        for c, state in zip(word, states, strict=True):
            letters[state][c] += n
        for a, b in zip(states, states[1:], strict=False):
            moves[a][b] += n
    single = letters[SINGLE].total()
    opening = {BEGIN: total - single, SINGLE: single}
    for state in (END, SINGLE):
        moves[state].update(opening)
    share = lambda n, of: log(n / of) if n else NEVER
    return Model(
        Trie.of({word: log(n / total) for word, n in counts.items()}),
        -log(max(total, 1)),
        [share(opening.get(state, 0), total) for state in range(4)],
        [[share(moves[a][b], moves[a].total()) for b in range(4)] for a in range(4)],
        [{c: log(n / letters[state].total()) for c, n in letters[state].items()} for state in range(4)],
    )


def best_path(walker: Walker, run: str, unknown: float) -> list[str]:
    """The words of the most probable path through the word graph of a run."""
    best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
    for start in range(len(run) - 1, -1, -1):
        edges = walker.words(run, start)
        if not edges or edges[0][0] != start + 1:
            edges = [(start + 1, unknown), *edges]
        best[start] = max((weight + best[end][0], end) for end, weight in edges)
    out, at = [], 0
    while at < len(run):
        out.append(run[at : best[at][1]])
        at = best[at][1]
    return out


#: Cells of a block of the word graph, and characters of a column at least.
CELLS, COLUMN = 32_768, 1_000


def best_steps(trie: Trie, codes: np.ndarray, ends: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """``best_path`` of many runs at once: of every place, how long the word is that begins there on its best path, and the word's node.

    ``codes`` are the trie's codes of runs with one place behind each, which ``ends`` lists. Runs are put one below the
    other in columns, all columns are walked from their ends to their starts together, and a block of rows has
    its words found and its best paths added up at a time, so that memory beside a few bytes a place is bounded.
    """
    tops, limit, top = [], max(int(np.diff(ends, prepend=-1).max()), COLUMN), 0
    while top < len(codes):
        tops.append(top)
        top = int(ends[np.searchsorted(ends, top + limit, "left") - 1]) + 1
    tops.append(len(codes))
    wide, high = len(tops) - 1, int(np.diff(tops).max())
    table, over = np.zeros((high + 1, wide), np.int32), np.ones((high, wide), bool)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    for k, (low, up) in enumerate(itertools.pairwise(tops)):
        table[: up - low, k], over[: up - low, k] = codes[low:up], ~inside[low:up]
    flat = table.ravel()
    more = np.zeros(max(trie.codes.values(), default=0) + 1, np.int32)
    base, owner = np.concatenate([trie.base, more]), np.concatenate([trie.owner, more - 1])
    weight = np.where(np.isnan(trie.weight), -np.inf, trie.weight)
    best = np.zeros((high + 1, wide))
    steps, nodes = np.ones((high, wide), np.int32), np.zeros((high, wide), np.int32)
    rows = max(CELLS // wide, 1)
    for low in reversed(range(0, high, rows)):
        up, first = min(low + rows, high), low * wide
        at, levels = np.flatnonzero(flat[first : up * wide]), []
        node = np.zeros(len(at), np.int32)
        while len(at):
            child = base.take(node) + flat.take(at + (first + len(levels) * wide))
            met = np.flatnonzero(owner.take(child) == node)
            at, node = at.take(met), child.take(met)
            some = weight.take(node)
            ended = np.flatnonzero(some > -np.inf)
            levels.append((at.take(ended), node.take(ended), some.take(ended)))
        size = max(len(levels), 1)
        if len(best) < high + 1 + size:
            best = np.concatenate([best, np.zeros((high + 1 + size - len(best), wide))])
        edges = np.full((size, up - low, wide), -np.inf)
        edges[0] = unknown
        for k, (at, _, some) in enumerate(levels):
            edges[k].reshape(-1)[at] = some
        sums = np.empty((size, wide))
        for row in range(up - 1, low - 1, -1):
            np.add(edges[:, row - low], best[row + 1 : row + 1 + size], out=sums)
            np.maximum.reduce(sums, 0, None, best[row])
            np.copyto(best[row], 0.0, where=over[row])
        for k, (at, node, some) in enumerate(levels[1:], 1):
            places = at + first
            met = np.flatnonzero(some + best.reshape(-1).take(places + (k + 1) * wide) == best.reshape(-1).take(places))
            steps.reshape(-1)[places.take(met)] = k + 1
            nodes.reshape(-1)[places.take(met)] = node.take(met)
    steps[over] = 1
    out = np.empty(len(codes), np.int32), np.empty(len(codes), np.int32)
    for k, (low, up) in enumerate(itertools.pairwise(tops)):
        out[0][low:up], out[1][low:up] = steps[: up - low, k], nodes[: up - low, k]
    return out


#: States that may follow one another.
FOLLOWS = {BEGIN: (MIDDLE, END), MIDDLE: (MIDDLE, END), END: (BEGIN, SINGLE), SINGLE: (BEGIN, SINGLE)}


def by_states(model: Model, run: str) -> list[str]:
    """The words of the most probable legal sequence of states; of equal ones the one whose last state, and so on backwards, is the least."""
    score = [model.starts[s] + model.letters[s].get(run[0], NEVER) if s in (BEGIN, SINGLE) else float("-inf") for s in range(4)]
    back: list[list[int]] = []
    for c in run[1:]:
        found = [max((score[a] + model.moves[a][b], -a) for a in range(4) if b in FOLLOWS[a]) for b in range(4)]
        back.append([-a for _, a in found])
        score = [found[b][0] + model.letters[b].get(c, NEVER) for b in range(4)]
    state = max((END, SINGLE), key=lambda s: (score[s], -s))
    states = [state]
    for step in reversed(back):
        state = step[state]
        states.append(state)
    out, word = [], ""
    for c, state in zip(run, reversed(states), strict=True):
        word += c
        if state in (END, SINGLE):
            out.append(word)
            word = ""
    return out


def cut(model: Model, walker: Walker, run: str) -> list[str]:
    """The words of a run: the best path, in which unknown stretches of single characters are cut by states."""
    return with_states(model, walker, best_path(walker, run, model.unknown))


def with_states(model: Model, walker: Walker, words: list[str]) -> list[str]:
    """The words of a best path, whose unknown stretches are cut by states."""
    out, loose = [], ""
    for word in [*words, ""]:
        if len(word) == 1:
            loose += word
            continue
        if loose:
            out += [loose] if len(loose) == 1 else list(loose) if walker.holds(loose) else by_states(model, loose)
            loose = ""
        if word:
            out.append(word)
    return out


def for_search(walker: Walker, words: Iterable[str]) -> list[str]:
    """Before each longer word, the dictionary's words of two and three characters inside it."""
    out = []
    for word in words:
        for size in (2, 3):
            if len(word) > size:
                out += [part for k in range(len(word) - size + 1) if walker.holds(part := word[k : k + size])]
        out.append(word)
    return out


def spaced_words(texts: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS) -> dict[str, int]:
    """The most frequent words of texts that have spaces, in lower case: counted by Spark, and at most ``max_words`` fetched."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).filter(F.char_length("word") <= MAX_LENGTH)
    found = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT).orderBy(F.col("n").desc(), "word").limit(max_words)
    return {r.word: r.n for r in found.collect()}


def cohesive_words(texts: DataFrame, text_col: str = "text", unspaced: str = UNSPACED, max_words: int = MAX_WORDS, cohesion: float = COHESION) -> dict[str, int]:
    """Words of runs without spaces: single characters, and stretches whose every two parts stand together ``cohesion`` times as often as by chance."""
    # a range of characters is looked for far faster than scripts: texts that end below the least of them have no runs
    texts = texts.filter(F.col(text_col).rlike(rf"[\x{{{least(unspaced):X}}}-\x{{10FFFF}}]"))
    run = F.explode(F.regexp_extract_all(text_col, F.lit(f"[{_java(unspaced)}]+"), F.lit(0))).alias("run")
    size = F.char_length("run")
    parts = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda k: F.substring("run", k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = texts.select(run).select(F.explode(F.concat(*map(parts, range(1, RUN_WORD + 1)))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)
    grams = checkpointed(grams)  # or texts were read for each of its uses
    characters = grams.filter(F.char_length("word") == 1).agg(F.sum("n").alias("characters"))
    cuts = F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("at")
    split = grams.filter(F.char_length("word") > 1).select("word", "n", cuts).select("word", "n", F.expr("left(word, at)").alias("a"), F.expr("substring(word, at + 1)").alias("b"))
    other = lambda side: grams.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    met = split.join(other("a"), "a").join(other("b"), "b").crossJoin(F.broadcast(characters))
    tied = met.groupBy("word", "n").agg(F.min(F.col("n") * F.col("characters") / (F.col("n_a") * F.col("n_b"))).alias("tie")).filter(F.col("tie") >= cohesion)
    words = tied.select("word", "n").unionByName(grams.filter(F.char_length("word") == 1)).orderBy(F.col("n").desc(), "word").limit(max_words)
    return {r.word: r.n for r in words.collect()}


def least(unspaced: str) -> int:
    """Where the block of 128 characters begins that has the first character of the class."""
    import regex

    inner = regex.compile(rf"[{unspaced}]")
    return next((k for k in range(0x110000) if inner.match(chr(k))), 0) & ~0x7F


def _java(unspaced: str) -> str:
    """The class in Java's spelling: scripts by ``Is``."""
    return unspaced.replace(r"\p{", r"\p{Is")


def terms_of(text: str, model: Model, walker: Walker, unspaced: str = UNSPACED) -> list[str]:
    """The terms of one text: segmented runs, other words whole, in lower case; what has no letter or digit is dropped."""
    import regex

    runs = regex.compile(rf"[{unspaced}]+|[^{unspaced}\W_]+(?:\p{{M}}+[^{unspaced}\W_]*)*")
    inner = regex.compile(rf"[{unspaced}]")
    out = []
    for run in runs.findall(unicodedata.normalize("NFKC", text)):
        out += for_search(walker, cut(model, walker, run)) if inner.match(run) else [run]
    return [term.lower() for term in out if any(c.isalnum() for c in term)]


#: Characters of texts that are cut together, and stretches whose terms a worker remembers.
TOGETHER, REMEMBERED = 1_000_000, 200_000
#: What a character is to a run: of those that are segmented, of a whole word, or a mark that goes on with one; NEW was not looked up yet.
INNER, WORD, MARK, NEW = 1, 2, 4, 255


class Cutter:
    """``terms_of`` for many texts at once. Terms are numbers until they are shown; those of the dictionary's words are known beforehand."""

    def __init__(self, model: Model, unspaced: str = UNSPACED):
        import regex

        self.model, self.known = model, {}
        self.inner, self.word, self.mark = regex.compile(rf"[{unspaced}]"), regex.compile(rf"[^{unspaced}\W_]"), regex.compile(r"\p{M}")
        self.runs = regex.compile(rf"[^{unspaced}\W_]+(?:\p{{M}}+[^{unspaced}\W_]*)*")
        self.ascii = any(self.inner.match(chr(k)) for k in range(128))
        self.plain = "".join(chr(k).lower() if self.word.match(chr(k)) else " " for k in range(128))
        found = model.trie.words()
        self.words = dict.fromkeys(found.values())
        self.place = np.zeros(len(model.trie.base), np.int32)
        self.place[list(found)] = np.arange(len(found))
        self.names: dict[str, int] = {}
        of = [self.numbered(self.terms_of_words([word]), self.names) for word in found.values()]
        self.parts = np.array([k for own in of for k in own], np.int32)
        self.counts = np.array([len(own) for own in of], np.int64)
        self.kinds = self.codes = None

    def holds(self, word: str) -> bool:
        return word in self.words

    def terms_of_words(self, words: list[str]) -> list[str]:
        return [term.lower() for term in for_search(self, words) if any(c.isalnum() for c in term)]

    @staticmethod
    def numbered(terms: list[str], names: dict[str, int]) -> list[int]:
        return [names.setdefault(term, len(names)) for term in terms]

    def of_stretch(self, stretch: str) -> list[str]:
        """The terms of characters that the best path left single."""
        found = self.known.get(stretch)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[stretch] = self.terms_of_words(with_states(self.model, self, list(stretch)))
        return found

    def classes(self, points: np.ndarray) -> np.ndarray:
        """INNER or WORD for the characters of runs, else 0: what ``terms_of`` finds by its expression."""
        if self.kinds is None:
            self.kinds, self.codes = np.full(0x110000, NEW, np.uint8), np.zeros(0x110000, np.int32)
            self.codes[[ord(c) for c in self.model.trie.codes]] = list(self.model.trie.codes.values())
        kinds = self.kinds.take(points)
        if (kinds == NEW).any():
            for point in np.unique(points[kinds == NEW]).tolist():
                c = chr(point)
                kind = INNER if self.inner.match(c) else WORD if self.word.match(c) else 0
                self.kinds[point] = kind | (MARK if kind != WORD and self.mark.match(c) else 0)
            kinds = self.kinds.take(points)
        if (kinds & MARK).any():
            # a mark goes on with a word that reaches it
            strong = np.maximum.accumulate(np.where(kinds & MARK, 0, np.arange(len(kinds))))
            kinds = np.where(kinds & MARK, np.where(kinds.take(strong) == WORD, WORD, kinds & INNER), kinds)
        return kinds

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Of each term the text's place and the term's number, in order, and the numbers of terms that are not the dictionary's."""
        normal = [unicodedata.normalize("NFKC", text) for text in texts]
        text = "\0".join(["", *normal, ""])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes(points)
        edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        begun = kinds.take(edges)
        spans = [(edges[k], edges[k + 1]) for k in np.flatnonzero(begun == WORD).tolist()]
        own, units, firsts = {}, [], [np.array([low for low, _ in spans], np.int64)]
        more: list[list[str]] = []

        def unit(key: tuple, terms: Callable[[], list[str]]) -> int:
            found = own.get(key)
            if found is None:
                found = own[key] = len(self.counts) + len(more)
                more.append(terms())
            return found

        for low, up in spans:
            run = text[low:up]
            units.append(unit((WORD, run), lambda: [run.lower()] if any(c.isalnum() for c in run) else []))  # noqa: B023
        units = [np.array(units, np.int64)]
        if (begun == INNER).any():
            inner = kinds == INNER
            kept = inner.copy()
            kept[1:] |= inner[:-1]
            places = np.flatnonzero(kept)
            ends = np.flatnonzero(~inner.take(places))
            codes = self.codes.take(points.take(places))
            codes[ends] = 0
            steps, nodes = best_steps(self.model.trie, codes, ends, self.model.unknown)
            starts, at, step = [], 0, steps.tolist()
            while at < len(step):
                starts.append(at)
                at += step[at]
            starts = np.array(starts)
            long = steps.take(starts) > 1
            firsts.append(places.take(starts[long]))
            units.append(self.place.take(nodes.take(starts[long])).astype(np.int64))
            # stretches of single characters
            loose = places.take(starts[~long])
            loose = loose[inner.take(loose)]
            if len(loose):
                cuts = np.flatnonzero(np.diff(loose) != 1) + 1
                lows, ups = loose[np.concatenate([[0], cuts])], loose[np.concatenate([cuts - 1, [len(loose) - 1]])] + 1
                firsts.append(lows)
                units.append(np.array([unit((INNER, c), lambda: self.of_stretch(c)) for c in (text[low:up] for low, up in zip(lows.tolist(), ups.tolist(), strict=True))], np.int64))  # noqa: B023
        firsts, units = np.concatenate(firsts), np.concatenate(units)
        order = np.argsort(firsts, kind="stable")
        firsts, units = firsts.take(order), units.take(order)
        names: dict[str, int] = {}
        extra = []
        for terms in more:
            extra.append([self.names[t] if t in self.names else len(self.names) + names.setdefault(t, len(names)) for t in terms])
        counts = np.concatenate([self.counts, np.array([len(x) for x in extra], np.int64)])
        parts = np.concatenate([self.parts, np.array([k for x in extra for k in x], np.int32)])
        size = counts.take(units)
        start = (np.cumsum(counts) - counts).take(units)
        total = np.cumsum(size)
        terms = parts.take(np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size))
        tops = np.cumsum([len(x) + 1 for x in normal])
        docs = np.repeat(np.searchsorted(tops, firsts, "right"), size)
        return docs, terms, names

    def tally(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of each different term of a text the text's place, the term, and how often it occurs."""
        plain, sizes, named, counts, runs = [], [], [], [], []
        for k, text in enumerate(texts):
            normal = unicodedata.normalize("NFKC", text or "")
            if self.ascii or not normal.isascii() and self.inner.search(normal):
                runs.append(k)
                continue
            own: dict[str, int] = {}
            if normal.isascii():
                own = Counter(normal.translate(self.plain).split())
            else:
                for run, n in Counter(self.runs.findall(normal)).items():
                    if run.isalnum() or any(c.isalnum() for c in run):
                        term = run.lower()
                        own[term] = own.get(term, 0) + n
            plain.append(k)
            sizes.append(len(own))
            named += own.keys()
            counts += own.values()
        docs, shown, tf = np.repeat(np.array(plain, np.int64), sizes), pa.array(named, pa.string()), np.array(counts, np.int64)
        if runs:
            own, terms, more = self.tokens([texts[k] or "" for k in runs])
            names = [*self.names, *more]
            keys, n = counted(own * len(names) + terms)
            shown = pa.concat_arrays([shown, pa.array(names, pa.string()).take(pa.array(keys % max(len(names), 1)))])
            docs, tf = np.concatenate([docs, np.array(runs, np.int64).take(keys // max(len(names), 1))]), np.concatenate([tf, n])
        return docs, shown, tf

    def terms(self, texts: list[str | None]) -> list[list[str] | None]:
        """Terms of each text; null gives null."""
        out: list[list[str] | None] = []
        for some in portions([len(text or "") for text in texts]):
            held = texts[some]
            docs, terms, more = self.tokens([text or "" for text in held])
            names = [*self.names, *more]
            named = [names[k] for k in terms.tolist()]
            cuts = np.searchsorted(docs, np.arange(len(held) + 1)).tolist()
            out += [None if text is None else named[low:up] for text, (low, up) in zip(held, itertools.pairwise(cuts), strict=True)]
        return out


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in order, and how often each occurs."""
    keys = np.sort(keys)
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys.take(firsts), np.diff(firsts, append=len(keys))


def portions(sizes: list[int]) -> Iterator[slice]:
    """Rows whose texts are cut together: TOGETHER characters or a few more, a longer text with them."""
    start, size = 0, 0
    for k, own in enumerate(sizes, 1):
        size += own
        if size >= TOGETHER or k == len(sizes):
            yield slice(start, k)
            start, size = k, 0


def analyzer(model: Model, unspaced: str = UNSPACED) -> Callable[[Column | str], Column]:
    """A function from a text column to its terms, for retrieval's ``slide_terms`` and ``query_terms``."""
    cutter = Cutter(model, unspaced)

    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series(cutter.terms(texts.tolist()), dtype=object)

    return F.pandas_udf(terms, ArrayType(StringType()))


def text_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of batches (id, text) for as many rows as are cut together; the others stay in Arrow's buffers."""
    for batch in batches:
        for some in portions(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
            part = batch.slice(some.start, some.stop - some.start)
            yield part.column(0), part.column(1).to_pylist()


def term_counts(texts: DataFrame, model: Model, unspaced: str = UNSPACED) -> DataFrame:
    """Of texts (id, text) id, term and tf, row by row: an analyzer's terms, which never leave the worker one by one."""
    cutter, key = Cutter(model, unspaced), texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in text_parts(batches):
            docs, terms, tf = cutter.tally(held)
            yield pa.record_batch([ids.take(pa.array(docs)), terms, pa.array(tf)], names=[key, "term", "tf"])

    return texts.mapInArrow(run, StructType([texts.schema[key], StructField("term", StringType()), StructField("tf", LongType())]))


def wanted_counts(texts: DataFrame, wanted: dict[str, int], model: Model, unspaced: str = UNSPACED) -> DataFrame:
    """Of texts (id, text) what ``retrieval.counted`` gives for an analyzer's terms: how many there are, and numbers and counts of wanted ones."""
    cutter, key = Cutter(model, unspaced), texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([wanted.get(term, -1) for term in cutter.names], np.int64)
        for ids, held in text_parts(batches):
            docs, terms, more = cutter.tokens([text or "" for text in held])
            found = np.concatenate([own, np.array([wanted.get(term, -1) for term in more], np.int64)]).take(terms)
            met = np.flatnonzero(found >= 0)
            keys, tf = counted(docs.take(met) * len(wanted) + found.take(met))
            cuts = pa.array(np.searchsorted(keys, np.arange(len(held) + 1) * len(wanted)), pa.int32())
            size = pa.array(np.bincount(docs, minlength=len(held)), pa.int64(), mask=np.array([text is None for text in held]))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (keys % max(len(wanted), 1), tf)]
            yield pa.record_batch([ids, size, *lists], names=[key, "len", "at", "tf"])

    numbers = ArrayType(IntegerType())
    return texts.mapInArrow(run, StructType([texts.schema[key], StructField("len", LongType()), StructField("at", numbers), StructField("tf", numbers)]))
