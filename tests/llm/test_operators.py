"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import language_id, line_dedup, mixing, ngram_join, quality_model, quality_rules, tiff, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


def table(spark, rows):
    """Rows (doc_id, text, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(k, t, "en", s, len(t or ""), "size", "score") for k, t, s in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng, rows = random.Random(3), []
    base = [prose(rng, rng.choice([3, 5, 8, 60, 200, 400])) for _ in range(60)]
    for k, text in enumerate(base):
        rows.append((k, text, f"s{k % 7}"))
    for k in range(60, 160):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{k}"
        rows.append((k, " ".join(words), f"s{k % 7}"))
    rows += [(160, None, None), (161, "", "s1"), (162, " \t\n", None), (163, "One two", "s2"), (164, "one  TWO", "s3"), (None, base[5], "s1"), (5, base[5], "s5"), (165, prose(rng, 20_000), "s0"), (None, None, None)]
    return rows


def sets_of(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def components(rows):
    """(shingles, least id) of each row by comparing all pairs."""
    sets, parent = [sets_of(t) for _, t, _ in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _, _) in enumerate(rows):
        least[root(i)].append(k)
    name = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return [(k, len(sets[i]), name[root(i)] if sets[i] else k) for i, (k, _, _) in enumerate(rows)]


def test_jaccard_components_are_those_of_all_pairs(spark, corpus):
    got = ngram_join.ngram_components(table(spark, corpus)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(components(corpus))


def test_jaccard_keeps_one_of_each_group(spark, corpus):
    kept = ngram_join.one_of_each(table(spark, corpus)).collect()
    wordy = [r for r in kept if WORD.search(r.text or "")]
    assert {r.doc_id for r in wordy} == {c for (k, n, c) in components(corpus) if n}
    assert len(wordy) == len({r.doc_id for r in wordy})
    assert len(kept) - len(wordy) == sum(not WORD.search(t or "") for _, t, _ in corpus)


def test_jaccard_links_a_star_whose_leaves_are_unlike(spark):
    rng = random.Random(9)
    words = prose(rng, 150).split()
    rows = [(0, " ".join(words), "a")]
    for k in range(1, 40):
        own = list(words)
        own[(k * 7) % 140 + 3] = f"x{k}"
        own[(k * 31) % 140 + 5] = f"y{k}"
        rows.append((k, " ".join(own), "a"))
    got = ngram_join.ngram_components(table(spark, rows)).collect()
    want = {k: c for k, _, c in components(rows)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_finds_every_link(spark, corpus):
    rng = random.Random(4)
    words, near = prose(rng, 200).split(), []
    for k in range(300, 340):
        own = list(words)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(200)] = f"new{k}"
        near.append((k, " ".join(own), "s1"))
    rows = corpus + near
    sets = [sets_of(t) for _, t, _ in rows]
    linked = lambda x, y: bool(x and y) and 9 * len(x & y) >= 4 * (len(x) + len(y))
    want = Counter((k, sum(linked(x, y) for y in sets) - bool(x)) for (k, _, _), x in zip(rows, sets, strict=True))
    got = ngram_join.ngram_joined(table(spark, rows))
    assert Counter(map(tuple, got.select("doc_id", "n_links").collect())) == want
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == Counter(components(rows))
    different = list(set(sets))
    pairs = ngram_join.ngram_links(table(spark, rows)).select("a", "b").collect()
    assert len(set(pairs)) == len(pairs) == sum(linked(x, y) for i, x in enumerate(different) for y in different[:i])


def test_jaccard_links_of_groups_dealt_in_blocks(spark, monkeypatch):
    """Small blocks, so that lists, components and sets of many pairs are all dealt out."""
    for name, value in (("SETS", 8), ("LIST_ROWS", 16), ("SPREAD", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, rows = random.Random(14), []
    for group in range(2):
        words = prose(rng, 120 + 60 * group).split()
        for k in range(30):
            own = list(words)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"new{group}x{k}"
            rows.append((100 * group + k, " ".join(own), "a"))
    rows += [(k + 300, f"same start of all these texts and then {k} other words {k * 7} here", "b") for k in range(40)]
    sets = [sets_of(t) for _, t, _ in rows]
    linked = lambda x, y: 9 * len(x & y) >= 4 * (len(x) + len(y))
    got = ngram_join.ngram_joined(table(spark, rows)).select("doc_id", "n_links", "component_id").collect()
    want = {k: c for k, _, c in components(rows)}
    assert {tuple(r) for r in got} == {(k, sum(linked(x, y) for y in sets) - 1, want[k]) for (k, _, _), x in zip(rows, sets, strict=True)}


def test_jaccard_keys_that_clash():
    hashes, n = np.arange(1, 11, dtype=np.uint64), np.array([4, 6])
    k, k2 = ngram_join._folded(hashes, n, ngram_join._NONE)
    again, _ = ngram_join._folded(hashes, n, k[:1])
    assert list(again) == [k2[0], k[1]] and len({*k, *k2}) == 4


def test_jaccard_links_of_one_block_are_those_of_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(200, 301), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(40)]
    n = np.array([len(x) for x in sets])
    both = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    want = 9 * both >= 4 * (n[:, None] + n[None, :])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(40), n)
    assert (ngram_join.linked_sets(flat, owner, n, 15) == want[:15, 15:]).all()
    np.fill_diagonal(want, False)
    assert want.any() and not want.all() and (ngram_join.linked_sets(flat, owner, n, 40) == want).all()


def test_shingle_hashes_ignore_chunks_and_neighbours():
    texts = [b"", b"A b c d e f", b"x", b"a B c d e f  ", "é ü a b c d".encode(), b"one two three four"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together, owner = ngram_join.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, 5)
    for k, t in enumerate(texts):
        alone, _ = ngram_join.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 5)
        assert list(alone) == list(together[owner == k])
    assert list(together[owner == 1]) == list(together[owner == 3])


@pytest.mark.parametrize("operator", [ngram_join.ngram_components, line_dedup.dedup_lines, mixing.mix, mixing.mixed_documents, quality_rules.apply_rules, tiff.write_column])
def test_empty_tables(spark, operator):
    assert operator(table(spark, [])).count() == 0


def wanted_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while True:
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return out | share
        out |= {s: float(most * sizes[s]) for s in above}
        open_ -= above


def test_mixing_meets_targets(spark, corpus):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in corpus]
    by_source = defaultdict(int)
    for (_, _, s), n in zip(corpus, sizes, strict=True):
        by_source[s] += n
    want = wanted_targets(by_source)
    source = dict(((k, t), s) for k, t, s in corpus)
    rows = mixing.mix(table(spark, corpus), fan=8).collect()
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    sized = {s: (n, want[s]) for s, n in by_source.items()}
    for r in rows:
        key = next(s for s, (n, t) in sized.items() if n == r.source_size and abs(t - r.target) < 1e-6)
        taken[key] += r.taken
        largest[key] = max(largest[key], r["size"])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    again = mixing.mix(table(spark, corpus).repartition(5), fan=8).collect()
    key = lambda r: (str(r.doc_id), r.salt, r.row)
    assert sorted((key(r), r.copies) for r in rows) == sorted((key(r), r.copies) for r in again)
    assert mixing.mixed_documents(table(spark, corpus), fan=8).count() == sum(r.copies for r in rows)
    assert source


def test_mixing_misses_by_short_documents(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([5, 9, 20, 40, 300, 2500] if k % 3 else [3, 8])), f"s{k % 4}") for k in range(600)]
    rows.append((600, " ".join(["w"] * 9000), "s1"))
    taken, source = defaultdict(int), {k: s for k, _, s in rows}
    targets = {}
    for r in mixing.mix(table(spark, rows), fan=16).collect():
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 300 for s, t in targets.items()), (taken, targets)


def test_mixing_repeated_rows_share_copies(spark):
    rows = [(1, "a b c", "x")] * 50 + [(k, "d e f g", "y") for k in range(2, 8)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == 56
    copies = [r.copies for r in got if r.doc_id == 1]
    assert max(copies) - min(copies) <= 1
    assert mixing.mixed_documents(table(spark, rows)).count() == sum(r.copies for r in got)


def plain_dedup(rows, least):
    sites, first = defaultdict(set), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        for p, line in enumerate((rows[i][1] or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r")
            if key:
                sites[key].add(rows[i][2])
                first.setdefault(key, (i, p))
    out = []
    for i, (k, text, _) in enumerate(rows):
        if text is None:
            out.append((k, None, 0))
            continue
        lines = text.split("\n")
        gone = [p for p, x in enumerate(lines) if (key := x.strip(" \t\n\x0b\x0c\r")) and len(sites[key]) >= least and first[key] != (i, p)]
        out.append((k, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)))
    return out


def test_line_dedup_is_exact_near_its_threshold(spark):
    rng, rows = random.Random(5), []
    shared = [f"shared line {k}" for k in range(12)]
    for k in range(150):
        lines = [f"own {k} {j}" for j in range(rng.randrange(4))] + [shared[j] for j in range(12) if rng.random() < (j + 1) / 60]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), None if k % 9 == 0 else f"site{k % 8}"))
    rows += [(150, None, "site1"), (151, "", "site1"), (152, "\n \n", "site2"), (153, "  shared line 11\t\nshared line 11\nshared line 11", "site3"), (154, "\n".join(["x"] * 3000), "site4")]
    got = line_dedup.dedup_lines(table(spark, rows)).select("doc_id", "text", "n_removed").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain_dedup(rows, line_dedup.MIN_SITES)


def test_line_dedup_with_many_sites(spark):
    rows = [(k, f"everywhere\nown {k}", f"site{k}") for k in range(300)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == {0: "everywhere\nown 0"} | {k: f"own {k}" for k in range(1, 300)}


def plain_measures(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    spots = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots)


def test_quality_measures(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "a b c a b c", "x y\nx y\n\nx y ", "é ü z\x0bq #*", " wide space"]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 90))) for _ in range(60)] + [prose(rng, 5000), "1 " * 70, "word " * 60 + "9" * 20_000]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        r, want = got[k], plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_every_order_of_the_cascade_gives_one_verdict(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = None
    for order in (sorted, lambda x: sorted(x, reverse=True)):
        monkeypatch.setattr(quality_rules, "cascade_order", lambda seen, cost, order=order: order(cost))
        got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()}
        want = want or got
        assert got == want


def test_tiff_forms_and_errors(spark):
    pages = [np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8) for shape in ((1, 96), (70, 96), (33, 100))]
    for compression, tiled, predictor in [*tiff.FORMS, (tiff.PACKBITS, False, 2)]:
        for order in "<>":
            back = list(tiff.read(tiff.write(pages, compression, tiled, predictor, order)))
            assert all((p.pixels[..., 0] == q).all() for p, q in zip(back, pages, strict=True))
    for size in (0, 1, 4000, 300_000):
        for body in (bytes(size), random.Random(size).randbytes(size), (b"abc" * size)[:size]):
            assert tiff.unlzw(tiff.lzw(body), size) == body and tiff.unpackbits(tiff.packbits(body), size) == body
    # the example of the specification: codes 256 7 258 8 8 258 6 6 257
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])).hex() == "8001e0408044080c068080"
    broken = spark.createDataFrame([(1, b"II*\x00"), (2, None), (3, b"no"), (4, tiff.write(pages))], "doc_id long, media binary")
    rows = tiff.read_column(broken).collect()
    assert Counter((r.doc_id, r.page) for r in rows) == Counter([(1, -1), (3, -1), (4, 0), (4, 1), (4, 2)])


def test_cascade_counts_rejections_among_survivors():
    seen = [{"a": False, "b": False, "c": True}] * 6 + [{"a": True, "b": True, "c": False}] * 3 + [{"a": True, "b": True, "c": True}]
    assert quality_rules.cascade_order(seen, {"b": 1.0, "a": 0.9, "c": 1.0}) == ["a", "c", "b"]
    assert quality_rules.cascade_order([], {"b": 1.0, "a": 1.0, "c": 0.5}) == ["c", "a", "b"]


def test_tiff_digests_of_odd_media(spark):
    good = tiff.write([np.arange(96, dtype=np.uint8).reshape(1, 96)] * 2)
    huge = bytearray(tiff.write([np.zeros((1, 96), np.uint8)]))
    at = int.from_bytes(huge[4:8], "little")
    huge[at + 10 : at + 14] = (1 << 31).to_bytes(4, "little")
    rows = [(1, None), (2, good), (2, good), (3, good[: len(good) // 2]), (4, b""), (5, bytes(huge))]
    got = tiff.digest(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1), keep=("doc_id",)).collect()
    assert [(r.doc_id, r.payload_bytes, r.media_bytes, r.error is None) for r in got] == [(1, None, None, False), (2, 192, len(good), True), (2, 192, len(good), True), (3, None, len(good) // 2, False), (4, None, 0, False), (5, None, len(huge), False)]
    assert got[1].media_sha256 == hashlib.sha256(good).hexdigest() and got[1].feature.startswith("pages=2;size=96x2;mean=47.500;")
    assert tiff.digest(spark.createDataFrame([], "doc_id long, media binary"), keep=("doc_id",)).count() == 0


def test_clashing_columns(spark):
    """Names that operators use themselves, on columns that must come through."""
    odd = ["n_lines", "n_removed", "__own", "__gone", "__key", "__id", "__h", "__n", "k", "n"]
    docs = table(spark, [(k, f"same line\nown {k} words", f"s{k}") for k in range(8)] + [(9, None, None)]).withColumns({c: F.lit(f"mine {c}") for c in odd})
    mine = lambda df: all(r[c] == f"mine {c}" for r in df.collect() for c in odd)
    cleaned = line_dedup.dedup_lines(docs, names=("gone", "lines"))
    assert mine(cleaned) and cleaned.filter("text LIKE 'same%'").count() == 1
    assert {r.n_lines for r in line_dedup.dedup_lines(docs).collect()} == {0, 2}
    for df in (ngram_join.one_of_each(docs), mixing.mixed_documents(docs)):
        assert df.columns == docs.columns and df.count() > 0 and mine(df)


def test_tiff_digests(spark, corpus):
    for r in tiff.digest(tiff.write_column(table(spark, corpus).filter("doc_id IS NOT NULL"))).collect():
        text = next(t for k, t, _ in corpus if k == r.doc_id)
        body = (text or "").encode()
        want = body + b"\xff" * (576 * max(-(-len(body) // 576), 1) - len(body))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(4)
    bodies = [None, "", "<p>é</p>", "x" * 50_000] + [f"<html>{prose(rng, 30)}</html>" for _ in range(30)]
    rows = [(k, f"http://host{k % 3}.example/a b?{k}", bodies[k % len(bodies)]) for k in range(90)] + [(7, None, bodies[7]), (None, "u\r\n", bodies[3]), (None, "v", "only here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.write(pages, f"{tmp_path}/archive")
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for k, _, h in rows:
        by[h or ""].append(k)
    want = Counter()
    for k, _, h in rows:
        body, last = (h or "").encode(), max((x for x in by[h or ""] if x is not None), default=None)
        revisit = last is not None and k != last
        want[(k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    empty = warc.write(pages.filter("page_id < 0"), f"{tmp_path}/none")
    assert warc.read(spark, empty).count() == 0


def test_warc_frames_open_with_the_dictionary(spark, tmp_path):
    import zstandard

    pages = spark.range(200).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "concat('<html><body>common page text ', id, '</body></html>') AS html").coalesce(1)
    folder = warc.write(pages, f"{tmp_path}/archive")
    data = next(p.read_bytes() for p in __import__("pathlib").Path(folder).glob("part-*"))
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    kinds = Counter(re.search(rb"WARC-Type: (\w+)", r)[1] for r in warc.records(data))
    assert kinds == {b"warcinfo": 1, b"response": 200}
    assert warc.frame_end(f := zstandard.ZstdCompressor().compress(b"abc" * 90_000), 0) == len(f)


def test_warc_archives_are_bounded(spark, tmp_path):
    rng = random.Random(8)
    pages = spark.createDataFrame([(k, f"http://a/{k}", "".join(chr(rng.randrange(33, 126)) for _ in range(9_000 if k == 7 else 900))) for k in range(60)], "page_id long, url string, html string").coalesce(2)
    folder = warc.write(pages, f"{tmp_path}/archive", archive_bytes=5_000)
    files = [p.read_bytes() for p in __import__("pathlib").Path(folder).glob("part-*")]
    held = [list(warc.records(f)) for f in files]
    assert len(files) > 5 and sum(map(len, held)) == 60 + len(files)
    for data, own in zip(files, held, strict=True):
        size = int.from_bytes(data[4:8], "little")
        assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and b"WARC-Type: warcinfo" in own[0]
        assert len(data) - size < 5_000 + 500 or len(own) == 2
    assert sorted(r.page_id for r in warc.read(spark, folder).collect()) == list(range(60))


def test_warc_names_of_repeated_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a", "x"), (1, "u", "b", "x"), (2, "u", "b", "x")], "page_id long, url string, html string, sha1 string")
    folder = warc.write(pages, f"{tmp_path}/archive")
    raw = [r for p in __import__("pathlib").Path(folder).glob("part-*") for r in warc.records(p.read_bytes())]
    names = {re.search(rb"WARC-Record-ID: (\S+)", r)[1] for r in raw if b"warcinfo" not in r}
    refers = [m[1] for r in raw if (m := re.search(rb"WARC-Refers-To: (\S+)", r))]
    assert len(names) == 3 and len(refers) == 1 and refers[0] in names


def test_language_sample_has_rare_languages_and_ends_of_texts(spark):
    rows = [(k, "plain words " * 2 + "x" * 6000 + " the end", "big") for k in range(400)] + [(1000 + k, "rare", "few") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(language_id.trainable(F.col("doc_id")))
    got = language_id.sample(df, 4, 4_000).collect()
    assert Counter(r.lang for r in got) == {"big": 2, "few": 2}
    assert all(900 <= len(r.windows) <= 1_100 for r in got)
    big = [w for r in got if r.lang == "big" for w in r.windows]
    assert all(len(w) == language_id.WINDOW for w in big)
    assert any("plain" in w for w in big) and any("the" in w for w in big)
    assert sorted(got) == sorted(language_id.sample(df.repartition(5), 4, 4_000).collect())


def test_language_sample_orders_few_hashes_of_a_language_with_all_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("xx").alias("lang"))
    hashed = df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("h")).filter(language_id.trainable(F.col("doc_id"))).collect()
    hot = hashed[0].doc_id
    copies = spark.range(9_000).select(F.lit(hot).alias("doc_id"), F.lit("other text").alias("text"), F.lit("xx").alias("lang"))
    got = language_id.sample(df.unionByName(copies), 100, 1_000).collect()
    assert sorted(r.h for r in got) == sorted(r.h for r in hashed)[:100]
    assert sum(r.h / 2**53 * (len(hashed) + 9_000) < 400 for r in hashed) < 700


def test_language_of_odd_texts(spark):
    rng = random.Random(6)
    rows = []
    for k in range(240):
        alphabet, lang = (("abcde", "aa"), ("vwxyz", "zz"), ("éèçàù", "ff"))[k % 3]
        rows.append((k, " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 60))), lang))
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "aa"), (1003, "abc abd " * 4000, None), (None, "xyz zyx vwv", "zz")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    net = language_id.fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, net).collect()}
    assert len(got) == len(rows) + len(odd)
    assert [got[k] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "aa" and got[None][0] == "zz"
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k][0] == lang for k, lang in held]) > 0.95
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None and {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = language_id.train([b"abc" * 30, b"xyz" * 30], ["a", "z"], steps=1)
    for p in net.parameters():
        p *= 0.5
    x, y = rng.integers(0, 256, (12, 5)).astype(np.uint8), np.array([0, 1, 0, 1, 1])

    def loss():
        return -np.log(net.label(x)[:, np.arange(5), y]).mean()

    ahead = []
    up = net.read(x, 0, ahead)
    g = net.label(x)
    g[:, np.arange(5), y] -= 1
    g /= 60
    found = language_id._back(net, x, 0, ahead, g @ net.out[: language_id.HIDDEN].T)
    assert up.shape == (12, 5, language_id.HIDDEN)
    for grad, weights in ((found[1], net.gates[0]), (found[2], net.inner[0])):
        for spot in ((0, 0), (3, 5), (7, 2)):
            old = weights[spot]
            weights[spot] = old + 2e-2
            high = loss()
            weights[spot] = old - 2e-2
            low = loss()
            weights[spot] = old
            assert abs((high - low) / 4e-2 - grad[spot]) < 2e-3


def test_quality_without_enough_labels(spark):
    docs = table(spark, [(k, f"text {k}", "s") for k in range(20)])
    none = quality_model.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_model.score_quality(docs, none).collect()} == {0.5}
    ones = quality_model.fit(docs, spark.createDataFrame([(k, 1) for k in range(20)] + [(None, 0), (3, None)], "doc_id long, quality int"))
    assert {(r.score, r.predicted) for r in quality_model.score_quality(docs, ones).collect()} == {(1.0, 1)}


def test_quality_separates_held_out_documents(spark):
    rng, rows, labels = random.Random(2), [], []
    for k in range(400):
        good = k % 3 > 0
        text = prose(rng, rng.randrange(20, 200)).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in prose(rng, rng.randrange(20, 200)).split())
        rows.append((k, text, "s"))
        labels.append((k, int(good)))
    docs = table(spark, [*rows, (900, None, None), (901, "", "s")])
    model = quality_model.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality_model.score_quality(docs, model).collect()}
    held = [(k, q) for k, q in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].predicted == q for k, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_isotonic_pooling():
    values = quality_model.pooled(np.array([1, 1, 2, 1]), np.array([1, 0, 2, 0]))
    assert np.allclose(values, [0.5, 0.5, 2 / 3, 2 / 3])
