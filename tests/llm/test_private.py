"""Personal data: base spans and candidates against plain versions, with nulls, empty, long and awkward texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import private_spans as ps

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for at, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), at, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


AWKWARD = [
    None, "", " \n\t", "a@b.c", "a@b.c_d@e.f", "x.a@b.c.d@e.f", "a@b.c@d.e", "@b.c", "a@b", "a@b.", "%+-@a-b.c-d..e", "é@a.b é.x@y.z😀q@w.e", "a@b.c,d@e.f;g@h.i",
    "1.2.3.4.5.6.7.8", "1.2.3", "255.255.255.255 256.1.1.1 0001.00.000.0255 1.2.3.999999999999999999999", "1.2.3.4 4111 1111 1111 1111", "12.34.56.78.9",
    "4111111111111111", "4111-1111-1111-1111 4111 1111 1111 1112", "4111 1111 1111 1111 1", "0", "00", "0" * 12, "0" * 19, "0" * 20, "1 2 3 4 5 6 7 8 9 0 1 2 3", "4111  1111",
    "+1 (743) 555-3824", "+1 (743) 555-3824 +44 20 7946 0958", "++1 234 567 890", "+12", "+1-", "+1234567890123456", "+1 2 3 4 5 6 7 8 9", "+49 (0) 30.123456 ", "😀+1 (743) 555-3824😀 a@b.c",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "call (743) 555-3824 or jane.roe [at] mail [dot] org", "Dear Mrs. Sarah Connor,", "x" * 5_000 + "@" + "y" * 5_000 + ".de", "a." * 4_000 + "@" + "b." * 4_000 + "c",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    soup = [" ".join(rng.choice(["a@b.cc", "+1 (743) 555-3824", "4111111111111111", "8.8.8.8", "x", "5", "12-3", "\n", "+", "@", ".", "😀", "+49 30", "1.2", "token=ab12ab12ab12ab12ab12"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    glued = ["".join(rng.choice("0123456789 -+.@a(é") for _ in range(rng.randrange(80))) for _ in range(200)]
    many = " ".join(rng.choice(["8.8.4.4", "n@o.pq", "4111 1111 1111 1111,"]) for _ in range(3_000))
    return list(enumerate([*AWKWARD, *soup, *glued, many])) + [(None, "a@b.c"), (None, None), (3, "a@b.c"), (3, "a@b.c")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y", 1) for k, t in rows], "doc_id long, text string, found string, __email string, cell int").repartition(3)


def test_base_spans_are_those_of_the_patterns(table, rows):
    got = ps.find(table, keep=("doc_id", "text", "found", "__email", "cell")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["found"], r["__email"], r["cell"]) == ("x", "y", 1)
        want = base_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in ps.BASE]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in ps.BASE] == want
        places = [(int(a), ps.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert places == sorted(places) and r.n_added == len(spans) - len(want)
        added = [p for p in places if p[1] >= 4]
        for p in added:
            assert not any(q is not p and p[0] < q[2] and q[0] < p[2] for q in places), r.text
            assert 0 <= p[0] < p[2] <= len(r.text)


def test_candidates_of_each_kind(table):
    found = ps.candidates(table.filter(F.col("doc_id") < len(AWKWARD)), keep=("doc_id", "text")).collect()
    kinds = {(ps.KINDS[s.kind], r.text[s.start : s.end]) for r in found for s in r.spans if s.kind >= 4}
    assert {("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), ("local_phone", "(743) 555-3824"), ("masked_email", "jane.roe [at] mail [dot] org"), ("person", "Mrs. Sarah Connor"), ("number", "4111 1111 1111 1111 1")} <= kinds
    assert all(0 <= s.cell < ps.cells() for r in found for s in r.spans)


def test_candidates_see_their_context(spark):
    texts = ['my token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "state-of-the-art-language-models"]
    found = ps.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    votes = {r.doc_id: ps.digits_of(np.array([s.cell for s in r.spans]))[0].tolist() for r in found}
    assert votes[0][1:7] == [1, 1, 0, 0, 1, 1] and votes[1][1:7] == [1, 1, 0, 0, 2, 0] and votes[2][1:7] == [2, 2, 0, 0, 0, 0]
    assert votes[0][0] == 2 and votes[0][-1] == 0


def test_maximisation_is_that_of_plain_loops():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, ps.cells(), 60))
    x, n = ps.digits_of(cells), rng.integers(1, 50, len(cells)).astype(float)
    q, rates = ps.maximised(x, n, rounds=4)
    plain = [1.0 if r[-1] else 1 / (1 + math.exp(sum(v == 2 for v in r[1:7]) - sum(v == 1 for v in r[1:7]))) for r in x.tolist()]
    for _ in range(4):
        new = []
        for i, r in enumerate(x.tolist()):
            own = [j for j, s in enumerate(x.tolist()) if s[0] == r[0]]
            loose = [j for j in own if not x[j, -1]]
            prior = (sum(n[j] * plain[j] for j in loose) + 1) / (sum(n[j] for j in loose) + 2)
            yes, no = prior, 1 - prior
            for k in range(1, 7):
                same = [j for j in own if x[j, k] == r[k]]
                yes *= (sum(n[j] * plain[j] for j in same) + 1) / (sum(n[j] * plain[j] for j in own) + 3)
                no *= (sum(n[j] * (1 - plain[j]) for j in same) + 1) / (sum(n[j] * (1 - plain[j]) for j in own) + 3)
            new.append(1.0 if r[-1] else yes / (yes + no))
        plain = new
    assert q == pytest.approx(plain, abs=1e-9)
    assert rates.shape == (4, 6, 3, 2)


def test_regression_parts_what_labels_part():
    cells = np.arange(0, ps.cells(), 997)
    x = ps.digits_of(cells)
    q = (x[:, 2] == 1).astype(float)
    weights, intercept = ps.regressed(x, np.ones(len(x)), q)
    logit = intercept + sum(w[x[:, k]] for k, w in enumerate(weights))
    assert ((logit > 0) == (q == 1)).all()


def test_classifier_in_a_row_is_that_on_cells(spark):
    rng = np.random.default_rng(5)
    model = ps.Model([rng.normal(size=s).tolist() for s in ps.SIZES], 0.25, np.zeros(1))
    cells = rng.integers(0, ps.cells(), 200)
    got = spark.createDataFrame([(int(c),) for c in cells], "cell int").select("cell", model.logit(F.col("cell")).alias("z")).collect()
    x = ps.digits_of(np.array([r.cell for r in got]))
    assert [r.z for r in got] == pytest.approx((0.25 + sum(np.array(w)[x[:, k]] for k, w in enumerate(model.weights))).tolist())


def test_empty_table_and_clashing_names(spark, table):
    assert ps.find(table.limit(0)).count() == 0
    assert ps.find(spark.createDataFrame([(1, "no such thing")], "doc_id long, text string")).first().spans == ""
    for name in ("spans", "n_email"):
        with pytest.raises(ValueError, match=name):
            ps.find(table.withColumn(name, F.lit(1)), keep=("doc_id", name))
