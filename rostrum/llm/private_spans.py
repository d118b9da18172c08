r"""Personal data by weak supervision, in DataFrame operations only.

Base spans (email, ip, card, phone) are exact patterns with exact checks; they
always stay. Candidates beside them are wider: spelled-out addresses (masked_email),
phones without a plus (local_phone), other long numbers (number), keys and tokens
(secret) and names behind a title (person). Six labelers vote for, against or not
at all on each span: two regular expressions (shape, checksum and make-up), two
gazetteers (known issuers, codes, hosts and names; placeholders) and two of context
(words before it; signs around it).

Votes and a few features make a span's cell. Spans are counted by cell, and only
these counts, of at most ``cells()`` kinds whatever the corpus, reach the driver.
Expectation-maximisation estimates how each labeler votes on private and on other
spans of a family, with base spans held as private; logistic regression on votes
and features, with its posteriors as soft labels, is the final classifier, so it
also judges cells that no training table had. It is applied as a sum of looked-up
weights inside the row, so no text and no span is shuffled.

A pattern's matches are placed by lengths: of what lies between matches and of the
matches, summed in blocks, so a text with many spans takes little more than linear
time. Candidates never overlap a base span or an earlier kind of candidate.

Null texts are empty: no spans. Repeated rows give repeated results, an empty table
an empty one. Texts are searched whole. Positions are code points, ends exclusive.
Other columns than ``keep`` and the text are not read; ``keep`` may not hold the
names of the results (ValueError). Reruns give the same spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import checkpointed, documents, results_free

#: Kinds in the order in which spans that start together are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "masked_email", "local_phone", "number", "secret", "person")
BASE = KINDS[:4]
FAMILIES = ("mail", "number", "secret", "person")
FAMILY = {"email": 0, "masked_email": 0, "ip": 1, "card": 1, "phone": 1, "local_phone": 1, "number": 1, "secret": 2, "person": 3}

# Base patterns. Runs are possessive and start where they can't have started earlier
# (or where the last match ended), so that no text takes quadratic time; what they match is the same.
LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "masked_email": rf"(?<!{LOCAL}){LOCAL}++ ?[\[({{] ?(?:at|AT) ?[\])}}] ?[A-Za-z0-9-]++(?: ?(?:[\[({{] ?(?:dot|DOT) ?[\])}}]|\.) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+])\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
    "person": r"(?<!\p{L})(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra?|Señora?)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
#: What a text must hold for a pattern to be looked for at all.
NEEDS = {"email": "@", "phone": "+", "local_phone": "(", "masked_email": r"[\[({] ?(?:at|AT) ?[\])}]", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "secret": "[A-Za-z0-9+/_-]{20}", "person": r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra?|Señora?)\.? \p{Lu}"}
#: Code points before and after a span that context labelers see.
BEFORE, AFTER = 32, 12

# Gazetteers and context words of the four families.
ISSUERS, CALLING_CODES = "4|5[1-5]|3[47]|6011|65|35", "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
DOMAINS = "com|org|net|edu|gov|io|info|eu|de|fr|es|uk|ch|at|it|nl"
NAMES = "Anna|Anne|Antonio|Carlos|Carmen|Claude|David|Elena|Emma|Hans|Ines|Jan|Jean|John|José|Juan|Julia|Karl|Laura|Lucia|Luis|Maria|Marie|Martin|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sophie|Thomas"
KEY_STARTS = "AKIA|AIza|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|eyJ"
SAMPLES = ("example|sample|test@|foo@|localhost|domain\\.", "1234567|([0-9])\\1{6}", "example|sample|deadbeef|([0-9a-zA-Z])\\1{7}", "Doe$|Mustermann|Dupont$")
SPEAKS_FOR = (
    "e-?mail|contact|kontakt|correo|courriel|write to|reply|mailto",
    "phone|tel|call|fax|mobil|m[oó]vil|handy|whatsapp|sms|card|carte|karte|tarjeta|visa|account|konto|compte|cuenta|iban|\\bip\\b|ssn|passport",
    "token|secret|key|passw|pwd|auth|bearer|credential|api|schl[uü]ssel|clave|contrase|jeton",
    "dear|liebe|cher|estimad|signed|author|by|von|par|por",
)
SPEAKS_AGAINST = ("version|npm|git", "isbn|doi|order|version|page|figure|seite|fig\\.|build|total|price|sku", "commit|sha|checksum|hash|digest|md5|version|uuid|href|src", "street|avenue|rue|stra[sß]e|calle")

#: Values of each feature of a cell: family, six votes (none, for, against), length, share of digits, separators, an assignment before it; then whether it is a base span.
SIZES = (len(FAMILIES), *[3] * 6, 4, 4, 3, 2)
VOTES = slice(1, 7)
#: Rounds of expectation-maximisation; steps of the regression, their length and its ridge; the probability from which a candidate is a span.
ROUNDS, FIT_STEPS, RATE, RIDGE, THRESHOLD = 40, 1500, 0.3, 1e-3, 0.5
BLOCK = 256


def cells() -> int:
    """How many cells there can be."""
    return 2 * prod(SIZES)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _running(values: Column) -> Column:
    """Running sums of an integer array, in blocks: appending to an array copies it, so only short ones are appended to."""
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: F.slice(values, (b - 1) * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))
    grown = lambda array, start: F.aggregate(array, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    starts = grown(F.transform(blocks, _total), F.lit(0))
    return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda block, start: F.slice(grown(block, start), 2, F.lit(BLOCK))))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")


def _matches(df: DataFrame, text: Column, kind: str) -> DataFrame:
    """Adds ``__kind``: start, end, text and context of every match, in order. Context ends at the matches next to it."""
    pattern, out = F.lit(PATTERNS[kind]), f"__{kind}"
    there = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
    df = df.withColumn("__m", F.when(there, F.regexp_extract_all(text, pattern, F.lit(0))))
    df = df.withColumn("__p", F.when(F.size("__m") > 0, F.split(text, PATTERNS[kind], -1)))
    df = df.withColumn("__e", F.when(F.size("__m") > 0, F.zip_with(F.slice("__p", 1, F.size("__m")), "__m", lambda gap, m: F.char_length(gap) + F.char_length(m))))
    df = df.withColumn("__e", F.when(F.col("__e").isNotNull(), _running(F.col("__e"))))
    found = F.transform(
        F.arrays_zip("__m", "__e", F.slice("__p", 1, F.size("__m")).alias("b"), F.slice("__p", 2, F.size("__m")).alias("a")),
        lambda x: F.struct((x["__e"] - F.char_length(x["__m"])).alias("start"), x["__e"].alias("end"), x["__m"].alias("found"), F.right(x["b"], F.lit(BEFORE)).alias("before"), F.left(x["a"], F.lit(AFTER)).alias("after")),
    )
    return df.withColumn(out, F.when(F.size("__m") > 0, found).otherwise(_no_spans())).drop("__m", "__p", "__e")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    size = F.char_length(digits)
    at = lambda k: F.substring(digits, size - k + 1, F.lit(1)).cast("int")
    doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), lambda s, k: s + F.when(k % 2 == 0, doubled(at(k))).otherwise(at(k))) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        size = F.char_length(_digits(found))
        return F.when((size >= 12) & (size <= 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(found)).between(9, 15)
    return F.lit(True)


def _apart(span: Column, spans: Column) -> Column:
    """Whether a span overlaps none of these sorted, disjoint ones: of those that start before its end, the last must end before its start."""
    steps = F.lit([1 << k for k in range(23, -1, -1)])
    last = F.aggregate(F.filter(steps, lambda s: s <= F.size(spans)), F.lit(0), lambda at, s: F.when((at + s <= F.size(spans)) & (F.get(spans, at + s - 1)["start"] < span["end"]), at + s).otherwise(at))
    return F.coalesce(F.get(spans, last - 1)["end"] <= span["start"], F.lit(True))


def _vote(speaks_for: Column, against: Column) -> Column:
    return F.when(against, 2).when(speaks_for, 1).otherwise(0)


def _votes(kind: str, x: Column) -> list[Column]:
    """What the six labelers say of a span: 0 nothing, 1 for, 2 against."""
    family, found, before = FAMILY[kind], x["found"], F.lower(x["before"])
    if family == 0:
        shape = _vote(found.rlike(r"(?:\.|[dD][oO][tT]\W+)[A-Za-z]{2,24}$"), found.rlike(r"\.[0-9]+$"))
        check = _vote(F.char_length(found).between(6, 254), F.char_length(found) > 254)
        known, around = _vote(found.rlike(rf"\W(?:{DOMAINS})$"), F.lit(False)), _vote(before.rlike(r"[<:=(]\s*$"), before.rlike("/$"))
    elif family == 1:
        digits = _digits(found)
        shape = _vote(found.rlike(rf"^(?:[0-9]{{16}}|(?:[0-9]{{4}}[ -]){{3}}[0-9]{{4}}|\+?[0-9]{{0,3}} ?\(?[0-9]{{2,4}}\)?[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}|{OCTET}(?:\.{OCTET}){{3}})$"), found.rlike(r"^(?:[0-9]{1,2}[ -]){3}"))
        sized = F.char_length(digits).between(12, 19)
        if kind == "card":
            check = F.lit(1)
        else:
            check = _vote(F.lit(kind in BASE) | (F.char_length(digits).between(9, 11) & found.rlike("[ -]")), sized if kind == "number" else F.lit(False))
        known = _vote((F.char_length(digits).between(15, 16) & digits.rlike(f"^(?:{ISSUERS})")) | found.rlike(rf"^\+(?:{CALLING_CODES})"), F.lit(False))
        around = _vote(before.rlike(r"[:=#]\s*[\"']?$"), before.rlike(r"[\p{L}_/.,]$") | x["after"].rlike(r"^[\p{L}_/]|^\s?(?:%|€|\$|km|kg|cm|mm|usd|eur)"))
    elif family == 2:
        shape = _vote(found.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"), found.rlike("^[A-Za-z]+(?:[-_/+]+[A-Za-z]+)*$"))
        figures = F.char_length(_digits(found))
        check = _vote((figures >= 4) & (F.char_length(found) - figures >= 4), figures == 0)
        known, around = _vote(found.rlike(f"^(?:{KEY_STARTS})"), F.lit(False)), _vote(before.rlike(r"[:=]\s*[\"'`]?$"), before.rlike("[/.]$"))
    else:
        shape, check = _vote(found.rlike(r"\p{Ll} \p{Lu}\p{Ll}+$"), F.lit(False)), _vote(F.char_length(found).between(6, 40), F.char_length(found) > 60)
        known, around = _vote(found.rlike(rf"\b(?:{NAMES})\b"), F.lit(False)), F.lit(0)
    sample = _vote(F.lit(False), found.rlike(SAMPLES[family]))
    context = _vote(before.rlike(SPEAKS_FOR[family]), before.rlike(SPEAKS_AGAINST[family]))
    return [shape, check, known, sample, context, around]


def _cell(kind: str, x: Column) -> Column:
    """The number of a span's cell: family, votes, features and whether it is a base span, as digits of mixed base."""
    size, figures = F.char_length(x["found"]), F.char_length(_digits(x["found"]))
    separators = size - F.char_length(F.regexp_replace(x["found"], r"[ ().\-]", ""))
    features = [
        F.when(size < 8, 0).when(size < 16, 1).when(size < 32, 2).otherwise(3),
        F.when(figures == 0, 0).when(2 * figures < size, 1).when(figures < size, 2).otherwise(3),
        F.when(separators == 0, 0).when(separators <= 2, 1).otherwise(2),
        x["before"].rlike(r"[:=]\s*[\"'`]?$").cast("int"),
    ]
    out = F.lit(FAMILY[kind])
    for size, value in zip(SIZES[1:], [*_votes(kind, x), *features], strict=True):
        out = out * size + value
    return (out * 2 + int(kind in BASE)).cast("int")


def candidates(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and spans: start, kind (its place in KINDS), end and cell of base spans and candidates, ordered."""
    results_free(keep, "spans")
    df, text = df.select(F.struct(*keep).alias("__kept"), F.coalesce(text_col, F.lit("")).alias("__text")), F.col("__text")
    for kind in BASE:
        df = _matches(df, text, kind)
    long_number = lambda x: F.char_length(_digits(x["found"])).between(7, 19)
    missed = F.filter("__card", lambda x: ~_holds("card", x["found"]) & long_number(x))
    df = df.withColumn("__number", missed)
    df = df.withColumns({f"__{kind}": _kept(kind) for kind in BASE})
    earlier = list(BASE)
    for kind in ("masked_email", "local_phone", "secret", "person", "number"):
        df = df if kind == "number" else _matches(df, text, kind)
        df = df.withColumn(f"__{kind}", _away(kind, earlier))
        earlier.append(kind)
    df = df.drop("__text")
    parts = [F.transform(f"__{kind}", _described(kind, at)) for at, kind in enumerate(KINDS)]
    return df.select("__kept.*", F.sort_array(F.concat(*parts)).alias("spans"))


def _kept(kind: str) -> Column:
    return F.filter(f"__{kind}", lambda x: _holds(kind, x["found"]))


def _away(kind: str, earlier: list[str]) -> Column:
    """Candidates of a kind that overlap no span of these kinds."""
    out = F.col(f"__{kind}")
    for other in earlier:
        out = F.filter(out, _apart_from(other))
    return out


def _apart_from(kind: str):
    return lambda x: _apart(x, F.col(f"__{kind}"))


def _described(kind: str, at: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("kind"), x["end"].alias("end"), _cell(kind, x).alias("cell"))


@dataclass
class Model:
    """Weights of the final classifier by feature and value, its intercept, and how labelers vote: (family, labeler, vote, private or not)."""

    weights: list[list[float]]
    intercept: float
    votes: np.ndarray

    def logit(self, cell: Column) -> Column:
        out, scale = F.lit(self.intercept), 2
        for size, own in zip(reversed(SIZES), reversed(self.weights), strict=True):
            out = out + F.get(F.lit(own), (F.floor(cell / scale) % size).cast("int"))
            scale *= size
        return out


def digits_of(cell: np.ndarray) -> np.ndarray:
    """The features of cells, one column each, and in the last whether they are base spans."""
    out = []
    for size in (2, *reversed(SIZES)):
        out.append(cell % size)
        cell = cell // size
    return np.stack(out[::-1], 1)


def maximised(x: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each cell to be private, and the vote rates (family, labeler, vote, private).

    Within a family votes are independent given the truth. Base spans are private;
    the share of private spans is that of the other candidates.
    """
    votes, family, base = x[:, VOTES], x[:, 0], x[:, -1] == 1
    q = np.where(base, 1.0, 1 / (1 + np.exp(-((votes == 1).sum(1) - (votes == 2).sum(1)).astype(float))))
    rates = np.zeros((len(FAMILIES), votes.shape[1], 3, 2))
    for _ in range(rounds):
        weight = np.stack([n * (1 - q), n * q], 1)
        told = np.zeros((len(x), 2))
        for f in range(len(FAMILIES)):
            own = family == f
            loose = own & ~base
            prior = (weight[loose].sum(0) + 1) / (weight[loose].sum() + 2)
            told[own] = np.log(prior)
            for k in range(votes.shape[1]):
                for v in range(3):
                    rates[f, k, v] = weight[own & (votes[:, k] == v)].sum(0) + 1
                rates[f, k] /= rates[f, k].sum(0)
                told[own] += np.log(rates[f, k])[votes[own, k]]
        q = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(told[:, 0] - told[:, 1], -50, 50))))
    return q, rates


def regressed(x: np.ndarray, n: np.ndarray, q: np.ndarray, steps: int = FIT_STEPS) -> tuple[list[np.ndarray], float]:
    """Weights and intercept of a ridge logistic regression on the cells' features, with soft labels ``q``. Each family counts as one."""
    n, weights, intercept = n / np.bincount(x[:, 0], n)[x[:, 0]], [np.zeros(size) for size in SIZES], 0.0
    n = n / n.sum()
    for _ in range(steps):
        logit = intercept + sum(w[x[:, k]] for k, w in enumerate(weights))
        gap = n * (1 / (1 + np.exp(-logit)) - q)
        intercept -= RATE * gap.sum()
        weights = [w - RATE * (np.bincount(x[:, k], gap, len(w)) + RIDGE * w) for k, w in enumerate(weights)]
    return weights, float(intercept)


def fit(found: DataFrame) -> Model:
    """The classifier for spans as ``candidates`` gives them."""
    counted = found.select(F.explode("spans.cell").alias("cell")).groupBy("cell").count().collect()
    if not counted:
        return Model([[0.0] * size for size in SIZES], -1.0, np.zeros((len(FAMILIES), 6, 3, 2)))
    counted.sort()
    x, n = digits_of(np.array([r[0] for r in counted])), np.array([r[1] for r in counted], float)
    q, rates = maximised(x, n)
    weights, intercept = regressed(x, n, q)
    return Model([w.tolist() for w in weights], intercept, rates)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.lit(list(KINDS)), s["kind"]), s["start"], s["end"])), ",")


def decided(found: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, counts of base spans by kind, base_sha256, spans (as text) and n_added."""
    results_free(keep, *(f"n_{kind}" for kind in BASE), "base_sha256", "spans", "n_added")
    least = float(np.log(threshold / (1 - threshold)))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    every = F.filter("spans", lambda s: (s["kind"] < len(BASE)) | (model.logit(s["cell"]) >= least))
    out = found.select(F.struct(*keep).alias("__kept"), base.alias("__base"), every.alias("__every"))
    count = lambda at: F.size(F.filter("__base", lambda s: s["kind"] == at)).cast("long")
    counts = [count(at).alias(f"n_{kind}") for at, kind in enumerate(BASE)]
    return out.select("__kept.*", *counts, F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__every")).alias("spans"), (F.size("__every") - F.size("__base")).cast("long").alias("n_added"))


def find(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Base spans and those that the classifier, trained on this table, adds."""
    found = checkpointed(candidates(df, text_col, keep))
    return decided(found, fit(found), keep, threshold)


def op11_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
